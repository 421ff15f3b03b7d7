"""Personal data: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import filled, stored

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds. Possessive repeats and the look-behinds keep the leftmost
# matches and make long runs of one character class linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Shapes that only become spans when the classifier accepts them.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
# Gazetteers and context words, fixed values.
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
LEADS = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "credit", "pay", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "llama", "anruf", "appel"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "sha", "build", "section", "=")
CONTEXT = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: Column, x: Column) -> Column:
    """The checks after the pattern: parts of an address, digits and Luhn of a card, digits of a phone."""
    n = F.length(_digits(x))
    parts = F.transform(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) * 1000 + F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int"))
    return F.when(kind == "email", True).when(kind == "ip", F.forall(parts, lambda p: p <= 3255)).when(kind == "card", n.between(16, 19) & F.call_function("luhn_check", F.when(n.between(16, 19), _digits(x)).otherwise("0"))).otherwise(n.between(8, 15))


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, kind, wide, start, end, match, before, after) of all matches, base and wide."""
    text = F.col("text")
    has = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), "phone": F.contains(text, F.lit("+")),
        "email_wide": text.rlike(r"[(\[]at[)\]]"), "phone_wide": text.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    }
    gap = lambda g: F.struct(F.length(g).alias("n"), F.lower(F.right(g, F.lit(CONTEXT))).alias("tail"), F.left(g, F.lit(1)).alias("head"))

    def found(name: str, pattern: str, kind: str, wide: bool) -> Column:
        """The matches of one pattern, each with what stands around it; null where the text can't have any."""

        def spans(x: Column) -> Column:
            near = lambda i: F.get(x["gaps"], i)
            return F.transform(x["found"], lambda m, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("i"), m.alias("match"), near(i)["n"].alias("gap"), near(i)["tail"].alias("before"), near(i + 1)["head"].alias("after"),
            ))

        # Matches and gaps are bound to the variable of an outer transform, else Spark would find them anew for each match.
        bound = F.array(F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.transform(F.split("text", pattern, -1), gap).alias("gaps")))
        return F.when(has[name], F.get(F.transform(bound, spans), F.lit(0)))

    patterns = [*((k, p, k, False) for k, p in BASE.items()), *((f"{k}_wide", p, k, True) for k, p in WIDE.items())]
    matches = F.flatten(F.array_compact(F.array(*[found(*p) for p in patterns])))
    out = docs.select("doc_id", F.xxhash64("text").alias("row"), F.inline(matches))
    # A row repeated with one doc_id and one text gives its spans once.
    out = out.distinct()
    upto = W.partitionBy("doc_id", "row", "kind", "wide").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    return out.withColumn("start", F.col("end") - F.length("match")).drop("i", "gap")


def votes(spans: DataFrame) -> DataFrame:
    """Adds ``base`` and the votes (1, 0, -1) of the form, gazetteer, context and edge labelers."""
    kind, x = F.col("kind"), F.col("match")
    spans = spans.withColumn("valid", _valid(kind, x))
    digits = _digits(x)
    tld = F.element_at(F.split(F.regexp_replace(F.lower(x), r"[(\[]dot[)\]]| ", "."), r"\."), -1)
    gazetteer = (
        F.when(kind == "email", F.when(tld.isin(*TLDS), 1).otherwise(-1))
        .when(kind == "ip", F.when(x.rlike(r"^(?:0|10|127|192\.168)\."), -1).otherwise(0))
        .when(kind == "card", F.when(digits.rlike("^[3-6]"), 1).otherwise(-1))
        .otherwise(F.when(digits.rlike("555"), 0).when(digits.rlike("^1?[2-9]"), 1).otherwise(-1))
    )
    any_of = lambda ws: F.col("before").rlike("|".join(ws))
    lead = F.lit(False)
    for k, ws in LEADS.items():
        lead = F.when(kind == k, any_of(ws)).otherwise(lead)
    edge = F.when(F.col("before").rlike(r"[A-Za-z0-9_]$|[\"'=/]$") | F.col("after").rlike(r"^[A-Za-z0-9_\"'/]"), -1).otherwise(1)
    return spans.withColumns({
        "base": ~F.col("wide") & F.col("valid"),
        "v_form": F.when(F.col("wide"), 0).when(F.col("valid"), 1).otherwise(-1),
        "v_gazetteer": gazetteer,
        "v_context": F.when(lead, 1).when(any_of(AGAINST), -1).otherwise(0),
        "v_edge": edge,
    })


LABELERS = ("v_form", "v_gazetteer", "v_context", "v_edge")


def reliabilities(patterns: list[tuple], rounds: int = 25) -> tuple[list[float], dict, float]:
    """EM over distinct vote patterns (kind, votes..., count): truth probabilities, labelers' vote rates, prior."""
    n = len(LABELERS)
    p = [1 / (1 + math.exp(-sum(r[1 : 1 + n]))) for r in patterns]  # start: the majority
    rates, prior = {}, 0.5
    for _ in range(rounds):
        total = sum(r[-1] for r in patterns) or 1
        prior = min(max(sum(q * r[-1] for q, r in zip(p, patterns, strict=True)) / total, 1e-3), 1 - 1e-3)
        for j in range(n):
            for y in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for q, r in zip(p, patterns, strict=True):
                    mass[r[1 + j]] += (q if y else 1 - q) * r[-1]
                rates |= {(j, y, v): m / sum(mass.values()) for v, m in mass.items()}
        log = [math.log(prior / (1 - prior)) + sum(math.log(rates[j, 1, r[1 + j]] / rates[j, 0, r[1 + j]]) for j in range(n)) for r in patterns]
        p = [1 / (1 + math.exp(-max(min(x, 30), -30))) for x in log]
    return p, rates, prior


def fit_classifier(patterns: list[tuple], truth: list[float], steps: int = 300) -> list[float]:
    """Logistic regression of the truth probabilities on kinds and votes, by gradient steps over the patterns."""
    feature = lambda r: [float(r[0] == k) for k in KINDS] + [float(v == s) for v in r[1 : 1 + len(LABELERS)] for s in (-1, 1)]
    xs, total = [feature(r) for r in patterns], sum(r[-1] for r in patterns) or 1
    w = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    for _ in range(steps):
        grad = [1e-4 * a for a in w]
        for x, q, r in zip(xs, truth, patterns, strict=True):
            off = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - q) * r[-1] / total
            for i, b in enumerate(x):
                grad[i] += off * b
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def find_pii(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """One row per span: doc_id, row (hash of its text), kind, start, end (code points), base, p.

    Candidates are the matches of the base patterns and of wider shapes. Four labelers vote on
    each: form (pattern and checks), gazetteer, context words before it, and edges. EM over the
    distinct vote patterns, at most kinds x 3^labelers rows whatever the corpus, estimates how
    often each labeler is right; the posteriors train the span classifier. Base spans always
    stay; a wide match joins them from ``accept`` on if it overlaps no other span. The texts are
    read once: the candidates are stored and all that follows works on them.

    Null text is empty; rows repeated with one doc_id and one text give their spans once; without
    candidates nothing is fitted and no row comes out. Other columns are ignored.
    """
    spans = stored(votes(candidates(docs.select("doc_id", filled().alias("text")))))
    table = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS).collect()
    patterns = [tuple(r) for r in table]
    truth, _, _ = reliabilities(patterns)
    w = fit_classifier(patterns, truth)
    z = sum((F.lit(w[i]) * (F.col("kind") == k).cast("double") for i, k in enumerate(KINDS)), F.lit(0.0))
    for j, name in enumerate(LABELERS):
        for s, sign in enumerate((-1, 1)):
            z = z + F.lit(w[len(KINDS) + 2 * j + s]) * (F.col(name) == sign).cast("double")
    spans = spans.withColumn("p", 1 / (1 + F.exp(-z))).filter(F.col("base") | (F.col("wide") & (F.col("p") >= accept)))
    order = W.partitionBy("doc_id", "row").orderBy("start", "end", "wide", "kind")
    before, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    apart = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(behind) >= F.col("end"), F.lit(True))
    return spans.withColumn("apart", apart).filter(F.col("base") | F.col("apart")).select("doc_id", "row", "kind", "start", "end", "base", "p")
