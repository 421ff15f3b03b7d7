"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import filled, materialize

TOKEN = re.compile(r"[^\W\d_]+")
#: Bound of the fit: labelled rows read.
FIT_ROWS = 12_000
PRIOR, LEAST_Z, LEAST_ODDS, DRIFT = 0.5, 3.2, 1.5, 1.0
#: Deviations from which on a whole word's log-odds count against toxicity.
AGAINST_Z = 1.5
#: Share of clean rows, those with the best segments, that the law leaves out: labels err.
TRIM = 0.01
MEMO_WORDS = 300_000
PIECES = (4, 5, 6, 8)
#: Letters of a token; longer runs of letters, as in scripts without spaces, are dealt into tokens of so many.
UNIT = 40


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens: runs of letters, long ones in units that overlap so that each piece lies within one."""
    runs = [m.span() for m in TOKEN.finditer(text)]
    if all(b - a <= UNIT for a, b in runs):
        return runs
    return [(i, min(i + UNIT, b)) for a, b in runs for i in range(a, max(b - max(PIECES) + 1, a + 1), UNIT - max(PIECES) + 1)]


def tokens(text: str) -> list[str]:
    """The tokens of ``places`` in lower case, the ends of runs of letters marked by ^ and $."""
    out = []
    for w in TOKEN.findall(text):
        if len(w) <= UNIT:
            out.append(f"^{w.lower()}$")
        else:
            at = places(w)
            out.extend("^" * (a == 0) + w[a:b].lower() + "$" * (b == len(w)) for a, b in at)
    return out


def features(token: str) -> list[str]:
    """The token, and all its pieces of 4, 5, 6 and 8 characters, marked ends included."""
    return [token, *{token[i : i + k] for k in PIECES for i in range(len(token) - k + 1)}]


@dataclass
class ToxicModel:
    weights: dict[str, float]
    decay: float = 1.0  # lambda of the extreme-value law
    factor: float = 1.0  # its K
    slope: float = -1.0
    offset: float = 0.0

    def scorer(self):
        """A function from a text to the scores of its tokens. Words are looked up as they stand; only new ones are lower-cased and cut to pieces."""
        get = self.weights.get
        least = min(PIECES)
        heads = {f[:least] for f, w in self.weights.items() if w > 0}  # pieces are looked up only where one begins so

        def of(token: str) -> float:
            own = best = get(token, 0.0)
            for i in range(len(token) - least + 1):
                if token[i : i + least] in heads:
                    for k in PIECES:
                        if (w := get(token[i : i + k], 0.0)) > best:
                            best = w
            return best if best > 0 else min(own, 0.0) - DRIFT

        class Memo(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > MEMO_WORDS:
                    self.clear()
                self[word] = out = of(f"^{word.lower()}$")
                return out

        memo = Memo()

        def scores(text: str) -> np.ndarray:
            words = TOKEN.findall(text)
            if max(map(len, words), default=0) <= UNIT:
                return np.fromiter(map(memo.__getitem__, words), float, len(words))
            return np.array([x for w in words for x in ([memo[w]] if len(w) <= UNIT else map(of, tokens(w)))], float)

        return scores

    def surprise(self, best: float, n: int) -> float:
        """-ln of the number of segments this good that n clean tokens would show by chance."""
        return self.decay * best - math.log(self.factor * max(n, 1)) if best > 0 else -math.log(self.factor * max(n, 1)) - 1.0

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln of the chance that n clean tokens show as many segments as good as these.

        Segments of a surprise of x or more come by chance as a Poisson count of mean e^-x, and k of
        them with a chance of at most e^-kx / k!. Every k best significant segments are tried, each at
        a prior of 2^-k; one segment alone counts as its surprise.
        """
        each = sorted((self.surprise(s, n) for s in scores), reverse=True) or [self.surprise(0.0, n)]
        many = (k * x + math.lgamma(k + 1) - (k - 1) * math.log(2) for k, x in enumerate(each, 1) if x > 0)
        return max(each[0], max(many, default=each[0]))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(max(min(-(self.slope * evidence + self.offset), 60), -60)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass, disjoint and in order.

    A new positive run joins the segments before it while that raises the sum above what lies
    to their left. The list of candidates keeps left and right cumulative sums.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # start, end, sum before, sum after
    for i in positive.tolist():
        now = [i, i + 1, sums[i], sums[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= now[3]:
                stack.append([*now, j])
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(int(a), int(b), r - left) for a, b, left, r, _ in stack]


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _fit_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows that may be learned from, about ``limit`` of them, chosen by a hash of doc_id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~_held_out())
    share = min(1.0, limit / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(known, "doc_id")


def _document_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class with the feature, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            out = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "clean", "toxic"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[int(toxic == 1)].update({f for w in set(tokens(text)) for f in features(w)})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _log_odds(counts: DataFrame, n_clean: int, n_toxic: int) -> DataFrame:
    """Features whose log-odds between the classes, under a Dirichlet prior, stand out.

    Words and pieces count for a passage, whole words also against it. Each weight is the
    log-odds less one deviation. All such features are kept; the fitted rows bound their number.
    """
    t, c, p = F.col("toxic"), F.col("clean"), PRIOR
    odds = F.log((t + p) / (n_toxic + 2 * p - t - p + 1)) - F.log((c + p) / (n_clean + 2 * p - c - p + 1))
    out = counts.withColumns({"odds": odds, "spread": F.sqrt(1 / (t + p) + 1 / (c + p))})
    out = out.withColumns({"z": F.col("odds") / F.col("spread"), "weight": F.col("odds") - F.signum("odds") * F.col("spread")})
    speaks_for = (t > 2) & (F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_ODDS)
    return out.filter(speaks_for | ((F.col("z") <= -AGAINST_Z) & F.col("feature").rlike(r"^\^.*\$$"))).select("feature", "weight")


def _scored(docs: DataFrame, model: ToxicModel, keep: str) -> DataFrame:
    """(keep, n_tokens, best, evidence, score, spans): best segment per text, and all significant passages, placed by characters."""
    kind = dict(docs.dtypes)[keep]
    passages = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for b in batches:
            ns, bests, proofs, probs, spans = [], [], [], [], []
            for text in b.column(1).to_pylist():
                each = scores(text)
                n = len(each)
                found = segments(each)
                proof = model.evidence([s for _, _, s in found], n)
                ns.append(n)
                bests.append(max((s for _, _, s in found), default=0.0))
                proofs.append(proof)
                probs.append(model.probability(proof))
                found = [x for x in found if model.surprise(x[2], n) > 0]
                at = places(text) if found else []
                spans.append([{"start": at[i][0], "end": at[j - 1][1], "score": s} for i, j, s in found])
            out = [pa.array(ns, pa.int64()), *(pa.array(x, pa.float64()) for x in (bests, proofs, probs)), pa.array(spans, passages)]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], [keep, "n_tokens", "best", "evidence", "score", "spans"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {kind}, n_tokens long, best double, evidence double, score double, spans array<struct<start: long, end: long, score: double>>")


def _decay(scores: list[tuple[float, float]]) -> float:
    """The positive root of sum p e^(x s) = 1, by bisection; the scores' mean is below 0."""
    total = sum(p for _, p in scores) or 1.0
    f = lambda x: sum(p / total * math.exp(min(x * s, 700)) for s, p in scores) - 1
    if not any(s > 0 for s, _ in scores):
        return 1.0
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicModel:
    """Learn from at most about ``fit_rows`` labelled rows outside the held-out quarter."""
    rows = materialize(_fit_rows(docs, labels, fit_rows).select("text", "toxic"))
    sizes = {r["t"]: r["n"] for r in rows.groupBy((F.col("toxic") == 1).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicModel({}, slope=1.0, offset=-60.0 if not n_toxic else 60.0)
    model = ToxicModel({r["feature"]: r["weight"] for r in _log_odds(_document_counts(rows), n_clean, n_toxic).collect()})
    seen = [(r["toxic"] == 1, r["n_tokens"], r["best"]) for r in _scored(rows, model, "toxic").select("toxic", "n_tokens", "best").collect()]
    # Positive tokens per clean token give the law's decay; its factor is what the clean rows show.
    clean = sorted(((n, b) for t, n, b in seen if not t), key=lambda x: (x[1], x[0]))
    clean = clean[: len(clean) - int(TRIM * len(clean))]
    tokens = sum(n for n, _ in clean) + 1
    hits = Counter(round(b, 1) for _, b in clean if b > 0)
    model.decay = _decay([(-DRIFT, tokens - sum(hits.values())), *((s, k) for s, k in hits.items())])
    model.factor = max(min((sum(hits.values()) + 0.5) / tokens * math.exp(model.decay * min(hits, default=0.0)), 1.0), 1e-6)
    model.slope, model.offset = _platt([(r["evidence"], r["toxic"] == 1) for r in _scored(rows, model, "toxic").select("toxic", "evidence").collect()], n_toxic, n_clean)
    return model


def _platt(rows: list[tuple[float, bool]], n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Logistic regression on the surprise, with targets short of 0 and 1, by Newton steps."""
    x, y = np.array([a for a, _ in rows]), np.array([(n_toxic + 1) / (n_toxic + 2) if t else 1 / (n_clean + 2) for _, t in rows])
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + 1e-3 * w
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_passages, spans.

    Tokens are words, runs of more than 40 letters in units of 40 that overlap. A token's score is
    the strongest log-odds, under a Dirichlet prior, among the word and its pieces of 4, 5, 6 and 8
    characters; where none speaks for toxicity it is the word's own log-odds, if those speak
    against it, less a constant loss. Every maximal segment is found; spans holds
    those that chance would show less than once in a text of that length, as start, end (in
    characters, the end left out) and score, and n_passages counts them. The chance of so many
    segments so good, by the extreme-value law (``evidence``), calibrated on the labelled rows,
    is the score. Fitting
    reads a bounded, hash-chosen part of the labelled rows; scoring reads all texts whole.

    Null text counts as empty and gets the score of a text without toxic tokens. A doc_id with
    several labels is toxic if one says so; without labels of both classes all scores are one
    constant. Null doc_ids are never learned from and not held out. Repeated rows are scored
    alike; other columns are ignored.
    """
    rows = docs.select("doc_id", filled().alias("text"))
    model = fit_toxicity(rows, labels, fit_rows)
    out = _scored(rows, model, "doc_id")
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_passages"), "spans")
