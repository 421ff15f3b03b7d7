"""Periodic runs, exact top-k and conversation repair against brute force, with all the awkward rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import periodic_runs as periods
from parley.llm import queries, repair, top_k

SPACES = " \t\n\x0b\x0c\r"


def split_words(x):
    return (x or "").encode().split()


def brute_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda x: (x[0], x[2]))


def brute_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


@pytest.mark.parametrize("least,times", [(6, 4), (4, 2), (5, 3), (2, 2)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w, n = [], rng.randrange(60)
            while len(w) < n:
                u = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 6))]
                w += (u * rng.randrange(1, 7))[rng.randrange(len(u)) :] if rng.random() < 0.5 else [rng.randrange(3)]
            docs.append(w)
        got = periods.runs_of([np.array(w, np.int64) for w in docs], least, times)
        assert got == [brute_runs(w, least, times) for w in docs]


def test_maximal_pairs_give_one_run_for_a_long_repeat():
    assert periods.runs_of([np.zeros(5000, np.int64), np.arange(5000) % 9, np.zeros(0, np.int64), np.arange(50)]) == [[(0, 5000, 1)], [(0, 5000, 9)], [], []]


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        seq = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))] + [99]
        order, common = periods.suffix_order(np.array(seq), 3)
        same = lambda a, b: next(k for k in range(len(seq)) if a + k >= len(seq) or b + k >= len(seq) or seq[a + k] != seq[b + k])
        assert order.tolist() == sorted(order.tolist(), key=lambda i: seq[i:])
        assert {i for i in range(len(seq)) if any(i != j and same(i, j) >= 3 for j in range(len(seq)))} <= set(order.tolist())
        assert common.tolist()[1:] == [same(a, b) for a, b in zip(order, order[1:], strict=False)]


@pytest.fixture(scope="module")
def strange(spark):
    """Texts null, empty, of white space only, long, repeated; ids null and repeated; columns that clash."""
    rng = random.Random(5)
    texts = [None, "", SPACES, "a", "a " * 6, "a b " * 4, "a b " * 4 + "c", "x\x0by z " * 9, "No no " * 3, "é é é é é é", "w" * 100_000, "long " * 30_000, " ".join(rng.choice("ab") for _ in range(3000)), "p q r s\n" * 7 + "p q r t"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)] + [(3, "a"), (3, "b b b b b b b"), (None, None)] + [(100 + k, " ".join(rng.choice("abc") for _ in range(k))) for k in range(60)]
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "doc_id long, text string, words string, n int, runs string, start string").repartition(3)


def test_periodic_runs(strange, monkeypatch):
    monkeypatch.setattr(periods, "BLOCK_WORDS", 5000)
    monkeypatch.setattr(periods, "TABLE_WORDS", 10)
    want = []
    for r in strange.collect():
        w = split_words(r["text"])
        runs = brute_runs(w) if len(w) < 5000 else [(0, len(w), 1)]
        want.append((r["doc_id"], len(w), runs, brute_collapsed(w, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in periods.periodic_runs(strange).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(strange.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(strange, times=1)


def digest(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def brute_op11(doc_id, text):
    w = split_words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{m},{q}\n" for a, m, q in runs)), digest(brute_collapsed(w, runs)))


def test_op11(spark, sf_dir, strange, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(strange.filter("length(text) < 50000 OR text IS NULL").select("doc_id", "text"), allowMissingColumns=True)
    docs = docs.withColumn("a", F.lit("x")).withColumn("g", F.lit("y")).withColumn("p", F.lit("z"))  # names that the query uses
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in docs.collect() if len(split_words(r["text"])) <= 4000]
    want = sorted((brute_op11(r["doc_id"], r["text"]) for r in short), key=repr)
    long = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in short}
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] not in long), key=repr) == want
    assert sum(x[1] > 0 for x in want) > 10


def brute_top(queries_, rows, k=5):
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in queries_ if i is not None and v is not None}):
        dot = lambda c: sum(a * b for a, b in zip(v, c, strict=False))
        best = sorted((-dot(c), math.inf if j is None else j) for j, c in rows if c is not None and j != i)[:k]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,pivots", [(8192, 32), (7, 3), (40, 0)])
def test_top_k(spark, block, pivots):
    rng = random.Random(block)
    rows = [(i, [rng.randrange(-9, 10) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [3, 3, 3, 0, 0, 0]) for i in range(40)] + [rows[3], rows[3], (3, [9] * 6), (None, [8] * 6), (None, [8] * 6), (500, []), (501, None), (502, [5]), (503, [1] * 9), (504, [0] * 6), (550, [9] * 6), (550, [9] * 6), (550, [-9] * 6)]
    schema = "vec_id long, v array<long>, id string, block string, far string, norm string, n string"
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], schema).repartition(3)
    for k in (5, 1, 300):
        asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
        got = top_k.top_k(df.filter("vec_id % 50 = 0"), df, k, pivots, block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(asked, rows, k)
    assert top_k.top_k(df.limit(0), df).count() == top_k.top_k(df.limit(0), df.limit(0)).count() == 0
    assert top_k.top_k(df.filter("vec_id = 50"), df.filter("vec_id = 50")).count() == 0


def test_usable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001, 1.0]), (2, None), (3, [1.0, None]), (4, [nan]), (5, [-inf, 1.0]), (6, []), (7, [inf]), (None, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(((r["vec_id"], r["v"]) for r in top_k.usable(df).collect()), key=repr) == sorted([(1, [128, -1, 256]), (6, []), (None, [512])], key=repr)


def test_bounds_eliminate_and_stay_exact():
    """On clustered vectors few products are computed; large components fall back to whole numbers."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (20, 8))
    v = centres[rng.integers(0, 20, 3000)] + rng.integers(-4, 5, (3000, 8))
    pivots = top_k.choose_pivots(v[:500], 24)
    ids, q = np.arange(3000), v[:50]
    norms, far = top_k._distances(v, pivots)
    found, looked = top_k.best_in_block(q, ids[:50], np.full(50, -(1 << 60)), (norms[:50], far[:50]), v, ids, (norms, far), 5)
    products = q @ v.T
    for i in range(50):
        want = sorted(((-products[i, j], j) for j in range(3000) if j != i))[:5]
        assert [(s, r) for a, r, s in found if a == i] == [(-s, j) for s, j in want]
    assert looked < 0.6 * 50 * 3000
    big = rng.integers(-(1 << 28), 1 << 28, (30, 5))
    assert (top_k._products(big, big) == np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in big] for x in big])).all()


def brute_repair(rows):
    """rows: (turn, role, text) in order. Cheapest edits by dynamic programming over rows and states; strings are compared whole."""
    faults, heard = [], set()
    for _, role, text in rows:
        seen = text.strip(SPACES)
        faults.append("blank" if not seen else "duplicate" if (role, text) in heard else "truncated" if seen[-1] not in ".!?" else "")
        heard.add((role, text))
    put = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    ways = {0: (0, "", ())}

    def inserted(ways):
        for _ in range(3):
            new = dict(ways)
            for s, (c, a, t) in ways.items():
                role, to = put[s]
                new[to] = min(new.get(to, (math.inf,)), (c + 3, a + "I", (*t, f"{role}:")))
            ways = new
        return ways

    for (_, role, text), f in zip(rows, faults, strict=True):
        new = {}
        for s, (c, a, t) in inserted(ways).items():
            more = [(s, c + 4, "D", t)]
            if f in ("", "truncated"):
                extra = 3 if f else 0
                if (s, role[:1]) in keep:
                    more.append((keep[s, role[:1]], c + extra, "K", (*t, f"{role}:{text}")))
                r, to = put[s]
                if r != role:
                    more.append((to, c + 3 + extra, "R", (*t, f"{r}:{text}")))
            for to, cost, letter, said in more:
                new[to] = min(new.get(to, (math.inf,)), (cost, a + letter, said))
        ways = new
    cost, audit, said = min(w for s, w in inserted(ways).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest("\n".join(said)))


TEXTS = ["Hello.", "Yes!", "Why?", "no end", "", "  ", "Hello.", "end. \n", "é.", None]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None]


def talks(rng, n):
    return [(rng.choice([None, *range(8)]) if rng.random() < 0.3 else k, rng.choice(ROLES), rng.choice(TEXTS)) for k in range(n)]


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.mark.parametrize("block", [128, 3, 1])
def test_repair(spark, block):
    rng = random.Random(block)
    convs = {c: talks(rng, rng.randrange(1, 14)) for c in range(150)} | {None: talks(rng, 9), 1000: [(k, ["user", "assistant"][k % 2], f"t{k}" + "."[: k % 3]) for k in range(300)], 1001: [(0, "user", "")] * 5, 1002: [(0, "system", "x.")]}
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, n int, first string, again string").repartition(4)
    got = {r["conv_id"]: tuple(r[c] for c in repair.OUT) for r in repair.repair(df, block).collect()}
    assert got == {c: brute_repair(in_order(rs)) for c, rs in convs.items()}
    assert repair.repair(df.limit(0)).count() == 0


def test_search_gives_the_least_of_equal_audits():
    row = lambda role, fault="": repair.Row(role, "x.", fault)
    assert repair.cheapest([row("user")]) == (3, "KI") and repair.cheapest([row("assistant")]) == (3, "IK")
    assert repair.cheapest([row("system")]) == (4, "D") and repair.cheapest([row("user", "blank")]) == (4, "D")
    assert repair.cheapest([], 0, frozenset({0})) == (0, "") and repair.cheapest([], 3, frozenset({1})) is None
    assert repair.cheapest([row("user"), row("user")]) == (3, "KR")


def test_op13(spark, tmp_path):
    rng = random.Random(13)
    rows = [(c, *r) for c in range(400) for r in talks(rng, rng.randrange(1, 7))] + [(None, None, None, None), (None, 2, "user", "Hi.")]
    schema = "conv_id long, turn long, role string, text string, kind string, copy string"
    spark.createDataFrame([(*r, "k", "c") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {}
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind, own = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, convs.setdefault(conv, [])
        role, text = "user" if kind == 4 else space(role), "" if kind == 1 else space(text)
        text = "".join(x for x in text if x not in ".!?") if kind == 2 else text
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    empty = (0, 0, 0, 0, 0, 0, "", digest(""))
    got = {r["conv_id"]: tuple(r[c] for c in repair.OUT) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: brute_repair(in_order(rs)) if rs else empty for c, rs in convs.items()}
    assert empty in got.values()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_periodic_runs", "op12_exact_top_k", "op13_conversation_repair"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == 0
