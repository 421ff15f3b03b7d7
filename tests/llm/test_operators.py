"""The training-data operators against brute force, on small tables with all the awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import mixing, near_dedup, pii, quality, toxicity
from parley.llm.chat import ChatTemplate, format_chats, read_back
from parley.llm.components import components
from parley.llm.decontaminate import decontaminate
from parley.llm.exact_dedup import exact_dedup
from parley.llm.line_dedup import line_dedup
from parley.llm.mixing import mix_sources
from parley.llm.quality import score_quality
from parley.llm import substring_dedup as substring
from parley.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, key string, fp string, b string, words string, size string"
WORDS = ["alpha", "Beta", "gamma", "DELTA", "épsilon", "zeta", "Éta", "theta9", "io-ta", "k"]


def lower(x):
    return re.sub("[A-Z]", lambda m: m.group().lower(), x)


def split_words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage = sentence(rng, 70)
    bench = [(1, sentence(rng, 30)), (2, sentence(rng, 13)), (3, "Épsilon only-Four words"), (4, ""), (5, None), (6, sentence(rng, 20)), (6, "zq zw ze zr zt"), (None, "qa qb qc qd qe qf qg qh qi qj qk ql qm qn")]
    shared = "This common line is in many documents."
    docs = []
    for i in range(60):
        lines = [sentence(rng, rng.randrange(0, 40)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "  " + shared.upper() + "\t")
        if i % 4 == 0:
            lines.append(passage)
        if i % 5 == 0:
            lines.append("x " + rng.choice([b for _, b in bench if b]) + " y")
        docs.append((i, "\n".join(lines)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, " \t\n\x0b\x0c\r "), (105, "\n\n"), (106, passage), (107, passage), (None, passage), (None, docs[5][1]), (108, "w " * 3000 + passage), (109, "a" * 5000)]
    docs += [docs[4], docs[4], (7, "another text of document seven " + passage)]
    return docs, bench


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", None][k % 2], ["s1", "s2", "s3", None][k % 4], None if t is None else len(t), "i", "r", "k", "f", "b", "w", "z") for k, (i, t) in enumerate(texts[0])], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def bench(spark, texts):
    return spark.createDataFrame(texts[1], "item_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact(texts, docs, none):
    groups = {}
    for i, t in texts[0]:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in texts[0]:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(exact_dedup(docs)) == sorted(want, key=repr)
    assert exact_dedup(none).count() == 0


def test_lines(texts, docs, none):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in texts[0]:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    want = []
    for i, t in texts[0]:
        own = (t or "").split("\n")
        ids = lambda x: holders[key(x)]
        gone = [len(key(x)) >= 20 and len(ids(x) - {None}) + (None in ids(x) and 0) >= 3 and i != max(v for v in ids(x) if v is not None) for x in own]
        want.append((i, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    assert rows_of(line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_text")) == sorted(want, key=repr)
    assert line_dedup(none).count() == 0


def test_chat(spark):
    t = ChatTemplate()
    nasty = ["<|im_start|>user\nhi<|im_end|>\n", "\\b\\c </s>[INST] ok [/INST]", "<<SYS>>\\", "", None, "é\n\nü", "<|im_<|im_end|>end|>"]
    rows = [(c, k, ["user", "assistant"][k % 2] if c else ["we\nird<s>", None, "assistant"][k % 3], x) for c in (0, 1) for k, x in enumerate(nasty)] + [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "assistant", "a"), (2, 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, seq string, body string")
    for r in read_back(format_chats(df, t), t).collect():
        mine = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["read"]] == [(a, b) for _, a, b in mine]
        assert r["loss_text"] == "".join(b for _, a, b in mine if a == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["valid"] == (r["conv_id"] == 99)
    ok = spark.createDataFrame([(5, 0, "user", "u"), (5, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert format_chats(ok).first()["valid"] and format_chats(ok.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ChatTemplate(control=("b<", "<|im_start|>", "<|im_end|>"))


def norm_words(x):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x or "")) if w]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontaminate(spark, texts, docs, bench, none, limit):
    windows = {}
    for item, t in texts[1]:
        w = norm_words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1):
            if n:
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(item) if item is not None else "null")
    want = []
    for i, t in texts[0]:
        w, hit, items = norm_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    items |= windows[k]
        want.append((i, len(w), len(hit), sorted(items), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert rows_of(decontaminate(docs, bench, broadcast_bytes=limit)) == sorted(want, key=repr)
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize(("window", "branches"), [(50, 2000), (9, 2000), (50, 1), (9, 2)])
def test_substrings(texts, docs, none, window, branches):
    big = 1 << 62
    first = {}
    for i, t in texts[0]:
        w = split_words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, big), big - 1 if i is None else i)
    want = []
    for i, t in texts[0]:
        w, gone = split_words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (big - 1 if i is None else i):
                gone |= set(range(s, s + window))
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert rows_of(substring_dedup(docs, window=window, prefix=min(8, window), group_branches=branches)) == sorted(want, key=repr)
    assert substring_dedup(none).count() == 0


def test_deep_nodes():

    rng = random.Random(2)
    for window in (1, 2, 3, 7):
        slices = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(30))] for _ in range(12)]
        ids = np.array([rng.randrange(8) for _ in slices])
        low = {}
        for w, i in zip(slices, ids.tolist()):
            for s in range(len(w) - window + 1):
                low[tuple(w[s : s + window])] = min(low.get(tuple(w[s : s + window]), 99), i)
        want = [[s for s in range(len(w) - window + 1) if low[tuple(w[s : s + window])] < i] for w, i in zip(slices, ids.tolist())]
        assert [x.tolist() for x in substring.deep_nodes(slices, ids, window)] == want


def brute_simhash(x):
    w = split_words(lower(x or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_near(texts, docs, none):
    fp = [brute_simhash(t) for _, t in texts[0]]
    comp = groups([(a, b) for a, b in itertools.combinations(sorted(set(fp)), 2) if (a ^ b).bit_count() <= 4], set(fp))
    low = {}
    for (i, _), f in zip(texts[0], fp):
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], i), i)
    want = [(i, f"{f:016x}", low.get(comp[f])) for (i, _), f in zip(texts[0], fp)]
    assert rows_of(near_dedup.near_dedup(docs).drop("row")) == sorted(want, key=repr)
    assert near_dedup.near_dedup(none).count() == 0


def test_masks():
    """Any four bits leave a signature alike, and each signature leaves one bit of one segment out."""
    rng = random.Random(3)
    for m, bits in ((5, 24), (6, 30), (7, 35)):
        kept = near_dedup.masks(m)
        assert len(set(kept)) == len(kept) < 1 << near_dedup.TAG_BITS and min(x.bit_count() for x in kept) == bits
        for _ in range(3000):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & k == 0 for k in kept)
    assert [near_dedup.enough_segments(n) for n in (0, 1, 1 << 24, 1 << 25, 1 << 31)] == [5, 5, 5, 6, 7]


@pytest.mark.parametrize("segments", [None, 6, 7])
def test_links(spark, segments):
    """Chains and clouds of fingerprints: every pair within four bits is linked, none beyond."""
    rng = random.Random(5)
    f = set()
    for _ in range(40):
        x = b = rng.getrandbits(64)
        f.add(b)
        for _ in range(12):
            y = rng.choice([x, b])
            for i in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << i
            f.add(y)
            x = y
    cloud = [x ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)]
    f |= {*cloud, *(c ^ (0b1111 << 40) for c in cloud[:5]), *(c ^ (0b11111 << 30) for c in cloud[:5])}
    want = groups([(a, b) for a, b in itertools.combinations(sorted(f), 2) if (a ^ b).bit_count() <= 4], f)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = {r["fp"]: r["component"] for r in near_dedup.link(spark.createDataFrame([(signed(v),) for v in f], "fp long"), segments=segments).collect()}
    pack = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert pack({signed(k): v for k, v in want.items()}) == pack(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(x):
    out = set()
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(v) <= 255 for v in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.add((kind, m.start(), m.end()))
    return out


def test_pii(spark, none):
    rng = random.Random(4)
    parts = ["a@b.com", "x.y+z@h-1.example.org", "a@b.c._q@r.s", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49 30 1234567", "+1", "é", "card", "call (212) 555-0199 now", "who [at] host [dot] com", "@", "+((((", "5500005555555559", " ", "\n", "ü9", "...", "12 34-56"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(12)))) for i in range(300)] + [(900, None), (901, ""), (902, "a" * 20000 + "@"), (903, "1" * 20000), (904, "a@" + "b." * 5000 + "c"), (0, "repeat a@b.com"), (0, "repeat a@b.com"), (None, "n@b.com")]
    got = {}
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r["doc_id"], r["row"]), []).append(r)
    keys = {(r["doc_id"], r["h"]): r["text"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    for k, text in keys.items():
        spans = got.get(k, [])
        assert {(r["kind"], r["start"], r["end"]) for r in spans if r["base"]} == base_spans(text), text[:80]
        extra = [r for r in spans if not r["base"]]
        assert all(e["end"] <= o["start"] or o["end"] <= e["start"] for e in extra for o in spans if o is not e)
    assert pii.find_pii(none).count() == 0


def test_em():
    """Labelers that agree are trusted over one that answers at random."""
    patterns = [("card", 1, 1, s, 1, 50) for s in (-1, 0, 1)] + [("card", -1, -1, s, -1, 50) for s in (-1, 0, 1)]
    p, _, prior = pii.reliabilities(patterns)
    assert all(x > 0.95 for x in p[:3]) and all(x < 0.05 for x in p[3:]) and prior == pytest.approx(0.5, abs=0.05)


def water_fill(sizes, weights):
    total, target, left = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(2 * sizes[i] for i in range(len(sizes)) if i not in left)
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] > 2 * sizes[i] + 1e-9}
        if not over:
            return [share[i] if i in left else 2.0 * sizes[i] for i in range(len(sizes))]
        left -= over


def test_mixing(spark, texts, docs, none):
    a, b = mix_sources(docs), mix_sources(docs)
    assert rows_of(a) == rows_of(b)
    rows = [r.asDict() for r in a.collect()]
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(r["size"] for r in rows) == sorted(len(split_words(t)) for _, t in texts[0])
    order = ["s1", "s2", "s3", None]
    sizes = [sum(len(split_words(r["text"])) for r in docs.collect() if r["source"] == s) for s in order]
    want = dict(zip(sizes, water_fill(sizes, [3, 1, 2, 3])))
    assert {r["source_size"]: r["target"] for r in rows} == pytest.approx(want)
    for size, target in want.items():
        assert sum(r["taken"] for r in rows if r["source_size"] == size) == pytest.approx(target, abs=200)
    assert mix_sources(none).count() == 0
    assert mix_sources(docs.filter("text IS NULL OR text = ''")).filter("taken > 0").count() == 0


def test_mix_shards(spark, docs, tmp_path):
    """The mix holds the documents' own words, block by block, and taken is what it holds."""
    path = str(tmp_path / "mix")
    rows = mix_sources(docs, block_words=16, shard_slots=64, bucket_shards=3, path=path).collect()
    mix = mixing.read_mix(docs, path).collect()
    shards, held, own = {}, {}, {}
    for r in docs.collect():
        own.setdefault(r["doc_id"], []).append(r["text"] or "")
    for m in mix:
        shards.setdefault(m["shard"], []).append(m["slot"])
        words, at = split_words(m["text"]), 0
        assert 0 < len(words) <= 16 and len(words) == sum(p["words"] for p in m["parts"])
        for p in m["parts"]:
            piece = " ".join(words[at : at + p["words"]])
            assert any(f" {piece} " in f" {' '.join(split_words(t))} " for t in own[p["doc_id"]])
            at += p["words"]
            held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["words"]
        if len(m["parts"]) == 1:
            assert any(m["text"] in t for t in own[m["parts"][0]["doc_id"]])
    assert len(shards) > 5 and all(sorted(x) == list(range(len(x))) for x in shards.values())
    once = {r["doc_id"]: r["taken"] for r in rows if len(own[r["doc_id"]]) == 1}
    assert once == {i: held.get(i, 0) for i in once} and sum(once.values()) > 0


def test_permutations():

    for n in (1, 2, 3, 17, 64, 1000):
        got = mixing.permuted(np.arange(n), n, 12345)
        assert sorted(got.tolist()) == list(range(n)) and mixing.permuted(got, n, 12345, back=True).tolist() == list(range(n))


def test_shard_counts():

    for quota, sizes in (([5, 0, 7], [4, 4, 4]), ([1000, 3], [500, 503]), ([0], [0, 0]), ([2, 2], [0, 1, 3])):
        got = mixing.shard_counts(np.array(quota), np.array(sizes), 3)
        assert got.sum(axis=0).tolist() == quota and got.sum(axis=1).tolist() == sizes and got.min() >= 0


def test_segments():

    rng = random.Random(9)

    def brute(x):
        """Ruzzo and Tompa's definition: the best segment, then the same to its left and right."""
        best = max(((sum(x[a:b]), -a, -(b - a)) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[1], -best[1] - best[2]
        return brute(x[:a]) + [(a, b)] + [(b + p, b + q) for p, q in brute(x[b:])]

    for _ in range(200):
        x = [rng.uniform(-2, 1.5) for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(x))] == brute(x)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_many_passages(spark):
    """Separate passages add up, and each is returned with its place."""
    model = toxicity.ToxicModel({"^vile$": 3.0}, decay=1.0, factor=0.001, slope=1.0, offset=-4.0)
    gap = "mild words of no note at all " * 10
    long = (gap + "vile Vile ") * 12 + gap
    rows = spark.createDataFrame([(1, gap + "vile Vile " + gap), (2, long), (3, gap * 13)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity._scored(rows, model, "doc_id").collect()}
    assert got[2]["best"] == got[1]["best"] and got[2]["score"] > got[1]["score"] > got[3]["score"]
    assert [long[s["start"] : s["end"]] for s in got[2]["spans"]] == ["vile Vile"] * 12 and not got[3]["spans"]


def test_long_tokens(spark):
    """Every piece of a token of any length is scored and learned, in a unit that holds it whole."""
    rng = random.Random(4)
    for n in (*range(1, 130), 1000):
        w = "".join(rng.choice("abcdeféß中文") for _ in range(n))
        units, marked = toxicity.tokens(w), f"^{w}$"
        pieces = {marked[i : i + k] for k in (4, 5, 6, 8) for i in range(len(marked) - k + 1)}
        assert {f for u in units for f in toxicity.features(u)[1:]} == pieces and max(map(len, units)) <= 42
        assert len(units) == len(toxicity.places(w)) and (n > 40 or units == [marked])
    model = toxicity.ToxicModel({"毒毒毒毒": 5.0}, decay=1.0, factor=0.01, slope=1.0, offset=-2.0)
    texts = [(1, "字" * 500), (2, "字" * 300 + "毒毒毒毒" + "字" * 196), (3, "字" * 36 + "毒毒毒毒" + "字" * 460)]
    got = {r["doc_id"]: r for r in toxicity._scored(spark.createDataFrame(texts, "doc_id long, text string"), model, "doc_id").collect()}
    assert got[2]["score"] > 0.5 > got[1]["score"] and got[3]["score"] > 0.5 and got[1]["n_tokens"] == 15
    for i in (2, 3):
        assert any("毒毒毒毒" in texts[i - 1][1][s["start"] : s["end"]] for s in got[i]["spans"])


def test_scores_of_tokens(monkeypatch):
    """The score of each token of a text against all its features, also while the memo is cleared; a word seen again isn't cut to pieces again."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abABßΣİ毒") for _ in range(rng.choice([1, 3, 5, 9, 41, 60])))
    words = [word() for _ in range(300)]
    weights = {f: rng.choice([-1.0, 2.0, 3.5]) if f[0] == "^" else rng.choice([1.5, 2.5]) for w in words[:60] for t in toxicity.tokens(w) for f in rng.sample(toxicity.features(t), 1)}
    for memo in (toxicity.MEMO_WORDS, 5):
        monkeypatch.setattr(toxicity, "MEMO_WORDS", memo)
        scores = toxicity.ToxicModel(weights).scorer()
        for _ in range(200):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
            best = [(max(weights.get(f, 0.0) for f in toxicity.features(t)), weights.get(t, 0.0)) for t in toxicity.tokens(text)]
            assert scores(text).tolist() == [b if b > 0 else min(own, 0.0) - toxicity.DRIFT for b, own in best]


def test_toxicity(spark, docs, none):
    d = "/root/testdata/sf0.1"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score_toxicity(real, labels).join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.9
    assert sum(r["predicted"] for r in rows if not r["toxic"]) < 0.05 * len(rows)
    few = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 0), (5, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, few).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(none, few).count() == 0 and toxicity.score_toxicity(docs, few.limit(0)).count() == docs.count()


def test_co_training(spark):
    """The fit on Spark is that of the same sums over all pool rows in one array; held-out rows are ranked well."""

    d = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").filter("doc_id % 3 <> 0")
    model = quality.fit_quality(real.repartition(5), labels)
    y = {r["doc_id"]: r["quality"] for r in labels.filter("quality IS NOT NULL").collect()}
    rows = sorted((r for r in real.collect()), key=lambda r: r["doc_id"])
    half = lambda t: quality.text_view(t or "").astype(np.float32).astype(float)
    text, meta = np.array([half(r["text"]) for r in rows]), np.array([quality.metadata_view(r["lang"], r["source"], r["n_chars"]) for r in rows])
    own = np.array([r["doc_id"] in y for r in rows])
    aside = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows if r["doc_id"] in y])
    told = text[own], meta[own], np.array([float(y[r["doc_id"]]) for r in rows if r["doc_id"] in y])
    want = quality.co_train(*told, lambda views: quality.pool_sums(text[~own], meta[~own], views), held=aside)
    for a, b in ((model.text.weights, want.text.weights), (model.meta.weights, want.meta.weights)):
        assert np.allclose(a, b, atol=1e-6)
    alone = quality.co_train(*told, lambda views: 0 * quality.pool_sums(text[~own], meta[~own], views), held=aside)
    assert any(not np.allclose(a.weights, b.weights, atol=1e-4) for a, b in ((alone.meta, want.meta), (alone.text, want.text)))
    held = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").filter("doc_id % 3 = 0 AND quality IS NOT NULL").collect()}
    score = dict(zip([r["doc_id"] for r in rows], model.probabilities(text, meta)[2], strict=True))
    assert auc([(score[i], q) for i, q in held.items() if i in score]) > 0.95


def test_quality(spark, docs, none):
    d = "/root/testdata/sf0.1"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = score_quality(real, labels).join(labels, "doc_id").select("score", "quality", "keep").collect()
    assert auc([(r["score"], r["quality"]) for r in rows]) > 0.97
    assert sum(not r["keep"] for r in rows if r["quality"]) < 0.01 * len(rows)
    few = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, few).count() == docs.count() and score_quality(none, few).count() == 0
    assert score_quality(docs, few.limit(0)).filter(F.col("keep")).count() == docs.count()


def test_quality_of_a_very_long_word(spark):
    """One labelled text without spaces, and a labelled row repeated, change no other score by much; weights that aren't finite are an error."""
    d = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    plain = {r["doc_id"]: r["score"] for r in score_quality(real, labels).collect()}
    some = labels.filter("quality IS NOT NULL").join(real, "doc_id").orderBy("doc_id").first()
    more = spark.createDataFrame([(-1, "x" * 700_000, "en", None, 7)] + [(some["doc_id"], some["text"], some["lang"], some["source"], some["n_chars"])] * 50, "doc_id long, text string, lang string, source string, n_chars long")
    told = labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame([(-1, 0, 0)], "doc_id long, quality int, toxic int"))
    rows = score_quality(real.select(more.columns).union(more), told).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    gaps = [abs(r["score"] - plain[r["doc_id"]]) for r in rows if r["doc_id"] in plain]
    assert len(gaps) == len(plain) + 50 and sum(gaps) / len(gaps) < 0.01
    text, meta = np.random.default_rng(1).normal(size=(2, 40, 3))
    with pytest.raises(ValueError):
        quality.co_train(text, meta, np.arange(40) % 2.0, lambda views: np.full(2 * 2 * (1 + 4 + 16), np.inf))


def test_one_passage_between_own_neighbours(spark):
    """A passage in 3000 documents, each with its own words around it, loses all copies but the first, and the join of its windows can be split."""
    passage = [f"p{i}" for i in range(60)]
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("a"), F.col("id"), F.lit("x"), i)), F.lit(" ".join(passage)), F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("b"), F.col("id"), F.lit("x"), i))).alias("text"))
    out = substring_dedup(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out.collect()}
    assert got == {i: (180, 60 if i else 0) for i in range(3000)}


def test_components_of_a_hub(spark):
    hub = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(hub.union(spark.createDataFrame([(7000, 7001), (7002, 7001), (4999, 6000)], "a long, b long")))
    assert got.count() == 5000 + 3 + 1 and {r["node"]: r["component"] for r in got.filter("node >= 6000").collect()} == {6000: 0, 7000: 7000, 7001: 7000, 7002: 7000}
