"""The queries against their SQL, and the pipeline stage by stage against brute force."""

import pytest
from conftest import same_rows
from test_operators import brute_simhash, groups, lower, norm_words, split_words

import corpus_pipeline
from parley.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name]))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, sf_dir)
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    assert 0.5 * docs.count() < len(kept) < docs.count() and first.columns == corpus_pipeline.COLUMNS
    # Lines.
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in kept.items():
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    kept = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(h := holders[key(x)]) < 3 or i == max(h)) for i, t in kept.items()}
    # Near copies.
    fp = {i: brute_simhash(t) for i, t in kept.items()}
    ids = sorted(kept)
    comp = groups([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    # Benchmark passages.
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = norm_words(r["text"])
        windows |= {tuple(w[s : s + min(13, len(w))]) for s in range(max(len(w) - 12, 1)) if w}

    def clean(t):
        w = norm_words(t)
        hit = {p for n in {len(k) for k in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        return not hit or 20 * len(hit) < len(w)

    kept = {i: t for i, t in kept.items() if clean(t)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: len(split_words(t)) for i, t in kept.items()} == {i: r["size"] for i, r in got.items()}
    total = sum(r["size"] for r in got.values())
    assert sum(r["taken"] for r in got.values()) == pytest.approx(1.5 * total, rel=0.05) and all(r["taken"] <= 2 * r["size"] for r in got.values())


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, one doc_id with two texts, extra columns, empty tables."""
    d = "/root/testdata/sf0.001"
    (passage,) = next((r["text"],) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if len(norm_words(r["text"])) > 20)
    prose = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect() if r["text"] and 300 < len(r["text"]) < 2000][:3]
    rows = [(1, prose[0]), (1, prose[0]), (2, prose[0]), (3, prose[1]), (3, passage), (None, prose[0]), (None, prose[2]), (None, prose[2]), (4, None), (5, ""), (6, passage)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, r string, root string, bad string, id string"
    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, "x", "x", "x", "x", "x") for k, (i, t) in enumerate(rows)], schema)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == corpus_pipeline.COLUMNS and stage(spark, docs.limit(0), d).count() == 0, name
    assert pairs(corpus_pipeline.lines(spark, docs, d)) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert pairs(corpus_pipeline.near_copies(spark, docs, d)) == sorted([(1, prose[0]), (3, prose[1]), (3, passage), (None, prose[2]), (4, None)], key=repr)
    assert pairs(corpus_pipeline.benchmarks(spark, docs, d)) == sorted([x for x in rows if x[1] != passage], key=repr)
    got = corpus_pipeline.mix(spark, docs, d).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got) and corpus_pipeline.mix(spark, docs.limit(0), d).count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"] and corpus_pipeline.ORACLE_SQL is None
