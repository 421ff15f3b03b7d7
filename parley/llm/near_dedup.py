"""SimHash near-duplicates by deletion variants of fingerprint segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import discard, filled, stored
from parley.llm.components import components

MAX_BITS = 4
SHINGLE = 4
CHUNK = 1 << 16
#: Low bits of a key that hold the number of its signature.
TAG_BITS = 9
#: Components of so many fingerprints count as large: within a bucket their own pairs are never looked at.
LARGE = 16


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; without words it is zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \\x20\\x09-\\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[min(shingle, len(words)) - 1 :].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp): fp as a signed long, row the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(filled()), filled().alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def masks(segments: int) -> list[int]:
    """The bits that each signature keeps: ``segments`` - 4 whole segments and the next one with one bit deleted.

    With four differing bits in at least five segments there is always such a choice where the
    whole segments are alike and the next one differs by at most one bit.
    """
    cut = [64 * i // segments for i in range(segments + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    out = []
    for whole in combinations(range(segments), segments - 4):
        w = next(i % segments for i in range(whole[-1] + 1, whole[-1] + segments) if i % segments not in whole)
        out += [sum(bits[i] for i in whole) | (bits[w] & ~(1 << b)) for b in range(cut[w], cut[w + 1])]
    return out


def enough_segments(n: int) -> int:
    """The fewest segments whose signatures have as many bits as tell ``n`` fingerprints apart, so that strangers rarely meet."""
    return next((m for m in (5, 6) if min(x.bit_count() for x in masks(m)) >= math.log2(max(n, 1))), 7)


def _masks(segments: int) -> Column:
    return F.lit(np.array(masks(segments), np.uint64).view(np.int64))


def _variants(fps: DataFrame, segments: int, *more: str) -> DataFrame:
    """A row per signature: (fp, key), the key holding a hash of the bits kept and the signature's number."""
    rows = fps.select("fp", *more, F.posexplode(_masks(segments)).alias("tag", "mask"))
    key = F.shiftleft(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask"))), TAG_BITS).bitwiseOR(F.col("tag").cast("long"))
    return rows.select("fp", *more, key.alias("key"))


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _first_meeting(x: Column, key: Column, segments: int) -> Column:
    """True at the first of the signatures that two fingerprints with difference x share."""
    shared = F.transform(_masks(segments), lambda m: x.bitwiseAND(m) == 0)
    return F.array_position(shared, F.lit(True)) - 1 == key.bitwiseAND(F.lit((1 << TAG_BITS) - 1))


def link(fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """(fp, component) over the distinct ``fps``, none null: linked where at most ``max_bits`` bits differ.

    Signatures are one-wildcard variants of a segment together with whole segments before it;
    ``segments`` follows the count of fingerprints (five up to 2^24, then six or seven), so that
    a bucket holds few strangers whatever the corpus; all choices find the same pairs. First each bucket's
    least fingerprint is compared with all others of the bucket and what is linked becomes one
    component; that takes a row per member, however many near copies a bucket holds. What remains
    is links between components: in each bucket that still holds several, the members outside one
    large component are compared with all others by an equality join whose condition is the
    distance, each pair at one bucket only. No candidate is dropped.
    """
    if max_bits > 4:
        raise ValueError("these signatures find pairs of at most 4 differing bits")
    fps = stored(fps.select("fp"))
    segments = segments or enough_segments(fps.count())
    # As many tasks as a shuffle has, however small the fingerprints are before they turn into signatures.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _variants(fps.repartition(tasks, "fp"), segments)
    pivots = stored(keys.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("most")).filter("pivot < most").select(F.col("key").alias("k"), "pivot"))
    # Merge joins: what would be broadcast on small tables only is shuffled on all, and large buckets can be split.
    stars = keys.join(pivots.hint("merge"), (F.col("key") == F.col("k")) & (F.col("fp") != F.col("pivot")) & _near(F.col("fp"), F.col("pivot"), max_bits))
    stars = components(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    large = stored(stars.groupBy("component").count().filter(F.col("count") >= LARGE).select(F.col("component").alias("big")))
    stars = stars.join(large, F.col("component") == F.col("big"), "left")
    first = stored(fps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("c"), "big"))
    discard(pivots)

    keys = _variants(first.repartition(tasks, "fp"), segments, "c", "big")
    mixed = keys.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("big").alias("main")).filter("c0 < c1")
    mixed = stored(mixed.select(F.col("key").alias("k"), "main"))
    strangers = keys.join(mixed.hint("merge"), (F.col("key") == F.col("k")) & ~F.col("c").eqNullSafe(F.col("main")))
    strangers = stored(strangers.select("k", F.col("fp").alias("other"), F.col("c").alias("oc")))
    x = F.col("fp").bitwiseXOR(F.col("other"))
    pairs = keys.join(strangers.hint("merge"), (F.col("key") == F.col("k")) & (F.col("c") != F.col("oc")) & (F.bit_count(x) <= max_bits) & _first_meeting(x, F.col("key"), segments))
    merged = components(pairs.select(F.col("c").alias("a"), F.col("oc").alias("b")))
    discard(mixed)
    discard(strangers)
    return first.join(merged, F.col("c") == F.col("node"), "left").select("fp", F.coalesce("component", "c").alias("component"))


def near_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id reachable), row (hash of the text).

    Rows with equal fingerprints are one class from the start, so only distinct fingerprints are
    compared. Null and empty texts have fingerprint zero and link like any other. Rows repeated
    with one doc_id each get a row; a null doc_id gets its group's smallest id, or null if the
    group has none. An empty table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs))
    linked = stored(link(fps.select("fp").distinct(), max_bits))
    lowest = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(linked, "fp")
    roots = stored(lowest.groupBy("component").agg(F.min("low").alias("component_id")))
    ids = stored(linked.join(roots, "component").select("fp", "component_id"))
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row")
