"""Mixing sources to target weights over fixed-length blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import filled, shared_folder, stored

WEIGHTS = (3, 1, 2)
BLOCK_WORDS, SHARD_SLOTS = 64, 16384
#: Shards that one bucket of documents fills, about SHARD_SLOTS slots each.
BUCKET_SHARDS = 4
#: Tables of at most so many sources are broadcast (below 100 bytes a row); larger ones are shuffled.
BROADCAST_SOURCES = 100_000
SCALE, MOST = 1.5, 2.0
#: Blocks that a task holds before it hands them on.
FLUSH_BLOCKS = 4096
MIX = "slot long, source string, text string, parts array<struct<doc_id: {}, row: long, words: long>>, shard long"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, scale: float = SCALE, most: float = MOST) -> DataFrame:
    """Adds rank and target to (source, source_size): ``scale`` times all words shared by weight, at most ``most`` times a source.

    Stopping a source and resharing its excess until none is above ends where every source has
    min(most * size, level * weight); the level is read off the sources in the order in which
    they stop. One row per source, whatever the corpus.
    """
    place = W.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("rank", F.row_number().over(place) - 1).withColumn("weight", F.get(table, F.col("rank") % len(weights))).withColumn("limit", most * F.col("source_size"))
    by = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, onward = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("total", scale * F.sum("source_size").over(all_rows))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source, in that order, that the level does not fill sets it for all after it.
    s = s.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "rank", "level")))
    level = F.min("open").over(all_rows)["level"]
    return s.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "rank", "target")


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse: a Feistel network of four rounds, walked until it falls below n."""
    bits = np.uint64(max((max(n - 1, 1).bit_length() + 1) // 2, 1))
    mask, out, todo = (np.uint64(1) << bits) - np.uint64(1), i.astype(np.uint64), np.arange(len(i))

    def mixed(x: np.ndarray, r: int) -> np.ndarray:
        f = (x + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((f ^ (f >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(33)) & mask

    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            left, right = (right ^ mixed(left, r), left) if back else (right, left ^ mixed(right, r))
        out[todo] = left << bits | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    """A 64-bit key of several whole numbers."""
    x = 0
    for p in parts:
        x = ((x ^ (p & ((1 << 64) - 1))) * 0xD6E8FEB86659FD93 + 0xA0761D6478BD642F) % (1 << 64)
        x ^= x >> 29
    return x


def shard_counts(quota: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """(shards, sources): a multinomial draw of each shard's slots over what the sources still have to give.

    What a draw asks of a source beyond that goes to the others, so the columns add up to ``quota``.
    """
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), quota.astype(np.int64), []
    for n in sizes.tolist():
        if n:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            room = left - got
            got += np.clip(n - got.sum() - (np.cumsum(room) - room), 0, room)
        else:
            got = np.zeros_like(left)
        left = left - got
        out.append(got)
    return np.array(out).reshape(len(sizes), len(quota))


def _draws(buckets: DataFrame, shards: int, seed: int) -> DataFrame:
    """(bucket, plan): for each source of a bucket its blocks and quota, where its slots end in each shard, and what stands before them there."""
    plan = "array<struct<rank: long, blocks: long, quota: long, ends: array<long>, at: array<long>, sizes: array<long>>>"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plans = []
            for bucket, sources in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                quota = np.array([x["quota"] for x in sources])
                sizes = np.diff(quota.sum() * np.arange(shards + 1) // shards)
                n = shard_counts(quota, sizes, _key(seed, bucket))
                ends, at = np.cumsum(n, axis=0), np.cumsum(n, axis=1) - n
                plans.append([x | {"ends": ends[:, k].tolist(), "at": at[:, k].tolist(), "sizes": sizes.tolist()} for k, x in enumerate(sources)])
            inner = pa.list_(pa.int64())
            kind = pa.list_(pa.struct([("rank", pa.int64()), ("blocks", pa.int64()), ("quota", pa.int64()), ("ends", inner), ("at", inner), ("sizes", inner)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plans, kind)], ["bucket", "plan"])

    return buckets.mapInArrow(draw, f"bucket long, plan {plan}")


class _Packer:
    """Packs the documents of one source and bucket into blocks and deals each block to the slots that use it."""

    def __init__(self, bucket: int, rank: int, source: str | None, plan: dict, block_words: int, seed: int, doc_id: pa.DataType) -> None:
        self.bucket, self.rank, self.source, self.plan, self.block_words, self.seed = bucket, rank, source, plan, block_words, seed
        self.parts = pa.struct([("doc_id", doc_id), ("row", pa.int64()), ("words", pa.int64())])
        self.done, self.texts, self.made, self.ends = 0, [], [], [0]
        self.open: list[bytes] = []
        self.room = block_words

    def add(self, raw: bytes, doc_id, row: int) -> None:
        """A word keeps the white space after it, the first one also what stands before it."""
        space = _SPACE[np.frombuffer(raw, np.uint8)]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])).tolist()
        at, n, cuts = 0, len(starts), [0, *starts[1:], len(raw)]
        while at < n:
            take = min(self.room, n - at)
            self.open.append(raw[cuts[at] : cuts[at + take]])
            self.made.append({"doc_id": doc_id, "row": row, "words": take})
            at, self.room = at + take, self.room - take
            if not self.room:
                self.close()

    def close(self) -> None:
        if self.open:
            self.texts.append(b"\n".join(self.open))
            self.ends.append(len(self.made))
            self.open, self.room = [], self.block_words

    def flush(self) -> pa.RecordBatch:
        """A row for each use of the closed blocks."""
        p, shards = self.plan, len(self.plan["sizes"])
        block = np.arange(self.done, self.done + len(self.texts))
        uses, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for turn in range(-(-p["quota"] // max(p["blocks"], 1))):
            j = turn * p["blocks"] + permuted(block, p["blocks"], _key(self.seed, self.bucket, self.rank, turn), back=True)
            uses.append(np.flatnonzero(j < p["quota"]))
            slots.append(j[uses[-1]])
        use, j = np.concatenate(uses), np.concatenate(slots)
        ends, at = np.array([0, *p["ends"]]), np.array(p["at"])
        shard = np.searchsorted(ends[1:], j, side="right")
        slot = at[shard] + j - ends[shard]
        for g in np.unique(shard).tolist():
            slot[shard == g] = permuted(slot[shard == g], p["sizes"][g], _key(self.seed, self.bucket, g, -1))
        kept = self.ends[-1]
        parts = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.made[:kept], self.parts))
        texts = pa.array(self.texts, pa.binary()).cast(pa.string())
        out = [pa.array(slot), pa.array([self.source] * len(use), pa.string()), texts.take(pa.array(use)), parts.take(pa.array(use)), pa.array(self.bucket * shards + shard)]
        self.done, self.texts, self.made, self.ends = self.done + len(self.texts), [], self.made[kept:], [0]
        return pa.RecordBatch.from_arrays(out, ["slot", "source", "text", "parts", "shard"])


def _packed(docs: DataFrame, block_words: int, seed: int) -> DataFrame:
    """The slots of the mix; ``docs`` (bucket, rank, source, doc_id, row, text, plan) stands in order of bucket, rank and row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for b in batches:
            texts, plans = b.column(5).cast(pa.binary()), b.column(6)
            for i, (bucket, rank, source, doc_id, row) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                if packer is None or (packer.bucket, packer.rank) != (bucket, rank):
                    if packer is not None:
                        packer.close()
                        yield packer.flush()
                    packer = _Packer(bucket, rank, source, plans[i].as_py(), block_words, seed, b.schema.field(3).type)
                packer.add(texts[i].as_py(), doc_id, row)
                if len(packer.texts) >= FLUSH_BLOCKS:
                    yield packer.flush()
        if packer is not None:
            packer.close()
            yield packer.flush()

    return docs.select("bucket", "rank", "source", "doc_id", "row", "text", "plan").mapInArrow(run, MIX.format(kind))


def read_mix(docs: DataFrame, path: str) -> DataFrame:
    """The shards that ``mix_sources`` wrote for ``docs``: shard, slot, source, text, parts."""
    return docs.sparkSession.read.schema(MIX.format(dict(docs.dtypes)["doc_id"])).parquet(path)


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, bucket_shards: int = BUCKET_SHARDS, seed: int = 11, path: str | None = None) -> DataFrame:
    """Writes the mix to ``path`` and returns a row per row of ``docs``: doc_id, size, source_size, target, taken.

    The mix is a Parquet folder per output shard (``shard=N``), a row per slot in order: slot,
    source, text, and parts, the documents that the text came from with their words. ``read_mix``
    reads it; without ``path`` it goes to a new folder ``mix-*`` in the shared one. ``taken``
    is summed from the shards as read back. Texts keep their white space; where one document
    ends within a block and the next begins there is a line feed.

    Documents are dealt to buckets by a hash, each of which fills ``bucket_shards`` shards of about
    ``shard_slots`` slots, so the text goes through one exchange and a task writes whole shards.
    Within a bucket the words of each source, its documents in pseudorandom order, are packed into
    blocks of ``block_words``. A bucket gives as many slots to a source as its share of the target
    asks for, rounded so that all buckets together miss it by less than a block; each shard draws
    its counts per source from a multinomial over what is left of them; a source's slots map to
    blocks by index permutations, one for each time that its blocks are gone through, so no block
    is used more than twice; another permutation scatters the sources over a shard's slots.

    Reruns agree (fixed seed). Null or empty text has size 0 and is never taken; null is a source
    of its own, last in order. Rows repeated with one doc_id and one text share their places and
    take the mean of what those places take (rounded down). Without any words all targets and
    takes are 0. An empty table gives no rows; other columns are ignored.
    """
    spark, path = docs.sparkSession, path or f"{shared_folder(docs.sparkSession)}/mix-{uuid.uuid4().hex}"
    size = F.size(F.array_remove(F.split(filled(), r"[\x20\x09-\x0D]+"), "")).cast("long")
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = stored(keyed.select("doc_id", "source", "row", size.alias("size")))
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    n_sources, total = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()

    def ranked(df: DataFrame) -> DataFrame:
        """With rank, source_size and target of each row's source."""
        t = targets.withColumnRenamed("source", "s")
        return df.join(F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t, df["source"].eqNullSafe(t["s"])).drop("s")

    rows = ranked(rows)
    if not total:
        spark.createDataFrame([], MIX.format(dict(docs.dtypes)["doc_id"])).write.parquet(path)
        return rows.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    buckets = max(1, round(total / (block_words * shard_slots * bucket_shards)))
    bucket = F.pmod("row", F.lit(buckets))

    shares = rows.filter("size > 0").groupBy("rank", bucket.alias("bucket")).agg(F.ceil(F.sum("size") / block_words).alias("blocks"), (F.first("target") / F.first("source_size")).alias("ratio"))
    upto = F.sum("blocks").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    quota = F.round(F.col("ratio") * upto) - F.round(F.col("ratio") * (upto - F.col("blocks")))
    shares = shares.withColumn("quota", F.least(quota.cast("long"), (MOST * F.col("blocks")).cast("long")))
    plans = stored(_draws(shares.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("rank", "blocks", "quota")))), bucket_shards, seed))

    texts = ranked(keyed.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))).withColumn("bucket", bucket).drop("source_size", "target")
    own = F.get(F.filter("plan", lambda x: x["rank"] == F.col("rank")), F.lit(0))
    dealt = texts.join(plans, "bucket").withColumn("plan", own).repartition("bucket").sortWithinPartitions("bucket", "rank", "row", "doc_id")
    _packed(dealt, block_words, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)

    taken = read_mix(docs, path).select(F.inline("parts")).groupBy("doc_id", "row").agg(F.sum("words").alias("words"))
    copies = rows.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies"))
    taken = copies.join(taken, copies["doc_id"].eqNullSafe(taken["doc_id"]) & (copies["row"] == taken["row"]), "left")
    taken = taken.select(copies["doc_id"].alias("id"), copies["row"].alias("r"), F.floor(F.coalesce("words", F.lit(0)) / F.col("copies")).cast("long").alias("taken"))
    return rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r"))).select("doc_id", "size", "source_size", "target", "taken")
