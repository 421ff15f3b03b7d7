"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stored

#: Pivots of the table, besides the origin; rows they are chosen from; rows of a block; pairs whose bounds a task holds at once.
PIVOTS, SAMPLE, BLOCK, TILE = 32, 2048, 8192, 1 << 21
_NO_ID = (1 << 63) - 1
_SLACK = 1e-9


def usable(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x becomes floor(scale * x); vectors null or with a null, NaN or infinite component are left out."""
    x = F.col(column).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which changes no product and no distance."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _exact_in_floats(a: np.ndarray, b: np.ndarray) -> bool:
    top = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    return top[0] * top[1] * max(a.shape[1], b.shape[1], 1) < 1 << 53


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, as whole numbers: in floating point where that is exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    if _exact_in_floats(a, b):
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _distances(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms of the rows of ``v``, and their distances to the origin and to each pivot."""
    norms = np.einsum("ij,ij->i", v, v)
    squares = norms[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * _products(v, pivots)
    return norms, np.sqrt(np.maximum(np.hstack([norms[:, None], squares]), 0).astype(float))


def choose_pivots(v: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each as far as can be from those before it."""
    if not len(v):
        return v
    chosen, gap = [0], None
    while len(chosen) < min(n, len(v)):
        squares = ((v - v[chosen[-1]]) ** 2).sum(axis=1)
        gap = squares if gap is None else np.minimum(gap, squares)
        if gap.max() == 0:
            break
        chosen.append(int(gap.argmax()))
    return v[chosen]


def best_in_block(q: np.ndarray, own: np.ndarray, floors: np.ndarray, q_table: tuple, v: np.ndarray, ids: np.ndarray, table: tuple, k: int) -> tuple[list, int]:
    """((query, row, score) of the k best rows of a block for each query, products computed).

    A row's distance to a query is at least the greatest difference of their distances to one
    pivot, so its product is at most half of both squared norms less that bound's square. Rows
    are evaluated from the highest bound down, until the next bound is below the k-th score.
    """
    (q_norms, q_far), (norms, far) = q_table, table
    width = max(q.shape[1], v.shape[1])
    if _exact_in_floats(q, v):
        q, v = _widened(q, width).astype(float), _widened(v, width).astype(float)
    else:
        q, v = _widened(q, width), _widened(v, width)
    # Bounds in single precision, less what its rounding may have added.
    wrong = 4e-7 * float(q_far.max(initial=0) + far.max(initial=0))
    q_near, near = q_far.astype(np.float32), np.ascontiguousarray(far.astype(np.float32).T)
    out, looked = [], 0
    step_q = max(1, TILE // max(len(v), 1))
    for a in range(0, len(q), step_q):
        part = slice(a, a + step_q)
        low = np.zeros((len(q[part]), len(v)), np.float32)
        gap = np.empty_like(low)
        for p in range(len(near)):
            np.subtract(q_near[part, p, None], near[p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        for i in range(len(low)):
            bound = np.maximum(low[i].astype(float) - wrong, 0)
            high = (q_norms[a + i] + norms) * (0.5 + _SLACK) - bound * bound / 2 + 0.5  # rounded up
            alive = np.flatnonzero((high >= floors[a + i]) & (ids != own[a + i]))
            order = alive[np.argsort(-high[alive])]
            best, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 256
            while at < len(order) and (len(best) < k or high[order[at]] >= scores[-1]):
                new = order[at : at + step]
                best, scores = np.concatenate([best, new]), np.concatenate([scores, (v[new] @ q[a + i]).astype(np.int64)])
                if len(best) > 4 * k:  # only what reaches the k-th score can stay, ties included
                    reach = scores >= np.partition(scores, -k)[-k]
                    best, scores = best[reach], scores[reach]
                top = np.lexsort((ids[best], -scores))[:k]
                best, scores, at, step = best[top], scores[top], at + step, step * 2
            looked += min(at, len(order))
            out += [(a + i, int(r), int(s)) for r, s in zip(best, scores, strict=True)]
    return out, looked


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors(vec_id, v)`` with the greatest inner product for each row of ``queries``.

    Pivots are chosen from SAMPLE rows at most (those with the least hashes), each far from the
    others; every row gets its distances to all of them, written as the pivot table. Rows are
    dealt by hash to blocks of about ``block`` rows, and every query visits every block with the
    k-th score it has among the sample, which no row below can beat. A block gives its k best,
    and these are ranked. Nothing is approximate.

    Ties go to the smaller vec_id, null last. A query never meets rows of its own vec_id. Rows
    repeated with vec_id and vector are candidates each, and one query; queries of one vec_id
    with different vectors are answered each. Shorter vectors count as filled with zeros, empty
    ones have score 0. Null vectors, and queries with a null vec_id, take no part. Scores are exact while they fit a
    long. Fewer than k other rows: all of them. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.filter("v IS NOT NULL").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("id"), "v", F.least("n", F.lit(k)).cast("int").alias("n")))
    seen = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE).toArrow()
    sample, sample_ids = _matrix(seen.column("v")), seen.column("id").to_numpy()
    chosen = choose_pivots(sample, pivots)
    blocks = max(1, -(-rows.count() // block))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norms, far = _distances(_matrix(b.column(1)), chosen)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norms), pa.array([x.tobytes() for x in far], pa.binary())], ["id", "v", "n", "norm", "far"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                norms, far = _distances(q, chosen)
                scores = np.where(sample_ids[None, :] == ids[:, None], -_NO_ID, _products(q, sample))
                floors = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -_NO_ID)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norms), pa.array([x.tobytes() for x in far], pa.binary()), pa.array(floors)], ["id", "v", "norm", "far", "floor"])

    table = rows.mapInArrow(measured, "id long, v array<long>, n int, norm long, far binary")
    table = table.withColumns({"floor": F.lit(None).cast("long"), "block": F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")})
    wanted = queries.filter("v IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), "v").distinct()
    wanted = wanted.mapInArrow(asked, "id long, v array<long>, norm long, far binary, floor long").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = stored(table.unionByName(wanted.withColumn("n", F.lit(None).cast("int"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for b in batches:
            numbers = b.column("block").to_numpy()
            queried = b.column("floor").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (queried[1:] != queried[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                if numbers[i] != block:
                    block, parts, held = numbers[i], [], None
                part = pa.Table.from_batches([b.slice(i, j - i)])
                if not queried[i]:
                    parts.append(part)
                    continue
                if held is None:
                    if not parts:
                        continue
                    t = pa.concat_tables(parts)
                    held = _matrix(t.column("v")), t.column("id").to_numpy(), t.column("n").to_numpy(), _told(t)
                    parts = []
                v, ids, n, far = held
                q, own = _matrix(part.column("v")), part.column("id").to_numpy()
                found, _ = best_in_block(q, own, part.column("floor").to_numpy(), _told(part), v, ids, far, k)
                who, row, score = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
                keys = part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(keys[who]), pa.array(ids[row]), pa.array(n[row]), pa.array(score)], ["query_id", "key", "id", "n", "score"])

    # A block's rows come before the queries that visit it.
    dealt = both.withColumn("key", F.xxhash64("v")).repartition("block").sortWithinPartitions("block", F.col("floor").asc_nulls_first())
    found = dealt.mapInArrow(search, "query_id long, key long, id long, n int, score long")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("id", F.lit(_NO_ID)).alias("vec_id"), "score")


def _told(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    far = t.column("far").to_pylist()
    return t.column("norm").to_numpy(), np.frombuffer(b"".join(far), float).reshape(len(far), -1)
