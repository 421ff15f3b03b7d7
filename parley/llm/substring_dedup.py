"""Long passages that repeat across documents: suffixes split by prefix, a suffix array for each prefix, and the internal nodes at the depth of a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import discard, filled, stored

WINDOW, PREFIX = 50, 8
#: Words a task works on at once, and words in its table of word hashes before that starts anew.
BLOCK_WORDS, TABLE_WORDS = 500_000, 500_000
#: Groups of more branches than this are split by a longer prefix; words whose trees a task builds at once.
GROUP_BRANCHES, TREE_WORDS = 2_000, 300_000
_POS = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2^64
_LAST = (1 << 63) - 1


class _Hashes(dict):
    """word -> 128-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > TABLE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh128_digest(word, 42)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two independent 64-bit hashes of each word, a column each."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Rolling:
    """Hashes of any stretch of a sequence of word hashes: polynomials modulo 2^64."""

    def __init__(self, hashes: np.ndarray, base: int) -> None:
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(base, n), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    out, step = x, 1
    while 2 * step <= n:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = n - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def prefixes(hashes: np.ndarray, doc: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share one prefix: (first window, last window, prefix hash, two hashes of the run's words).

    ``hashes`` holds the words of several documents one after another, ``doc`` the number of each
    word's document. A window's prefix is its least ``prefix``-gram, the leftmost among equals, so equal windows have equal
    prefixes at equal offsets, wherever they stand. A run's hash covers all its words and how
    its windows lie around the prefix.
    """
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    rolls = [_Rolling(hashes[:, k], b) for k, b in enumerate(_BASES)]
    at = np.arange(len(hashes) - prefix + 1)
    grams = rolls[0].of(at, at + prefix)
    least = _slide_min((grams & ~_POS) | at.astype(np.uint64), window - prefix + 1) & _POS
    starts = np.flatnonzero(doc[window - 1 :] == doc[: len(doc) - window + 1])
    if not len(starts):
        return prefixes(hashes[:0], doc, window, prefix)
    spot = least[starts].astype(np.int64)
    # Another prefix, or a window that is not the next one, begins a run; windows across documents are left out.
    new = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last, spot = starts[new], starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])], spot[new]
    shape = _mix(((spot - first) * 4096 + (last - first)).astype(np.uint64))
    return first, last, grams[spot], *((r.of(first, last + window) ^ shape) for r in rolls)


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first text, words of each text) for stretches of about BLOCK_WORDS words."""
    begin, block, n = 0, [], 0
    for i, text in enumerate(texts):
        block.append(text.encode("utf-8", "surrogatepass").split())  # bytes: splits at \\x20\\x09-\\x0D only
        n += len(block[-1])
        if n >= BLOCK_WORDS:
            yield begin, block
            begin, block, n = i + 1, [], 0
    yield begin, block


def _pieces(words: list[list[bytes]], table: _Hashes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, document of each word, position of each word in its document), at most 2^24 words at once.

    A text beyond that is dealt in stretches that overlap by a window less one word.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    hashes = table.of([x for w in words for x in w])
    doc = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    step = int(_POS) - window
    for i in range(0, max(len(hashes) - window + 1, 1), step):
        part = slice(i, i + step + window - 1)
        yield hashes[part], doc[part], pos[part]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(id, row, a, b, g, r1, r2): the windows a..b of a document share the prefix g; r1, r2: 128 bits of what the run holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for batch in batches:
            ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for begin, words in _blocks(batch.column(2).to_pylist()):
                for hashes, doc, pos in _pieces(words, table, window):
                    first, last, g, r1, r2 = prefixes(hashes, doc, window, prefix)
                    if len(first):
                        own, places = begin + doc[first], (pa.array(pos[x].astype(np.int32)) for x in (first, last))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(rows[own]), *places, *map(_signed, (g, r1, r2))], ["id", "row", "a", "b", "g", "r1", "r2"])

    return docs.select("id", "row", "text").mapInArrow(run, "id long, row long, a int, b int, g long, r1 long, r2 long")


def _slices(docs: DataFrame, window: int) -> DataFrame:
    """(g, r1, r2, id, text): the words of the runs that ``todo`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                words, doc = batch.column(3)[i].as_py().encode("utf-8", "surrogatepass").split(), batch.column(1)[i].as_py()
                for x in batch.column(4)[i].as_py():
                    text = b" ".join(words[x["a"] : x["b"] + window]).decode("utf-8", "surrogatepass")
                    for column, v in zip(out, (x["g"], x["r1"], x["r2"], doc, text), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], ["g", "r1", "r2", "id", "text"])

    # doc_id is only asked for so that this use of the documents and the last one share an exchange.
    return docs.select("doc_id", "id", "row", "text", "todo").mapInArrow(run, "g long, r1 long, r2 long, id long, text string")


def deep_nodes(slices: list[list[bytes]], ids: np.ndarray, window: int) -> list[np.ndarray]:
    """For each slice, the windows whose words also start a window of a smaller id, by the suffix array of all slices.

    Suffixes are sorted by ranks of doubled lengths up to ``window`` words; those with one rank
    hang below one internal node at that depth, which keeps its smallest id.
    """
    lengths = np.array([len(w) for w in slices], np.int64)
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for words in slices for w in words), np.int64, lengths.sum())
    own = np.repeat(np.arange(len(slices)), lengths)
    at = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    done = 1
    while done < window:
        step = min(done, window - done)
        rank = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank = np.unique(rank, return_inverse=True)[1]
        done += step
    starts = np.flatnonzero(at[: len(rank)] + window <= lengths[own[: len(rank)]])
    if not len(starts):
        return [np.zeros(0, np.int64) for _ in slices]
    order = starts[np.argsort(rank[starts], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    least = np.repeat(np.minimum.reduceat(ids[own[order]], first), np.diff(np.concatenate([first, [len(order)]])))
    lost = np.sort(order[least < ids[own[order]]])
    return np.split(at[lost], np.searchsorted(own[lost], np.arange(1, len(slices))))


def _trees(slices: DataFrame, window: int) -> DataFrame:
    """(g, r1, r2, lost): windows of a run, counted from its start, that repeat a smaller document of the group g."""
    kind = pa.list_(pa.int32())

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        words = [r[4].encode("utf-8", "surrogatepass").split() for r in rows]
        lost = deep_nodes(words, np.array([r[3] for r in rows], np.int64), window)
        hit = [i for i, x in enumerate(lost) if len(x)]
        return pa.RecordBatch.from_arrays([*(pa.array([rows[i][c] for i in hit], pa.int64()) for c in range(3)), pa.array([lost[i] for i in hit], kind)], ["g", "r1", "r2", "lost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        n = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= TREE_WORDS and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, n = [], 0
                rows.append(r)
                n += r[4].count(" ") + 1
        if rows:
            yield solve(rows)

    return slices.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, r1 long, r2 long, lost array<int>")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(g, r1, r2, id, at, w1, w2): each window of the runs that ``todo`` names, by 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Hashes()
        for batch in batches:
            for i in range(batch.num_rows):
                hashes, doc = table.of(batch.column(3)[i].as_py().encode("utf-8", "surrogatepass").split()), batch.column(1)[i].as_py()
                rolls = [_Rolling(hashes[:, k], b) for k, b in enumerate(_BASES)]
                for x in batch.column(4)[i].as_py():
                    at = np.arange(x["a"], x["b"] + 1)
                    same = (pa.array(np.full(len(at), v, np.int64)) for v in (x["g"], x["r1"], x["r2"], doc))
                    yield pa.RecordBatch.from_arrays([*same, pa.array((at - x["a"]).astype(np.int32)), *(_signed(r.of(at, at + window)) for r in rolls)], ["g", "r1", "r2", "id", "at", "w1", "w2"])

    return docs.select("doc_id", "id", "row", "text", "todo").mapInArrow(run, "g long, r1 long, r2 long, id long, at int, w1 long, w2 long")


def _remove(docs: DataFrame) -> DataFrame:
    """Drops the words in ``gone``: stretches (a, b) of word positions, b exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if gone.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for x in gone.as_py():
                        edges[x["a"]] += 1
                        edges[x["b"]] -= 1
                    keep = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
                    words = [words[i] for i in keep]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_branches: int = GROUP_BRANCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    A suffix belongs to the group of its prefix, which is chosen by content: the least
    ``prefix``-gram within its first ``window`` words. Neighbouring suffixes share it, so a run of
    them travels as one slice of text. Prefixes found in one document only are discarded. Copies
    of one run are merged on the map side to their smallest document, told by 128 bits of their
    words; all others lose the whole run. Where a prefix has several branches (different runs), one slice
    a branch goes to the group's task, which builds its suffix array; the internal nodes at depth
    ``window`` are the repeats, and each keeps its smallest document. A prefix with more than
    ``group_branches`` branches, as at the edge of a passage that a third of all documents
    holds, would not fit a task: its suffixes get prefixes as long as the window instead, whose
    groups are single nodes: their least documents are found on the map side, written, and joined back to the
    windows. No larger group is ever gathered.
    A word goes if a window over it also starts in a document with a smaller doc_id.

    Null text has no words. A null doc_id counts as larger than all others. Rows repeated with
    one doc_id are one document to each other: they lose nothing to one another, and each loses
    the words at the places where any of them repeats a smaller document; rows of one doc_id
    with different texts are told apart by their texts. An empty table gives no rows.
    """
    if not 0 < prefix <= window < 4096:
        raise ValueError("0 < prefix <= window < 4096")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(_LAST)), "row": F.xxhash64("text")})
    run, place = ["g", "r1", "r2"], ["id", "row"]
    runs = stored(_runs(rows, window, prefix))
    shared = stored(runs.groupBy("g").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("g"))
    met = stored(runs.join(shared.hint("merge"), "g", "left_semi"))
    discard(runs)

    branches = stored(met.groupBy(*run).agg(F.min("id").alias("low")))
    forks = stored(branches.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    told = met.join(branches.hint("merge"), run).join(forks.hint("merge"), "g", "left").filter("id > low OR n IS NOT NULL")
    told = stored(told.select(*run, *place, "a", "b", "low", "n"))
    # The smallest document of each branch of a fork, one run of it.
    heads = told.filter("id = low AND n IS NOT NULL").groupBy(*run, "n").agg(F.min(F.struct(*place, "a", "b")).alias("p"))
    heads = heads.select("n", "p.id", "p.row", F.struct("p.a", "p.b", *run).alias("t"))

    dealt = rows.repartition(*place)

    def with_todo(keep: str) -> DataFrame:
        todo = heads.filter(keep).groupBy(*place).agg(F.collect_list("t").alias("todo"))
        return dealt.join(todo.hint("shuffle_hash"), place)

    lost = _trees(_slices(with_todo(f"n <= {group_branches}"), window), window).select(*run, F.explode("lost").alias("at"))
    # Both sides of the join are tables, so that the windows of a passage that very many branches hold are split over tasks.
    windows = stored(_windows(with_todo(f"n > {group_branches}"), window))
    nodes = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("w1", "w2", "low")
    lost = lost.union(windows.join(stored(nodes).hint("merge"), ["w1", "w2"]).filter("id > low").select(*run, "at")).groupBy(*run).agg(F.collect_set("at").alias("lost"))

    whole = told.filter("id > low").select(*place, "a", (F.col("b") + window).alias("b"))
    more = told.filter("id = low").join(lost, run).select(*place, F.explode("lost").alias("at"), "a")
    more = more.select(*place, (F.col("a") + F.col("at")).alias("a"), (F.col("a") + F.col("at") + window).alias("b"))
    gone = whole.union(more).groupBy(*place).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return _remove(dealt.join(gone.hint("shuffle_hash"), place, "left"))
