"""Periodic runs of words: maximal pairs in the LCP-interval tree of each text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import filled

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4
#: Words a task works on at once, and words that its table of numbers holds before it starts anew.
BLOCK_WORDS, TABLE_WORDS = 400_000, 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """word -> number, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def shortest_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Words that a run shares with itself, moved by its period, at least."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def with_repeats(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the documents in which some n words in a row stand twice; a few more may be named, none is missed."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    mixed = _mixed(words.astype(np.uint64) + np.uint64(1))
    m = len(words) - n + 1
    grams = mixed[:m].copy()
    for k in range(1, n):
        grams *= _BASE
        grams += mixed[k : k + m]
    grams = _mixed(grams + doc[:m].astype(np.uint64) * _BASE)[doc[:m] == doc[n - 1 :]]
    kept = np.sort(grams)
    twice = kept[1:][kept[1:] == kept[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    table = np.zeros(1 << 22, bool)
    table[(twice >> np.uint64(42)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(grams >> np.uint64(42)).astype(np.int64)])
    hit = maybe[np.isin(grams[maybe], twice)]
    return np.unique(doc[:m][doc[:m] == doc[n - 1 :]][hit])


def suffix_order(seq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes that share at least their first n words with another, in order, and the common prefix of each with the one before).

    Ranks of doubled lengths: ranks are places in the order, so a group of equal prefixes is
    split in place and only suffixes still tied are sorted again. Common prefixes are read from
    the ranks kept of each length. ``seq`` must end with a number that occurs once.
    """
    order = np.argsort(seq, kind="stable")
    new = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
    rank = np.empty(len(seq), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    levels, depth = [(1, rank.astype(np.int32))], 1
    tied = np.sort(order[~(new & np.append(new[1:], True))])
    named = tied
    while len(tied):
        key = rank[tied] * (len(seq) + 1) + rank[np.minimum(tied + depth, len(seq) - 1)]
        by = np.argsort(key, kind="stable")
        key, tied = key[by], tied[by]
        old = rank[tied]
        at = np.arange(len(tied))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
        depth *= 2
        levels.append((depth, rank.astype(np.int32)))
        tied = np.sort(tied[~(new & np.append(new[1:], True))])
        if depth <= n:
            named = tied
    order = named[np.argsort(rank[named], kind="stable")]
    a, b, common = order[:-1], order[1:], np.zeros(max(len(order) - 1, 0), np.int64)
    for depth, ranks in reversed(levels):
        same = ranks[np.minimum(a + common, len(seq) - 1)] == ranks[np.minimum(b + common, len(seq) - 1)]
        common += depth * same
    return order, np.concatenate([np.zeros(min(len(order), 1), np.int64), common])


def _promising(order: np.ndarray, common: np.ndarray, n: int, times: int) -> np.ndarray:
    """Bounds of the stretches of ``order`` that share n words and where the nearest two suffixes may be near enough for the longest prefix: (first, end) rows."""
    cut = np.flatnonzero(common < n)
    end = np.append(cut[1:], len(order))
    cut, end = cut[end - cut > 1], end[end - cut > 1]
    if not len(cut):
        return np.zeros((0, 2), np.int64)
    inside = np.repeat(np.arange(len(cut)), end - cut)
    at = np.concatenate([np.arange(a, b) for a, b in zip(cut, end, strict=True)])
    first = np.cumsum(end - cut) - (end - cut)
    longest = np.maximum.reduceat(np.where(common[at] < n, 0, common[at]), first)
    by = np.lexsort((order[at], inside))
    gap = np.diff(order[at][by], append=0)
    gap[np.append(first[1:], len(at)) - 1] = np.iinfo(np.int64).max // (2 * times)
    near = np.minimum.reduceat(gap, first) * (times - 1) <= longest
    return np.stack([cut[near], end[near]], axis=1)


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of pairs of suffixes whose distance fits their common prefix and whose left words differ.

    Bottom-up through the LCP intervals: an interval keeps, for the classes of left words in it,
    its suffixes by position, and the smaller child's list is merged into the larger one's. A
    suffix and its neighbours in the other list meet here for the first time, so the interval's
    prefix is all they share to the right; if they are of different classes, they share nothing
    to the left. If their distance is at most the prefix by ``times`` - 1, the stretch from the first
    to the end of the second's prefix repeats with it and can't be longer: a run, with nothing to extend.
    A run's least period is always the distance of two neighbours, since any suffix between
    them that shares the prefix would make the period smaller; multiples of it give the same
    stretch, of which the least period is kept.
    """
    found: dict[tuple[int, int], int] = {}

    def met(a: int, b: int, shared: int) -> None:
        d = b - a
        if d * (times - 1) <= shared and d + shared >= least and left[a] != left[b]:
            run = (a, d + shared)
            if found.get(run, d) >= d:
                found[run] = d

    def merged(x: list[int], y: list[int], shared: int) -> list[int]:
        if len(x) < len(y):
            x, y = y, x
        n = len(x)
        for b in y:
            k = bisect_left(x, b)
            if k:
                met(x[k - 1], b, shared)
            if k < n:
                met(b, x[k], shared)
        if len(y) == 1:
            x.insert(k, b)
        else:
            x += y
            x.sort()
        return x

    depths: list[int] = []
    lists: list[list[int]] = []
    last = [order[0]]
    for i in range(1, len(order)):
        shared = common[i]
        while depths and depths[-1] > shared:
            last = merged(lists.pop(), last, depths.pop())
        if depths and depths[-1] == shared:
            lists[-1] = merged(lists[-1], last, shared)
        else:
            depths.append(shared)
            lists.append(last)
        last = [order[i]]
    while depths:
        last = merged(lists.pop(), last, depths.pop())
    return [(a, length, d) for (a, length), d in found.items()]


def _least_periods(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs over the same stretch that with the least period."""
    best: dict[tuple[int, int], int] = {}
    for a, length, d in runs:
        best[a, length] = min(d, best.get((a, length), d))
    return sorted(((a, length, d) for (a, length), d in best.items()), key=lambda x: (x[0], x[2]))


def runs_of(docs: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each sequence of word numbers its runs (start, length, period), by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    lengths = np.array([len(d) for d in docs], np.int64)
    n = shortest_overlap(least, times)
    todo = with_repeats(np.concatenate([np.zeros(0, np.int64), *docs]), np.repeat(np.arange(len(docs)), lengths), n)
    if not len(todo):
        return out
    # Each text stands between numbers of their own, which end every common prefix and are left words of no other class.
    seq = np.concatenate([x for i, d in enumerate(todo.tolist()) for x in (np.array([i]), docs[d] + len(todo) + 1)] + [np.array([len(todo)])])
    starts = np.cumsum(lengths[todo] + 1) - lengths[todo]
    order, common = suffix_order(seq, n)
    left = np.concatenate([[-1], seq[:-1]]).tolist()
    for a, b in _promising(order, common, n, times).tolist():
        for s, length, d in maximal_pairs(order[a:b].tolist(), common[a:b].tolist(), left, least, times):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            out[todo[k]].append((s - int(starts[k]), length, d))
    return [_least_periods(r) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside all runs, and of each run those that no run drops: a run drops what follows its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for a, length, d in runs:
        edges[a + d] += 1
        edges[a + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed_text.

    A run is a stretch of words with least period q and at least ``least`` words and ``times`` periods that no
    neighbouring word continues. Each text has its own LCP-interval tree, whose maximal pairs of
    fitting distance are the runs; texts in which no five words in a row stand twice have none.
    Texts are never compared with each other, so nothing is shuffled; a task holds about
    BLOCK_WORDS words or one longer text.

    Null text has no words and no runs, so an empty collapsed_text. Repeated rows and null
    doc_ids are rows like others. An empty table gives no rows; other columns are ignored.
    """
    if least < 2 or times < 2:
        raise ValueError("least and times must be 2 or more")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(ids: pa.Array, texts: list[list[bytes]], table: _Numbers) -> pa.RecordBatch:
        numbers = [np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in texts]
        found = runs_of(numbers, least, times)
        kept = [b" ".join(collapsed(w, r) if r else w).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
        runs = pa.array([[{"start": a, "length": n, "period": d} for a, n, d in r] for r in found], kind)
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Numbers()
        for b in batches:
            begin, texts, n = 0, [], 0
            for i in range(b.num_rows):
                texts.append(b.column(1)[i].as_py().encode("utf-8", "surrogatepass").split())  # bytes: splits at \\x20\\x09-\\x0D only
                n += len(texts[-1])
                if n >= BLOCK_WORDS or i == b.num_rows - 1:
                    yield solve(b.column(0).slice(begin, i + 1 - begin), texts, table)
                    begin, texts, n = i + 1, [], 0
                    if len(table) > TABLE_WORDS:
                        table = _Numbers()

    return docs.select(F.col("doc_id").cast("long"), filled()).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")
