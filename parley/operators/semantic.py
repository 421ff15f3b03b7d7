"""Transcripts: windows, probe and answer turns, semantic scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import classify_answer, invention_score, normalize_text, word_count
from parley.operators.intervals import AGENT



def concat_timeline(turns: DataFrame, gap: float = 0.30) -> DataFrame:
    """{call_id, channel, turn_id, w0, w1}: where each turn lies when a channel's turns are put one after another."""
    order = W.partitionBy("call_id", "channel").orderBy("turn_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("e") - F.col("s") + gap).over(order), F.lit(0.0))
    return turns.select("call_id", "channel", "turn_id", start.alias("w0"), (start + F.col("e") - F.col("s")).alias("w1"))


def assign_segments(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """{call_id, channel, turn_id, text}: each segment {call_id, channel, seg, s, e, text} goes to the window its middle is in, else to the nearest; the earlier wins ties.

    Both sides form one stream by time per channel. The window at or before a middle and the one
    after it are the only candidates, so there are no pairs.
    """
    mid = segments.select("call_id", "channel", ((F.col("s") + F.col("e")) / 2).alias("t"), "seg", "text", F.lit(1).alias("kind"))
    win = windows.select("call_id", "channel", F.col("w0").alias("t"), F.struct("turn_id", "w0", "w1").alias("w"), F.lit(0).alias("kind"))
    order = W.partitionBy("call_id", "channel").orderBy("t", "kind")
    both = win.unionByName(mid, allowMissingColumns=True)
    before = F.last("w", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("w", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = both.withColumns({"b": before, "a": after}).filter("kind = 1 AND (b IS NOT NULL OR a IS NOT NULL)")
    left, right = F.greatest(F.lit(0.0), F.col("t") - F.col("b.w1")), F.col("a.w0") - F.col("t")
    own = F.when(F.col("b").isNull(), F.col("a.turn_id")).when(F.col("a").isNull() | (left <= right), F.col("b.turn_id")).otherwise(F.col("a.turn_id"))
    rows = rows.select("call_id", "channel", own.alias("turn_id"), "seg", "text")
    return rows.groupBy("call_id", "channel", "turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), " ").alias("text"))


def probe_prefilter(turns: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """Agent turns with norm that hold an anchor word; the costly comparison sees no others. Rows without a channel are the agent's."""
    own = turns.filter(F.col("channel") == AGENT) if "channel" in turns.columns else turns
    return own.withColumn("norm", normalize_text(F.col("text"))).filter(F.col("norm").rlike("|".join(anchors)))


def shared_letters(text: Column, other: str) -> Column:
    """An upper bound of ``similarity``: letters in common, as often as both have them."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    common = sum((F.least(count(c), F.lit(other.count(c))) for c in sorted(set(other))), F.lit(0))
    return 2 * common / (F.length(text) + len(other))


def similarity(a: str, b: str) -> float:
    """Twice the letters in matching blocks over all letters: the longest common block (the first of several), then the same to its left and right."""
    if not a or not b:
        return float(not a and not b)
    matched, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        n = at = 0
        for i in range(len(x)):
            while i + n < len(x) and x[i : i + n + 1] in y:
                n, at = n + 1, i
            if i + n >= len(x):
                break
        if n:
            j = y.find(x[at : at + n])
            matched += n
            todo += [(x[:at], y[:j]), (x[at + n :], y[j + n :])]
    return 2 * matched / (len(a) + len(b))


def subsequences(letters: np.ndarray, starts: np.ndarray, other: str, steps: int) -> np.ndarray:
    """[n, k]: the longest common subsequence of ``other``, of at most 64 letters, and the n letters from ``starts[k]`` on, up to ``steps``; by bits, all starts at once."""
    masks = np.zeros(len(letters) + steps, np.uint64)
    for j, c in enumerate(other):
        masks[: len(letters)][letters == ord(c)] |= np.uint64(1 << j)
    out, state, width = np.zeros((steps + 1, len(starts)), np.int64), np.full(len(starts), 2**64 - 1, np.uint64), np.uint64((1 << len(other)) - 1)
    for n in range(steps):
        both = state & masks[starts + n]
        state = (state + both) | (state - both)
        out[n + 1] = np.bitwise_count(~state & width)
    return out


def best_run(norm: str, variants: tuple[str, ...], shortest: int, longest: int, memo: dict[tuple[int, str], float]) -> float:
    """The best similarity to a variant of any run of so many words, or of the whole text, of a text of single spaces.

    Matching blocks are a common subsequence, which bounds runs of up to four times a variant's
    letters; the letters in common bound the others. Runs are tried in the order of their bounds
    until the next is not above the best. ``memo`` keeps up to 100,000 similarities.
    """
    letters = np.frombuffer(norm.encode("utf-32-le"), np.uint32)
    ends = np.append(np.flatnonzero(letters == 32), len(letters))
    starts = np.append(0, ends[:-1] + 1)
    sizes = range(max(1, shortest), min(longest, len(ends)) + 1)
    first = np.concatenate([[0], *(np.arange(len(starts) - n + 1) for n in sizes)])
    a, b = starts[first], np.concatenate([[len(letters)], *(ends[n - 1 :] for n in sizes)])
    bounds = np.zeros((len(variants), len(a)))
    for row, v in zip(bounds, variants, strict=True):
        common = np.zeros(len(a), np.int64)
        for c in sorted(set(v)):
            upto = np.append(0, np.cumsum(letters == ord(c)))
            common += np.minimum(upto[b] - upto[a], v.count(c))
        near = np.flatnonzero(b - a <= 4 * len(v))
        if len(v) <= 64 and len(near):
            size = (b - a)[near]
            common[near] = subsequences(letters, starts, v, int(size.max()))[size, first[near]]
        row[:] = 2 * common / np.maximum(b - a + len(v), 1)
    top = 0.0
    for at in np.argsort(-bounds, axis=None, kind="stable"):
        if bounds.flat[at] <= top:
            break
        v, k = divmod(int(at), len(a))
        run = norm[a[k] : b[k]]
        if (score := memo.get((v, run))) is None:
            if len(memo) >= 100_000:
                memo.clear()
            memo[v, run] = score = similarity(run, variants[v])
        top = max(top, score)
    return top


def probe_fuzzy_score(spans: DataFrame, variants: tuple[str, ...], anchors: tuple[str, ...]) -> DataFrame:
    """{call_id, [first_turn,] turn_id, score} of turns or of ``probe_spans``: the best similarity to a variant of any run of words,
    from three words fewer to four more than the first variant has, or of the whole text.

    Spans stay whole rows, so nothing but scores is exchanged; a task cuts a span's runs and compares them in the order
    of their bounds (``best_run``). Spans without an anchor word don't come out; rows of one span give one score.
    """
    place = [c for c in ("call_id", "first_turn", "turn_id") if c in spans.columns]
    words = len(variants[0].split())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[int, str], float] = {}
        for b in batches:
            scores = [best_run(norm, variants, words - 3, words + 4, memo) for norm in b.column("norm").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*place, "score"])

    kinds = dict(spans.dtypes)
    scored = probe_prefilter(spans, anchors).select(*place, "norm").mapInArrow(best, ", ".join([*(f"{c} {kinds[c]}" for c in place), "score double"]))
    return scored.groupBy(*place).agg(F.max("score").alias("score"))


def probe_spans(turns: DataFrame) -> DataFrame:
    """{call_id, first_turn, turn_id, text}: each agent turn with words in {call_id, turn_id, channel, text}, and each two of them in a row as one text.

    The caller may have spoken between the two; turn_id is the last turn of the span.
    """
    order = W.partitionBy("call_id").orderBy("turn_id")
    a = turns.filter((F.col("channel") == AGENT) & F.col("text").rlike(r"\S")).select("call_id", "turn_id", "text", F.lead(F.struct("turn_id", "text")).over(order).alias("n"))
    span = lambda last, text: F.struct(F.col("turn_id").alias("first_turn"), last.alias("turn_id"), text.alias("text"))
    pair = F.when(F.col("n").isNotNull(), span(F.col("n.turn_id"), F.concat_ws(" ", "text", "n.text")))
    return a.select("call_id", F.inline(F.array_compact(F.array(span(F.col("turn_id"), F.col("text")), pair))))


def find_probe_turn(scores: DataFrame, threshold: float = 0.60) -> DataFrame:
    """{call_id, probe_turn, score}: the last turn of the call's best span at or above the threshold; the earliest wins ties.

    ``scores`` {call_id, turn_id, score} may have first_turn, as ``probe_spans`` gives it.
    """
    first = F.col("first_turn") if "first_turn" in scores.columns else F.col("turn_id")
    best = scores.filter(F.col("score") >= threshold).groupBy("call_id").agg(F.max_by(F.struct("turn_id", "score"), F.struct("score", (-first).alias("first"), (-F.col("turn_id")).alias("last"))).alias("b"))
    return best.select("call_id", F.col("b.turn_id").alias("probe_turn"), F.col("b.score").alias("score"))


def probe_ground_truth(calls: DataFrame, probes: DataFrame, answers: DataFrame, turns: DataFrame) -> DataFrame:
    """{call_id, probe_found, probe_turn, score, answer_turn, latency} for all calls; score has 4, latency 3 decimals."""
    at = turns.select("call_id", "turn_id", "s", "e")
    p = at.select("call_id", F.col("turn_id").alias("probe_turn"), F.col("e").alias("pe"))
    a = at.select("call_id", F.col("turn_id").alias("answer_turn"), F.col("s").alias("as"))
    out = calls.select("call_id").join(probes, "call_id", "left").join(answers.select("call_id", "answer_turn"), "call_id", "left").join(p, ["call_id", "probe_turn"], "left").join(a, ["call_id", "answer_turn"], "left")
    return out.select("call_id", F.col("probe_turn").isNotNull().alias("probe_found"), "probe_turn", F.round("score", 4).alias("score"), "answer_turn", F.round(F.col("as") - F.col("pe"), 3).alias("latency"))


def probe_coverage(truth: DataFrame) -> DataFrame:
    """{considered, found, coverage} of ``probe_ground_truth``: the share of calls with a probe, 4 decimals, 0 without calls."""
    share = F.round(F.coalesce(F.avg(F.col("probe_found").cast("double")), F.lit(0.0)), 4)
    return truth.agg(F.count(F.lit(1)).alias("considered"), F.count_if("probe_found").alias("found"), share.alias("coverage"))


def semantic_scores(calls: DataFrame, models: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per call and model {model}: answer rules over ``answers`` {call_id, model, text}; what is missing is false, '', 0.5."""
    rows = calls.select("call_id").crossJoin(models).join(answers.withColumn("kind", classify_answer(F.col("text"))), ["call_id", "model"], "left")
    kind = F.col("kind")
    here = F.col("text").isNotNull()
    return rows.select("call_id", "model", here.alias("semantic_available"), F.when(here, kind).otherwise("").alias("answer_type"), F.when(here, invention_score(kind)).otherwise(0.5).alias("invention_score"), word_count(F.col("text")).alias("words"))


def semantic_outcome(rows: DataFrame) -> DataFrame:
    """{call_id, reason, available, p_final} of {enabled, probe_turn, answer_turn, failed, p, p_fused}."""
    reason = F.when(~F.col("enabled"), "disabled").when(F.col("probe_turn").isNull(), "no_probe").when(F.col("answer_turn").isNull(), "no_answer_turn").when(F.col("failed"), "error").otherwise("ok")
    return rows.withColumn("reason", reason).select("call_id", "reason", (F.col("reason") == "ok").alias("available"), F.when(F.col("reason") == "ok", F.col("p_fused")).otherwise(F.col("p")).alias("p_final"))


def answer_digest(answers: DataFrame) -> DataFrame:
    """{label, answer_type, n, share, mean_score, empty_share} of {label, text}; label null is everyone."""
    answers, kind = answers.withColumn("kind", classify_answer(F.col("text"))), F.col("kind")
    rows = answers.select("label", kind.alias("answer_type"), invention_score(kind).alias("score"), (~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).cast("double").alias("empty"))
    sets = rows.select("answer_type", "score", "empty", F.explode(F.array(F.col("label"), F.lit("all"))).alias("label"))
    out = sets.groupBy("label", "answer_type").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("empty").alias("empty_share"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label"))).select("label", "answer_type", "n", "share", "mean_score", "empty_share")


def answer_gap(answers: DataFrame) -> DataFrame:
    """{human, synthetic, gap}: the mean score of each label's answers {label, text} (0 without any) and synthetic minus human."""
    score = invention_score(classify_answer(F.col("text")))
    mean = lambda label: F.coalesce(F.avg(F.when(F.col("label") == label, score)), F.lit(0.0)).alias(label)
    return answers.agg(mean("human"), mean("synthetic")).withColumn("gap", F.col("synthetic") - F.col("human"))


def best_turn(scores: DataFrame, min_frames: int = 0) -> DataFrame:
    """{call_id, turn_id, score}: the least score per call; the earlier turn wins ties. With ``min_frames`` turns whose n_frames are fewer don't count."""
    scores = scores.filter(F.col("n_frames") >= min_frames) if min_frames else scores
    return scores.groupBy("call_id").agg(F.min(F.struct("score", "turn_id")).alias("b")).select("call_id", F.col("b.turn_id").alias("turn_id"), F.col("b.score").alias("score"))


def classify_score(score, present: float, absent: float):
    """True at or below ``present``, false at or above ``absent``, null between."""
    return F.when(score <= present, True).when(score >= absent, False)


def pick_bounds(scores: DataFrame) -> DataFrame:
    """{present, absent} from the training scores {has_probe, score}, 6 decimals."""
    b = scores.agg(F.max(F.when(F.col("has_probe"), F.col("score"))).alias("pos"), F.min(F.when(~F.col("has_probe"), F.col("score"))).alias("neg"))
    apart = F.col("pos") < F.col("neg")
    return b.select(F.round(F.when(apart, F.col("pos")).otherwise(F.col("neg") - 1e-6), 6).alias("present"), F.round(F.when(apart, F.col("neg")).otherwise(F.col("pos") + 1e-6), 6).alias("absent"))


def detector_validation(rows: DataFrame) -> DataFrame:
    """{label, n, recall, precision, fpr, ambiguous} of {label, has_probe, detected}; label null is everyone."""
    yes, truth = F.col("detected"), F.col("has_probe")
    ratio = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    return rows.rollup("label").agg(F.count(F.lit(1)).alias("n"), ratio(yes & truth, truth).alias("recall"), ratio(yes & truth, yes).alias("precision"), ratio(yes & ~truth, ~truth).alias("fpr"), F.count_if(yes.isNull()).alias("ambiguous"))


def detection_gap(rows: DataFrame) -> DataFrame:
    """{human, synthetic, gap}: the share of each label's probes {label, has_probe, detected} that is found, 4 decimals, and how far both lie apart.

    An ambiguous probe is not found. A label without probes has share 0 and then the gap is 0.
    """
    hit = F.coalesce(F.col("detected"), F.lit(False)).cast("double")
    share = lambda label: F.round(F.avg(F.when(F.col("label") == label, hit)), 4).alias(label)
    both = rows.filter("has_probe").agg(share("human"), share("synthetic"))
    zero = F.lit(0.0)
    return both.select(F.coalesce("human", zero).alias("human"), F.coalesce("synthetic", zero).alias("synthetic"), F.coalesce(F.round(F.abs(F.col("synthetic") - F.col("human")), 4), zero).alias("gap"))


def recover_span(turns: DataFrame, probes: DataFrame, least: float = 1.2, most_gap: float = 1.0) -> DataFrame:
    """{call_id, probe_turn, s, e, turns}: the probe turn, with turns of its channel before it while the span is shorter than ``least`` and the gap at most ``most_gap``.

    Walking back stops at the first turn that already gives ``least`` seconds or at a larger gap; both are running conditions over the turns before.
    """
    p = probes.join(turns.select("call_id", F.col("turn_id").alias("probe_turn"), "channel", F.col("e").alias("end")), ["call_id", "probe_turn"])
    back = turns.join(p, ["call_id", "channel"]).filter(F.col("turn_id") <= F.col("probe_turn"))
    order = W.partitionBy("call_id", "probe_turn").orderBy(F.desc("turn_id"))
    later = F.lag("s").over(order)
    stop = (F.col("end") - later >= least) | (later - F.col("e") > most_gap)
    back = back.withColumn("stop", F.coalesce(stop, F.lit(False)).cast("int")).withColumn("stopped", F.sum("stop").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return back.filter("stopped = 0").groupBy("call_id", "probe_turn").agg(F.min("s").alias("s"), F.max("end").alias("e"), F.count(F.lit(1)).alias("turns"))


def reject_reasons(rows: DataFrame) -> DataFrame:
    """{reason, n} of {probe_turn, channel, s, e}; 'accepted' where nothing is wrong."""
    d = F.col("e") - F.col("s")
    reason = F.when(F.col("probe_turn").isNull(), "no_ground_truth").when(F.col("channel") != AGENT, "bad_channel").when((d < 1.2) | (d > 6.0), "implausible_duration").otherwise("accepted")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pick_templates(spans: DataFrame, k: int = 3, shortest: float = 1.8, longest: float = 3.2) -> DataFrame:
    """k candidates {call_id, s, e} of fitting length, evenly spaced in the order of call_id.

    Candidates are numbered by a prefix sum over blocks of ids, then within each block.
    """
    ok = spans.filter((F.col("e") - F.col("s")).between(shortest, longest)).withColumn("_b", F.floor(F.col("call_id") / 10_000))
    blocks = ok.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    every = W.orderBy("_b")
    blocks = blocks.select("_b", F.coalesce(F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    rows = ok.join(blocks, "_b").withColumn("r", F.col("_base") + F.row_number().over(W.partitionBy("_b").orderBy("call_id", "s")) - 1)
    wanted = F.array(*[F.floor(F.lit(i) * F.col("n") / k) for i in range(k)])
    return rows.filter(F.array_contains(wanted, F.col("r"))).select("call_id", "s", "e")


