"""Speech segmentation over frames {call_id, channel, i, db}: windows and islands, no loop over frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("call_id", "channel")


@dataclass(frozen=True)
class VadParams:
    percentile: float = 0.10
    offset_db: float = 6.0
    on_frames: int = 3
    off_frames: int = 15
    min_speech_ms: int = 200
    min_gap_ms: int = 250
    hop_ms: int = 10
    frame_ms: int = 20


def _limit(x: int | str) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x)


def frame_rms_db(samples: DataFrame, frame: int = 160, hop: int = 80, floor_db: float = -100.0) -> DataFrame:
    """Frames of {call_id, channel, x ARRAY<DOUBLE>}: level of every full frame."""
    n = F.floor((F.size("x") - frame) / hop).cast("int")
    rows = samples.filter(F.size("x") >= frame).select(*KEY, "x", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    power = F.aggregate(F.slice("x", F.col("i") * hop + 1, frame), F.lit(0.0), lambda a, v: a + v * v) / frame
    return rows.select(*KEY, F.col("i").cast("long").alias("i"), F.when(power > 0, F.greatest(F.lit(floor_db), 10 * F.log10(power))).otherwise(floor_db).alias("db"))


def adaptive_threshold(frames: DataFrame, p: float = 0.10, offset: float = 6.0, by: tuple[str, ...] = KEY) -> DataFrame:
    """{call_id, channel, thr}: the nearest-rank percentile of a channel's levels plus an offset."""
    ranked = frames.select(*by, "db", F.row_number().over(W.partitionBy(*by).orderBy("db")).alias("r"), F.count(F.lit(1)).over(W.partitionBy(*by)).alias("n"))
    at = F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return ranked.filter(F.col("r") - 1 == at).select(*by, (F.col("db") + offset).alias("thr"))


def raw_activity(frames: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Frames with active: level strictly above the channel's threshold."""
    return frames.join(thresholds, list(by)).select(*by, "i", (F.col("db") > F.col("thr")).alias("active"))


def hysteresis(activity: DataFrame, on: int | str = 3, off: int | str = 15, by: tuple[str, ...] = KEY) -> DataFrame:
    """{.., f0, f1}: speech begins with a run of at least ``on`` active frames and lasts until one of at least ``off`` silent ones.

    Runs too short for either are dropped, then runs of the kind already held; what is left alternates.
    ``on`` and ``off`` may name columns.
    """
    order = W.partitionBy(*by).orderBy("i")
    flips = activity.withColumn("flip", F.when(F.col("active") == F.lag("active").over(order), 0).otherwise(1))
    flips = flips.withColumns({"run": F.sum("flip").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "total": F.max("i").over(W.partitionBy(*by)) + 1})
    extra = [x for x in (on, off) if isinstance(x, str) and x not in by]
    runs = flips.groupBy(*by, *extra, "run", "active", "total").agg(F.min("i").alias("f0"), F.count(F.lit(1)).alias("n"))
    runs = runs.filter((F.col("active") & (F.col("n") >= _limit(on))) | (~F.col("active") & (F.col("n") >= _limit(off))))
    order = W.partitionBy(*by).orderBy("run")
    runs = runs.withColumn("before", F.lag("active").over(order)).filter(F.coalesce(F.col("before") != F.col("active"), F.col("active")))
    return runs.withColumn("f1", F.coalesce(F.lead("f0").over(order), F.col("total"))).filter("active").select(*by, "f0", "f1")


def drop_short(segments: DataFrame, min_speech_ms: int | str = 200, hop_ms: int = 10, frame_ms: int = 20) -> DataFrame:
    """Frames f0..f1 in milliseconds, without those shorter than ``min_speech_ms``, a number or a column's name."""
    ms = segments.withColumns({"s": F.col("f0") * hop_ms, "e": F.col("f1") * hop_ms + (frame_ms - hop_ms)})
    return ms.filter(F.col("e") - F.col("s") >= _limit(min_speech_ms)).drop("f0", "f1")


def merge_close(segments: DataFrame, min_gap_ms: int | str = 250, by: tuple[str, ...] = KEY) -> DataFrame:
    """Segments {.., s, e} merged over gaps shorter than ``min_gap_ms``, a number or one of the columns ``by``."""
    order = W.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = segments.withColumn("new", F.when(F.col("s") - reach < _limit(min_gap_ms), 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def detect_turns(frames: DataFrame, params: VadParams | None = None) -> DataFrame:
    """{call_id, turn_id, channel, s, e} in seconds, numbered per call by start."""
    v = params or VadParams()
    active = raw_activity(frames, adaptive_threshold(frames, v.percentile, v.offset_db))
    turns = merge_close(drop_short(hysteresis(active, v.on_frames, v.off_frames), v.min_speech_ms, v.hop_ms, v.frame_ms), v.min_gap_ms)
    number = F.row_number().over(W.partitionBy("call_id").orderBy("s", "channel")) - 1
    return turns.select("call_id", number.alias("turn_id"), "channel", (F.col("s") / 1e3).alias("s"), (F.col("e") / 1e3).alias("e"))


#: The settings that are tried, in the order in which ties are settled.
GRID = {"offset_db": (4, 6, 8, 10), "off_frames": (10, 15, 25), "min_speech_ms": (150, 200, 300), "min_gap_ms": (150, 250, 400)}


def param_grid(spark: SparkSession, grid: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """A row per combination of ``grid``: {combo, offset_db, off_frames, min_speech_ms, min_gap_ms}."""
    out = spark.range(1)
    for name, values in (grid or GRID).items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id").withColumn("combo", F.concat_ws("/", *GRID))


def shared_frames(pred: DataFrame, gold: DataFrame, by: tuple[str, ...], hop_ms: int = 10) -> DataFrame:
    """{.., n_pred, n_gold, n_both}: how many frames the turns {.., s, e} of either side and of both cover."""
    cells = lambda turns: turns.select(*by, F.floor(F.col("s") * 1000 / hop_ms).alias("a"), F.floor(F.col("e") * 1000 / hop_ms).alias("z"))
    return shared_cells(cells(pred), cells(gold), by)


def shared_cells(pred: DataFrame, gold: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The same of stretches of frames {.., a, z}, z exclusive.

    The ends of all stretches are one ordered stream per group, with the number of open ones of each side between two ends; no frame is a row.
    """

    def ends(turns: DataFrame, p: int, g: int) -> DataFrame:
        end = lambda x, sign: F.struct(F.col(x).cast("long").alias("f"), F.lit(sign * p).alias("p"), F.lit(sign * g).alias("g"))
        return turns.select(*by, F.explode(F.array(end("a", 1), end("z", -1))).alias("x")).select(*by, "x.*")

    steps = ends(pred, 1, 0).union(ends(gold, 0, 1)).groupBy(*by, "f").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    order = W.partitionBy(*by).orderBy("f")
    sofar = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = steps.select(*by, (F.sum("p").over(sofar) > 0).alias("p"), (F.sum("g").over(sofar) > 0).alias("g"), (F.lead("f").over(order) - F.col("f")).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return steps.groupBy(*by).agg(total(F.col("p")).alias("n_pred"), total(F.col("g")).alias("n_gold"), total(F.col("p") & F.col("g")).alias("n_both"))


def vad_param_grid(frames: DataFrame, gold: DataFrame, grid: DataFrame, on_frames: int = 3) -> DataFrame:
    """``grid`` with median_f1, n_turns and ratio: the median over channels of the frames' F1 against ``gold`` {call_id, channel, s, e}, and detected over true turns.

    ``grid`` is a small table as ``param_grid`` gives it. Frames are crossed only with what sets
    the level and the pause; the shortest speech and gap are tried on the segments found.
    A channel that has no turn on either side counts for nothing; without any, median_f1 is 0.
    """
    level = ("offset_db", "off_frames")
    by = (*KEY, "combo")
    base = adaptive_threshold(frames, 0.10, 0.0)
    active = frames.join(base, list(KEY)).crossJoin(grid.select(*level).distinct()).select(*KEY, *level, "i", (F.col("db") > F.col("thr") + F.col("offset_db")).alias("active"))
    found = hysteresis(active, on_frames, "off_frames", (*KEY, *level)).join(grid, list(level))
    turns = merge_close(drop_short(found.select(*by, "min_speech_ms", "min_gap_ms", "f0", "f1"), "min_speech_ms"), "min_gap_ms", (*by, "min_gap_ms"))
    turns = turns.select(*by, (F.col("s") / 1e3).alias("s"), (F.col("e") / 1e3).alias("e"))
    cells = shared_frames(turns, gold.select(*KEY, "s", "e").crossJoin(grid.select("combo")).select(*by, "s", "e"), by)
    f1 = cells.groupBy("combo").agg(F.median(F.coalesce(F.try_divide(2 * F.col("n_both"), F.col("n_pred") + F.col("n_gold")), F.lit(0.0))).alias("median_f1"))
    n = turns.groupBy("combo").agg(F.count(F.lit(1)).alias("n_turns"))
    n_gold = gold.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_gold"))
    out = grid.join(f1, "combo", "left").join(n, "combo", "left").crossJoin(n_gold)
    n_turns = F.coalesce("n_turns", F.lit(0))
    return out.select(*grid.columns, F.coalesce("median_f1", F.lit(0.0)).alias("median_f1"), n_turns.alias("n_turns"), (n_turns / F.col("n_gold")).alias("ratio"))


def best_vad_params(tried: DataFrame) -> DataFrame:
    """The row of ``vad_param_grid`` with the highest median_f1, then the ratio nearest to 1, then the first in the grid's order."""
    return tried.orderBy(F.desc("median_f1"), F.abs(F.col("ratio") - 1), *GRID).limit(1)
