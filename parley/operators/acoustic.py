"""Acoustic and spectral jobs: clips are dealt to chunks that overlap, NumPy transforms a chunk, relational aggregates do the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATE, HOP = 8000, 80
BANDS, N_FFT, LOWEST_HZ = 32, 256, 50.0
#: Samples that a chunk owns, a multiple of both hops; shorter clips have no pitch.
CHUNK, LEAST_PITCHED = 64_000, 256
EPS = 1e-12


def clipping_and_floor(samples: DataFrame, at: float = 0.999, block: int = 256) -> DataFrame:
    """{call_id, clipping, silence_db}: share of samples at full scale, and the 10th percentile of block levels; {call_id, i, x}."""
    blocks = samples.groupBy("call_id", F.floor(F.col("i") / block).alias("b")).agg(F.avg(F.col("x") * F.col("x")).alias("power"), F.count_if(F.abs("x") >= at).alias("c"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("call_id").agg((F.sum("c") / F.sum("n")).alias("clipping"), F.expr("percentile(10 * log10(greatest(power, 1e-10D)), 0.1)").alias("silence_db"))


def frame_sizes(rate: int = RATE) -> tuple[int, int]:
    """Samples of a frame of 25 ms and of a hop of 10 ms."""
    return max(64, int(0.025 * rate)), max(32, int(0.010 * rate))


def _lags(rate: int) -> np.ndarray:
    """Zero, and the lags of pitches from 500 down to 50 Hz."""
    return np.concatenate([[0], np.arange(max(1, rate // 500), rate // 50 + 1)])


def _halo(rate: int) -> int:
    """Samples after its own that a chunk also sees: the rest of its last frame, and its last sample's partner at the longest lag."""
    frame, hop = frame_sizes(rate)
    return max(frame - hop, N_FFT - HOP, rate // 50)


def chunks_of_clips(clips: DataFrame, rate: int = RATE, size: int = CHUNK) -> DataFrame:
    """{call_id, chunk, x ARRAY<DOUBLE>} of clips {call_id, x ARRAY<DOUBLE>}: each owns ``size`` samples and sees some more; an empty clip has one empty chunk."""
    last = F.greatest(F.ceil(F.size("x") / size).cast("int") - 1, F.lit(0))
    cut = clips.select("call_id", F.coalesce("x", F.array().cast("array<double>")).alias("x"))
    return cut.select("call_id", "x", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select("call_id", "chunk", F.slice("x", F.col("chunk") * size + 1, F.lit(size + _halo(rate))).alias("x"))


def chunks_of_samples(samples: DataFrame, rate: int = RATE, size: int = CHUNK) -> DataFrame:
    """The same of samples {call_id, i, x}, of which no task ever holds a whole clip: a sample goes to its own chunk and to those before that see it."""
    seen = F.sequence(F.greatest(F.floor((F.col("i") - _halo(rate)) / size).cast("int"), F.lit(0)), F.floor(F.col("i") / size).cast("int"))
    dealt = samples.select("call_id", "i", "x", F.explode(seen).alias("chunk"))
    gathered = F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x"))))
    return dealt.groupBy("call_id", "chunk").agg(F.transform(gathered, lambda v: v["x"]).alias("x"))


def _described(x: np.ndarray, rate: int, size: int, at: float) -> Iterator[tuple[str, np.ndarray, list[np.ndarray]]]:
    """What a chunk adds to its clip: (kind, index, values) of its frames, of the power of each frequency, of the products at each lag, and in all."""
    frame, hop = frame_sizes(rate)
    own = x[:size]
    starts = np.arange(0, max(min(len(own), len(x) - frame + 1), 0), hop)
    if len(starts):
        frames = np.lib.stride_tricks.sliding_window_view(x, frame)[starts]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        magnitude, hz = np.sqrt(power + EPS), np.fft.rfftfreq(frame, 1 / rate)
        flatness = np.exp(np.log(power + EPS).mean(axis=1)) / (power.mean(axis=1) + EPS)
        centroid = (magnitude @ hz) / (magnitude.sum(axis=1) + EPS)
        yield "frame", np.zeros(len(starts), np.int64), [flatness, centroid, np.sqrt((frames**2).mean(axis=1))]
        yield "power", np.arange(len(hz)), [power.sum(axis=0), hz, np.full(len(hz), float(len(starts)))]
    lags = _lags(rate)
    pairs = np.clip(len(x) - lags, 0, len(own))
    sums = np.concatenate([[0.0], np.cumsum(x)])
    products = np.array([own[:n] @ x[k : k + n] for k, n in zip(lags, pairs, strict=True)])
    yield "lag", lags, [products, sums[pairs] + sums[lags.clip(max=len(x)) + pairs] - sums[lags.clip(max=len(x))], pairs.astype(float)]
    yield "all", np.zeros(1, np.int64), [np.array([own.sum()]), np.array([float(len(own))]), np.array([float((np.abs(own) >= at).sum())])]


def describe_chunks(chunks: DataFrame, at: float = 0.999, rate: int = RATE, size: int = CHUNK) -> DataFrame:
    """The eight descriptors of each clip in ``chunks``; see ``acoustic_features``.

    A chunk gives sums that add up over a clip, so only frames' levels and sums of powers and of
    products at the lags of a voice leave a task, and the clip's mean is taken out of the products afterwards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for call, x in zip(b["call_id"], b["x"], strict=True):
                for kind, i, values in _described(np.asarray(x, float), rate, size, at):
                    yield pd.DataFrame({"call_id": call, "kind": kind, "i": i} | {f"v{k}": v for k, v in enumerate(values)})

    parts = chunks.select("call_id", "x").mapInPandas(run, f"call_id {dict(chunks.dtypes)['call_id']}, kind string, i long, v0 double, v1 double, v2 double")
    level = F.expr("percentile(v2, 0.1) FILTER (WHERE kind = 'frame')").alias("level")
    sums = parts.groupBy("call_id", "kind", "i").agg(*(F.sum(f"v{k}").alias(f"s{k}") for k in range(3)), *(f(f"v{k}").alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("std", F.stddev_pop))), level)
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    slope = F.regr_slope(F.when(F.col("kind") == "power", F.ln(F.col("s0") / F.col("s2") + EPS)), F.when((F.col("kind") == "power") & (F.col("mean1") > 0), F.ln("mean1")))
    lags = F.collect_list(F.when(F.col("kind") == "lag", F.struct("i", F.col("s0").alias("p"), F.col("s1").alias("s"), F.col("s2").alias("n"))))
    clips = sums.groupBy("call_id").agg(
        *(one("frame", c).alias(c) for c in ("mean0", "std0", "mean1", "std1", "level")), slope.alias("slope"), lags.alias("lags"),
        *(one("all", f"s{k}").alias(f"s{k}") for k in range(3)),
    )
    mean = F.col("s0") / F.col("s1")
    centred = F.transform(F.filter("lags", lambda v: v["n"] > 0), lambda v: F.struct(v["i"].alias("i"), (v["p"] - mean * v["s"] + mean * mean * v["n"]).alias("a")))
    energy = F.filter("centred", lambda v: v["i"] == 0)[0]["a"]
    peak = F.array_max(F.transform(F.filter("centred", lambda v: v["i"] > 0), lambda v: v["a"]))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return clips.withColumn("centred", centred).select(
        "call_id", zero(F.col("mean0")).alias("flatness_mean"), zero(F.col("std0")).alias("flatness_std"), zero(F.col("mean1")).alias("centroid_mean"), zero(F.col("std1")).alias("centroid_std"),
        zero(F.when((F.col("s1") >= LEAST_PITCHED) & (energy > EPS), peak / (energy + EPS))).alias("f0_stability"), zero(F.col("slope")).alias("ltas_tilt"),
        zero(F.when(F.col("level").isNotNull(), 20 * F.log10(F.greatest("level", F.lit(EPS))))).alias("silence_db"), (F.col("s2") / F.greatest("s1", F.lit(1.0))).alias("clipping"),
    )


def acoustic_features(clips: DataFrame, at: float = 0.999, rate: int = RATE, size: int = CHUNK) -> DataFrame:
    """The eight descriptors of each clip {call_id, x ARRAY<DOUBLE>}: flatness and centroid of frames of 25 ms (mean and deviation), the highest
    peak of the clip's normalised autocorrelation between 50 and 500 Hz, the slope of log power over log frequency, the 10th
    percentile of the frames' levels in dB, and the share of samples at full scale.

    A clip shorter than a frame has no frames and zeros for what comes from them; an empty or null one has zeros only.
    """
    return describe_chunks(chunks_of_clips(clips, rate, size), at, rate, size)


def mel_filters(rate: int = RATE, n_fft: int = N_FFT, bands: int = BANDS, low: float = LOWEST_HZ) -> np.ndarray:
    """Triangular filters over frequency bins, bands x (n_fft / 2 + 1); corners are rounded down to bins and lie at least one bin apart."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    corners = 700 * (10 ** (np.linspace(mel(low), mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.clip(np.floor((n_fft + 1) * corners / rate), 0, n_fft // 2)[:, None]
    left, k = bins[:-2], np.arange(n_fft // 2 + 1)[None, :]
    middle = np.maximum(bins[1:-1], left + 1)
    right = np.where(bins[2:] == middle, middle + 1, bins[2:])
    rising, falling = (k - left) / (middle - left), (right - k) / np.where(right == middle, 1, right - middle)
    return np.where((k >= left) & (k < middle), rising, np.where((k >= middle) & (k < right), falling, 0.0))


def log_mel_frames(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """{call_id, frame, m ARRAY<DOUBLE>}: log energies of BANDS mel bands, a row for each hop; a clip shorter than a window is filled with zeros."""
    filters, window = mel_filters(), np.hamming(N_FFT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for call, chunk, x in zip(b["call_id"], b["chunk"], b["x"], strict=True):
                x = np.asarray(x, float)
                if chunk == 0 and len(x) < N_FFT:
                    x = np.pad(x, (0, N_FFT - len(x)))
                starts = np.arange(0, max(min(size, len(x) - N_FFT + 1), 0), HOP)
                if len(starts):
                    power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, N_FFT)[starts] * window)) ** 2 / N_FFT
                    yield pd.DataFrame({"call_id": call, "frame": chunk * (size // HOP) + starts // HOP, "m": list(np.log(power @ filters.T + 1e-10))})

    return chunks.select("call_id", "chunk", "x").mapInPandas(run, f"call_id {dict(chunks.dtypes)['call_id']}, frame long, m array<double>")


def log_mel(clips: DataFrame, size: int = CHUNK) -> DataFrame:
    """{call_id, frame, m ARRAY<DOUBLE>}: log-mel frames of {call_id, x ARRAY<DOUBLE>}, each band z-scored over its clip, each frame of length 1.

    The bands' means and deviations come from an aggregate and are joined back; no clip is gathered.
    """
    frames = log_mel_frames(chunks_of_clips(clips, size=size), size)
    over = lambda f: F.array(*(f(F.col("m")[k]) for k in range(BANDS)))
    norms = frames.groupBy("call_id").agg(over(F.avg).alias("means"), over(F.stddev_pop).alias("stds"))
    centred = F.zip_with("m", "means", lambda a, b: a - b)
    rows = frames.join(norms, "call_id").select("call_id", "frame", F.zip_with(centred, "stds", lambda a, b: a / F.when(b < 1e-8, 1.0).otherwise(b)).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda t, v: t + v * v))
    return rows.withColumn("length", length).select("call_id", "frame", F.transform("m", lambda v: v / F.when(F.col("length") < 1e-8, 1.0).otherwise(F.col("length"))).alias("m"))


def normalize_frames(cells: DataFrame) -> DataFrame:
    """{call_id, frame, band, x}: each band z-scored over the clip (a std below 1e-8 counts as 1), each frame scaled to length 1 (one below 1e-8 stays)."""
    std = F.stddev_pop("x").over(W.partitionBy("call_id", "band"))
    z = (F.col("x") - F.avg("x").over(W.partitionBy("call_id", "band"))) / F.when(std < 1e-8, 1.0).otherwise(std)
    rows = cells.select("call_id", "frame", "band", z.alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("call_id", "frame")))
    return rows.withColumn("x", F.col("x") / F.when(norm < 1e-8, 1.0).otherwise(norm))


def cosine_cost(a, b):
    """1 minus the dot product of two unit arrays."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


class Warp:
    """The least cosine cost of warping a whole template onto any stretch of a query that arrives frame by frame."""

    def __init__(self, template: np.ndarray) -> None:
        self.template, self.column, self.best = template, None, float("inf")

    def add(self, frame: np.ndarray) -> None:
        c = 1 - self.template @ frame
        reach = np.full(len(c), np.inf)
        if self.column is not None:
            reach = np.minimum(self.column, np.concatenate([[np.inf], self.column[:-1]]))
        reach[0] = 0  # the stretch may begin anywhere
        # Going on in the template at one query frame adds costs: a running minimum over prefix sums.
        total = np.cumsum(c)
        self.column = np.minimum.accumulate(reach + c - total) + total
        self.best = min(self.best, float(self.column[-1]) / len(c))


def dtw_cost(query: np.ndarray, template: np.ndarray) -> float:
    """The least cosine cost of warping the whole template onto any stretch of the query, per template frame."""
    if not len(query) or not len(template):
        return float("inf")
    warp = Warp(template)
    for frame in query:
        warp.add(frame)
    return warp.best


def template_dtw_score(mels: DataFrame, bank: list[list[list[float]]]) -> DataFrame:
    """{call_id, score}: the best warp of any template of the small bank onto the frames {call_id, frame, m} of a clip.

    Frames pass in order, and a task holds one column of the warping table for each template, however long the clip.
    """
    templates = [np.asarray(t, float) for t in bank if len(t)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, warps = None, None
        for b in batches:
            done = []
            for c, m in zip(b["call_id"], b["m"], strict=True):
                if warps is None or c != call:
                    if warps is not None:
                        done.append((call, min((w.best for w in warps), default=float("inf"))))
                    call, warps = c, [Warp(t) for t in templates]
                for w in warps:
                    w.add(np.asarray(m, float))
            yield pd.DataFrame(done, columns=["call_id", "score"])
        if warps is not None:
            yield pd.DataFrame([(call, min((w.best for w in warps), default=float("inf")))], columns=["call_id", "score"])

    kind = dict(mels.dtypes)["call_id"]
    return mels.select("call_id", "frame", "m").repartition("call_id").sortWithinPartitions("call_id", "frame").mapInPandas(run, f"call_id {kind}, score double")
