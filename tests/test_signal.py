"""Hysteresis against a state machine, audio round trip, warping, throttling, calibration."""

import json
import random
import struct
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators import acoustic, calibrate, events, monitor, semantic, vad
from parley.operators.gates import gate_class_balance
from parley.plans import q_signal
from parley.sources import readers, sinks
from parley.streaming import jobs


def machine(mask, on, off):
    out, start, run, speech = [], 0, 0, False
    for i, a in enumerate(mask):
        run = run + 1 if i and a == mask[i - 1] else 1
        if not speech and a and run == on:
            speech, start = True, i - on + 1
        elif speech and not a and run == off:
            speech = False
            out.append((start, i - off + 1))
    return out + [(start, len(mask))] * speech


def test_hysteresis(spark):
    rng = random.Random(1)
    masks = [[rng.random() < 0.5 for _ in range(rng.randrange(1, 40))] for _ in range(200)]
    rows = [(k, 0, i, a) for k, m in enumerate(masks) for i, a in enumerate(m)]
    act = spark.createDataFrame(rows, "call_id int, channel int, i long, active boolean")
    got = sorted((r["call_id"], r["f0"], r["f1"]) for r in vad.hysteresis(act, 2, 3).collect())
    assert got == sorted((k, a, b) for k, m in enumerate(masks) for a, b in machine(m, 2, 3))


def test_audio(spark):
    x = (np.sin(np.arange(1600) / 5) * 20000).astype("<i2")
    both = np.stack([x, np.zeros_like(x)], axis=1).tobytes()
    wav = b"RIFF" + struct.pack("<I", 36 + len(both)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(both)) + both
    files = spark.createDataFrame([(1, bytearray(wav)), (2, bytearray(b"no audio"))], "call_id long, content binary")
    got = readers.explode_audio(files).collect()
    assert [r["error"] for r in got if r["call_id"] == 2] == ["not a WAV file"]
    assert {r["channel"]: r["db"] for r in got if r["call_id"] == 1 and r["i"] == 0}[1] == -100.0
    h = readers.wav_header(files.selectExpr("call_id AS path", "content")).orderBy("path").collect()
    assert tuple(h[0])[1:] == (2, 8000, 16) and tuple(h[1])[1:] == (None, None, None)


def test_audio_of_whole_texts(spark, sf_dir):
    """Texts of any length become samples and levels to their last full frame."""
    frames = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        width = 2 if r["doc_id"] % 7 == 0 else 4
        frames[r["doc_id"]] = max(0, (len(r["text"].encode()) // width - 160) // 80 + 1) * width // 2
    assert any(n > 4000 // 4 // 80 * 2 for n in frames.values())
    files = q_signal._wavs(spark, sf_dir).selectExpr("doc_id AS call_id", "content")
    got = readers.explode_audio(files)
    assert {r["call_id"]: r["count"] for r in got.groupBy("call_id").count().collect()} == {k: n for k, n in frames.items() if n}
    chunks = readers.explode_audio(files, chunk_frames=3)
    assert got.exceptAll(chunks).count() == chunks.exceptAll(got).count() == 0


def test_audio_batches(spark, monkeypatch):
    """Many short files, some broken or null, come in few batches, and in batches of any size are the same."""
    wav = lambda n: b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", n) + bytes(n)
    rows = [(k, None if k % 50 == 0 else bytearray(b"x" if k % 7 == 0 else wav(k * 4))) for k in range(400)]
    files = spark.createDataFrame(rows, "call_id long, content binary").coalesce(1)
    got = readers.explode_audio(files)
    want = [(k, None if bad else 0, None if bad else i, None if bad else -100.0, "not a WAV file" if bad else None) for k, c in rows for bad in [c is None or len(c) == 1] for i in range(1 if bad else max(0, (k * 2 - 160) // 80 + 1))]
    assert list(map(tuple, got.collect())) == want
    batches = lambda: sum(r[0] for r in readers.explode_audio(files).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [1]}) for _ in bs), "n long").collect())
    assert batches() <= 3
    monkeypatch.setattr(readers, "BATCH_FRAMES", 7)
    assert list(map(tuple, readers.explode_audio(files).collect())) == want


def test_warping():
    rng = np.random.default_rng(0)
    q = rng.normal(size=(20, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    t = q[5:9]
    assert acoustic.dtw_cost(q, t) == pytest.approx(0, abs=1e-12)
    # Against the full table.
    u = rng.normal(size=(6, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cost = 1 - u @ q.T
    d = np.full(cost.shape, np.inf)
    d[0] = cost[0]
    for i in range(1, len(u)):
        for j in range(len(q)):
            d[i, j] = cost[i, j] + min(d[i - 1, j], d[i, j - 1] if j else np.inf, d[i - 1, j - 1] if j else np.inf)
    assert acoustic.dtw_cost(q, u) == pytest.approx(d[-1].min() / len(u))
    assert acoustic.dtw_cost(q[:0], t) == float("inf")


def test_descriptors_of_a_sine(spark):
    """200 Hz: a peak of the autocorrelation near 1, a centroid at 200 Hz, a level of -3 dB below full scale; noise has neither pitch nor a flat tilt."""
    t = np.arange(80_000) / 8000
    rng = np.random.default_rng(4)
    clips = {"sine": np.sin(2 * np.pi * 200 * t), "quiet": 0.001 * np.sin(2 * np.pi * 200 * t) + 0.4, "noise": rng.normal(0, 0.1, 30_000), "loud": np.clip(3 * np.sin(2 * np.pi * 100 * t[:9000]), -1, 1)}
    rows = {r["call_id"]: r for r in acoustic.acoustic_features(spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()], "call_id string, x array<double>")).collect()}
    assert rows["sine"]["f0_stability"] == pytest.approx(1, abs=0.01) and rows["sine"]["silence_db"] == pytest.approx(-3.01, abs=0.1)
    assert rows["sine"]["centroid_mean"] == pytest.approx(200, abs=15) and rows["sine"]["flatness_mean"] < 0.01 < 0.4 < rows["noise"]["flatness_mean"]
    assert rows["quiet"]["f0_stability"] == pytest.approx(1, abs=0.01)  # the mean is taken out over the whole clip
    assert rows["noise"]["f0_stability"] < 0.1 and abs(rows["noise"]["ltas_tilt"]) < 0.1 and rows["sine"]["ltas_tilt"] < -1
    assert rows["sine"]["clipping"] == pytest.approx(np.mean(np.abs(clips["sine"]) >= 0.999)) and 0.7 < rows["loud"]["clipping"] < 0.8


def _slow_descriptors(x, rate=8000):
    """The eight descriptors of a whole clip at once."""
    x = np.asarray(x, float)
    starts = range(0, len(x) - 199, 80)
    frames = [x[s : s + 200] for s in starts]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200)
    power = [np.abs(np.fft.rfft(f * window)) ** 2 for f in frames]
    hz = np.arange(101) * 40.0
    out = [0.0] * 7
    if frames:
        flat = [np.exp(np.log(p + 1e-12).mean()) / (p.mean() + 1e-12) for p in power]
        cent = [(np.sqrt(p + 1e-12) * hz).sum() / (np.sqrt(p + 1e-12).sum() + 1e-12) for p in power]
        level = 20 * np.log10(max(1e-12, np.percentile([np.sqrt((f**2).mean()) for f in frames], 10)))
        out = [np.mean(flat), np.std(flat), np.mean(cent), np.std(cent), 0.0, np.polyfit(np.log(hz[1:]), np.log(np.mean(power, axis=0)[1:] + 1e-12), 1)[0], level]
    if len(x) >= 256:
        c = x - x.mean()
        auto = [c[: len(c) - k] @ c[k:] for k in range(min(len(c) - 1, 160) + 1)]
        out[4] = max(auto[16:]) / (auto[0] + 1e-12) if auto[0] > 1e-12 else 0.0
    return [*out, (np.abs(x) >= 0.999).sum() / max(1, len(x))]


NAMES = ["flatness_mean", "flatness_std", "centroid_mean", "centroid_std", "f0_stability", "ltas_tilt", "silence_db", "clipping"]


@pytest.mark.parametrize("size", [80, 160, 240, 4000])
def test_descriptors_over_chunks(spark, size):
    """The same over one chunk or many, of arrays or of samples in any order; short, empty, null and constant clips."""
    rng = np.random.default_rng(size)
    clips = {n: rng.normal(0.1, 0.3, n) for n in (0, 1, 79, 80, 81, 199, 200, 255, 256, 279, 280, 400, 1000, 1601)} | {5000: np.zeros(500), 5001: np.full(600, 0.5)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()] + [(-1, None)], "call_id long, x array<double>")
    samples = spark.createDataFrame([(k, i, float(x)) for k, v in clips.items() for i, x in enumerate(v)], "call_id long, i long, x double").repartition(3)
    want = {k: _slow_descriptors(v) for k, v in clips.items()} | {-1: [0.0] * 8}
    for got, keys in ((acoustic.acoustic_features(df, size=size), set(want)), (acoustic.describe_chunks(acoustic.chunks_of_samples(samples, size=size), size=size), set(want) - {0, -1})):
        rows = {r["call_id"]: [r[c] for c in NAMES] for r in got.collect()}
        assert set(rows) == keys
        for k, row in rows.items():
            assert row == pytest.approx(want[k], rel=1e-7, abs=1e-7), k


@pytest.mark.parametrize("size", [80, 320, 64_000])
def test_log_mel_over_chunks(spark, size):
    rng = np.random.default_rng(size)
    clips = {n: rng.normal(0, 0.3, n) for n in (0, 1, 255, 256, 335, 336, 900, 1700)}
    got = {}
    for r in acoustic.log_mel(spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()], "call_id long, x array<double>"), size).collect():
        got.setdefault(r["call_id"], {})[r["frame"]] = r["m"]
    for n, x in clips.items():
        x = np.pad(x, (0, max(256 - n, 0)))
        power = np.array([np.abs(np.fft.rfft(x[s : s + 256] * np.hamming(256))) ** 2 / 256 for s in range(0, len(x) - 255, 80)])
        m = np.log(power @ acoustic.mel_filters().T + 1e-10)
        std = m.std(axis=0)
        z = (m - m.mean(axis=0)) / np.where(std < 1e-8, 1, std)
        length = np.linalg.norm(z, axis=1, keepdims=True)
        z /= np.where(length < 1e-8, 1, length)
        assert sorted(got[n]) == list(range(len(z)))
        assert np.array([got[n][k] for k in range(len(z))]) == pytest.approx(z, abs=1e-6)


def test_mel_filters():
    """Each filter rises to 1 at one bin and meets no bin below 50 Hz; neighbours overlap."""
    f = acoustic.mel_filters()
    assert f.shape == (32, 129) and (f.max(axis=1) == 1).all() and (f >= 0).all() and (f[:, 0] == 0).all()
    assert (np.diff(f.argmax(axis=1)) > 0).all()


def test_scores_of_warped_frames(spark):
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 4)))
    clips, bank = {k: unit(5 + 7 * k) for k in range(6)}, [unit(3), unit(9)]
    rows = [(k, i, m.tolist()) for k, v in clips.items() for i, m in enumerate(v)]
    df = spark.createDataFrame(rows, "call_id long, frame long, m array<double>").repartition(3)
    got = {r["call_id"]: r["score"] for r in acoustic.template_dtw_score(df, [t.tolist() for t in bank]).collect()}
    assert got == pytest.approx({k: min(acoustic.dtw_cost(v, t) for t in bank) for k, v in clips.items()})
    assert acoustic.template_dtw_score(df.limit(0), [bank[0].tolist()]).count() == 0


def test_throttle(spark):
    rng = random.Random(2)
    rows = sorted((rng.choice("ab"), rng.randrange(3000)) for _ in range(300))
    e = spark.createDataFrame(rows, "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts")
    want = []
    for k in "ab":
        last = None
        for s in sorted(s for x, s in rows if x == k):
            if last is None or s - last >= 60:
                want.append((k, s))
                last = s
    assert sorted(map(tuple, monitor.incident_throttle(e, 60).selectExpr("key", "unix_seconds(ts)").collect())) == want


def test_throttle_over_batches(spark):
    """A burst that spans many batches, rows without key or time, repeated rows, no rows."""
    times = [s for s in range(0, 400, 7)] * 2
    rows = [(k, s) for k in ("a", None) for s in times] + [("a", None)]
    e = spark.createDataFrame(rows, "key string, s long").selectExpr("key", "timestamp_seconds(s) AS ts")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    got = [(r[0], r[1]) for r in monitor.incident_throttle(e, 60).selectExpr("key", "unix_seconds(ts)").collect()]
    spark.conf.set(size, before)
    assert sorted(got, key=str) == sorted([(k, s) for k in ("a", None) for s in range(0, 400, 63)], key=str)
    assert monitor.incident_throttle(e.limit(0), 60).count() == 0


def test_late_rows(spark, tmp_path):
    """Late rows of a second run are folded into their bucket, and a reader doesn't see the open minute."""
    source, schema = f"{tmp_path}/in", "ts timestamp, is_synthetic boolean, confidence double, latency_ms int"
    for rows in ([("2024-01-01 10:00:10", True, 0.5, 3), ("2024-01-01 10:05:00", False, 0.5, 5)], [("2024-01-01 10:00:50", False, 0.25, 4)]):
        spark.createDataFrame(rows, "ts string, is_synthetic boolean, confidence double, latency_ms int").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "is_synthetic", "confidence", "latency_ms").write.mode("append").parquet(source)
        jobs.start_stats(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/stats", f"{tmp_path}/state").awaitTermination()
    now = monitor.F.lit("2024-01-01 10:05:30").cast("timestamp")
    got = jobs.read_stats(spark, f"{tmp_path}/stats", now).collect()
    assert [(r["n"], r["n_synthetic"], r["latency_sum"], r["confidence_sum"]) for r in got] == [(2, 1, 7, 0.75)]
    assert jobs.read_stats(spark, f"{tmp_path}/stats").count() == 2


def test_shared_frames(spark):
    rng = random.Random(5)
    sides = [[(c, s / 100, (s + rng.randrange(40)) / 100) for c in range(4) for s in rng.sample(range(300), c * 3)] for _ in range(2)]
    frames = lambda turns, c: {f for k, s, e in turns if k == c for f in range(int(s * 1000 // 10), int(e * 1000 // 10))}
    got = vad.shared_frames(*(spark.createDataFrame(t, "call_id int, s double, e double") for t in sides), ("call_id",)).collect()
    assert sorted(r["call_id"] for r in got) == [1, 2, 3]
    for r in got:
        p, g = (frames(t, r["call_id"]) for t in sides)
        assert (r["n_pred"], r["n_gold"], r["n_both"]) == (len(p), len(g), len(p & g))


def test_best_setting(spark):
    rows = [("a", 4, 10, 150, 150, 0.5, 1, 1.125), ("b", 4, 10, 150, 250, 0.5, 1, 0.9375), ("c", 6, 10, 150, 150, 0.5, 1, 1.0625), ("d", 4, 15, 150, 150, 0.4, 1, 1.0)]
    tried = spark.createDataFrame(rows, "combo string, offset_db int, off_frames int, min_speech_ms int, min_gap_ms int, median_f1 double, n_turns long, ratio double")
    assert vad.best_vad_params(tried).first()["combo"] == "b"
    assert vad.best_vad_params(tried.filter("combo <> 'b'")).first()["combo"] == "c"
    assert vad.param_grid(spark).count() == 108


def test_label_gaps(spark):
    probes = spark.createDataFrame([("human", True, True), ("human", True, None), ("human", False, True), ("synthetic", True, True)], "label string, has_probe boolean, detected boolean")
    assert tuple(semantic.detection_gap(probes).first()) == (0.5, 1.0, 0.5)
    assert tuple(semantic.detection_gap(probes.filter("label = 'human'")).first()) == (0.5, 0.0, 0.0)
    assert tuple(semantic.answer_gap(spark.createDataFrame([], "label string, text string")).first()) == (0.0, 0.0, 0.0)


def test_metrics_record(spark):
    part = spark.createDataFrame([(1, None)], "seed int, brier double")
    assert sinks.export_metrics([part], ("seed", "brier")).first()[0] == '{"seed":1,"brier":null}'
    for parts, required in (([part], sinks.REQUIRED_KEYS), ([part, part], ())):
        with pytest.raises(ValueError):
            sinks.export_metrics(parts, required)


def test_event_ids(spark):
    rows = [("r1", None, "2024-01-01 10:00:01"), ("r2", "", "2024-01-01 10:00:01"), ("r3", "c", "2024-01-01 10:00:02"), ("r4", None, "2024-01-02 09:00:00"), ("r0", None, None)]
    e = spark.createDataFrame(rows, "request_id string, call_id string, ts string").selectExpr("request_id", "call_id", "CAST(ts AS TIMESTAMP) AS ts")
    got = {r["request_id"]: r["id"] for r in monitor.assign_event_id(e).collect()}
    assert got == {"r0": "evt-1", "r1": "evt-2", "r2": "evt-3", "r3": "c", "r4": "evt-4"}


def test_history_guards(spark):
    assert monitor.lookback_seconds("90m") == 5400 and monitor.lookback_seconds("soon") == 86400
    stats = spark.createDataFrame([], "bucket timestamp, n long, n_synthetic long, p50 double, p95 double, p99 double, confidence double")
    assert monitor.history(stats, "1d", "7m", monitor.F.current_timestamp()).count() == 0


def test_platt_and_fusion(spark):
    rows = spark.createDataFrame([(int(i % 3 == 0), i % 10 / 10 + 0.3 * (i % 3 == 0)) for i in range(300)], "y int, score double")
    a, b = calibrate.platt_fit(rows)
    assert a < 0
    mean = rows.select(calibrate.platt_apply(rows["score"], a, b).alias("p")).agg({"p": "avg"}).first()[0]
    assert mean == pytest.approx(1 / 3, abs=0.02)
    f = rows.select(calibrate.fuse_probability(rows["score"], monitor.F.lit(0.9), 4.0, 0.1).alias("q"), "score").collect()
    assert all(0 <= r["q"] <= 1 and abs(r["q"] - r["score"]) <= 0.1 + 0.4 for r in f)


def test_guards(spark):
    calls = spark.createDataFrame([(1, "human", "train"), (2, "synthetic", "train")], "call_id int, label string, split string")
    with pytest.raises(ValueError):
        readers.read_split(calls, "test")
    assert gate_class_balance(calls).first()["majority_share"] == 0.5
    v = events.verdict(spark.createDataFrame([(0.2,), (0.9,)], "p double"), 0.42).orderBy("p").collect()
    assert [(r["is_synthetic"], r["confidence"]) for r in v] == [(False, 0.8), (True, 0.9)]


def test_requests(spark):
    bodies = [("a", '{"audio":"data:audio/wav;base64,aGk="}'), ("b", '{"other":1}'), ("c", ""), ("d", "aGk"), ("e", '{"wav":"!!"}'), ("f", None)]
    got = {r["call_id"]: (bytes(r["audio"]) if r["audio"] else None, r["error"]) for r in readers.ingest_requests(spark.createDataFrame(bodies, "call_id string, body string")).collect()}
    assert got["a"] == (b"hi", None) and got["b"][1] == "UnknownJsonShape" and got["c"][1] == "EmptyBody" and got["d"] == (b"hi", None) and got["e"][1] == "InvalidBase64" and got["f"][1] == "EmptyBody"


def test_similarity_is_the_library_s_ratio():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abñ ") for _ in range(rng.randrange(25))) for _ in range(2))
        assert semantic.similarity(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def test_best_run():
    """Against every run of words, with long words, long variants and repeated words; few runs are compared letter by letter."""
    rng = random.Random(8)
    words = ["nomina", "plus", "verde", "credito", "la", "de", "x" * 70, "a", "nomin", "9"]
    for variants in (("nomina plus", "credito verde la"), ("la nomina", "credito de la nomina plus verde y de todo lo que se diga de la misma cuenta"), ("ñ",)):
        memo, size = {}, len(variants[0].split())
        for _ in range(60):
            norm = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
            w = norm.split()
            runs = {norm} | {" ".join(w[i : i + n]) for n in range(max(1, size - 3), size + 5) for i in range(len(w) - n + 1)}
            assert semantic.best_run(norm, variants, size - 3, size + 4, memo) == max(SequenceMatcher(None, x, v, autojunk=False).ratio() for x in runs for v in variants)
        assert len(memo) < 500


def test_fuzzy_scores_of_spans(spark):
    """Turns and pairs against brute force over all runs of words; a pair and a single turn that end together stay apart."""
    rng = random.Random(7)
    words = ["esto", "es", "sobre", "su", "cuenta", "nomina", "plus", "o", "credito", "verde", "Gracias.", "sí"]
    turns = [(c, t, rng.choice([1, 1, 0]), " ".join(rng.choice(words) for _ in range(rng.randrange(14)))) for c in range(12) for t in range(5)]
    variants, anchors = ("sobre su cuenta nomina plus", "su credito berde"), ("cuenta", "verde")
    df = spark.createDataFrame(turns, "call_id long, turn_id long, channel int, text string")
    spans = semantic.probe_spans(df)
    got = {(r["call_id"], r["first_turn"], r["turn_id"]): r["score"] for r in semantic.probe_fuzzy_score(spans, variants, anchors).collect()}
    want = {}
    for r in spans.select("call_id", "first_turn", "turn_id", text.normalize_text(F.col("text")).alias("norm")).collect():
        if any(a in r["norm"] for a in anchors):
            w = r["norm"].split()
            runs = {r["norm"]} | {" ".join(w[i : i + n]) for n in range(2, 10) for i in range(len(w) - n + 1)}
            want[r["call_id"], r["first_turn"], r["turn_id"]] = max(SequenceMatcher(None, x, v, autojunk=False).ratio() for x in runs for v in variants)
    assert got == pytest.approx(want) and len({k for k in got if k[1] < k[2]}) > 5
    bounds = spans.select(text.normalize_text(F.col("text")).alias("n")).select("n", semantic.shared_letters(F.col("n"), variants[0]).alias("b")).filter("n <> ''").collect()
    assert all(semantic.similarity(r["n"], variants[0]) <= r["b"] + 1e-12 for r in bounds)
    found = semantic.find_probe_turn(semantic.probe_fuzzy_score(spans, variants, anchors), 0.5).collect()
    for r in found:
        top = max(s for k, s in want.items() if k[0] == r["call_id"])
        assert r["score"] == pytest.approx(top) and r["probe_turn"] == min((k[1:] for k, s in want.items() if k[0] == r["call_id"] and s == top))[1]
    plain = semantic.probe_fuzzy_score(df, variants[:1], anchors)
    assert plain.columns == ["call_id", "turn_id", "score"] and semantic.probe_fuzzy_score(df.limit(0), variants, anchors).count() == 0


@pytest.mark.parametrize("n", [1, 3, 7, 40])
def test_groups_of_peaks(spark, n):
    """Longer and shorter envelopes than groups, against every group's range."""
    rng = random.Random(n)
    rows = [(c, 0, b, rng.random() * 1.2) for c in range(12) for b in range(c * 3 + 1) if rng.random() < 0.9 or b == c * 3]
    want = {}
    for c in {r[0] for r in rows}:
        own = {b: p for k, _, b, p in rows if k == c}
        step = (max(own) + 1) / n
        for g in range(n):
            a = int(g * step)
            if hit := [own[b] for b in range(a, max(a + 1, int((g + 1) * step))) if b in own]:
                want[c, g] = min(max(hit), 1.0)
    df = spark.createDataFrame(rows, "call_id long, channel int, b long, peak double")
    assert {(r["call_id"], r["g"]): r["peak"] for r in events.downsample_peaks(df, n).collect()} == want


def test_review_queue(spark):
    """Many events at one distance, several days, rows without a time, none."""
    rng = random.Random(1)
    rows = [(f"r{i}", None if i % 97 == 0 else f"2024-01-0{1 + i % 3} 10:{i % 60:02d}:00", rng.choice([0.5, 0.5, 0.61, 0.42, 0.9, 0.05])) for i in range(800)]
    df = spark.createDataFrame(rows, "request_id string, ts string, confidence double").withColumn("ts", F.col("ts").cast("timestamp"))
    days = {}
    for r in rows:
        if abs(r[2] - 0.6) <= 0.2:
            days.setdefault(r[1] and r[1][:10], []).append((abs(r[2] - 0.6), r[1] or "", r[0]))
    want = {r[2]: k + 1 for own in days.values() for k, r in enumerate(sorted(own))}
    got = events.review_queue(df, 0.6)
    assert {r["request_id"]: r["priority"] for r in got.collect()} == want and events.review_queue(df.limit(0), 0.6).count() == 0


def test_flip_points(spark):
    """The best weight by prefix sums against every weight tried on every row; clamped, constant and unreachable rows."""
    rng = random.Random(2)
    for delta, threshold in ((1.0, 0.42), (0.05, 0.5), (0.0, 0.3), (1.0, 1e-9)):
        rows = [(rng.randrange(2), rng.choice([0.0, 1.0, 0.42, 0.5, rng.random()]), rng.choice([0.0, 0.5, 1.0, rng.random()])) for _ in range(120)]
        df = spark.createDataFrame(rows, "y int, p double, invention double")
        tried = df.crossJoin(spark.range(-80, 81).select((F.col("id") / 20).alias("w")))
        yes = calibrate.fuse_probability(F.col("p"), F.col("invention"), F.col("w"), delta) >= threshold
        pos = F.col("y") == 1
        tried = tried.groupBy("w").agg(((F.count_if(yes & pos) / F.count_if(pos) + F.count_if(~yes & ~pos) / F.count_if(~pos)) / 2).alias("ba")).collect()
        top = max(r["ba"] for r in tried)
        got = calibrate.select_w(df, threshold, max_delta=delta).first()
        assert got["balanced_accuracy"] == pytest.approx(top) and got["w"] == min(r["w"] for r in tried if r["ba"] > top - 1e-12)
    plan = calibrate.select_w(df, 0.42)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Cartesian" not in plan


def test_rationale(spark):
    """Halves go to the even digit by the value itself, also features without a sentence have a say."""
    rows = [(1, 1, "resp_latency_mean", 0.125, "human", 0.125), (1, 2, "overlap_count", 2.5, "synthetic", 0.405), (1, 3, "new_one", 1.0005, "neutral", 0.005), (1, 4, "speech_balance", 1.0, "human", 0.1), (2, 1, "resp_latency_cv", 1234.565, "human", 1.0)]
    df = spark.createDataFrame(rows, "call_id long, rank int, feature string, value double, direction string, weight double")
    got = {r["call_id"]: r["rationale"] for r in events.rationale(df, spark.createDataFrame([(2, 12)], "call_id long, agent long")).collect()}
    told = lambda v, d: f"{v:.{d}f}"  # noqa: E731  exact, halves to even
    assert got[1] == f"Mean response latency was {told(0.125, 2)}s (resp_latency_mean, human signal, weight {told(12.5, 0)}%). {told(2.5, 0)} caller/agent overlaps were detected (overlap_count, synthetic signal, weight {told(0.405 * 100, 0)}%). new_one measured {told(1.0005, 3)} (new_one, neutral signal, weight {told(0.5, 0)}%)."
    assert got[2] == f"Response latency stayed within CV {told(1234.565, 2)} across 12 agent turns (resp_latency_cv, human signal, weight 100%)."


def test_turn_files(spark, tmp_path):
    """Real files by name; broken ones are error rows and hide no other."""
    texts = {
        "a": '{"turns": [{"channel": 1, "start": 2.5, "end": 3}, {"channel": 0, "start": 0.5, "end": 1.0}], "more": 1}', "b": '{"turns": [{"channel": 0,', "c": '{"turns": []}', "d": " ",
        "e": '{"turns": [{"channel": 0, "start": 1}]}', "f": '{"turns": {"channel": 0}}', "g": "[1]", "h": '{"turns":\n[{"channel": 0, "start": 1, "end": 2}]}\n',
    }
    for name, content in texts.items():
        (tmp_path / f"{name}.json").write_text(content)
    files = {r["call_id"]: r["error"] for r in readers.read_turn_files(spark, str(tmp_path)).collect()}
    assert set(files) == set(texts) and {k for k, e in files.items() if e is None} == {"a", "c", "h"} and files["e"] == "a turn lacks its channel, start or end"
    assert sorted(map(tuple, readers.read_turns(spark, str(tmp_path)).collect())) == [("a", 0, 0, 0.5, 1.0), ("a", 1, 1, 2.5, 3.0), ("h", 0, 0, 1.0, 2.0)]


def test_packed_turn_files(spark, sf_dir, tmp_path):
    """Packed files give what files by themselves give, also empty ones; the queries' files don't grow with the calls."""
    texts = {"a": '{"turns": [{"channel": 1, "start": 2.5, "end": 3}]}', "b": '{"turns": [', "c": "", "d": '{"turns":\n[{"channel": 0, "start": 1, "end": 2}]}\n'}
    (tmp_path / "pack.json").write_text("\n".join(json.dumps({"path": f"x/{k}.json", "content": v}) for k, v in texts.items()) + "\n{cut")
    files = {r["call_id"]: r["error"] for r in readers.read_turn_files(spark, str(tmp_path), packed=True).collect()}
    assert files == {"a": None, "b": "not JSON", "c": "not JSON", "d": None, None: "not JSON"}
    assert sorted(map(tuple, readers.read_turns(spark, str(tmp_path), packed=True).collect())) == [("a", 0, 1, 2.5, 3.0), ("d", 0, 0, 1.0, 2.0)]
    parts = spark.read.text(q_signal._turn_files(spark, sf_dir)).inputFiles()
    assert len(parts) <= 4
