"""Sources: manifests, turns, request logs, audio headers and samples, result files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType().add("call_id", "string").add("label", "string").add("split", "string").add("duration_s", "double")
TURNS_FILE = "turns ARRAY<STRUCT<channel: INT, start: DOUBLE, end: DOUBLE>>"
#: The keys under which a request may carry its audio, in order, and the largest body.
AUDIO_KEYS = ("audio_base64", "audio", "wav", "data", "file", "clip", "content")
MAX_BODY = 16 * 1024 * 1024
#: Levels of frames to a batch.
BATCH_FRAMES = 65_536


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, mode="FAILFAST")


def turns_from_array(files: DataFrame) -> DataFrame:
    """{call_id, turns ARRAY} as rows numbered by start; ties keep the file's order."""
    rows = files.select("call_id", F.posexplode("turns").alias("pos", "x"))
    number = F.row_number().over(W.partitionBy("call_id").orderBy("x.start", "pos")) - 1
    return rows.select("call_id", number.alias("turn_id"), F.col("x.channel").alias("channel"), F.col("x.start").alias("s"), F.col("x.end").alias("e"))


def read_turn_files(spark: SparkSession, path: str, name: str = r"([^/]+)\.json$", packed: bool = False) -> DataFrame:
    """{call_id, turns ARRAY, error}: one JSON file per call, whose id is the first group of ``name`` in the file's path.

    A file that is no JSON object with a list of turns of whole numbers and seconds is a row with its error and no turns; Spark's sources pass over files without a byte, so these give no row.
    ``packed``: the files lie in JSON lines {path, content}, many to a file, which spares listing and opening each; such may be without a byte, and a line that can't be read is a row without an id.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    files = reader.schema("path STRING, content STRING").json(path) if packed else reader.format("binaryFile").load(path).withColumn("content", F.decode("content", "UTF-8"))
    raw = files.select(F.regexp_extract("path", name, 1).alias("call_id"), F.col("content").alias("value"))
    parsed = F.from_json("value", f"{TURNS_FILE}, bad STRING", {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"})
    rows = raw.withColumn("x", parsed)
    lacking = F.exists("x.turns", lambda t: t.isNull() | t["channel"].isNull() | t["start"].isNull() | t["end"].isNull())
    error = F.when(F.col("value").isNull() | F.col("x.bad").isNotNull() | F.col("x").isNull() | ~F.col("value").rlike(r"\S"), "not JSON").when(F.col("x.turns").isNull(), "no turns").when(lacking, "a turn lacks its channel, start or end")
    rows = rows.select("call_id", F.col("x.turns").alias("turns"), error.alias("error"))
    return rows.withColumn("turns", F.when(F.col("error").isNull(), F.col("turns")))


def read_turns(spark: SparkSession, path: str, name: str = r"([^/]+)\.json$", packed: bool = False) -> DataFrame:
    """{call_id, turn_id, channel, s, e} of all files of ``read_turn_files`` without an error."""
    return turns_from_array(read_turn_files(spark, path, name, packed).filter("error IS NULL"))


def read_split(rows: DataFrame, split: str | None) -> DataFrame:
    """Rows of one split; any name but train and val is refused."""
    if split not in ("train", "val", None):
        raise ValueError(f"unknown split: {split!r}")
    return rows if split is None else rows.filter(F.col("split") == split)


def read_check_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file {summary, results} as a row per call."""
    schema = "results ARRAY<STRUCT<is_synthetic: BOOLEAN, confidence: DOUBLE, latency_s: DOUBLE, call_id: STRING, label: STRING>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("results"))


def ingest_requests(requests: DataFrame, max_bytes: int = MAX_BODY) -> DataFrame:
    """{call_id, audio, error} of {call_id, body}, the body text or binary.

    A JSON body gives the first of the audio keys that holds a string, a body with the head of a
    WAV file is the audio itself, any other is base64 as it stands. JSON is parsed once.
    """
    text = F.col("body").cast("string")
    rows = requests.select("call_id", F.col("body").cast("binary").alias("raw"), text.alias("text"), F.startswith(F.trim(text), F.lit("{")).alias("is_json"))
    rows = rows.withColumn("json", F.from_json(F.when(F.col("is_json"), F.col("text")), ", ".join(f"{k} VARIANT" for k in AUDIO_KEYS)))
    strings = [F.when(F.schema_of_variant(F.col("json")[k]) == "STRING", F.variant_get(F.col("json")[k], "$", "string")) for k in AUDIO_KEYS]
    rows = rows.select("call_id", "raw", "text", "is_json", F.coalesce(*strings).alias("value"))
    is_wav = (F.substring("raw", 1, 4) == F.lit(b"RIFF")) & (F.substring("raw", 9, 4) == F.lit(b"WAVE"))
    code = F.regexp_replace(F.regexp_replace(F.when(F.col("is_json"), F.col("value")).when(~is_wav, F.col("text")), r"^\s*data:[^,]*,", ""), r"\s+|=+\s*$", "")
    rows = rows.withColumn("is_wav", ~F.col("is_json") & is_wav).withColumn("code", F.translate(code, "-_", "+/"))
    padded = F.rpad("code", (F.ceil(F.length("code") / 4) * 4).cast("int"), F.lit("="))
    rows = rows.withColumn("audio", F.when(F.col("is_wav"), F.col("raw")).when(F.length("code") % 4 != 1, F.try_to_binary(padded, F.lit("base64"))))
    error = (
        F.when(F.octet_length("raw") > max_bytes, "BodyTooLarge").when(F.col("text").isNull() | (F.trim("text") == ""), "EmptyBody")
        .when(F.col("is_json") & F.col("value").isNull(), "UnknownJsonShape").when(F.col("audio").isNull(), F.when(F.col("is_json"), "InvalidBase64").otherwise("UnrecognizedFormat"))
    )
    return rows.withColumn("error", error).select("call_id", F.when(F.col("error").isNull(), F.col("audio")).alias("audio"), "error")


def _le(content: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number of n bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + n - i, 1)) for i in range(n)]), 16, 10).cast("long")


def wav_header(files: DataFrame) -> DataFrame:
    """{path, channels, rate, bits} of {path, content}; nulls where the head is not a WAV file's."""
    c = F.col("content")
    is_wav = (F.substring(c, 1, 4) == F.lit("RIFF").cast("binary")) & (F.substring(c, 9, 4) == F.lit("WAVE").cast("binary"))
    return files.select("path", *[F.when(is_wav, _le(c, at, n)).alias(name) for name, at, n in (("channels", 22, 2), ("rate", 24, 4), ("bits", 34, 2))])


def wav_census(files: DataFrame, channels: int = 2, rate: int = 8000, bits: int = 16) -> tuple[DataFrame, DataFrame]:
    """(files per format, paths of files in another format)."""
    h = wav_header(files)
    ok = (F.col("channels") == channels) & (F.col("rate") == rate) & (F.col("bits") == bits)
    return h.groupBy("channels", "rate", "bits").agg(F.count(F.lit(1)).alias("n")), h.filter(~F.coalesce(ok, F.lit(False))).select("path")


def gate_dataset_format(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """{n_files, n_bad, passed, has_speaker_id}: all files {path, content} in the expected format; whether the manifest names speakers."""
    _, bad = wav_census(files)
    named = bool({"speaker_id", "speaker"} & set(manifest.columns))
    counted = files.agg(F.count(F.lit(1)).alias("n_files")).crossJoin(bad.agg(F.count(F.lit(1)).alias("n_bad")))
    return counted.select("n_files", "n_bad", (F.col("n_bad") == 0).alias("passed"), F.lit(named).alias("has_speaker_id"))


def content_sha256(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def header_mismatch(requests: DataFrame) -> DataFrame:
    """Warnings {call_id, field, declared, found} where {declared_rate, declared_channels} differ from the header's {rate, channels}; the header wins."""
    pairs = F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"declared_{x}").alias("declared"), F.col(x).alias("found")) for x in ("rate", "channels")])
    return requests.select("call_id", F.inline(pairs)).filter(F.col("declared").isNotNull() & (F.col("declared") != F.col("found")))


def decode_wav(content: bytes, scale: float = 32767.0) -> tuple[int, np.ndarray]:
    """(rate, samples by channel) of a PCM file of 16 or 32 bits or floats; raises ValueError for others."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", content, at + 8)
        elif name == b"data":
            break
        at += 8 + size + size % 2
    else:
        raise ValueError("no samples")
    if fmt is None or fmt[1] not in (1, 2) or (fmt[0], fmt[5]) not in ((1, 16), (1, 32), (3, 32)):
        raise ValueError("unsupported format")
    kind = {(1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}[fmt[0], fmt[5]]
    data = content[at + 8 : at + 8 + size]
    x = np.frombuffer(data[: len(data) - len(data) % (fmt[5] // 8 * fmt[1])], kind).astype(np.float64)
    x = x if kind == "<f4" else x / (scale if kind == "<i2" else 2147483647.0)
    return fmt[2], x.reshape(-1, fmt[1]).T


def explode_audio(files: DataFrame, frame_ms: int = 20, hop_ms: int = 10, floor_db: float = -100.0, chunk_frames: int = 8192) -> DataFrame:
    """{call_id, channel, i, db, error} of {call_id, content}: levels of full frames, ``chunk_frames`` at a time; a file that can't be read is one error row.

    Levels go out in batches of about ``BATCH_FRAMES``, however short the files are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []  # (row, channel, first frame, levels, error)
            size = 0

            def flush(calls: pa.Array = b.column(0)) -> pa.RecordBatch:
                n = [len(p[3]) for p in parts]
                each = lambda k, kind: pa.array([p[k] for p in parts], kind).take(pa.array(np.repeat(np.arange(len(parts)), n)))
                i, db = np.concatenate([np.arange(p[2], p[2] + len(p[3])) for p in parts]), np.concatenate([p[3] for p in parts])
                failed = np.repeat([p[4] is not None for p in parts], n)
                columns = [calls.take(each(0, pa.int64())), each(1, pa.int32()), pa.array(i, pa.int64(), mask=failed), pa.array(db, pa.float64(), mask=failed), each(4, pa.string())]
                parts.clear()
                return pa.RecordBatch.from_arrays(columns, ["call_id", "channel", "i", "db", "error"])

            for row, content in enumerate(b.column(1)):
                try:
                    rate, channels = decode_wav(content.as_py() or b"")
                except ValueError as e:
                    parts.append((row, None, 0, np.zeros(1), str(e)))
                    size += 1
                    channels = ()
                for c, x in enumerate(channels):
                    frame, hop = rate * frame_ms // 1000, rate * hop_ms // 1000
                    for at in range(0, (len(x) - frame) // hop + 1, chunk_frames):
                        part = x[at * hop : (at + chunk_frames - 1) * hop + frame]
                        power = (np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] ** 2).mean(axis=1)
                        parts.append((row, c, at, np.maximum(10 * np.log10(np.maximum(power, 1e-20)), floor_db), None))
                        size += len(power)
                        if size >= BATCH_FRAMES:
                            yield flush()
                            size = 0
            if parts:
                yield flush()

    kind = dict(files.dtypes)["call_id"]
    return files.select("call_id", "content").mapInArrow(run, f"call_id {kind}, channel int, i long, db double, error string")


def reconcile_schema(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns of ``defaults`` {name: (type, value)} that are missing, and fills nulls in the others; doing it again changes nothing."""
    made = {}
    for name, (kind, value) in defaults.items():
        fallback = F.lit(value).cast(kind)
        made[name] = F.coalesce(F.col(name).cast(kind), fallback) if name in rows.columns else fallback
    return rows.withColumns(made)


def validate_record(records: DataFrame, rules: list[dict]) -> DataFrame:
    """{id, field, problem}: records {id, json} against rules {field, required, type, enum, min, max, strict, length}."""
    checks = []
    for r in rules:
        v = F.get_json_object("json", f"$.{r['field']}")
        number = v.try_cast("double")
        below = (number <= r["min"]) if r.get("strict") and "min" in r else (number < r["min"]) if "min" in r else F.lit(False)
        above = (number >= r["max"]) if r.get("strict") and "max" in r else (number > r["max"]) if "max" in r else F.lit(False)
        size = F.json_array_length(v)
        problem = F.when(v.isNull(), "missing" if r.get("required") else None).when(F.lit(r.get("type") == "number") & number.isNull(), "type")
        problem = problem.when(F.lit("enum" in r) & ~v.isin(*r.get("enum", [""])), "enum").when(below, "min").when(above, "max").when(F.lit("length" in r) & (F.coalesce(size, F.lit(-1)) != r.get("length", 0)), "length")
        checks.append(F.struct(F.lit(r["field"]).alias("field"), problem.alias("problem")))
    return records.select("id", F.inline(F.array(*checks))).filter(F.col("problem").isNotNull())
