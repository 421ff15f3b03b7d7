"""Document quality by co-training of a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import filled, stored

#: Bound of the fit: labelled rows. All other rows are the pool, whatever their number.
FIT_ROWS = 12_000
#: Rounds; how sure a view must be of a row to label it; what the rows it labels weigh at last, against the labelled rows of that class.
ROUNDS, SURE, GIVEN = 4, 0.95, 0.5
#: Slots for languages and for sources, and for the words of a text; words remembered by a task.
BUCKETS, WORD_BUCKETS, MEMO_WORDS = 64, 128, 300_000
PENALTY = 1.0
#: Parts of a step that are tried, and by how much the mean loss on the rows kept aside may rise in a step.
PARTS, BEAR = (1.0, 0.5, 0.25, 0.125), 0.001
#: Numbers that travel together when sums are added up.
LINE = 256

# Classes of bytes whose shares describe a text.
_CLASSES = np.zeros(256, np.int64)
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)))):
    _CLASSES[list(_bytes)] = _i + 1


class _Slots(dict):
    """word -> slot, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word) % WORD_BUCKETS
        return out


_WORDS = _Slots()


def text_view(text: str) -> np.ndarray:
    """Shares of byte classes, how long and how repetitive words and lines are, and the words themselves, hashed to slots."""
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=10) / max(len(raw), 1)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    slots = np.fromiter(map(_WORDS.__getitem__, raw.lower().split()), np.int64, len(words))
    return np.concatenate([np.sqrt(np.bincount(slots, minlength=WORD_BUCKETS) / n), shares, np.sqrt(shares[7:9]), [np.log1p(len(words)), np.log1p(len(raw) / n), len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), not words]])


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language and source as hashed indicators, and the stated length."""
    out = np.zeros(2 * BUCKETS + 2)
    out[zlib.crc32(repr(lang).encode()) % BUCKETS] = 1
    out[BUCKETS + zlib.crc32(repr(source).encode()) % BUCKETS] = 1
    out[-2] = np.log1p(max(n_chars or 0, 0)) / 5
    out[-1] = n_chars is None
    return out


@dataclass
class View:
    """Logistic regression on standardised features, then a calibration of its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        view = View(mean, np.where(scale < 1e-9, 1.0, scale), np.zeros(x.shape[1] + 1))
        view.weights = _logistic(view.standard(x), y, penalty)
        return view

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = self.standard(x)
        return np.clip(self.slope * (z @ self.weights[:-1] + self.weights[-1]) + self.offset, -30, 30)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        z = self.odds(x)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def slopes(self, x: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss of rows ``x`` with labels ``y``; both add up over rows."""
        z = np.hstack([self.standard(x), np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray, part: float = 1.0) -> None:
        keep = np.append(np.full(len(self.weights) - 1, PENALTY), 1e-6)
        step = np.linalg.solve(curvature + np.diag(keep), gradient + keep * self.weights)
        self.weights = self.weights - part * step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.offset = 1.0, 0.0
        w = _logistic(self.odds(x)[:, None], (y * y.sum() + y + 1) / (y.sum() + 2) if 0 < y.sum() < len(y) else y, 1e-3)
        if w[0] > 0:
            self.slope, self.offset = float(w[0]), float(w[1])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    keep[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass
class QualityModel:
    text: View | None
    meta: View | None
    constant: float = 1.0
    text_weight: float = 1.0
    meta_weight: float = 0.0
    offset: float = 0.0

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the text view, the metadata view and both."""
        if self.text is None:
            return (np.full(len(text), self.constant),) * 3
        a, b = self.text.odds(text), self.meta.odds(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, self.text_weight * a + self.meta_weight * b + self.offset))


def _views(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n_chars = (b.column(first + i).to_pylist() for i in range(4))
    return np.array([text_view(t) for t in text]), np.array([metadata_view(*m) for m in zip(lang, source, n_chars, strict=True)])


def pool_sums(text: np.ndarray, meta: np.ndarray, views: list[View]) -> np.ndarray:
    """What pool rows add to each view's loss, labelled by the other view where it is sure: for each view and class a count, a gradient and a curvature."""
    data, out = (text, meta), []
    for v in (0, 1):
        p = 1 / (1 + np.exp(-views[1 - v].odds(data[1 - v])))
        for label in (0, 1):
            x = data[v][p >= SURE if label else p <= 1 - SURE]
            gradient, curvature = views[v].slopes(x, label)
            out += [np.array([len(x)]), gradient, curvature.ravel()]
    return np.concatenate(out)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[list[View]], np.ndarray], rounds: int = ROUNDS, held: np.ndarray | None = None) -> QualityModel:
    """Each round ``pool`` gives the sums of ``pool_sums`` over all pool rows, and each view takes a Newton step on them and the labelled rows.

    The rows that a view gets from the other weigh up to GIVEN of the labelled rows of their
    class, however many they are. Of a step that makes a view worse on the rows kept aside by more than BEAR a half, a quarter or an eighth is taken, or none. The ``held`` labelled rows, by default every fifth, calibrate.
    """
    if not len(y) or y.min() == y.max():
        return QualityModel(None, None, float(y[0]) if len(y) else 1.0)
    held = np.arange(len(y)) % 5 == 0 if held is None else held
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    own, check = ~held, held if held.any() else ~held
    data = (text, meta)
    views = [View.fit(x[own], y[own]) for x in data]
    for v in (0, 1):
        views[v].calibrate(data[v][check], y[check])
    for r in range(rounds):
        sums, at = pool(views), 0
        for v in (0, 1):
            gradient, curvature = views[v].slopes(data[v][own], y[own])
            d = len(gradient)
            for label in (0, 1):
                n, g, c = sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
                weight = min(1.0, GIVEN * (r + 1) / rounds * (y[own] == label).sum() / max(n, 1))
                gradient, curvature, at = gradient + weight * g, curvature + weight * c, at + 1 + d + d * d
            # The whole step, or the longest part of it by halves that the rows kept aside bear.
            most = views[v].loss(data[v][check], y[check]) + BEAR
            for part in PARTS:
                told = replace(views[v])
                told.step(gradient, curvature, part)
                if not np.isfinite(told.weights).all():
                    raise ValueError("a step of co-training did not give finite weights")
                told.calibrate(data[v][check], y[check])
                if told.loss(data[v][check], y[check]) <= most:
                    views[v] = told
                    break
    model = QualityModel(*views)
    w = _logistic(np.stack([views[0].odds(text[check]), views[1].odds(meta[check])], axis=1), y[check], 1e-2)
    model.text_weight, model.meta_weight, model.offset = map(float, w)
    if not all(np.isfinite(x).all() for x in (w, *(v.weights for v in views))):
        raise ValueError("the fit of the quality model did not give finite weights")
    return model


def _unpacked(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of rows packed, lang, source, n_chars."""
    packed, *told = (b.column(c).to_pylist() for c in ("packed", "lang", "source", "n_chars"))
    text = np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1).astype(float) if packed else np.zeros((0, len(text_view(""))))
    return text, np.array([metadata_view(*m) for m in zip(*told, strict=True)]).reshape(len(packed), 2 * BUCKETS + 2)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed, lang, source, n_chars): the text view of whole texts in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [text_view(t).astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), *(b.column(i) for i in (2, 3, 4))], ["doc_id", "packed", "lang", "source", "n_chars"])

    asked = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), filled().alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return asked.mapInArrow(run, "doc_id long, packed binary, lang string, source string, n_chars long")


def _added(lines: DataFrame, *keys: str) -> DataFrame:
    """The sums of the arrays ``s``, number by number."""
    zero = F.array_repeat(F.lit(0.0), LINE)
    total = F.aggregate("xs", zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return lines.groupBy(*keys).agg(F.collect_list("s").alias("xs")).select(*keys, total.alias("s"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on about ``fit_rows`` labelled rows, chosen by a hash of doc_id, whose features meet on the driver, and on all rows without a label.

    Rows that repeat a labelled doc_id with the same features are one row of the fit. Of the pool the driver gets sums only, added up by Spark, as many numbers whatever the corpus.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    share = int(min(1.0, fit_rows / max(known.count(), 1)) * 1_000_000)
    rows = stored(_packed(docs)).join(known, "doc_id", "left")
    chosen = rows.filter(F.col("quality").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))
    got = chosen.distinct().orderBy("doc_id", "packed", "lang", "source", "n_chars").toArrow()
    pool = stored(rows.filter(F.col("quality").isNull()).select("packed", "lang", "source", "n_chars"))

    def sums(views: list[View]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    s = pool_sums(*_unpacked(b), views)
                    total = s if total is None else total + s
            if total is not None:
                lines = np.pad(total, (0, -len(total) % LINE)).reshape(-1, LINE)
                at = np.flatnonzero(lines.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(lines[at]), pa.list_(pa.float64()))], ["i", "s"])

        # Each task gives some hundred lines of numbers, which are added up in two steps.
        lines = pool.mapInArrow(run, "i long, s array<double>").withColumn("part", F.spark_partition_id() % 64)
        n = sum(2 * (1 + d + d * d) for d in (len(v.weights) for v in views))
        out = np.zeros((-(-n // LINE), LINE))
        for r in _added(_added(lines, "i", "part"), "i").collect():
            out[r["i"]] = r["s"]
        return out.ravel()[:n]

    # By doc_id, so that one more row does not move others between the two parts.
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.column("doc_id").to_pylist()], bool)
    return co_train(*_unpacked(got), got.column("quality").to_numpy().astype(float), sums, held=held)


def with_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with p_text, p_meta and score, all texts read whole."""
    kept = [f for f in docs.schema.fields if f.name not in ("p_text", "p_meta", "score")]
    names = [f.name for f in kept]
    extra = ("p_text", "p_meta", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                scores = model.probabilities(*_views(b, 0))
                yield pa.RecordBatch.from_arrays([*(b.column(4 + i) for i in range(len(names))), *map(pa.array, scores)], [*names, *extra])

    asked = [filled().alias("_text"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), F.col("n_chars").cast("long").alias("_n_chars")]
    schema = docs.select(*names).schema
    for x in extra:
        schema = schema.add(x, "double")
    return docs.select(*asked, *names).mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_text, p_meta, score (chance of quality 1), keep.

    The text view sees only the text, the metadata view only lang, source and n_chars. They are
    fitted on a bounded, hash-chosen part of the labelled rows, label those of all other rows that
    they are sure of for each other over some rounds, are calibrated on labelled rows kept aside, and are combined by
    a regression on both log-odds. Without any other rows the views learn from labelled rows only.

    Nulls in text, lang, source or n_chars are values of their own; a null doc_id is never
    learned from. A doc_id with several labels takes the lowest. With labels of one class or none every score is that class
    or 1. Repeated rows are scored alike; an empty table gives no rows.
    """
    view = docs.select("doc_id", filled().alias("text"), "lang", "source", "n_chars")
    model = fit_quality(view, labels)
    scored = with_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), model).drop("text", "lang", "source", "n_chars")
    return scored.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= reject).alias("keep"))
