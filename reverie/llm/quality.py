"""Quality by co-training of two views.

The content view sees the text alone: hashed character n-grams and figures of its layout; the metadata
view sees the record's language, source and stated length, and no text. Each is a logistic
classifier, fitted on a bounded sample of labelled rows. In each round all documents are read: where
one view is sure of a document (calibrated score of ``sure`` and more, or 1 - ``sure`` and
less), the other learns from that pseudo-label. Every partition descends on its own
documents from the round's weights, held back by a pull to the weights of
the labelled rows, and the partitions' weights are averaged by the number of documents
they learnt from. Both views are calibrated on labelled rows, by classifiers that have not seen the row, and a last logistic layer
over the calibrated views scores every document.

Bounds: about ``per_class`` labelled rows of each class; their features, not their texts, reach the
driver, and so do the averaged weights. There is no bound on the documents that give pseudo-labels.

Defined results: null columns count as empty or as their own category; without
labelled rows of both classes every document has score 1 and is accepted. Of a document with labels
that contradict each other, the higher one counts; labels that are null or neither 0 nor 1 and
labels with a null id teach nothing. Repeated rows get equal rows; an empty table gives no rows;
columns other than those named are not read; texts are never shortened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import map_arrow, table
from reverie.llm.toxicity import fit_logistic, labelled_texts

BUCKETS = 1 << 11
CATEGORIES = 32
#: Doublings of the stated length, and one place for none.
LENGTHS = 33


def content_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of characters, case and marks as they are, then the layout's figures."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    with np.errstate(over="ignore"):
        h = points * np.uint32(0x9E3779B1) + np.uint32(1)
        for n in range(1, 4):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
            if not len(h):
                break
            out += np.bincount((h * np.uint32(0x27D4EB2F)) >> shift, minlength=BUCKETS)
    return np.concatenate([np.sqrt(out / max(1, out.sum())), layout(text or "")]).astype(np.float32)


def layout(text: str) -> list[float]:
    """Figures of a text: its size and lines, shares of kinds of characters, and how many of its lines differ."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = np.bincount(data, minlength=256)
    n = max(1, len(data))
    lines, spaces = int(kinds[10]) + 1, int(kinds[9:14].sum() + kinds[32])
    upper, digits = kinds[65:91].sum() / n, kinds[48:58].sum() / n
    marks = (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n
    distinct = len(set(text.split("\n"))) / lines
    return [np.log1p(len(data)), np.log1p(lines), np.log1p(len(data) / lines), len(data) / (spaces + 1) / 10, 4 * upper, 4 * digits, 4 * marks, spaces / n, distinct, min(1.0, 10 * marks), min(1.0, 3 * upper)]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """One place each for the language, the source (both hashed) and the doubling of the stated length."""
    out = np.zeros(2 * CATEGORIES + LENGTHS, dtype=np.float32)
    out[zlib.crc32(str(lang).encode()) % CATEGORIES] = 1
    out[CATEGORIES + zlib.crc32(str(source).encode()) % CATEGORIES] = 1
    out[2 * CATEGORIES + (LENGTHS - 1 if n_chars is None else min(LENGTHS - 2, max(0, int(n_chars)).bit_length()))] = 1
    return out


def logistic_descent(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """For many features: Nesterov's method with balanced classes; the intercept is last."""
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    w = v = np.zeros(x1.shape[1], dtype=np.float32)
    rate = 4.0 / max(1e-6, float((share[:, None] * x1 * x1).sum()))
    for k in range(steps):
        ahead = v + (k / (k + 3)) * (v - w)
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        w, v = v, ahead - rate * (x1.T @ (share * (p - y)) + ridge * ahead)
    return v


@dataclass
class View:
    """A classifier over raw features: weights with the intercept last, then slope and intercept of its calibration."""

    weights: np.ndarray
    calibration: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Log odds after calibration."""
        return self.calibration[0] * self.margin(x) + self.calibration[1]


def chance(z) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class QualityModel:
    """Both views and the layer that joins their calibrated log odds."""

    content: View
    metadata: View
    joint: np.ndarray

    def score(self, text, lang, source, n_chars) -> tuple[float, float, float]:
        """Joint score, then each view's calibrated one."""
        own = np.array([self.content.calibrated(content_view(text)), self.metadata.calibrated(metadata_view(lang, source, n_chars))])
        p = chance(np.array([own @ self.joint[:-1] + self.joint[-1], *own]))
        return float(p[0]), float(p[1]), float(p[2])


class LabelledRows:
    """Features of both views and labels. Calibration sees margins of classifiers that were not fitted on the row."""

    def __init__(self, content: np.ndarray, metadata: np.ndarray, y: np.ndarray, *, folds: int = 4, seed: int = 5) -> None:
        self.views, self.y = (content, metadata), y
        spread = content.std(0) + 0.05
        spread[:BUCKETS] = max(1e-6, float(content[:, :BUCKETS].std()))
        # one of the few layout figures tells more than one of the many buckets
        spread[BUCKETS:] /= 4
        self.scale = ((content.mean(0), spread), (metadata.mean(0), metadata.std(0) + 0.2))
        everything = np.arange(len(y))
        #: weights from all labelled rows
        self.anchors = (self._fit(0, everything), self._fit(1, everything))
        self.folds = []
        # each class is dealt to the folds in turn
        order = np.random.default_rng(seed).permutation(len(y))
        place = np.empty(len(y), dtype=np.int64)
        for label in (0, 1):
            place[order[y[order] == label]] = np.arange((y == label).sum()) % folds
        for k in range(folds):
            held, rest = np.flatnonzero(place == k), np.flatnonzero(place != k)
            fits = len(set(y[rest].tolist())) == 2
            self.folds.append((held, tuple(self._fit(v, rest) if fits else self.anchors[v] for v in (0, 1))))

    def _fit(self, v: int, rows: np.ndarray) -> np.ndarray:
        """Weights for raw features."""
        mean, spread = self.scale[v]
        w = logistic_descent(((self.views[v][rows] - mean) / spread).astype(np.float32), self.y[rows].astype(np.float32))
        raw = w[:-1] / spread
        return np.append(raw, w[-1] - mean @ raw).astype(np.float64)

    def margins(self, v: int, weights: np.ndarray) -> np.ndarray:
        """What ``weights`` learnt beyond the labelled rows is added to each fold's classifier."""
        out = np.zeros(len(self.y))
        for held, fitted in self.folds:
            out[held] = View(fitted[v] + (weights - self.anchors[v]), np.array([1.0, 0.0])).margin(self.views[v][held])
        return out

    def calibrate(self, v: int, weights: np.ndarray) -> View:
        return View(weights, fit_logistic(self.margins(v, weights)[:, None], self.y.astype(float), ridge=1.0))

    def join(self, content: View, metadata: View) -> QualityModel:
        z = np.array([x.calibration[0] * self.margins(v, x.weights) + x.calibration[1] for v, x in enumerate((content, metadata))]).T
        return QualityModel(content, metadata, fit_logistic(z, self.y.astype(float), ridge=1.0))


class LocalDescent:
    """Descent of one view on the pseudo-labelled rows of a partition, in batches."""

    def __init__(self, weights: np.ndarray, anchor: np.ndarray, positive: float, *, batch: int = 128, pull: float = 0.5) -> None:
        self.w, self.anchor, self.pull = weights.astype(np.float64), anchor.astype(np.float64), pull
        self.weight = (0.5 / max(1e-3, 1 - positive), 0.5 / max(1e-3, positive))
        self.batch, self.x, self.y, self.seen = batch, [], [], 0

    def add(self, x: np.ndarray, label: int) -> None:
        self.x.append(x)
        self.y.append(label)
        if len(self.x) >= self.batch:
            self.step()

    def step(self) -> None:
        if not self.x:
            return
        x = np.hstack([np.array(self.x), np.ones((len(self.x), 1))])
        y = np.array(self.y)
        share = np.where(y > 0, self.weight[1], self.weight[0]) / len(y)
        rate = 1.0 / (0.25 * float((share[:, None] * x * x).sum()) + self.pull)
        slope = x.T @ (share * (chance(x @ self.w) - y)) + self.pull * (self.w - self.anchor)
        self.w -= rate * slope
        self.seen += len(y)
        self.x, self.y = [], []


def learn_from_all(docs: DataFrame, columns: list[str], views: tuple[View, View], anchors: tuple[np.ndarray, np.ndarray], positive: float, sure: float) -> list[np.ndarray]:
    """One round over all documents: each view's weights after learning from what the other is sure of.

    A partition gives its weights times the number of rows it learnt from, a number a
    row; these are summed on the executors, so that the driver gets one vector a view.
    """
    edge = float(np.log(sure / (1 - sure)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners = [LocalDescent(v.weights, a, positive) for v, a in zip(views, anchors, strict=True)]
        for batch in batches:
            for text, lang, source, n_chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = (content_view(text), metadata_view(lang, source, n_chars))
                for v in (0, 1):
                    z = views[v].calibrated(x[v])
                    if abs(z) >= edge:
                        learners[1 - v].add(x[1 - v], int(z > 0))
        for v, learner in enumerate(learners):
            learner.step()
            if learner.seen:
                n = len(learner.w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(learner.w * learner.seen), pa.array(np.full(n, learner.seen, dtype=np.int64))], names=["v", "at", "total", "seen"])

    parts = map_arrow(docs.select(*columns), run, "v int, at int, total double, seen long")
    out = [view.weights.copy() for view in views]
    for r in parts.groupBy("v", "at").agg((F.sum("total") / F.sum("seen")).alias("w")).collect():
        out[r["v"]][r["at"]] = round(r["w"], 9)  # the order of a sum must not show
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", per_class: int = 900, longest_fit: int = 100_000, rounds: int = 2, sure: float = 0.97) -> QualityModel | None:
    """Co-training of both views. None unless both classes are among the labelled rows."""
    columns = [text_col, lang_col, source_col, chars_col]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source, n_chars = (batch.column(i).to_pylist() for i in range(4))
            c = [content_view(t).tobytes() for t in text]
            m = [metadata_view(*r).tobytes() for r in zip(lang, source, n_chars, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(m, pa.binary()), batch.column(4).cast(pa.int32())], names=["c", "m", "y"])

    marked = labelled_texts(docs, labels, id_col, columns, label_col, per_class, longest_fit)
    rows = sorted(map(tuple, map_arrow(marked.select(*columns, "_y"), features, "c binary, m binary, y int").collect()))
    y = np.array([r[2] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    known = LabelledRows(*(np.array([np.frombuffer(r[v], dtype=np.float32) for r in rows]) for v in (0, 1)), y)
    views = tuple(known.calibrate(v, known.anchors[v]) for v in (0, 1))
    for _ in range(rounds):
        learnt = learn_from_all(docs, columns, views, known.anchors, float(y.mean()), sure)
        views = tuple(known.calibrate(v, learnt[v]) for v in (0, 1))
    return known.join(*views)


def classify_quality(docs: DataFrame, model: QualityModel | None, *, accept_from: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with ``score, content_score, metadata_score, accepted``; ``keep`` names columns passed through."""
    read = [text_col, lang_col, source_col, chars_col]
    columns = list(dict.fromkeys([id_col, *read, *keep]))
    out = list(dict.fromkeys([id_col, *keep]))
    places = [columns.index(c) for c in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(columns.index(c)).to_pylist() for c in read), strict=True)
            found = np.array([model.score(*r) if model else (1.0, 1.0, 1.0) for r in rows]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *(pa.array(found[:, k]) for k in range(3)), pa.array(found[:, 0] >= accept_from)], names=[*out, "score", "content_score", "metadata_score", "accepted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return map_arrow(docs.select(*columns), run, f"{kinds}, score double, content_score double, metadata_score double, accepted boolean")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
