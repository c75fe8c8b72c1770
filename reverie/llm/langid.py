"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's character n-grams are hashed into buckets; the mean of the buckets'
embeddings goes through one linear layer and a softmax. Embeddings and layer
are trained together by stochastic gradient descent in numpy on a bounded
sample (``per_language`` documents of each label). Temperature scaling on rows
kept out of the descent makes the scores probabilities, and the same rows set
the score below which a prediction is flagged as rejected.

Defined results: a null text or one without a letter (Unicode category L; numerals such
as a fraction or a Roman one are none) is ``und`` with score 0; without any training row
every text is ``und``. Repeated rows get equal rows; rows with a null id are scored and may be
learnt from; an empty table gives no rows; other columns are not read, whatever their names;
texts of any length are scored whole, those above ``longest_fit`` characters are not learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import bounded_rows, crc_mod, map_arrow, table

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    @property
    def buckets(self) -> int:
        return len(self.embedding)


def bucket_counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket is hit by the 1- to 4-grams of the letters (runs of others: one space)."""
    points = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), dtype=np.uint32)
    shift, out = np.uint32(32 - (buckets.bit_length() - 1)), np.zeros(buckets, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = points * np.uint32(0x9E3779B1) + np.uint32(1)
        for n in range(1, 5):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
            if not len(h):
                break
            out += np.bincount((h * np.uint32(0x27D4EB2F)) >> shift, minlength=buckets)
    return out


def sparse_shares(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text hits and their shares."""
    counts = bucket_counts(text, buckets)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1, counts.sum())).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], *, buckets: int = 1 << 13, dim: int = 16, epochs: int = 6, least_steps: int = 500, rate: float = 2.0, batch: int = 32, seed: int = 7, reject_share: float = 0.005) -> LanguageModel | None:
    """Descent on four fifths of the rows, calibration on the rest. None without rows."""
    if not texts:
        return None
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    shares = [sparse_shares(text, buckets) for text in texts]

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), buckets), dtype=np.float32)
        for i, row in enumerate(rows):
            at, share = shares[row]
            out[i, at] = share
        return out

    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    e = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    # a small sample is gone through more often
    epochs = max(epochs, -(-least_steps // max(1, -(-len(fit) // batch))))
    steps, done = epochs * max(1, -(-len(fit) // batch)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // batch))):
            if not len(rows):
                continue
            step = rate * (1 - done / steps)
            done += 1
            x = dense(rows)
            hidden = x @ e
            slope = softmax(hidden @ w + b)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ w.T
            w -= step * (hidden.T @ slope)
            b -= step * slope.sum(0)
            used = np.flatnonzero(x.any(axis=0))
            e[used] -= step * 20 * (x[:, used].T @ back)
    rows = held if len(held) else fit
    z = np.concatenate([dense(part) @ e @ w + b for part in np.array_split(rows, -(-len(rows) // 256))])
    # one error more than was seen is allowed for, so that a clean calibration set does not mean certainty
    soft = 1 / (len(rows) + 2)
    goal = np.full(z.shape, soft / max(1, z.shape[1] - 1))
    goal[np.arange(len(rows)), y[rows]] = 1 - soft
    loss = {t: -(goal * np.log(np.maximum(softmax(z / t), 1e-15))).sum(1).mean() for t in np.geomspace(0.02, 20, 61)}
    temperature = float(min(loss, key=loss.get))
    p = softmax(z / temperature)
    right = p[p.argmax(1) == y[rows]].max(1) if (p.argmax(1) == y[rows]).any() else np.array([0.0])
    return LanguageModel(languages, e, w, b, temperature, float(np.quantile(right, reject_share)))


def predict(model: LanguageModel | None, text: str | None) -> tuple[str, float, bool]:
    """Language, calibrated score, and whether the score is too low to be relied on."""
    if model is None or not text or not _LETTER.search(text):
        return UNDETERMINED, 0.0, True
    counts = bucket_counts(text, model.buckets)
    hit = np.flatnonzero(counts)
    hidden = counts[hit].astype(np.float64) @ model.embedding[hit] / counts.sum()
    p = softmax((hidden @ model.weights + model.bias) / model.temperature)
    k = int(p.argmax())
    return model.languages[k], float(p[k]), bool(p[k] < model.reject_below)


def fit_language_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 700, most_rows: int = 20_000, longest_fit: int = 100_000, **options) -> LanguageModel | None:
    """Train on about ``per_language`` rows of each label (fewer with many labels: ``most_rows`` in all), texts of up to ``longest_fit`` characters.

    These bounds are all that reaches the driver.
    """
    usable = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, label_col)
    rows = bounded_rows(usable, [id_col, text_col], F.col(label_col), per_language, most_rows=most_rows, only=F.char_length(text_col) <= longest_fit).collect()
    rows = sorted((r for r in rows if _LETTER.search(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return train([r[1] for r in rows], [r[2] for r in rows], **options)


def identify_language(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, language, score, rejected`` for every row, from the whole text alone."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=[id_col, "language", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), score, f"{id_col} {kind}, language string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit_language_model(docs.where(~held))
    found = identify_language(docs, model)
    return found.select("doc_id", held.alias("held_out"), F.col("language").alias("lang_pred"), "score", "rejected")
