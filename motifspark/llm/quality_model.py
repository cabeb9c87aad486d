"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a dozen transformed statistics (logarithms of sizes, log-odds of shares), computed over the whole
text in Arrow batches.  The class sums (count, sum, sum of products) of all labelled training rows are added up
by Spark, but for one in ``HELD`` that is kept for calibration; the class covariances are shrunk towards the pooled diagonal and
factored once (Cholesky), and a score is the logistic function of the difference of the two log densities, with a slope and an
offset fitted on at most ``CALIBRATION`` of the rows kept.

Defined results: null and empty texts have the statistics of a text without words and are scored like
any other; without training rows of both classes the score is the share of class 1, or 0.5; null labels are
ignored, of repeated labels the least counts; rows repeated stay repeated; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import first_by_hash, remainder
from .shared import materialise
from .textbatch import BYTES, Chunk, add_rows, map_text, span_hash

THRESHOLD = 0.3
SHRINKAGE = 0.1
HELD, CALIBRATION, SLOPE = 5, 4000, 0.25  # the slope is where the fit starts, and what holds where too few rows were kept

_UPPER = (BYTES >= 65) & (BYTES <= 90)
_LETTER = _UPPER | (BYTES >= 97) & (BYTES <= 122) | (BYTES >= 0xC0)
_DIGIT = (BYTES >= 48) & (BYTES <= 57)
_SYMBOL = np.isin(BYTES, [ord(c) for c in "#*$%&|<>"])
_MARK = (BYTES > 32) & (BYTES < 127) & ~_LETTER & ~_DIGIT & ~_SYMBOL
_CLASSES = np.stack([_UPPER, _LETTER, _DIGIT, _SYMBOL, _MARK, BYTES == ord("!"), BYTES == ord("."), (BYTES & 0xC0) != 0x80], axis=1).astype(np.int64)
NAMES = ["words", "word_length", "upper", "digit", "symbol", "mark", "exclaim", "stop", "distinct", "pairs", "line_words", "dup_lines", "long_words"]


def _distinct(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per row (44 bits of the hashes)."""
    k = np.sort((row.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    return np.bincount((k[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def _share(a, b):
    """Log-odds of a share, with half a case added on both sides."""
    return np.log((a + 0.5) / (np.maximum(b - a, 0) + 0.5))


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of statistics per text."""
    n = chunk.n
    starts, ends, first = chunk.words
    rows = chunk.rows_of(first)
    words = np.diff(first).astype(float)
    counts = np.zeros((n, _CLASSES.shape[1]))
    per_byte = np.zeros((n, 256))
    if len(chunk.data):
        row = np.repeat(np.arange(n), np.diff(chunk.off))
        per_byte = np.bincount(row * 256 + chunk.data, minlength=256 * n).reshape(n, 256)
        counts = per_byte @ _CLASSES
    upper, letter, digit, symbol, mark, exclaim, stop, chars = counts.T
    size = (ends - starts).astype(float)
    total = add_rows(size, first)
    h = chunk.word_hash
    with np.errstate(over="ignore"):
        pair = h[1:] * np.uint64(31) + h[:-1]
    inside = rows[1:] == rows[:-1]
    pairs = np.maximum(words - 1, 0)
    l_start, l_end, l_first = chunk.runs(chunk.data != 10)
    lines = np.diff(l_first).astype(float)
    l_rows = chunk.rows_of(l_first)
    long = add_rows((size > 14).astype(float), first)
    return np.stack(
        [
            np.log1p(words),
            np.log((total + 4) / (words + 1)),
            _share(upper, letter),
            _share(digit, chars),
            _share(symbol, chars),
            _share(mark, chars),
            _share(exclaim, words),
            _share(stop, words),
            _share(_distinct(h, rows, n), words),
            _share(_distinct(pair[inside], rows[1:][inside], n), pairs),
            np.log((words + 1) / (lines + 1)),
            _share(lines - _distinct(span_hash(chunk.lower, l_start, l_end), l_rows, n), lines),
            _share(long, words),
        ],
        axis=1,
    )


def _stats(chunk: Chunk) -> dict:
    x = statistics(chunk)
    return {"x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))}


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    return map_text(docs, text_col, lambda: _stats, "x array<double>", [id_col]).withColumnRenamed(id_col, "doc_id")


@dataclass
class Discriminant:
    mean: np.ndarray  # (2, d)
    factor: np.ndarray  # (2, d, d): inverse Cholesky factors
    logdet: np.ndarray  # (2,)
    prior: float  # log-odds of class 1
    centre: np.ndarray
    spread: np.ndarray
    share: float | None = None  # where there is one class only
    slope: float = SLOPE
    offset: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The difference of the log densities."""
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        dist = [np.square((z - m) @ w.T).sum(axis=1) + d for m, w, d in zip(self.mean, self.factor, self.logdet)]
        return (dist[0] - dist[1]) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + (self.prior if self.offset is None else self.offset), -30, 30)))

    def calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Newton's method for slope and offset, towards targets a little off 0 and 1."""
        n = [(y == c).sum() for c in (0, 1)]
        if min(n) < 5:
            return
        target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        v = np.stack([margin, np.ones(len(y))], axis=1)
        b = np.array([self.slope, self.prior])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(v @ b, -30, 30)))
            step = np.linalg.solve((v * (p * (1 - p))[:, None]).T @ v + 1e-6 * np.eye(2), v.T @ (p - target))
            b = b - np.clip(step, -0.5, 0.5)
        if b[0] > 0:
            self.slope, self.offset = float(b[0]), float(b[1])


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """sums: by class, the count, the sum and the sum of products of the statistics."""
    d = len(NAMES)
    n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    if min(n) < 2:
        z = np.zeros(d)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0, z, z + 1, (n[1] / sum(n)) if sum(n) else 0.5)
    centre = sum(sums[c][1] for c in (0, 1)) / sum(n)
    spread = np.sqrt(np.maximum(np.diag(sum(sums[c][2] for c in (0, 1))) / sum(n) - centre**2, 1e-6))
    mean, factor, logdet = [], [], []
    for c in (0, 1):
        count, total, products = sums[c]
        m = total / count
        cov = (products / count - np.outer(m, m)) / np.outer(spread, spread)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(d)
        low = np.linalg.cholesky(cov)
        mean.append((m - centre) / spread)
        factor.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(np.array(mean), np.array(factor), np.array(logdet), float(np.log(n[1] / n[0])), centre, spread)


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums of (y, x) rows by class, added up by Spark: 2 * (1 + d + d * d) numbers reach the driver."""
    d = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = np.asarray(b.column(0))
            x = np.asarray(b.column(1).flatten()).reshape(-1, d)
            for c in (0, 1):
                v = x[y == c]
                sums[c] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
        k = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k).astype(np.int32)), pa.array(np.tile(np.arange(k), 2).astype(np.int32)), pa.array(sums.ravel())], names=["y", "k", "s"])

    rows = labelled.select("y", "x").mapInArrow(partial, "y int, k int, s double").groupBy("y", "k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in rows:
        flat[r["y"], r["k"]] = r["s"]
    return {c: (flat[c, 0], flat[c, 1 : 1 + d], flat[c, 1 + d :].reshape(d, d)) for c in (0, 1) if flat[c, 0]}


def quality_scores(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", label_id: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model learns from the labels whose id meets ``allowed``."""
    x = materialise(document_statistics(docs, id_col, text_col), "statistics")
    y = labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    kept = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(1)), F.lit(HELD)) == 0
    of = lambda some: x.join(some, x["doc_id"] == some["__id"]).select("y", "x")
    model = fit(class_sums(of(y.where(~kept))))
    if model.share is None:
        rows = of(F.broadcast(first_by_hash(y.where(kept), "__id", CALIBRATION))).toArrow()
        if len(rows):
            model.calibrate(model.margin(np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, len(NAMES))), np.asarray(rows.column("y")))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(v))], names=["doc_id", "score"])

    return x.mapInArrow(apply, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality_scores(docs, labels, remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
