"""Homogeneous Markov background models."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import STANDARD, Alphabet

ALPHA = (1.0, 10.0, 10.0)
ROWS = 50_000  # of a batch that a task hands to Spark


def index_of(kmer: str, ab: Alphabet = STANDARD) -> int:
    y = 0
    for c in kmer:
        y = y * ab.size + ab.bases.index(c)
    return y


def kmer_of(y: int, length: int, ab: Alphabet = STANDARD) -> str:
    out = ""
    for _ in range(length):
        y, d = divmod(y, ab.size)
        out = ab.bases[d] + out
    return out


@dataclass
class Background:
    """v[k][y]: probability of the last base of (k + 1)-mer y after its first k; n: its counts."""

    v: list[np.ndarray]
    n: list[np.ndarray]
    alpha: tuple[float, ...]
    ab: Alphabet = STANDARD
    interpolate: bool = True

    @property
    def order(self) -> int:
        return len(self.v) - 1

    def joint(self) -> list[np.ndarray]:
        """p[k][y]: probability of the whole (k + 1)-mer."""
        p = [self.v[0]]
        for k in range(1, self.order + 1):
            y = np.arange(self.ab.size ** (k + 1))
            p.append(self.v[k] * p[k - 1][y // self.ab.size])
        return p

    def to_df(self, spark: SparkSession) -> DataFrame:
        p = self.joint()
        rows = [(k, kmer_of(y, k + 1, self.ab), y, int(self.n[k][y]), float(self.v[k][y]), float(p[k][y])) for k in range(self.order + 1) for y in range(len(self.v[k]))]
        return spark.createDataFrame(rows, "k int, kmer string, y long, n long, v double, p double")

    def cumulative(self, spark: SparkSession) -> DataFrame:
        """(k, kmer, upto): running sum of v within each context, by base."""
        rows = []
        for k in range(self.order + 1):
            upto = np.cumsum(self.v[k].reshape(-1, self.ab.size), axis=1).ravel()
            rows += [(k, kmer_of(y, k + 1, self.ab), float(x)) for y, x in enumerate(upto)]
        return spark.createDataFrame(rows, "k int, kmer string, upto double")


def shrink(n: list[np.ndarray], alpha, ab: Alphabet = STANDARD, interpolate: bool = True) -> list[np.ndarray]:
    """Conditional probabilities, each order shrunk towards the one below (or towards 1 / size)."""
    size = ab.size
    v = [(n[0] + alpha[0] / size) / (n[0].sum() + alpha[0])]
    for k in range(1, len(n)):
        y = np.arange(size ** (k + 1))
        lower = v[k - 1][y % size**k] if interpolate else np.full(len(y), 1 / size)
        v.append((n[k] + alpha[k] * lower) / (n[k - 1][y // size] + alpha[k]))
    return v


def from_counts(rows, order: int, alpha=ALPHA, ab: Alphabet = STANDARD, interpolate: bool = True) -> Background:
    """rows: (k, kmer, n)."""
    alpha = tuple(alpha) + (alpha[-1],) * (order + 1 - len(alpha))
    n = [np.zeros(ab.size ** (k + 1)) for k in range(order + 1)]
    for k, kmer, count in rows:
        n[k][index_of(kmer, ab)] += count
    return Background(shrink(n, alpha, ab, interpolate), n, alpha, ab, interpolate)


def context_counts(seqs: DataFrame, order: int, by: str | None = None, ab: Alphabet = STANDARD) -> DataFrame:
    """(by, kmer, n): how often each longest known k-mer of at most ``order`` + 1 bases ends somewhere, counted in the tasks."""
    from .score import batches_of

    names = np.array([kmer_of(y, k + 1, ab) for k in range(order + 1) for y in range(ab.size ** (k + 1))], dtype=object)

    def run(it):
        for b in it:
            for i, batch in batches_of(b.column(0), order, ab):
                known = batch.base > 0
                if by is None:
                    n = np.bincount(batch.ctx[known], minlength=len(names))
                    some = np.flatnonzero(n)
                    groups, both, n = pa.array(np.zeros(len(some), np.int32)), some, n[some]
                else:
                    key = b.column(1).slice(i, batch.n).dictionary_encode()
                    code = np.asarray(key.indices.fill_null(len(key.dictionary))).astype(np.int64)
                    both, n = np.unique(code[batch.row[known]] * len(names) + batch.ctx[known], return_counts=True)
                    groups = key.dictionary.take(pa.array(both // len(names), mask=both // len(names) == len(key.dictionary)))
                yield pa.RecordBatch.from_arrays([groups, pa.array(names[both % len(names)], pa.string()), pa.array(n.astype(np.int64))], names=["g", "kmer", "n"])

    g = F.col(by) if by else F.lit(0)
    kind = seqs.schema[by].dataType.simpleString() if by else "int"
    counted = seqs.select("seq", g.alias("g")).mapInArrow(run, f"g {kind}, kmer string, n long").groupBy("g", "kmer").agg(F.sum("n").alias("n"))
    return counted.select(F.col("g").alias(by), "kmer", "n") if by else counted.select("kmer", "n")


def kmer_table(seqs: DataFrame, order: int, by: str | None = None, ab: Alphabet = STANDARD) -> DataFrame:
    """(by, k, kmer, n) for k = 0..order, as ``sequence.kmer_counts``: shorter k-mers are suffixes of the longest."""
    keys = [by] if by else []
    each = context_counts(seqs, order, by, ab).select(*keys, "n", "kmer", F.explode(F.sequence(F.lit(0), F.length("kmer") - 1)).alias("k"))
    return each.select(*keys, "k", F.expr("right(kmer, k + 1)").alias("kmer"), "n").groupBy(*keys, "k", "kmer").agg(F.sum("n").alias("n"))


def fit(seqs: DataFrame, order: int = 2, alpha=ALPHA, ab: Alphabet = STANDARD, interpolate: bool = True) -> Background:
    """One distributed count; only its 4 + 16 + ... sums reach the driver."""
    rows = [(r["k"], r["kmer"], r["n"]) for r in kmer_table(seqs, order, ab=ab).collect()]
    return from_counts(rows, order, alpha, ab, interpolate)


def fit_by(seqs: DataFrame, by: str, order: int = 2, alpha=ALPHA, ab: Alphabet = STANDARD) -> dict[str, Background]:
    """A model per value of ``by`` (model names: a short list), from one pass."""
    groups: dict[str, list] = {}
    for r in kmer_table(seqs, order, by, ab).collect():
        groups.setdefault(r[by], []).append((r["k"], r["kmer"], r["n"]))
    return {name: from_counts(g, order, alpha, ab) for name, g in sorted(groups.items(), key=lambda x: str(x[0]))}


def log_likelihoods(seqs: DataFrame, models: dict[str, Background], by: list[str]) -> DataFrame:
    """(by..., model, llh): every group of sequences under every model; the context is shorter at a sequence's start.

    Contexts with an unknown base are left out.  Tasks add up whole sequences, so the shuffle has a row per sequence and model at most.
    """
    from .score import batches_of

    order, ab = max(m.order for m in models.values()), next(iter(models.values())).ab
    logs = []
    for k in range(order + 1):
        y = np.arange(ab.size ** (k + 1))
        logs.append(np.stack([np.log(m.v[min(k, m.order)])[y % ab.size ** (min(k, m.order) + 1)] for m in models.values()], axis=1))
    sent, names = seqs.sparkSession.sparkContext.broadcast(np.concatenate(logs)), list(models)

    def run(it):
        for b in it:
            for i, batch in batches_of(b.column(0), order, ab):
                at = np.arange(len(batch.row)) - batch.off[batch.row]
                whole = batch.run >= np.minimum(at, order) + 1
                row, ctx = batch.row[whole], batch.ctx[whole]
                for j, name in enumerate(names):
                    llh = np.bincount(row, sent.value[ctx, j], batch.n)
                    keys = [b.column(c + 1).slice(i, batch.n) for c in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([name] * batch.n, pa.string()), pa.array(llh)], names=[*[f"g{c}" for c in range(len(by))], "model", "llh"])

    kinds = [f"g{c} {seqs.schema[x].dataType.simpleString()}" for c, x in enumerate(by)]
    each = seqs.where(F.length("seq") > 0).select("seq", *by).mapInArrow(run, ", ".join([*kinds, "model string", "llh double"]))
    return each.groupBy(*[f"g{c}" for c in range(len(by))], "model").agg(F.sum("llh").alias("llh")).select(*[F.col(f"g{c}").alias(x) for c, x in enumerate(by)], "model", "llh")


def positional_likelihoods(seqs: DataFrame, model: Background) -> DataFrame:
    """(seq_id, i, lik): the probability of each base after its context."""
    from .score import batches_of

    order, ab = model.order, model.ab
    sent = seqs.sparkSession.sparkContext.broadcast(np.concatenate(model.v))

    def run(it):
        for b in it:
            for i, batch in batches_of(b.column(1), order, ab):
                at = np.arange(len(batch.row)) - batch.off[batch.row]
                whole = np.flatnonzero(batch.run > np.minimum(at, order))  # contexts with an unknown base are left out
                for a in range(0, len(whole), ROWS):
                    part = whole[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(batch.row[part] + i)), pa.array((at[part] + 1).astype(np.int32)), pa.array(sent.value[batch.ctx[part]])], names=["seq_id", "i", "lik"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, i int, lik double")


def posteriors(llh: DataFrame, of: str, model: str = "model", value: Column | None = None) -> DataFrame:
    """(of, model, posterior): softmax of the log-likelihoods of each set over the models; far terms count as zero."""
    from pyspark.sql import Window

    w = Window.partitionBy(of)  # one row per model
    gap = F.col("llh") - F.max("llh").over(w)
    floor = F.log(F.lit(1e-15)) - F.log(F.count("*").over(w))
    e = llh.withColumn("e", F.when(gap >= floor, F.exp(gap)).otherwise(0.0))
    return e.select(of, model, "llh", (F.col("e") / F.sum("e").over(w)).alias("posterior"))


def best_two(post: DataFrame, of: str, model: str = "model") -> DataFrame:
    """(of, rank, model, posterior) of the two likeliest models of each set; ties by name."""
    from pyspark.sql import Window

    w = Window.partitionBy(of).orderBy(F.desc("posterior"), F.desc("llh"), model)
    return post.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select(of, "rank", model, "posterior")
