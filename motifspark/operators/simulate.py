"""Background sequences, embedded and masked motifs.  Draws depend on (seed, sequence id, copy, place) only, see ``functions.draws``."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniforms
from .background import Background, shrink
from .em import roll_up
from .motif import Motif
from .score import Batch, batches_of

LETTERS = 500_000  # drawn side by side


def _upto(v: list[np.ndarray], size: int) -> np.ndarray:
    """(contexts of all orders, size): running sums of the conditionals, the last of each being 1."""
    x = np.concatenate([np.cumsum(y.reshape(*y.shape[:-1], -1, size), axis=-1) for y in v], axis=-2)
    return x / x[..., -1:]


def chains(upto: np.ndarray, lengths: np.ndarray, u: np.ndarray, order: int) -> np.ndarray:
    """Codes of Markov chains, end to end, from uniform numbers ``u``; all are stepped together, the first bases with shorter contexts.

    upto: (contexts, size), or (chains, contexts, size) for chains with models of their own.
    """
    size = upto.shape[-1]
    offset = np.concatenate([[0], np.cumsum([size**k for k in range(order + 1)])])
    by_length = np.argsort(-lengths, kind="stable")
    long = lengths[by_length]
    start = (np.cumsum(lengths) - lengths)[by_length]
    out = np.empty(len(u), np.uint8)
    ctx = np.zeros(len(lengths), np.int64)
    for i in range(int(long[0]) if len(long) else 0):
        n = int(np.searchsorted(-long, -i, "left"))  # chains longer than i
        k = min(i, order)
        at = offset[k] + ctx[:n]
        rows = upto[at] if upto.ndim == 2 else upto[by_length[:n], at]
        d = np.minimum((rows <= u[start[:n] + i, None]).sum(axis=1), size - 1)
        out[start[:n] + i] = d
        ctx = (ctx[:n] * size + d) % size ** min(i + 1, order)
    return out


def _strings(codes: np.ndarray, lengths: np.ndarray, bases: str) -> pa.Array:
    text = np.frombuffer(bases.encode(), np.uint8)[codes]
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(text.tobytes())]).cast(pa.string())


def own_models(batch: Batch, bg: Background, strength: float = 20.0) -> np.ndarray:
    """(rows, contexts, size): the model rescaled to each sequence, its own k-mer counts shrunk towards the common model; running sums."""
    size, contexts = bg.ab.size, sum(bg.ab.size ** (k + 1) for k in range(bg.order + 1))
    known = batch.run > 0
    sums = np.bincount(batch.row[known] * contexts + batch.ctx[known], minlength=batch.n * contexts).reshape(batch.n, contexts)
    v = []
    for k, n in enumerate(roll_up(sums.T.astype(float), bg.order, size)):
        context = n.reshape(-1, size, batch.n).sum(axis=1)
        v.append(((n + strength * bg.v[k][:, None]) / (np.repeat(context, size, axis=0) + strength)).T)
    return _upto(v, size)


def background_copies(seqs: DataFrame, bg: Background, fold: int = 1, seed: int = 42, rescaled: bool = False, doubled: bool = False) -> DataFrame:
    """(seq_id, copy, seq): ``fold`` random sequences per input sequence, as long as it (2 L + 1 if ``doubled``)."""
    sent = seqs.sparkSession.sparkContext.broadcast(bg)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bg = sent.value
        common = _upto(bg.v, bg.ab.size)
        for b in it:
            for i, batch in batches_of(b.column(1), bg.order, bg.ab, LETTERS):
                ids = b.column(0).slice(i, batch.n)
                n = np.diff(batch.off) * (2 if doubled else 1) + (1 if doubled else 0)
                upto = own_models(batch, bg) if rescaled else common
                for c in range(fold):
                    u = uniforms([f"{seed}:{x}:{c}" for x in ids.to_pylist()], n)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(batch.n, c, np.int32)), _strings(chains(upto, n, u, bg.order), n, bg.ab.bases)], names=["seq_id", "copy", "seq"])

    return seqs.select("seq_id", "seq").mapInArrow(run, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, copy int, seq string")


def raw_copies(seqs: DataFrame, fold: int = 1) -> DataFrame:
    """(seq_id, copy, seq): every sequence ``fold`` times as it is."""
    return seqs.select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(fold - 1))).alias("copy"), "seq")


def background_number(spark: SparkSession, bg: Background, n: int, length: int, seed: int = 42) -> DataFrame:
    """(seq_id, seq): ``n`` random sequences of one length."""
    sent = spark.sparkContext.broadcast(bg)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bg = sent.value
        common, step = _upto(bg.v, bg.ab.size), max(1, LETTERS // max(length, 1))
        for b in it:
            for i in range(0, b.num_rows, step):
                ids = b.column(0).slice(i, step)
                each = np.full(len(ids), length)
                u = uniforms([f"{seed}:{x}:0" for x in ids.to_pylist()], each)
                yield pa.RecordBatch.from_arrays([ids, _strings(chains(common, each, u, bg.order), each, bg.ab.bases)], names=["seq_id", "seq"])

    return spark.range(n).mapInArrow(run, "seq_id long, seq string")


def draw_sites(m: Motif, u: np.ndarray) -> np.ndarray:
    """(rows, W): codes of sites drawn from the motif by uniform numbers (rows, W)."""
    size, ctx = m.ab.size, np.zeros(len(u), np.int64)
    out = np.empty(u.shape, np.uint8)
    for j in range(m.width):
        k = min(j, m.order)
        upto = np.cumsum(m.v[k][:, j].reshape(-1, size), axis=1)
        rows = (upto / upto[:, -1:])[ctx]
        out[:, j] = np.minimum((rows <= u[:, j, None]).sum(axis=1), size - 1)
        ctx = (ctx * size + out[:, j]) % size ** min(j + 1, m.order)
    return out


def embed(seqs: DataFrame, m: Motif, seed: int = 42, at: int = 0) -> DataFrame:
    """(seq_id, seq, start): a drawn site put into a share q of the sequences (start from 1; null: none), the length kept.

    at: the position, or 0 for a random one.
    """
    sent = seqs.sparkSession.sparkContext.broadcast(m)
    W, key = m.width, F.col("seq_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u = uniforms([f"{seed}:{x}:site" for x in b.column(0).to_pylist()], np.full(b.num_rows, W)).reshape(-1, W)
            sites = _strings(draw_sites(sent.value, u).ravel(), np.full(b.num_rows, W), sent.value.ab.bases)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sites], names=["seq_id", "seq", "start", "site"])

    places = F.length("seq") - W + 1
    start = F.least(F.lit(at), places) if at else F.floor(uniform(seed, key, F.lit("start")) * places) + 1
    chosen = (uniform(seed, key, F.lit("chosen")) < m.q) & (F.length("seq") >= W)
    kind = seqs.schema["seq_id"].dataType.simpleString()
    drawn = seqs.select("seq_id", "seq", F.when(chosen, start.cast("int")).alias("start")).mapInArrow(run, f"seq_id {kind}, seq string, start int, site string")
    put = F.concat(F.substring("seq", F.lit(1), F.col("start") - 1), "site", F.substring("seq", F.col("start"), F.length("seq")))
    return drawn.select("seq_id", F.when(F.col("start").isNull(), F.col("seq")).otherwise(F.substring(put, F.lit(1), F.length("seq"))).alias("seq"), "start")


def mask(seqs: DataFrame, sites: DataFrame, width: int, mode: str = "mask") -> DataFrame:
    """(seq_id, seq): forward-strand sites (seq_id, start from 0) replaced by N, or deleted and the tail padded with N.

    Unknown bases of the sequence itself stay where they are.
    """
    hit = sites.groupBy("seq_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))  # at most one per base of a sequence
    both = seqs.join(hit.withColumnRenamed("seq_id", "h_id"), F.col("seq_id") == F.col("h_id"), "left")
    starts = F.coalesce("starts", F.array().cast("array<int>"))
    # what stands before each site and after the one before it; overlapping sites leave nothing between them
    end = lambda i: F.when(i == 0, 0).otherwise(F.get(starts, i - 1) + width)
    left = F.transform(starts, lambda a, i: F.substring("seq", end(i) + 1, F.greatest(a - end(i), F.lit(0))))
    rest = F.substring("seq", end(F.size(starts)) + 1, F.length("seq"))
    if mode == "delete":
        kept = F.concat(F.array_join(left, ""), rest)
    else:
        gap = lambda a, i: F.repeat(F.lit("N"), F.least(F.lit(width), a + width - end(i)))
        kept = F.concat(F.array_join(F.transform(starts, lambda a, i: F.concat(F.get(left, i), gap(a, i))), ""), rest)
    return both.select("seq_id", F.rpad(kept, F.length("seq"), F.lit("N")).alias("seq"))


def refit(n, bg: Background) -> Background:
    """A model from other counts with the same strengths."""
    return Background(shrink(n, bg.alpha, bg.ab, bg.interpolate), n, bg.alpha, bg.ab, bg.interpolate)
