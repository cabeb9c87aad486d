"""Log-odds scores of motifs on sequence sets: Arrow batches, gathers on small tables."""
from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import STANDARD, Alphabet, doubled
from .background import Background, kmer_of
from .motif import PSEUDO, Motif, score_table

CHUNK = 250_000  # letters of a batch: its arrays, some 50 bytes a letter, stay small at any size of the input
GRAMS = 100_000
HALF, BLOCK = 20_000, 64
COUNTED = 1_000_000  # different scores that a task holds


def scored_strands(seqs: DataFrame, single: bool = False, ab: Alphabet = STANDARD) -> DataFrame:
    """(seq_id, dseq, L): the text that is scanned; both strands with a separator, unless ``single``; a column ``fold`` is kept."""
    kept = [c for c in ("fold",) if c in seqs.columns]
    return seqs.select("seq_id", (F.col("seq") if single else doubled(F.col("seq"), ab)).alias("dseq"), F.length("seq").alias("L"), *kept)


@lru_cache(8)
def _grams(order: int, size: int) -> tuple[int, np.ndarray | None]:
    """How many window places g a gram covers, and the context of each of them in every gram (grams, g), the last letter's first.

    A gram is a number of g + order letters in base size + 1; 0 is an unknown base or none.  Where even one place takes more than
    GRAMS of them, grams are contexts.
    """
    base = size + 1
    if base ** (order + 1) > GRAMS:
        return 1, None
    g = 1
    while base ** (g + 1 + order) <= GRAMS:
        g += 1
    y = np.arange(base ** (g + order))
    letters = [y // base**d % base for d in range(g + order)]  # from the last one back
    offset = np.concatenate([[0], np.cumsum([size ** (i + 1) for i in range(order + 1)])])
    out = np.zeros((len(y), g), np.int64)
    for i in range(g):
        number, known, length = np.zeros_like(y), np.ones(len(y), bool), np.zeros_like(y)
        for d in range(order + 1):
            known &= letters[i + d] > 0
            number += np.where(known, (letters[i + d] - 1) * size**d, 0)
            length += known
        out[:, i] = np.where(length > 0, offset[np.maximum(length - 1, 0)] + number, 0)
    return g, out


@lru_cache(8)
def _codes(ab: Alphabet) -> np.ndarray:
    code = np.zeros(256, np.uint8)
    for i, b in enumerate(ab.bases):
        code[[ord(b), ord(b.lower())]] = i + 1
    return code


def numbers(code: np.ndarray, length: int, base: int) -> np.ndarray:
    """At each position the number of its last ``length`` codes in a base, in the narrowest integers; what would stand before the first is 0."""
    made = {1: code}

    def number(n: int) -> np.ndarray:
        if n not in made:
            h = 1 << (n - 1).bit_length() - 1
            kind = np.min_scalar_type(base**n - 1).type
            out = number(h).astype(kind)
            out[h:] += number(n - h)[:-h].astype(kind) * kind(base**h)
            made[n] = out
        return made[n]

    return number(length)


class Grams:
    """A table (contexts, W) by grams: a window is the sum, or the product, of some look-ups instead of W."""

    def __init__(self, table: np.ndarray, order: int, ab: Alphabet = STANDARD, exp: bool = False):
        self.group, self.contexts = _grams(order, ab.size)
        self.width, self.shape = table.shape[1], table.shape
        self.exp, self.parts = exp, []
        for first in range(0, self.width, self.group):
            last = min(first + self.group, self.width) - 1
            if self.contexts is None:
                part = np.ascontiguousarray(table[:, last])
            else:
                part = np.zeros(len(self.contexts))
                for j in range(first, last + 1):
                    part += table[self.contexts[:, last - j], j]
            self.parts.append((first, last, np.exp(part) if exp else part))

    def of(self, batch: Batch, starts: np.ndarray) -> np.ndarray:
        out = None
        for _, last, part in self.parts:
            x = part[batch.grams[starts + last]]
            if out is None:
                out = x
            elif self.exp:
                out *= x
            else:
                out += x
        return out

    def add(self, sums: list[np.ndarray], batch: Batch, starts: np.ndarray, weights: np.ndarray) -> None:
        """Adds the weights of windows to ``sums``, one array of grams a part (``empty``)."""
        for (_, last, _), x in zip(self.parts, sums):
            x += np.bincount(batch.grams[starts + last], weights, len(x))

    def everywhere(self, batch: Batch) -> np.ndarray:
        """``of`` at each position, whole windows or not; 0 where none fits in."""
        out = np.zeros(len(batch.base))
        n = max(len(out) - self.width + 1, 0)
        for k, (_, last, part) in enumerate(self.parts):
            x = part.take(batch.grams[last : last + n])
            if k == 0:
                out[:n] = x
            elif self.exp:
                out[:n] *= x
            else:
                out[:n] += x
        return out

    def add_everywhere(self, sums: list[np.ndarray], batch: Batch, weights: np.ndarray) -> None:
        """``add`` with a weight for each position."""
        n = max(len(weights) - self.width + 1, 0)
        for (_, last, _), x in zip(self.parts, sums):
            x += np.bincount(batch.grams[last : last + n], weights[:n], len(x))

    def empty(self) -> list[np.ndarray]:
        return [np.zeros(len(part)) for _, _, part in self.parts]

    def by_context(self, sums: list[np.ndarray]) -> np.ndarray:
        """Sums of grams as (contexts, W)."""
        out = np.zeros(self.shape)
        for (first, last, _), x in zip(self.parts, sums):
            for j in range(first, last + 1):
                out[:, j] = x if self.contexts is None else np.bincount(self.contexts[:, last - j], x, len(out))
        return out


class Batch:
    """Sequences of a batch laid end to end.

    base: 0 for an unknown base, else 1, 2, ...; ctx: number of each position's context, of order min(K, valid bases before it); grams: see ``Grams``.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, order: int, ab: Alphabet = STANDARD, coded: bool = False):
        """coded: data are bases already (``coded``), and each sequence ends in a 0."""
        self.off, self.n, self.order, self.ab, self.coded = off, len(off) - 1, order, ab, coded
        self.base = data if coded else _codes(ab)[data]

    @cached_property
    def run(self) -> np.ndarray:
        """Valid bases that end at each position."""
        at = np.arange(len(self.base))
        last = np.maximum.accumulate(np.where(self.base > 0, -1, at)) if len(at) else at
        return at - np.maximum(last, np.repeat(self.off[:-1], np.diff(self.off)) - 1)

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.off))

    def _letters(self, length: int) -> np.ndarray:
        """The number of the last ``length`` letters at each position; before a sequence's start they are 0."""
        base = self.ab.size + 1
        out = numbers(self.base, length, base)
        if not self.coded:
            out = out.copy()
            size = np.diff(self.off)
            for i in range(min(length - 1, len(self.base))):
                at = self.off[:-1][size > i] + i
                out[at] %= base ** (i + 1)
        return out

    @cached_property
    def grams(self) -> np.ndarray:
        g, contexts = _grams(self.order, self.ab.size)
        return self.ctx if contexts is None else self._letters(g + self.order).astype(np.intp)

    @cached_property
    def ctx(self) -> np.ndarray:
        size, order = self.ab.size, self.order
        if _grams(order, size)[1] is not None:
            return _one_context(order, size)[self._letters(order + 1)]
        k = np.minimum(self.run, order + 1) - 1
        y = np.maximum(self.base.astype(np.int64) - 1, 0)
        full = y.copy()
        for d in range(1, order + 1):
            before = np.zeros_like(y)
            before[d:] = y[:-d]
            full += np.where(k >= d, before, 0) * size**d
        offset = np.concatenate([[0], np.cumsum([size ** (i + 1) for i in range(order + 1)])])
        return np.where(k >= 0, offset[np.maximum(k, 0)] + full, 0)

    def whole(self, width: int) -> np.ndarray:
        """Whether a window without an unknown base starts at each position."""
        bad, have = self.base == 0, 1
        while have < width:
            step = min(have, width - have)
            bad[:-step] |= bad[step:]
            have += step
        bad[max(len(bad) - width + 1, 0) :] = True
        if not self.coded:
            at = self.off[1:]
            for j in range(1, width):
                bad[at[at >= j] - j] = True
        return ~bad

    def windows(self, width: int) -> np.ndarray:
        """Starts of the windows without an unknown base."""
        return np.flatnonzero(self.whole(width))

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """The place of each row's first window, and the end."""
        return np.searchsorted(starts, self.off)

    def rows(self, starts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.bounds(starts)))

    def sums(self, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """table (contexts, W): the sum over each window."""
        return Grams(table, self.order, self.ab).of(self, starts)

    def per_row(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have windows, and the first window of each."""
        bounds = self.bounds(starts)
        some = np.flatnonzero(np.diff(bounds))
        return some, bounds[:-1][some]


@lru_cache(8)
def _one_context(order: int, size: int) -> np.ndarray:
    """The context of every number of order + 1 letters."""
    return _grams(order, size)[1][: (size + 1) ** (order + 1), 0]


def batches_of(column: pa.Array, order: int, ab: Alphabet = STANDARD, letters: int = CHUNK) -> Iterator[tuple[int, Batch]]:
    """(first row, batch) of some ``letters`` letters each; a column of bytes is one of ``coded`` sequences."""
    known = pa.types.is_binary(column.type)
    column = column.cast(pa.large_binary() if known else pa.large_string())
    _, o, d = column.buffers()
    off = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + letters, "right")) - 1)
        yield i, Batch(data[off[i] : off[j]], off[i : j + 1] - off[i], order, ab, known)
        i = j


def coded(column: pa.Array, ab: Alphabet = STANDARD) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes) of sequences: the number of each base, 0 for an unknown one, and a 0 at the end of each sequence."""
    column = column.cast(pa.large_string())
    _, o, d = column.buffers()
    off = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(d, np.uint8)[off[0] : off[-1]] if d is not None else np.zeros(0, np.uint8)
    off = off - off[0] + np.arange(len(off))
    letter = np.ones(off[-1], bool)
    letter[off[1:] - 1] = False
    out = np.zeros(off[-1], np.uint8)
    out[letter] = np.frombuffer(data.tobytes().translate(_codes(ab).tobytes()), np.uint8)
    return off, out


def _tables(motifs: list[Motif], bg: Background, pseudo: float) -> list[np.ndarray]:
    return [np.concatenate(score_table(m, bg, pseudo)) for m in motifs]


def by_grams(tables: list[np.ndarray], order: list[int], ab: Alphabet) -> list[Grams]:
    return [Grams(t, k, ab) for t, k in zip(tables, order)]


def _windows(b: pa.RecordBatch, i: int, batch: Batch, width: int, fold: int | None) -> np.ndarray:
    """Starts of the windows, of one fold's rows only where there is one."""
    s = batch.windows(width)
    return s if fold is None else s[np.asarray(b.column("fold"))[i : i + batch.n][batch.row[s]] == fold]


def all_scores(strands: DataFrame, motifs: list[Motif], bg: Background, pseudo: float = PSEUDO, only: list[int] | None = None) -> DataFrame:
    """(motif_id, seq_id, L, start, score) of every window; start from 0 in the scanned text.

    only: for each motif, the ``fold`` whose sequences it scores; all motifs in one scan.
    """
    spark, order, ab = strands.sparkSession, [m.order for m in motifs], bg.ab
    sent = spark.sparkContext.broadcast(_tables(motifs, bg, pseudo))

    def run(it):
        tables = by_grams(sent.value, order, ab)
        for b in it:
            for m, table in enumerate(tables):
                for i, batch in batches_of(b.column(1), order[m], ab):
                    s = _windows(b, i, batch, table.width, only and only[m])
                    row = batch.rows(s)
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), m, np.int32)), b.column(0).take(take), b.column(2).take(take), pa.array((s - batch.off[row]).astype(np.int32)), pa.array(table.of(batch, s))],
                        names=["motif_id", "seq_id", "L", "start", "score"],
                    )

    kind = strands.schema["seq_id"].dataType.simpleString()
    return strands.select("seq_id", "dseq", "L", *(["fold"] if only else [])).mapInArrow(run, f"motif_id int, seq_id {kind}, L int, start int, score double")


def score_counts(strands: DataFrame, m: Motif, bg: Background, digits: int, pseudo: float = PSEUDO) -> DataFrame:
    """(score, pos, neg): how many windows of positive sequences (``is_pos`` 1) and of null ones have each rounded score.

    Tasks add up equal scores, so what is shuffled grows with the number of different windows.
    """
    order, ab = m.order, bg.ab
    sent = strands.sparkSession.sparkContext.broadcast(_tables([m], bg, pseudo)[0])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        score, n = (np.concatenate(x) for x in zip(*parts))
        distinct, at = np.unique(score, return_inverse=True)
        return distinct, np.stack([np.bincount(at, n[:, k], len(distinct)) for k in (0, 1)], axis=1)

    def run(it):
        table, parts, size = Grams(sent.value, order, ab), [], 0

        def rows(parts):
            score, n = merged(parts)
            for a in range(0, len(score), COUNTED // 10):
                x = slice(a, a + COUNTED // 10)
                yield pa.RecordBatch.from_arrays([pa.array(score[x]), *[pa.array(n[x, k].astype(np.int64)) for k in (0, 1)]], names=["score", "pos", "neg"])

        for b in it:
            for i, batch in batches_of(b.column(0), order, ab):
                s = batch.windows(table.width)
                pos = np.asarray(b.column(1))[i : i + batch.n][batch.rows(s)]
                parts.append(merged([(table.of(batch, s), np.stack([pos, 1 - pos], axis=1))]))
                size += len(parts[-1][0])
                if size > COUNTED:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > COUNTED // 2:
                        yield from rows(parts)
                        parts, size = [], 0
        if size:
            yield from rows(parts)

    counted = strands.select("dseq", F.col("is_pos").cast("int")).mapInArrow(run, "score double, pos long, neg long")
    return counted.groupBy(F.round("score", digits).alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def best_scores(strands: DataFrame, motifs: list[Motif], bg: Background, pseudo: float = PSEUDO, only: list[int] | None = None) -> DataFrame:
    """(motif_id, seq_id, L, start, score, windows): the best window of each sequence, the first of equals.

    only: for each motif, the ``fold`` whose sequences it scores; all motifs in one scan.
    """
    spark, order, ab = strands.sparkSession, [m.order for m in motifs], bg.ab
    sent = spark.sparkContext.broadcast(_tables(motifs, bg, pseudo))

    def run(it):
        tables = by_grams(sent.value, order, ab)
        for b in it:
            for m, table in enumerate(tables):
                for i, batch in batches_of(b.column(1), order[m], ab):
                    s = _windows(b, i, batch, table.width, only and only[m])
                    if not len(s):
                        continue
                    score = table.of(batch, s)
                    rows, first = batch.per_row(s)
                    top = np.maximum.reduceat(score, first)
                    count = np.diff(np.r_[first, len(s)])
                    hit = np.where(score == np.repeat(top, count), np.arange(len(s)), len(s))
                    at = np.minimum.reduceat(hit, first)
                    take = pa.array(rows + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), m, np.int32)), b.column(0).take(take), b.column(2).take(take), pa.array((s[at] - batch.off[rows]).astype(np.int32)), pa.array(top), pa.array(count.astype(np.int64))],
                        names=["motif_id", "seq_id", "L", "start", "score", "windows"],
                    )

    kind = strands.schema["seq_id"].dataType.simpleString()
    return strands.select("seq_id", "dseq", "L", *(["fold"] if only else [])).mapInArrow(run, f"motif_id int, seq_id {kind}, L int, start int, score double, windows long")


def _half_tables(spark: SparkSession, m: Motif, bg: Background, pseudo: float, ab: Alphabet) -> list[tuple[int, int, DataFrame]]:
    """(first, last, table (kmer, s)) of stretches of window places: the score of the places from the letters of the stretch and up to K before it."""
    K, W, size, table = m.order, m.width, ab.size, np.concatenate(score_table(m, bg, pseudo))
    g = 1
    while size ** (g + 1 + K) <= HALF:
        g += 1
    out = []
    for first in range(0, W, g):
        last, rows = min(first + g, W) - 1, []
        for before in range(K + 1):  # fewer than K letters before the stretch: a start, or an unknown base
            n = before + last - first + 1
            y = np.arange(size**n)
            s = np.zeros(len(y))
            for j in range(first, last + 1):
                k = min(K, before + j - first)
                offset = sum(size ** (i + 1) for i in range(k))
                s += table[offset + y // size ** (last - j) % size ** (k + 1), j]
            rows += zip([kmer_of(x, n, ab) for x in range(size**n)], s.tolist())
        out.append((first, last, spark.createDataFrame(rows, f"kmer{first} string, s{first} double")))
    return out


def join_scores(strands: DataFrame, m: Motif, bg: Background, pseudo: float = PSEUDO) -> DataFrame:
    """(seq_id, start, score) by built-in operators only: a row per window, joined with a broadcast table for each stretch of its places.

    What follows the last unknown base of a stretch is its context; where that cuts the stretch itself, no row of the table is met.
    """
    K, W, ab = m.order, m.width, bg.ab
    tables = _half_tables(strands.sparkSession, m, bg, pseudo, ab)
    # bytes, as a string is walked through from its start; and in blocks, so that a row per window does not carry its sequence
    raw = strands.where(F.length("dseq") >= W).select("seq_id", F.upper("dseq").cast("binary").alias("raw"), F.length("dseq").alias("n"))
    block = raw.select("seq_id", "raw", "n", F.explode(F.sequence(F.lit(0), F.col("n") - W, F.lit(BLOCK))).alias("b"))
    block = block.select("seq_id", "b", F.least(F.lit(BLOCK - 1), F.col("n") - W - F.col("b")).alias("more"), F.expr(f"greatest(b - {K}, 0)").alias("from"), F.expr(f"substring(raw, greatest(b - {K}, 0) + 1, {BLOCK + W + K})").alias("part"))
    at = block.select("seq_id", "part", "from", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("more"))).alias("start"))
    words = [F.expr(f"substring_index(CAST(substring(part, greatest(start + {first - K}, 0) - from + 1, start + {last + 1} - greatest(start + {first - K}, 0)) AS STRING), 'N', -1)").alias(f"kmer{first}") for first, last, _ in tables]
    out = at.select("seq_id", "start", *words)
    for first, _, table in tables:
        out = out.join(F.broadcast(table), f"kmer{first}")  # some 16,000 rows
    return out.select("seq_id", "start", reduce(add, [F.col(f"s{first}") for first, _, _ in tables]).alias("score"))


def strand_of(start: Column, length: Column) -> Column:
    return F.when(start < length, "+").otherwise("-")


def sites_of(scores: DataFrame, strands: DataFrame, width: int) -> DataFrame:
    """Adds strand, the 1-based inclusive range and the pattern to rows with (seq_id, start)."""
    text = strands.select(F.col("seq_id").alias("t_id"), "dseq")
    both = scores.join(text, scores["seq_id"] == text["t_id"]).drop("t_id")
    return both.select(
        *scores.columns, strand_of(F.col("start"), F.col("L")).alias("strand"), (F.col("start") + 1).alias("begin"), (F.col("start") + width).alias("end"), F.substring("dseq", F.col("start") + 1, F.lit(width)).alias("pattern")
    )
