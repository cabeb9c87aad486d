"""Expectation-maximisation of motifs: a Spark job per iteration, model updates on the driver."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.sequence import Alphabet
from .background import Background
from .motif import Motif, conditionals, joints, score_table
from .score import Grams, batches_of, coded

EPSILON, MAX_ITERATIONS, SITE_CUTOFF = 0.01, 1000, 0.3


def _table(m: Motif, bg: Background) -> np.ndarray:
    return np.concatenate(score_table(m, bg, 0.0))


SCALE = 10**12  # responsibilities are compared to 12 decimals


@dataclass(frozen=True)
class Cells:
    """Which windows count: those whose responsibility under a fixed score table is at least ``cutoff`` (in units of 1 / SCALE)."""

    table: np.ndarray
    q: float
    cutoff: int
    order: int = 0  # of the batches in which responsibilities were compared

    def grams(self, order: int, ab) -> Grams:
        """For batches of an order.  The table is of order 0; the numbers of longer contexts end in their last base."""
        contexts = sum(ab.size ** (i + 1) for i in range(order + 1))
        return Grams(np.tile(self.table, (-(-contexts // len(self.table)), 1)), order, ab, exp=True)

    def chosen(self, batch, grams: Grams | None = None) -> np.ndarray:
        """Whether the window at each position is one; False where none is whole."""
        whole = batch.whole(self.table.shape[1])
        return whole & (_units(_everywhere(batch, grams or self.grams(batch.order, batch.ab), self.q, whole)[0]) >= self.cutoff)


def _units(r: np.ndarray) -> np.ndarray:
    return np.rint(r * SCALE).astype(np.int64)


def _everywhere(batch, table: Grams, q: float, whole: np.ndarray, cells: Cells | None = None, cell_grams: Grams | None = None):
    """Responsibilities at all positions, 0 where no window is whole; log of the norm of each row, and its windows.  table: of odds."""
    rows = np.flatnonzero(np.diff(batch.off))
    first = batch.off[:-1][rows]
    odds, total, count = table.everywhere(batch), np.zeros(batch.n), np.zeros(batch.n, np.int64)
    odds *= whole
    if cells is not None:
        odds *= cells.chosen(batch, cell_grams)
    if len(rows):
        count[rows] = np.add.reduceat(whole, first, dtype=np.int64)
        total[rows] = np.add.reduceat(odds, first)
    share = q / np.maximum(count, 1)
    norm = (1 - q) + total * share
    odds *= np.repeat(share / norm, np.diff(batch.off))
    return odds, np.where(count > 0, np.log(norm), 0.0), count


def responsibilities(strands: DataFrame, m: Motif, bg: Background, at_least: float = 0.0) -> DataFrame:
    """(seq_id, L, start, r): the probability that each window is the sequence's site."""
    sent = strands.sparkSession.sparkContext.broadcast((_table(m, bg), m.q))
    order, ab = m.order, bg.ab

    def run(it):
        table, q = Grams(sent.value[0], order, ab, exp=True), sent.value[1]
        for b in it:
            for i, batch in batches_of(b.column(1), order, ab):
                whole = batch.whole(table.width)
                r = _everywhere(batch, table, q, whole)[0]
                s = np.flatnonzero(whole & (r >= at_least))
                r, row = r[s], batch.row[s]
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array((s - batch.off[row]).astype(np.int32)), pa.array(r)], names=["seq_id", "L", "start", "r"])

    kind = strands.schema["seq_id"].dataType.simpleString()
    return strands.select("seq_id", "dseq", "L").mapInArrow(run, f"seq_id {kind}, L int, start int, r double")


def expected_counts_many(
    strands: DataFrame, motifs: list[Motif], bg: Background, at_least: float = 0.0, sample_seed: int | None = None, cells: list[Cells | None] | None = None, held_out: list[int] | None = None
) -> list[tuple[list[np.ndarray], float, float, int]]:
    """For each motif: expected k-mer counts n[k][y, j], log-likelihood, sum of responsibilities, sequences; all in one job.

    at_least: only windows with that responsibility count.  cells: all others have none, whatever the model.  sample_seed: instead of fractions, one drawn site (or none)
    per sequence, the draw fixed by the seed and the sequence's id.  held_out: for each motif, the ``fold`` of sequences that do not count.
    A batch's contexts are found once for all motifs of an order; tasks send one table of sums each.  strands may also be ``distinct`` sequences,
    each of which counts as often as it stands there.
    """
    size, ab = bg.ab.size, bg.ab
    cells, folds = cells or [None] * len(motifs), held_out or [None] * len(motifs)
    sent = strands.sparkSession.sparkContext.broadcast([(m.order, _table(m, bg), m.q, c, f) for m, c, f in zip(motifs, cells, folds)])
    widths = [m.width for m in motifs]
    contexts = [len(t[1]) for t in sent.value]
    at = np.concatenate([[0], np.cumsum([c * w + 3 for c, w in zip(contexts, widths)])])

    def run(it):
        models = [(o, Grams(table, o, ab, exp=True), q, c, c and c.grams(o, ab), out) for o, table, q, c, out in sent.value]
        sums, ends = [m[1].empty() for m in models], np.zeros((len(models), 3))
        orders = sorted({m[0] for m in models})
        for b in it:
            many, fold = np.asarray(b.column(1)), np.asarray(b.column(2))
            for order in orders:
                for i, batch in batches_of(b.column(0), order, ab):
                    for k, (o, table, q, chosen, grams, out) in enumerate(models):
                        if o == order:
                            weight = many[i : i + batch.n] if out is None else np.where(fold[i : i + batch.n] != out, many[i : i + batch.n], 0)
                            ends[k] += one(b, i, batch, table, q, chosen, grams, weight, sums[k])
        flat = np.concatenate([np.r_[m[1].by_context(x).ravel(), e] for m, x, e in zip(models, sums, ends)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    def one(b, i, batch, table, q, chosen, grams, weight, sums) -> np.ndarray:
        r, llh, count = _everywhere(batch, table, q, batch.whole(table.width), chosen, grams)
        if sample_seed is not None:
            u = np.asarray(b.column(3))[i : i + batch.n]
            upto = np.r_[0.0, np.cumsum(r)]
            drawn_at = np.searchsorted(upto[1:], upto[batch.off[:-1]] + u, "right")
            drawn = (drawn_at < batch.off[1:]) & (count > 0)
            r = np.zeros(len(r))
            r[drawn_at[drawn]] = 1.0
        if at_least:
            r[r < at_least] = 0.0
        if not (weight == 1).all():
            r *= np.repeat(weight, np.diff(batch.off))
        table.add_everywhere(sums, batch, r)
        return np.array([(llh * weight).sum(), r.sum(), weight[count > 0].sum()])

    draw = uniform(sample_seed, F.col("seq_id"), F.lit("site")) if sample_seed is not None else F.lit(0.0)
    text = "codes" if "codes" in strands.columns else "dseq"
    many = F.col("many") if "many" in strands.columns else F.lit(1)
    fold = F.col("fold") if held_out else F.lit(0)
    made = strands.select(text, many.cast("long").alias("many"), fold.cast("int").alias("fold"), draw.alias("u")).mapInArrow(run, "i int, x double")
    flat = np.zeros(at[-1])
    for r in made.groupBy("i").agg(F.sum("x").alias("x")).collect():  # contexts * W + 3 rows a motif
        flat[r["i"]] = r["x"]
    out = []
    for k, m in enumerate(motifs):
        part = flat[at[k] : at[k + 1]]
        out.append((roll_up(part[:-3].reshape(contexts[k], widths[k]), m.order, size), float(part[-3]), float(part[-2]), int(part[-1])))
    return out


def distinct(strands: DataFrame, ab: Alphabet) -> DataFrame:
    """(codes, many, fold): the different sequences as ``coded`` bytes, and how often each stands in ``strands``.

    The shuffle also deals them evenly, however few row groups the input has; to two tasks a core, as each task of an iteration costs some
    90 ms before its first row.
    """
    names = ["many", *(["fold"] if "fold" in strands.columns else [])]
    found = strands.where(F.col("dseq").isNotNull()).groupBy("dseq", *names[1:]).agg(F.count("*").alias("many")).coalesce(2 * strands.sparkSession.sparkContext.defaultParallelism)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            off, codes = coded(b.column(0), ab)
            text = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([text.cast(pa.binary()), *b.columns[1:]], names=["codes", *names])

    return found.select("dseq", "many", *[F.col(c).cast("int").alias(c) for c in names[1:]]).mapInArrow(run, "codes binary, many long" + ", fold int" * len(names[1:]))


def expected_counts(strands: DataFrame, m: Motif, bg: Background, at_least: float = 0.0, sample_seed: int | None = None, cells: Cells | None = None) -> tuple[list[np.ndarray], float, float, int]:
    """``expected_counts_many`` of one motif."""
    return expected_counts_many(strands, [m], bg, at_least, sample_seed, [cells])[0]


def roll_up(sums: np.ndarray, order: int, size: int) -> list[np.ndarray]:
    """Counts by context of any order to counts n[k] of every order: a longer context also counts as its suffixes."""
    offset = np.concatenate([[0], np.cumsum([size ** (i + 1) for i in range(order + 1)])])
    n = [sums[offset[k] : offset[k + 1]].copy() for k in range(order + 1)]
    for k in range(order, 0, -1):
        n[k - 1] += n[k].reshape(size, size**k, -1).sum(axis=0)
    return n


def update(m: Motif, n: list[np.ndarray], bg: Background, q: float | None = None, alpha: np.ndarray | None = None) -> Motif:
    a = m.alpha if alpha is None else alpha
    v = conditionals(n, a, bg)
    return Motif(v, joints(v, bg), n, a, m.q if q is None else q, m.name, m.ab)


@dataclass
class Fit:
    motif: Motif
    log_likelihood: list[float]
    change: list[float]


def optimize_many(
    strands: DataFrame, motifs: list[Motif], bg: Background, optimize_q: bool = False, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, at_least: float = 0.0,
    cells: list[Cells | None] | None = None, held_out: list[int] | None = None, counts=None,
) -> list[Fit]:
    """Each motif until its conditionals change by less than ``epsilon`` in total, or its likelihood falls after iteration 10.

    One job an iteration for all motifs that still change.  held_out: for each motif, the ``fold`` it does not see.  counts: what gives
    the expected counts, ``expected_counts_many`` by default.
    """
    if counts is None:
        counts, strands = expected_counts_many, distinct(strands, bg.ab)
    strands = strands.persist()
    try:
        fits = [Fit(m, [], []) for m in motifs]
        active = list(range(len(motifs)))
        for i in range(max_iterations):
            pick = lambda x: None if x is None else [x[k] for k in active]
            found = counts(strands, [fits[k].motif for k in active], bg, at_least, cells=pick(cells), held_out=pick(held_out))
            on = []
            for k, (n, llh, total, n_seqs) in zip(active, found):
                fit = fits[k]
                q = (total + 1) / (n_seqs + 2) if optimize_q and i < 5 else None
                new = update(fit.motif, n, bg, q)
                change = float(np.abs(new.v[-1] - fit.motif.v[-1]).sum())
                fell = bool(fit.log_likelihood) and llh < fit.log_likelihood[-1]
                fit.change.append(change)
                fit.log_likelihood.append(llh)
                fit.motif = new
                if not (change < epsilon or (fell and i > 10)):
                    on.append(k)
            active = on
            if not active:
                break
        return fits
    finally:
        strands.unpersist()


def optimize(strands: DataFrame, m: Motif, bg: Background, optimize_q: bool = False, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, at_least: float = 0.0, cells: Cells | None = None) -> Fit:
    """``optimize_many`` of one motif."""
    return optimize_many(strands, [m], bg, optimize_q, epsilon, max_iterations, at_least, [cells])[0]


def top_cells(strands: DataFrame, m: Motif, bg: Background, share: float = 0.05) -> Cells:
    """The windows that an order-0 step chooses: those with at least the responsibility at place floor(share * windows), in descending order.

    The order statistic is exact: three passes count responsibilities by 14 bits each.
    """
    zero = Motif(m.v[:1], m.p[:1], m.n[:1], m.alpha[:1], m.q, m.name, m.ab)
    table, bits = _table(zero, bg), 14
    text = "codes" if "codes" in strands.columns else "dseq"
    many = F.col("many") if "many" in strands.columns else F.lit(1).cast("long")
    cells, ab = Cells(table, m.q, 0, m.order), bg.ab
    sent = strands.sparkSession.sparkContext.broadcast(cells)
    prefix, place = 0, None
    for turn in (2, 1, 0):
        low = bits * turn

        def run(it, prefix=prefix, low=low):
            cells, counts = sent.value, np.zeros(1 << bits, np.int64)
            grams = cells.grams(cells.order, ab)
            for b in it:
                for i, batch in batches_of(b.column(0), cells.order, ab):
                    whole, weight = batch.whole(grams.width), np.asarray(b.column(1))[i : i + batch.n]
                    u = _units(_everywhere(batch, grams, cells.q, whole)[0])
                    at = np.flatnonzero(whole & (u >> low + bits == prefix))
                    counts += np.bincount((u[at] >> low) & ((1 << bits) - 1), weight[batch.row[at]], 1 << bits).astype(np.int64)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["u", "n"])

        rows = strands.select(text, many.alias("many")).mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).orderBy(F.desc("u")).collect()  # 2^14 rows at most
        total = sum(r["n"] for r in rows)
        if not total:
            return cells
        place = min(int(total * share), total - 1) if place is None else place
        for r in rows:
            if place < r["n"]:
                prefix = (prefix << bits) | r["u"]
                break
            place -= r["n"]
    return Cells(table, m.q, prefix, m.order)


def masked_optimize(strands: DataFrame, m: Motif, bg: Background, share: float = 0.05, **options) -> Fit:
    """An order-0 step of the starting model chooses the windows with the highest responsibilities; full-order steps then use only those.

    The chosen windows stay the same in all steps: they are found once and kept as numbers of their letters (``chosen_grams``), so a step costs
    what its chosen windows do.
    """
    texts = distinct(strands, bg.ab).persist()
    try:
        cells = top_cells(texts, m, bg, share)
        counts = lambda rows, motifs, bg, at_least, cells, held_out: [_chosen_counts(rows, motifs[0], bg, at_least)]
        return optimize_many(chosen_grams(texts, cells, bg), [m], bg, counts=counts, **options)[0]
    finally:
        texts.unpersist()


def chosen_grams(texts: DataFrame, cells: Cells, bg: Background) -> DataFrame:
    """(windows, many, grams) of ``distinct`` sequences: how many windows each has, how often it stands in the input, and of its chosen windows the numbers
    that a table of the cells' order is read by (``Grams``), the parts of all windows one after another.

    Sequences without a chosen window are one row a batch, as only their number counts.
    """
    sent, ab, order, W = texts.sparkSession.sparkContext.broadcast(cells), bg.ab, cells.order, cells.table.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = sent.value.grams(order, ab)
        for b in it:
            for i, batch in batches_of(b.column(0), order, ab):
                weight, at = np.asarray(b.column(1))[i : i + batch.n], sent.value.chosen(batch, grams)
                windows, chosen = (np.add.reduceat(x, batch.off[:-1], dtype=np.int64) for x in (batch.whole(W), at))
                s = np.flatnonzero(at)
                numbers = np.stack([batch.grams[s + last] for _, last, _ in grams.parts], axis=1).astype(np.int32)
                some, none = np.flatnonzero(chosen), (chosen == 0) & (windows > 0)
                width = 4 * len(grams.parts)
                ends = np.r_[0, np.cumsum(chosen[some])] * width
                ends = np.r_[ends, ends[-1]].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[windows[some], 1]), pa.array(np.r_[weight[some], weight[none].sum()]), pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(numbers)])],
                    names=["windows", "many", "grams"],
                )

    return texts.select("codes", "many").mapInArrow(run, "windows long, many long, grams binary")


def _chosen_counts(rows: DataFrame, m: Motif, bg: Background, at_least: float = 0.0) -> tuple[list[np.ndarray], float, float, int]:
    """``expected_counts`` over ``chosen_grams``."""
    sent, order, ab = rows.sparkSession.sparkContext.broadcast((_table(m, bg), m.q)), m.order, bg.ab
    contexts, W = len(sent.value[0]), m.width

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, q = Grams(sent.value[0], order, ab, exp=True), sent.value[1]
        sums, ends, parts = table.empty(), np.zeros(3), len(table.parts)
        for b in it:
            windows, weight = np.asarray(b.column(0)), np.asarray(b.column(1))
            _, o, d = b.column(2).cast(pa.large_binary()).buffers()
            off = np.frombuffer(o, np.int64)[b.column(2).offset : b.column(2).offset + b.num_rows + 1]
            numbers = np.frombuffer(d, np.uint8)[off[0] : off[-1]].view(np.int32).reshape(-1, parts) if d is not None else np.zeros((0, parts), np.int32)
            off = (off - off[0]) // (4 * parts)
            at = [np.ascontiguousarray(x).astype(np.intp) for x in numbers.T]
            odds = np.ones(len(numbers))
            for (_, _, part), x in zip(table.parts, at):
                odds *= part.take(x)
            some, total = np.flatnonzero(np.diff(off)), np.zeros(len(windows))
            if len(some):
                total[some] = np.add.reduceat(odds, off[:-1][some])
            norm = (1 - q) + total * (q / windows)
            r = odds * np.repeat(q / windows / norm, np.diff(off))
            if at_least:
                r[r < at_least] = 0.0
            r *= np.repeat(weight, np.diff(off))
            for x, y in zip(sums, at):
                x += np.bincount(y, r, len(x))
            ends += [(np.log(norm) * weight).sum(), r.sum(), weight.sum()]
        flat = np.r_[table.by_context(sums).ravel(), ends]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    flat = np.zeros(contexts * W + 3)
    for r in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # contexts * W + 3 rows
        flat[r["i"]] = r["x"]
    return roll_up(flat[:-3].reshape(contexts, W), order, ab.size), float(flat[-3]), float(flat[-2]), int(flat[-1])


def chosen_windows(strands: DataFrame, cells: Cells, bg: Background) -> DataFrame:
    """(seq_id, start) of the chosen windows."""
    sent, ab = strands.sparkSession.sparkContext.broadcast(cells), bg.ab

    def run(it):
        grams = sent.value.grams(sent.value.order, ab)
        for b in it:
            for i, batch in batches_of(b.column(1), sent.value.order, ab):
                s = np.flatnonzero(sent.value.chosen(batch, grams))
                row = batch.row[s]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array((s - batch.off[row]).astype(np.int32))], names=["seq_id", "start"])

    return strands.select("seq_id", "dseq").mapInArrow(run, f"seq_id {strands.schema['seq_id'].dataType.simpleString()}, start int")


def positions(strands: DataFrame, m: Motif, bg: Background, cutoff: float = SITE_CUTOFF) -> DataFrame:
    """Sites: windows with a responsibility of at least ``cutoff``."""
    from .score import sites_of

    return sites_of(responsibilities(strands, m, bg, cutoff), strands, m.width)


def sites_from_pwm(strands: DataFrame, pwm: np.ndarray, bg: Background, order: int = 2, q: float = 0.3, seed: int = 42, name: str = "motif") -> Motif:
    """A motif of higher order from a weight matrix: one site (or none) is drawn per sequence from the order-0 posterior, and the k-mers of these sites are counted."""
    from .motif import build, from_pwm

    start = from_pwm(pwm, bg, order, q=q, name=name)
    n, _, drawn, _ = expected_counts(strands, start, bg, sample_seed=seed)
    return build(n, bg, q=q, name=name) if drawn else start
