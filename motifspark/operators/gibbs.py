"""Gibbs refinement: collapsed, with several chains at once (``collapsed``), or blocked (``optimize``).

Collapsed: a sequence's site is drawn given the sites of all others, its own taken out of the counts.  In a round a share of the sequences,
drawn anew each time, moves at once against the counts of the round before; the smaller the share, the closer to moving one
at a time.  A round is one Spark job: tasks send the new sites and the change of the counts.  The sequences lie in blocks of coded letters,
bucketed by block, so that a round joins a row a block.  A sequence's odds are products of a few tables of its own, one for each stretch of
places (``Stretches``): the letters before a window concern the background alone, and that part is the same for all sequences.

Blocked: all sites are drawn for the mean model of the round before, which is another chain than the collapsed one.  Draws depend on
(seed, chain, round, sequence id) only.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniforms
from ..functions.numeric import digamma
from ..functions.sequence import Alphabet
from ..shared import bucketed, dropped, materialise
from .background import Background
from .em import _table, expected_counts, roll_up, update
from .motif import Motif, conditionals
from .score import Batch, Grams, coded, numbers

ITERATIONS = 100
TABLES = 1_000_000  # places of the tables that a task holds at once
BLOCK, STRETCH = 64_000, 256  # letters of a block; numbers that a stretch of places takes
TASK = 32_000_000  # letters of a task: a round has one Python task for each, or two a core, as each costs some 90 ms before its first row
MOVED, NEAR = 300_000, 16_000  # letters of the sequences that are drawn at once, and of arrays that stay near the core


def log_posterior_alpha(a: float, k: int, j: int, n: list[np.ndarray], v_lower: np.ndarray, beta: float = 7.0, gamma: float = 3.0) -> float:
    """Log posterior of one strength alpha = a of order k at position j: Dirichlet-multinomial evidence of its contexts and an inverse-gamma-like prior."""
    size = n[0].shape[0]
    count, prior = n[k][:, j], a * v_lower[:, j]
    lg = np.vectorize(math.lgamma)
    context = count.reshape(-1, size).sum(axis=1)
    out = float((lg(count + prior) - lg(prior)).sum() + len(context) * math.lgamma(a) - lg(context + a).sum())
    b = beta * gamma ** max(k, 1)
    return out - 2 * math.log(a) - b / a


def gradient_alpha(a: float, k: int, j: int, n: list[np.ndarray], v_lower: np.ndarray, beta: float = 7.0, gamma: float = 3.0) -> float:
    """Derivative of ``log_posterior_alpha`` by log a."""
    size = n[0].shape[0]
    count, w = n[k][:, j], v_lower[:, j]
    dg = np.vectorize(digamma)
    context = count.reshape(-1, size).sum(axis=1)
    out = float((w * (dg(count + a * w) - dg(a * w))).sum() + len(context) * digamma(a) - dg(context + a).sum())
    return a * (out - 2 / a + beta * gamma ** max(k, 1) / a**2)


def _lower(m: Motif, bg: Background, k: int) -> np.ndarray:
    size = m.ab.size
    y = np.arange(size ** (k + 1))
    if k == 0:
        return np.repeat(np.maximum(bg.v[0], 1e-9)[:, None], m.width, axis=1)
    return np.maximum(m.v[k - 1][y % size**k], 1e-9)


class Adam:
    """Ascent on log alpha, the step shrinking with the square root of the round."""

    def __init__(self, shape, eta: float = 0.2):
        self.m, self.v, self.t, self.eta = np.zeros(shape), np.zeros(shape), 0, eta

    def step(self, log_alpha: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        rise = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return np.clip(log_alpha + self.eta / math.sqrt(self.t) * rise, -6, 12)


def metropolis(log_alpha: np.ndarray, m: Motif, bg: Background, rng: np.random.Generator) -> np.ndarray:
    """One proposal per (order, position), normal with deviation 1 / (k + 1)."""
    out = log_alpha.copy()
    for k in range(m.order + 1):
        low = _lower(m, bg, k)
        for j in range(k, m.width):
            new = out[k, j] + rng.normal() / (k + 1)
            gain = log_posterior_alpha(math.exp(new), k, j, m.n, low) - log_posterior_alpha(math.exp(out[k, j]), k, j, m.n, low)
            if math.log(rng.random() + 1e-300) < gain:
                out[k, j] = new
    return out


def on_grid(m: Motif, bg: Background, rng: np.random.Generator) -> np.ndarray:
    """Draws each log alpha from its posterior on the grid 0, 0.1, ..., 9.9."""
    grid, out = np.arange(100) / 10, np.log(m.alpha)
    for k in range(m.order + 1):
        low = _lower(m, bg, k)
        for j in range(k, m.width):
            lp = np.array([log_posterior_alpha(math.exp(a), k, j, m.n, low) for a in grid])
            p = np.exp(lp - lp.max())
            out[k, j] = rng.choice(grid, p=p / p.sum())
    return out


def moved_alpha(m: Motif, bg: Background, how: str, adam: Adam, rng: np.random.Generator) -> np.ndarray:
    """log alpha after one step.  how: adam, metropolis, grid or fixed."""
    log_alpha = np.log(m.alpha)
    if how == "adam":
        grad = np.zeros_like(log_alpha)
        for k in range(m.order + 1):
            low = _lower(m, bg, k)
            for j in range(k, m.width):
                grad[k, j] = gradient_alpha(m.alpha[k, j], k, j, m.n, low)
        return adam.step(log_alpha, grad)
    if how == "metropolis":
        return metropolis(log_alpha, m, bg, rng)
    return on_grid(m, bg, rng) if how == "grid" else log_alpha


def optimize(strands: DataFrame, m: Motif, bg: Background, iterations: int = ITERATIONS, seed: int = 42, sample_q: bool = True, alpha: str = "adam") -> Motif:
    """Blocked.  alpha: adam, metropolis, grid or fixed."""
    rng = np.random.default_rng(seed)
    adam = Adam(m.alpha.shape)
    strands = strands.persist()
    try:
        for i in range(iterations):
            n, _, total, n_seqs = expected_counts(strands, m, bg, sample_seed=seed * 1_000_003 + i)
            q = float(rng.beta(total + 1, n_seqs - total + 1)) if sample_q else None
            m = update(m, n, bg, None if q is None else min(max(q, 1e-3), 1 - 1e-3))
            m = update(m, n, bg, alpha=np.exp(moved_alpha(m, bg, alpha, adam, rng)))
        return m
    finally:
        strands.unpersist()


# --- collapsed ---


def split_r_hat(x: np.ndarray) -> float:
    """The potential scale reduction of chains (chains, rounds), each cut in halves."""
    half = x.shape[1] // 2
    x = np.concatenate([x[:, :half], x[:, half : 2 * half]])
    within, between = x.var(axis=1, ddof=1).mean(), half * x.mean(axis=1).var(ddof=1)
    if within <= 0:
        return 1.0 if between <= 0 else math.inf
    return float(np.sqrt(((half - 1) / half * within + between / half) / within))


@dataclass
class Chains:
    """motif: from the counts averaged over chains and rounds after the first half; marginals: (seq_id, start, p); r_hat, rounds."""

    motif: Motif
    marginals: DataFrame
    r_hat: float
    rounds: int


def draw_site(n: np.ndarray, own: np.ndarray | None, ctx: np.ndarray, starts: np.ndarray, alpha: np.ndarray, q: float, bg: Background, log_bg: np.ndarray, u: float) -> int:
    """The place in ``starts`` of a sequence's new site, or -1, given the context counts n (contexts, W) of all sites; own: the contexts of its old site."""
    W = n.shape[1]
    if own is not None:
        n = n.copy()
        n[own, np.arange(W)] -= 1
    v = np.concatenate(conditionals(roll_up(n, len(alpha) - 1, bg.ab.size), alpha, bg))
    s = np.log(np.maximum(v, 1e-300)) - log_bg[:, None]
    odds = np.exp(s[ctx[starts[:, None] + np.arange(W)], np.arange(W)].sum(axis=1)) * (q / max(len(starts), 1))
    upto = np.cumsum(odds)
    total = (1 - q) + (upto[-1] if len(upto) else 0.0)
    at = int(np.searchsorted(upto, u * total, "right"))
    return at if at < len(starts) else -1


def site_tables(n: np.ndarray, own: np.ndarray, alpha: np.ndarray, bg: Background, log_bg: np.ndarray) -> np.ndarray:
    """Log odds (sites, contexts, W) given the counts n (contexts, W) of all sites but one: that with the contexts own (sites, W), or none where they are negative."""
    size, W = bg.ab.size, n.shape[1]
    x = np.repeat(n[None], len(own), axis=0)
    some = np.flatnonzero(own[:, 0] >= 0)
    x[some[:, None], own[some], np.arange(W)] -= 1
    offset = np.concatenate([[0], np.cumsum([size ** (k + 1) for k in range(len(alpha))])])
    count = [x[:, offset[k] : offset[k + 1]] for k in range(len(alpha))]
    for k in range(len(alpha) - 1, 0, -1):
        count[k - 1] += count[k].reshape(len(own), size, size**k, W).sum(axis=1)
    v = [(count[0] + alpha[0] * bg.v[0][:, None]) / (count[0].sum(axis=1, keepdims=True) + alpha[0])]
    for k in range(1, len(alpha)):
        y = np.arange(size ** (k + 1))
        out = v[k - 1][:, y % size**k]
        out[:, :, k:] = (count[k][:, :, k:] + alpha[k, k:] * out[:, :, k:]) / (count[k - 1][:, y // size, k - 1 : -1] + alpha[k, k:])
        v.append(out)
    return np.log(np.maximum(np.concatenate(v, axis=1), 1e-300)) - log_bg[:, None]


def draw_sites(batch, starts: np.ndarray, odds: np.ndarray, rows: np.ndarray, q: float, u: np.ndarray) -> np.ndarray:
    """The new start in the batch of each of ``rows``, or -1; starts, odds: of all their windows, in order."""
    bounds = np.searchsorted(starts, np.stack([batch.off[rows], batch.off[rows + 1]]))
    count = bounds[1] - bounds[0]
    odds = odds * np.repeat(q / np.maximum(count, 1), count)
    upto = np.r_[0.0, np.cumsum(odds)]
    before, after = upto[bounds[0]], upto[bounds[1]]
    at = np.searchsorted(upto[1:], before + u * ((1 - q) + (after - before)), "right")
    found = at < bounds[1]
    return np.where(found, starts[np.where(found, at, 0)] if len(starts) else -1, -1)


class Stretches:
    """The motif's places in stretches whose letters, with those before them inside the window, take at most STRETCH numbers.

    parts: (first, last, letters, offset) of each; size: of all their tables together.  At places less than the background's order the
    background also sees letters before the window; there the tables leave it out (``outside`` has it).
    """

    def __init__(self, order: int, width: int, bg: Background):
        self.order, self.width, self.bg, size = order, width, bg, bg.ab.size
        self.seen = min(order, bg.order)
        self.parts, self.size, first = [], 0, 0
        while first < width:
            before, last = max(0, first - order), first
            while last + 1 < width and size ** (last + 2 - before) <= STRETCH:
                last += 1
            self.parts.append((first, last, last + 1 - before, self.size))
            self.size += size ** (last + 1 - before)
            first = last + 1

    def tables(self, n: list[np.ndarray], chain: np.ndarray, own: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        """Odds (sites, size) given the counts n[k][chain, y, j] of all sites of a chain but one: that with the letters own (sites, W), or none where they are negative.

        alpha: (chains, orders, W).
        """
        size, W, S, some = self.bg.ab.size, self.width, len(own), np.flatnonzero(own[:, 0] >= 0)
        letters, at, alpha = own[some], np.arange(W), alpha[chain]
        count = n[0].transpose(0, 2, 1)[chain]  # (sites, place, letters)
        count[some[:, None], at, letters] -= 1
        v = (count + alpha[:, 0, :, None] * self.bg.v[0]) / (count.sum(axis=2) + alpha[:, 0])[:, :, None]
        full, number = [v], letters
        for k in range(1, self.order + 1):
            number = number[:, :-1] * size + letters[:, k:]
            below, count = count, n[k][:, :, k:].transpose(0, 2, 1)[chain]
            count[some[:, None], at[: W - k], number] -= 1
            v = count.reshape(S, W - k, size, size**k) + (alpha[:, k, k:, None] * v[:, 1:])[:, :, None]
            v = (v.reshape(S, W - k, size**k, size) / (below[:, :-1] + alpha[:, k, k:, None])[..., None]).reshape(S, W - k, size ** (k + 1))
            full.append(v)
        out = np.empty((S, self.size))
        for first, last, length, offset in self.parts:
            table = np.ones((S, size ** (length - 1 - last + first)))  # by the letters before the stretch
            for j in range(first, last + 1):
                k = min(j, self.order)
                x = full[k][:, j - k]
                if j >= self.seen:
                    x = x / self.bg.v[self.seen][np.arange(size ** (k + 1)) % size ** (self.seen + 1)]
                table = (table.reshape(S, -1, size**k, 1) * x.reshape(S, 1, size**k, size)).reshape(S, -1)
            out[:, offset : offset + size**length] = table
        return out

    def outside(self, code: np.ndarray) -> np.ndarray:
        """One over the background's part at the places less than its order, of the window at each position of a text."""
        seen, size, out = self.seen, self.bg.ab.size, np.ones(len(code))
        if not seen:
            return out
        if (size + 1) ** (2 * seen) <= TABLES:
            n = max(len(code) - seen + 1, 0)
            out[:n] = self._outside.take(numbers(code, 2 * seen, size + 1)[seen - 1 :])
            return out
        odds = np.exp(-_log_background(self.bg, seen))
        for j in range(min(seen, len(code))):
            out[: len(code) - j] *= odds[contexts_at(code, np.arange(j, len(code)), seen, size)]
        return out

    @cached_property
    def _outside(self) -> np.ndarray:
        """``outside`` by the number of the letters around a window's start, as many before it as from it on."""
        seen, base = self.seen, self.bg.ab.size + 1
        y = np.arange(base ** (2 * seen))
        code = np.stack([y // base**d % base for d in range(2 * seen - 1, -1, -1)], axis=1).ravel()  # a text for each number
        odds, at = np.exp(-_log_background(self.bg, seen)), y * 2 * seen
        return np.prod([odds[contexts_at(code, at + seen + j, seen, base - 1)] for j in range(seen)], axis=0)

    def odds(self, text: Batch, whole: np.ndarray, tables: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The odds of the window at each position, 0 where it is not whole; which: the table of each sequence."""
        code, size = text.base, self.bg.ab.size
        out, m = self.outside(code), max(len(code) - self.width + 1, 0)
        first, known = np.repeat(which * self.size, np.diff(text.off)), np.maximum(code, 1) - np.uint8(1)
        parts = [(last, tables.ravel()[offset:], numbers(known, length, size)) for _, last, length, offset in self.parts]
        for a in range(0, m, NEAR):
            b = min(a + NEAR, m)
            for last, table, number in parts:
                out[a:b] *= table.take(first[a:b] + number[a + last : b + last], mode="clip")
        out *= whole
        return out


def contexts_at(code: np.ndarray, at: np.ndarray, order: int, size: int) -> np.ndarray:
    """The number of the context of order min(order, known bases before) at each place ``at``, in any shape."""
    y, k, known = np.zeros(at.shape, np.int64), np.full(at.shape, -1), np.ones(at.shape, bool)
    for d in range(order + 1):
        c = np.where(at >= d, code[np.maximum(at - d, 0)], 0).astype(np.int64)
        known &= c > 0
        y += np.where(known, (c - 1) * size**d, 0)
        k += known
    offset = np.concatenate([[0], np.cumsum([size ** (i + 1) for i in range(order + 1)])])
    return np.where(k >= 0, offset[np.maximum(k, 0)] + y, 0)


def drawn(odds: np.ndarray, ends: np.ndarray, windows: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The place of each row's new site in ``odds`` (those of all places of all rows, 0 where there is no window), or -1."""
    upto = np.cumsum(odds)
    after = upto[ends - 1]
    before = np.r_[0.0, after[:-1]]
    goal = before + u * ((1 - q) * np.maximum(windows, 1) / np.maximum(q, 1e-300) + (after - before))
    at = np.searchsorted(upto, goal, "right")
    return np.where((at < ends) & (windows > 0), at, -1)


def _log_background(bg: Background, order: int) -> np.ndarray:
    size, out = bg.ab.size, []
    for k in range(order + 1):
        o = min(k, bg.order)
        out.append(np.log(bg.v[o][np.arange(size ** (k + 1)) % size ** (o + 1)]))
    return np.concatenate(out)


def blocks(strands: DataFrame, ab: Alphabet) -> DataFrame:
    """(block, ids, sizes, codes): some BLOCK letters of ``coded`` sequences a row; sizes: of each of them, its end counted."""
    kind = strands.schema["seq_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in it:
            size = np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)).astype(np.int64) + 1
            for part in _parts(size, len(size), BLOCK):
                off, codes = coded(b.column(1).slice(part.start, part.stop - part.start), ab)
                one = pa.array([0, len(off) - 1], pa.int32())
                ids = pa.ListArray.from_arrays(one, b.column(0).slice(part.start, len(off) - 1))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.ListArray.from_arrays(one, pa.array(np.diff(off).astype(np.int32))), pa.array([codes.tobytes()], pa.binary())], names=["block", "ids", "sizes", "codes"])
                number += 1

    return strands.select("seq_id", "dseq").mapInArrow(run, f"block long, ids array<{kind}>, sizes array<int>, codes binary")


def _parts(size: np.ndarray, most: int, letters: int = MOVED) -> Iterator[slice]:
    """Runs of at most ``most`` rows and some ``letters`` letters, one row at least."""
    end, a = np.cumsum(size), 0
    while a < len(size):
        b = int(np.searchsorted(end, (end[a - 1] if a else 0) + letters, "right"))
        b = min(max(b, a + 1), a + most)
        yield slice(a, b)
        a = b


def _joined(b: pa.RecordBatch, order: int, ab: Alphabet) -> Iterator[tuple[int, int, Batch]]:
    """(first row, rows, batch) of blocks that lie end to end."""
    codes = b.column(3).cast(pa.large_binary())
    _, o, d = codes.buffers()
    off = np.frombuffer(o, np.int64)[codes.offset : codes.offset + len(codes) + 1]
    for part in _parts(np.diff(off), len(codes), 2 * MOVED):
        many = part.stop - part.start
        size = np.asarray(b.column(2).slice(part.start, many).flatten()).astype(np.int64)
        yield part.start, many, Batch(np.frombuffer(d, np.uint8)[off[part.start] : off[part.stop]], np.r_[0, np.cumsum(size)], order, ab, coded=True)


def _redrawn(batch: Batch, row: np.ndarray, chain: np.ndarray, old: np.ndarray, stretches: Stretches, n: list[np.ndarray], alpha: np.ndarray, q: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The places of the new sites of rows of chains, or -1, their old sites taken out of the counts."""
    had, W = old >= 0, stretches.width
    own = np.where(had[:, None], batch.base[np.where(had, old, 0)[:, None] + np.arange(W)].astype(np.int64) - 1, -1)
    key = chain.astype(object if len(q) * (batch.ab.size + 1) ** W > 2**62 else np.int64)
    for j in range(W):
        key = key * (batch.ab.size + 1) + own[:, j] + 1
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    tables = stretches.tables(n, chain[first], own[first], alpha)
    ends = np.cumsum(np.diff(batch.off)[row])
    text = Batch(np.concatenate([batch.base[a:b] for a, b in zip(batch.off[row].tolist(), batch.off[row + 1].tolist())]), np.r_[0, ends], batch.order, batch.ab, coded=True)
    whole = text.whole(W)
    windows = np.add.reduceat(whole, text.off[:-1], dtype=np.intp)
    at = drawn(stretches.odds(text, whole, tables, which), ends, windows, q[chain], u)
    return np.where(at >= 0, at - text.off[:-1] + batch.off[row], -1)


def _count(change: np.ndarray, batch: Batch, chain: np.ndarray, at: np.ndarray, by: int) -> None:
    """Adds the contexts of sites (-1: none) to ``change`` (chains, contexts, W)."""
    got, places = at >= 0, np.arange(change.shape[2])
    np.add.at(change, (chain[got][:, None], contexts_at(batch.base, at[got][:, None] + places, batch.order, batch.ab.size), places), by)


def collapsed(
    strands: DataFrame, m: Motif, bg: Background, rounds: int = ITERATIONS, chains: int = 4, share: float = 0.25, seed: int = 42, sample_q: bool = True, alpha: str = "adam", r_hat: float = 1.05, least: int = 20
) -> Chains:
    """Until the chains agree (split R-hat of the number of sites and of the motif's information, from ``least`` rounds on, looked at every ten), or ``rounds``.

    share: of the sequences that move in a round.  The sequences are written once, in blocks; a round moves only sites.
    """
    spark, K, W, ab, size = strands.sparkSession, m.order, m.width, bg.ab, bg.ab.size
    contexts = len(_table(m, bg))
    counts, alphas = np.zeros((chains, contexts, W)), [m.alpha.copy() for _ in range(chains)]
    adams, rng = [Adam(m.alpha.shape) for _ in range(chains)], np.random.default_rng(seed)
    name = f"gibbs_{uuid.uuid4().hex}"
    laid = materialise(blocks(strands, ab), "gibbs_blocks")
    letters, n_seqs = laid.agg(F.sum(F.length("codes").cast("long")), F.sum(F.size("ids").cast("long"))).first()
    bucketed(laid, name, "block", max(2 * spark.sparkContext.defaultParallelism, -(-(letters or 0) // TASK)))

    def step(i: int, sites: DataFrame | None, qs: list[float]) -> DataFrame:
        """(block, z, change): the sites of every sequence of a block by chain, and in rows without sites the change of the counts."""
        sent = spark.sparkContext.broadcast(([np.stack(x) for x in zip(*[roll_up(x, K, size) for x in counts])], np.stack(alphas), np.array(qs), _table(m, bg) if i == 0 else None))
        held = spark.table(name)
        if sites is None:
            rows = held.withColumn("z", F.lit(None).cast("array<array<int>>"))
        else:
            rows = held.join(sites.hint("shuffle_hash"), "block")  # some bytes a sequence

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, alpha, q, table = sent.value
            change, stretches = np.zeros((chains, contexts, W)), Stretches(K, W, bg)
            start = None if table is None else Grams(table, K, ab, exp=True)
            for b in it:
                for first, many, batch in _joined(b, K, ab):
                    ids = b.column(1).slice(first, many).flatten()
                    u = uniforms([f"{seed}:{x}:{i}" for x in ids.to_pylist()], np.full(batch.n, 2 * chains)).reshape(batch.n, 2, chains)
                    if i == 0:
                        z = np.full((batch.n, chains), -1)
                        whole = batch.whole(W)
                        odds = start.everywhere(batch) * whole
                        windows = np.add.reduceat(whole, batch.off[:-1], dtype=np.intp)
                        for c in range(chains):
                            at = drawn(odds, batch.off[1:], windows, q[c], u[:, 1, c])
                            z[:, c] = np.where(at >= 0, at - batch.off[:-1], -1)
                            _count(change, batch, np.full(batch.n, c), at, 1)
                    else:
                        z = np.asarray(b.column(4).slice(first, many).flatten().flatten()).reshape(batch.n, chains).copy()
                        rows, of = np.nonzero(u[:, 0] < share)
                        for part in _parts(np.diff(batch.off)[rows], max(1, TABLES // stretches.size)):
                            row, chain = rows[part], of[part]
                            old = np.where(z[row, chain] >= 0, batch.off[row] + z[row, chain], -1)
                            at = _redrawn(batch, row, chain, old, stretches, n, alpha, q, u[row, 1, chain])
                            _count(change, batch, chain, old, -1)
                            _count(change, batch, chain, at, 1)
                            z[row, chain] = np.where(at >= 0, at - batch.off[row], -1)
                    by_row = pa.ListArray.from_arrays(pa.array(np.arange(batch.n + 1, dtype=np.int32) * chains), pa.array(z.ravel().astype(np.int32)))
                    sizes = np.asarray(pc.list_value_length(b.column(1).slice(first, many)))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), by_row)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, many), lists, pa.nulls(many, pa.list_(pa.float64()))], names=["block", "z", "change"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.list_(pa.int32()))), pa.array([change.ravel()], pa.list_(pa.float64()))], names=["block", "z", "change"])

        return rows.select("block", "ids", "sizes", "codes", "z").mapInArrow(run, "block long, z array<array<int>>, change array<double>")

    try:
        n_seqs, sites, kept, seen, qs = int(n_seqs or 0), None, [], [], [m.q] * chains
        mean, worst, i = np.zeros((contexts, W)), math.inf, 0
        for i in range(rounds):
            made = materialise(step(i, sites, qs), "gibbs_round")
            change = made.where("change IS NOT NULL").select(F.posexplode("change").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # chains * contexts * W rows
            flat = np.zeros(counts.size)
            for r in change:
                flat[r["at"]] = r["x"]
            counts = counts + flat.reshape(counts.shape)
            sites = made.where("change IS NULL").select("block", "z")
            now = []
            for c in range(chains):
                n = roll_up(counts[c].copy(), K, size)
                found = update(m, n, bg, alpha=alphas[c])
                alphas[c] = np.exp(moved_alpha(found, bg, alpha, adams[c], rng))
                here = counts[c][:, 0].sum()
                qs[c] = min(max((here + 1) / (n_seqs + 2), 1e-3), 1 - 1e-3) if sample_q else m.q
                now.append((here, float((found.v[0] * np.log2(np.maximum(found.v[0], 1e-12))).sum())))
            seen.append(now)
            kept.append((sites, counts.sum(axis=0)))
            if i + 1 >= least and (i + 1) % 10 == 0:
                late = np.array(seen[len(seen) // 2 :]).transpose(2, 1, 0)
                worst = max(split_r_hat(x) for x in late)
                if worst < r_hat:
                    break
        late = kept[len(kept) // 2 :]
        mean = sum(x for _, x in late) / (len(late) * chains)
        rows = late[0][0]
        for x, _ in late[1:]:
            rows = rows.unionByName(x)
        each = rows.join(laid.select("block", "ids"), "block").select(F.explode(F.arrays_zip("ids", "z")).alias("s")).select(F.col("s.ids").alias("seq_id"), F.explode("s.z").alias("start"))
        each = each.where("start >= 0").groupBy("seq_id", "start").agg((F.count("*") / (len(late) * chains)).alias("p"))
        q = min(max(mean[:, 0].sum() / max(n_seqs, 1), 1e-3), 1 - 1e-3)
        return Chains(update(m, roll_up(mean, K, size), bg, q, np.mean(alphas, axis=0)), each, worst, i + 1)
    finally:
        dropped(spark, [name])
