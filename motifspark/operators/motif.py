"""Inhomogeneous Markov motif models."""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import STANDARD, Alphabet
from .background import Background, index_of, kmer_of

PSEUDO = 1e-5
MAX_ORDER = 8


def alphas(order: int, beta: float = 7.0, gamma: float = 3.0) -> np.ndarray:
    """1, beta * gamma, beta * gamma^2, ..."""
    return np.array([1.0] + [beta * gamma**k for k in range(1, order + 1)])


@dataclass
class Motif:
    """v[k][y, j], p[k][y, j] and counts n[k][y, j] of (k + 1)-mer y that ends at position j; alpha[k, j]; q: share of sequences with a site."""

    v: list[np.ndarray]
    p: list[np.ndarray]
    n: list[np.ndarray]
    alpha: np.ndarray
    q: float = 0.3
    name: str = "motif"
    ab: Alphabet = STANDARD

    @property
    def width(self) -> int:
        return self.v[0].shape[1]

    @property
    def order(self) -> int:
        return len(self.v) - 1

    def pwm(self) -> np.ndarray:
        return self.v[0].T

    def to_df(self, spark: SparkSession, motif_id: int = 0) -> DataFrame:
        rows = [
            (motif_id, j, k, kmer_of(y, k + 1, self.ab), y, float(self.n[k][y, j]), float(self.v[k][y, j]), float(self.p[k][y, j]))
            for k in range(self.order + 1) for y in range(self.v[k].shape[0]) for j in range(self.width)
        ]
        return spark.createDataFrame(rows, "motif_id int, j int, k int, kmer string, y long, n double, v double, p double")


def conditionals(n: list[np.ndarray], alpha: np.ndarray, bg: Background) -> list[np.ndarray]:
    """v from counts; alpha[k, j].  At j < k there is no full context inside the motif: the lower order is copied."""
    size = bg.ab.size
    v = [(n[0] + alpha[0] * bg.v[0][:, None]) / (n[0].sum(axis=0) + alpha[0])]
    for k in range(1, len(n)):
        y = np.arange(size ** (k + 1))
        lower = v[k - 1][y % size**k]
        out = lower.copy()
        out[:, k:] = (n[k][:, k:] + alpha[k, k:] * lower[:, k:]) / (n[k - 1][y // size][:, k - 1 : -1] + alpha[k, k:])
        v.append(out)
    return v


def joints(v: list[np.ndarray], bg: Background) -> list[np.ndarray]:
    """p[k][y, j] of the whole (k + 1)-mer; bases left of the motif come from the background."""
    size = bg.ab.size
    p = [v[0]]
    for k in range(1, len(v)):
        y = np.arange(size ** (k + 1))
        out = np.empty_like(v[k])
        out[:, k:] = v[k][:, k:] * p[k - 1][y // size][:, k - 1 : -1]
        for j in range(min(k, v[0].shape[1])):
            term = np.ones(len(y))
            for m in range(k + 1):  # base m of the k-mer stands at j - (k - m)
                part = y // size ** (k - m)
                at = j - (k - m)
                o = min(m, bg.order)
                term *= v[m][part, at] if at >= 0 else bg.v[o][part % size ** (o + 1)]
            out[:, j] = term
        p.append(out)
    return p


def build(n: list[np.ndarray], bg: Background, alpha=None, q: float = 0.3, name: str = "motif") -> Motif:
    a = alphas(len(n) - 1) if alpha is None else np.asarray(alpha, dtype=float)
    a = np.repeat(a[:, None], n[0].shape[1], axis=1) if a.ndim == 1 else a
    v = conditionals(n, a, bg)
    return Motif(v, joints(v, bg), n, a, q, name, bg.ab)


def site_counts(sites: DataFrame, order: int, width: int, by: list[str] | None = None) -> DataFrame:
    """(by..., k, j, kmer, n): counts of the (k + 1)-mers that end at position j >= k of the sites."""
    ends = F.explode(F.expr(f"flatten(transform(sequence(0, {width - 1}), j -> transform(sequence(0, least(j, {order})), k -> struct(k AS k, j AS j))))")).alias("e")
    by = by or []
    distinct = sites.groupBy("site", *by).agg(F.count("*").alias("n"))
    cut = distinct.select("site", "n", *by, ends).select(*by, "n", "e.k", "e.j", F.expr("substring(site, e.j - e.k + 1, e.k + 1)").alias("kmer"))
    return cut.groupBy(*by, "k", "j", "kmer").agg(F.sum("n").alias("n"))


def checked_sites(sites: DataFrame, width: int, order: int, keep: list[str] | None = None) -> DataFrame:
    """Raises in the job where a site has another width; here where the order does not fit."""
    if width < order + 1 or order > MAX_ORDER:
        raise ValueError("the width must exceed the order, and the order be at most 8")
    return sites.select(F.when(F.length("site") == width, F.col("site")).otherwise(F.raise_error(F.lit(f"a site is not {width} bases wide")).cast("string")).alias("site"), *(keep or []))


def from_sites(sites: DataFrame, width: int, bg: Background, order: int = 2, alpha=None, q: float = 0.3) -> Motif:
    n = [np.zeros((bg.ab.size ** (k + 1), width)) for k in range(order + 1)]
    for r in site_counts(checked_sites(sites, width, order), order, width).collect():  # width * 4^(order + 1) rows at most
        n[r["k"]][index_of(r["kmer"], bg.ab), r["j"]] = r["n"]
    return build(n, bg, alpha, q)


def from_sites_by_fold(sites: DataFrame, width: int, bg: Background, order: int = 2, alpha=None, q: float = 0.3) -> dict[int, Motif]:
    """For each ``fold`` of ``sites`` (site, fold), the motif of the other folds' sites; all counted in one job."""
    size = bg.ab.size
    by: dict[int, list[np.ndarray]] = {}
    one = checked_sites(sites, width, order, ["fold"])
    for r in site_counts(one, order, width, ["fold"]).collect():  # width * 4^(order + 1) rows a fold at most
        n = by.setdefault(r["fold"], [np.zeros((size ** (k + 1), width)) for k in range(order + 1)])
        n[r["k"]][index_of(r["kmer"], bg.ab), r["j"]] = r["n"]
    total = [sum(n[k] for n in by.values()) for k in range(order + 1)]
    return {f: build([total[k] - n[k] for k in range(order + 1)], bg, alpha, q) for f, n in sorted(by.items())}


def from_pwm(pwm: np.ndarray, bg: Background, order: int = 0, sites: float = 100.0, q: float = 0.3, name: str = "motif") -> Motif:
    """pwm (W, size): floored and normalised; higher orders begin as copies of order 0."""
    p = np.maximum(np.asarray(pwm, dtype=float), 1e-8)
    p /= p.sum(axis=1, keepdims=True)
    v = [p.T]
    for k in range(1, order + 1):
        v.append(v[0][np.arange(bg.ab.size ** (k + 1)) % bg.ab.size])
    n = [x * sites for x in joints(v, bg)]
    a = np.repeat(alphas(order)[:, None], len(p), axis=1)
    return Motif(v, joints(v, bg), n, a, q, name, bg.ab)


def extended(m: Motif, left: int, right: int, bg: Background) -> Motif:
    """Uniform flanks."""
    pad = lambda x: np.concatenate([np.full((len(x), left), 1 / m.ab.size), x, np.full((len(x), right), 1 / m.ab.size)], axis=1)
    zero = lambda x: np.concatenate([np.zeros((len(x), left)), x, np.zeros((len(x), right))], axis=1)
    v = [pad(x) for x in m.v]
    alpha = np.concatenate([np.repeat(m.alpha[:, :1], left, axis=1), m.alpha, np.repeat(m.alpha[:, -1:], right, axis=1)], axis=1)
    return replace(m, v=v, p=joints(v, bg), n=[zero(x) for x in m.n], alpha=alpha)


def reverse_complement(m: Motif, bg: Background) -> Motif:
    """Order 0, read on the other strand."""
    swap = [m.ab.bases.index(c) if c in m.ab.bases else i for i, c in enumerate(m.ab.complement)]
    return from_pwm(m.v[0][swap][:, ::-1].T, bg, 0, q=m.q, name=m.name)


def score_table(m: Motif, bg: Background, pseudo: float = PSEUDO) -> list[np.ndarray]:
    """s[k][y, j] for every effective order k <= K: log of the motif's over the background's conditional."""
    size, out = bg.ab.size, []
    for k in range(m.order + 1):
        o = min(k, bg.order)
        y = np.arange(size ** (k + 1))
        out.append(np.log(m.v[k] + pseudo) - np.log(bg.v[o][y % size ** (o + 1)])[:, None])
    return out


def score_table_df(spark: SparkSession, m: Motif, bg: Background, pseudo: float = PSEUDO, motif_id: int = 0) -> DataFrame:
    """(motif_id, kmer, j, s): the table for joins with the contexts of positions."""
    s = score_table(m, bg, pseudo)
    rows = [(motif_id, kmer_of(y, k + 1, bg.ab), j, float(s[k][y, j])) for k in range(len(s)) for y in range(len(s[k])) for j in range(m.width)]
    return spark.createDataFrame(rows, "motif_id int, kmer string, j int, s double")
