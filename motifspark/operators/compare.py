"""Similarity of motifs, database search, redundancy filter."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..shared import materialise

ALPHA, MIN_OVERLAP = 0.8, 2
MOST_CLUSTERED = 2_000


def _h(x: np.ndarray) -> np.ndarray:
    """Row sums of x log2 x."""
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(axis=1)


def divergence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per column: 0.5 (sum a log2 a + sum b log2 b) - sum m log2 m with m = (a + b) / 2."""
    return 0.5 * (_h(a) + _h(b)) - _h((a + b) / 2)


def offsets(m: int, n: int, min_overlap: int = MIN_OVERLAP) -> list[int]:
    """Start of the second motif relative to the first, for every alignment with that overlap (or all of the shorter one)."""
    least = min(min_overlap, m, n)
    return list(range(-(n - least), m - least + 1))


def aligned_similarity(a: np.ndarray, b: np.ndarray, bg: np.ndarray, alpha: float = ALPHA, min_overlap: int = MIN_OVERLAP) -> tuple[float, int]:
    """Best of: alpha times both motifs' divergence from the background, minus that between them, over the overlap; first of equals."""
    ha, hb = divergence(a, np.broadcast_to(bg, a.shape)), divergence(b, np.broadcast_to(bg, b.shape))
    best, at = -np.inf, 0
    for o in offsets(len(a), len(b), min_overlap):
        i, j, w = max(o, 0), max(-o, 0), min(len(a), o + len(b)) - max(o, 0)
        s = alpha * 0.5 * (ha[i : i + w].sum() + hb[j : j + w].sum()) - divergence(a[i : i + w], b[j : j + w]).sum()
        if s > best + 1e-12:
            best, at = float(s), o
    return best, at


def similarity(a: np.ndarray, b: np.ndarray, bg: np.ndarray | None = None, alpha: float = ALPHA, min_overlap: int = MIN_OVERLAP) -> tuple[float, int, str]:
    """(score, offset, strand) of the better strand; pwms are (W, 4) in the order A, C, G, T."""
    bg = np.full(4, 0.25) if bg is None else bg
    plus = aligned_similarity(a, b, bg, alpha, min_overlap)
    minus = aligned_similarity(a, b[::-1, ::-1], bg, alpha, min_overlap)
    return (*plus, "+") if plus[0] >= minus[0] else (*minus, "-")


def permuted(pwm: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The columns in reverse order, each moved by some two places; A and T, or C and G, swapped in some columns."""
    order = np.argsort(2 * rng.normal(size=len(pwm)) - np.arange(len(pwm)), kind="stable")
    out = pwm[order].copy()
    at, cg = rng.normal(size=len(pwm)) > 0.5, rng.normal(size=len(pwm)) > 0.5
    out[at] = out[at][:, [3, 1, 2, 0]]
    out[cg] = out[cg][:, [0, 2, 1, 3]]
    return out


def as_table(spark, motifs: dict[str, np.ndarray]) -> DataFrame:
    """(model_id, width, pwm): rows of a motif database."""
    rows = [(k, len(v), [[float(x) for x in r] for r in v]) for k, v in motifs.items()]
    return spark.createDataFrame(rows, "model_id string, width int, pwm array<array<double>>")


def _pwm(x) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=float) for r in x])


def search(queries: DataFrame, database: DataFrame, permutations: int = 10, max_p: float = 0.01, seed: int = 42, max_queries: int = 10_000) -> DataFrame:
    """(model_id, db_id, p_value, e_value, sim_score, offset, strand, model_width).

    The stated queries (at most ``max_queries``, checked) are sent to every task and run against the database's
    rows in blocks.  The null scores of a query come from permuted queries against the whole database; the best
    tenth of them gives an exponential tail.
    """
    rows = queries.select("model_id", "pwm").limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        raise ValueError("too many queries for one search: run it in blocks of queries")
    names = [r["model_id"] for r in rows]
    pwms = [_pwm(r["pwm"]) for r in rows]
    sent = queries.sparkSession.sparkContext.broadcast((names, pwms))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, pwms = sent.value
        null = [[permuted(p, np.random.default_rng([seed, i, k])) for k in range(permutations)] for i, p in enumerate(pwms)]
        for pdf in it:
            out = []
            for db, w in zip(pdf["model_id"], pdf["pwm"]):
                w = _pwm(w)
                for i, q in enumerate(pwms):
                    s, o, d = similarity(q, w)
                    out.append((names[i], db, False, s, o, d, len(q)))
                    out += [(names[i], db, True, similarity(x, w)[0], 0, "+", len(q)) for x in null[i]]
            yield pd.DataFrame(out, columns=["model_id", "db_id", "is_null", "sim_score", "offset", "strand", "model_width"])

    scored = materialise(database.select("model_id", "pwm").mapInPandas(run, "model_id string, db_id string, is_null boolean, sim_score double, offset int, strand string, model_width int"), "motif_scores")
    cut = scored.where("is_null").groupBy("model_id").agg(F.percentile_approx("sim_score", 0.9, F.lit(100_000)).alias("s0"), F.count("*").alias("n_null"))
    null = scored.where("is_null").join(F.broadcast(cut), "model_id").where("sim_score >= s0").groupBy("model_id", "s0", "n_null").agg(F.avg(F.col("sim_score") - F.col("s0")).alias("rate"))
    size = F.broadcast(database.agg(F.count("*").alias("size")))
    hits = scored.where("NOT is_null").join(F.broadcast(null), "model_id").where("sim_score >= s0").crossJoin(size)  # one row
    p = 0.1 * F.exp(-(F.col("sim_score") - F.col("s0")) / F.greatest("rate", F.lit(1e-12)))
    return hits.withColumn("p_value", p).where(F.col("p_value") < max_p).select("model_id", "db_id", "p_value", (F.col("p_value") * F.col("size")).alias("e_value"), "sim_score", "offset", "strand", "model_width")


def affinity_propagation(s: np.ndarray, damping: float = 0.5, iterations: int = 200) -> np.ndarray:
    """Exemplar of each item, by message passing on a small dense matrix; ``propagated`` does the same over edges."""
    n = len(s)
    s = s.astype(float).copy()
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0)
    s += 1e-9 * np.random.default_rng(0).normal(size=s.shape) * (np.abs(s).max() + 1)
    r, a = np.zeros_like(s), np.zeros_like(s)
    at = np.arange(n)
    for _ in range(iterations):
        t = a + s
        first = t.argmax(axis=1)
        top = t[at, first]
        t[at, first] = -np.inf
        new = s - top[:, None]
        new[at, first] = s[at, first] - (t.max(axis=1) if n > 1 else 0)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[at, at] = r[at, at]
        new = p.sum(axis=0)[None, :] - p
        own = new[at, at].copy()
        new = np.minimum(new, 0)
        new[at, at] = own
        a = damping * a + (1 - damping) * new
    keep = np.flatnonzero(np.diag(a + r) > 0)
    if not len(keep):
        return np.zeros(n, np.int64)
    label = keep[s[:, keep].argmax(axis=1)]
    label[keep] = keep
    return label


def all_pairs(spark, motifs: dict[str, np.ndarray]) -> DataFrame:
    """(a, b, sim_score) of every ordered pair of a motif set of at most MOST_CLUSTERED; tasks compute one half."""
    if len(motifs) > MOST_CLUSTERED:
        raise ValueError("too many motifs to compare all of them: search the set in blocks of queries")
    sent = spark.sparkContext.broadcast(list(motifs.items()))

    def run(it):
        for pdf in it:
            out = []
            for i in pdf["id"]:
                for b, y in sent.value[i:]:
                    a, x = sent.value[i]
                    s = similarity(x, y)[0]
                    out += [(a, b, s)] if a == b else [(a, b, s), (b, a, s)]
            yield pd.DataFrame(out, columns=["a", "b", "sim_score"])

    n = len(motifs)
    return spark.range(0, n, 1, max(1, min(n, 200))).mapInPandas(run, "a string, b string, sim_score double")


def propagated(edges: DataFrame, damping: float = 0.5, iterations: int = 200, steady: int = 15, stride: int = 5) -> DataFrame:
    """(model_id, exemplar) by affinity propagation over a sparse graph (a, b, sim_score); pairs that are left out have no similarity.

    The messages of an edge are columns of its row.  A round has two shuffles of the edges, by a (the two best of each row) and by b (sums of
    each column); every ``stride`` rounds are written, and it ends when the exemplars have stayed the same for ``steady`` rounds.  The preference of every
    motif is the median of all similarities between different motifs.  A motif without an exemplar among its neighbours is its own.
    """
    other = edges.where("a <> b")
    middle = other.agg(F.percentile_approx("sim_score", 0.5, F.lit(1_000_000)).alias("p"), F.max(F.abs("sim_score")).alias("most")).first()
    names = edges.select("a").union(edges.select("b")).distinct()
    own = names.select("a", F.col("a").alias("b"), F.lit(middle["p"] or 0.0).alias("s"))
    # equal similarities are told apart by a fixed small number
    noise = 1e-9 * ((middle["most"] or 0.0) + 1) * uniform(0, F.col("a"), F.col("b"))
    now = other.groupBy("a", "b").agg(F.max("sim_score").alias("s")).unionByName(own).select("a", "b", (F.col("s") + noise).alias("s"), F.lit(0.0).alias("r"), F.lit(0.0).alias("v"))
    now, before, same = materialise(now, "messages"), None, 0
    row, column = Window.partitionBy("a"), Window.partitionBy("b")
    order = row.orderBy(F.desc("t"), "b")
    for i in range(0, iterations, stride):
        for _ in range(min(stride, iterations - i)):
            t = now.withColumn("t", F.col("v") + F.col("s"))
            t = t.withColumns({"rank": F.row_number().over(order), "first": F.max("t").over(row)})
            t = t.withColumn("second", F.max(F.when(F.col("rank") > 1, F.col("t"))).over(row))
            best = F.when(F.col("rank") == 1, F.coalesce("second", F.lit(0.0))).otherwise(F.col("first"))
            r = t.select("a", "b", "s", "v", (damping * F.col("r") + (1 - damping) * (F.col("s") - best)).alias("r"))
            self_ = F.col("a") == F.col("b")
            part = F.when(self_, F.col("r")).otherwise(F.greatest("r", F.lit(0.0)))
            r = r.withColumn("sum", F.sum(part).over(column))
            new = F.when(self_, F.col("sum") - F.col("r")).otherwise(F.least(F.col("sum") - F.greatest("r", F.lit(0.0)), F.lit(0.0)))
            now = r.select("a", "b", "s", "r", (damping * F.col("v") + (1 - damping) * new).alias("v"))
        now = materialise(now, "messages")
        seen = now.where((F.col("a") == F.col("b")) & (F.col("r") + F.col("v") > 0)).agg(F.count("*"), F.sum(F.xxhash64("a").cast("decimal(38,0)"))).first()
        same = same + stride if seen == before and seen[0] else 0
        before = seen
        if same >= steady:
            break
    chosen = now.where((F.col("a") == F.col("b")) & (F.col("r") + F.col("v") > 0)).select(F.col("a").alias("e"))
    near = now.join(chosen, F.col("b") == F.col("e"))
    label = near.groupBy("a").agg(F.max_by("b", F.struct(F.col("a") == F.col("b"), "s", "b")).alias("exemplar"))
    return names.join(label, "a", "left").select(F.col("a").alias("model_id"), F.coalesce("exemplar", "a").alias("exemplar"))


def clusters(spark, motifs: dict[str, np.ndarray]) -> dict[str, str]:
    """Name of the first member of each motif's cluster, of a motif set whose pairs are all compared."""
    label = {r["model_id"]: r["exemplar"] for r in propagated(materialise(all_pairs(spark, motifs), "pairs")).collect()}
    first: dict[str, str] = {}
    return {x: first.setdefault(label[x], x) for x in motifs}


def exemplars(table: DataFrame, label: str, order: str) -> DataFrame:
    """The first row, by ``order``, of every label."""
    cols = table.columns
    return table.groupBy(label).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
