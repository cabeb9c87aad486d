"""Precision and recall curves, cross-validation folds, summary scores."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .background import Background
from .em import optimize_many
from .motif import Motif
from .ranking import running, scan
from .score import all_scores, best_scores, scored_strands


def folds(seqs: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``fold``: a hash of the id, so that every row has one and folds do not depend on order or partitions."""
    return seqs.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "seq_id"), F.lit(n)).cast("int"))


def numbered_folds(seqs: DataFrame, n: int = 4, buckets: int | None = None) -> DataFrame:
    """Adds ``idx`` (rank by id, from 0) and ``fold`` = idx modulo n."""
    ranked = scan(seqs, ["seq_id"], {"idx": "1"}, parts=buckets)
    return ranked.withColumn("idx", F.col("idx") - 1).withColumn("fold", F.pmod("idx", F.lit(n)).cast("int"))


def zoops_curve(scores: DataFrame, m_fold: float = 1.0, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """scores: (by..., id, score, is_pos 0/1).  Ranks by descending score, null scores first among equals, then ids."""
    by = by or []
    ranked = running(scores, "score", {"n_pos": "is_pos", "n_neg": "1 - is_pos"}, ["is_pos", "id"], by, buckets)
    total = scores.groupBy(*by).agg(F.sum("is_pos").alias("pos"))
    joined = ranked.join(F.broadcast(total), by) if by else ranked.crossJoin(F.broadcast(total))  # one row per ``by``
    fp = F.col("n_neg") / m_fold
    return joined.select(
        *by, "id", "score", "is_pos", (F.col("n_pos") + F.col("n_neg")).alias("rank"), F.col("n_pos").cast("double").alias("tp"), fp.alias("fp"),
        (fp / (F.col("n_pos") + fp)).alias("fdr"), (F.col("n_pos") / F.col("pos")).alias("recall"),
    )


def mops_curve(scores: DataFrame, m_fold: float = 1.0, buckets: int | None = None) -> DataFrame:
    """All windows: TP is what stands above the expected false ones; ranks after the last maximum of TP are dropped.

    One sort by score; the peak is a maximum over the sorted rows.
    """
    ranked = running(scores.select("id", "score", "is_pos"), "score", {"n_pos": "is_pos", "n_neg": "1 - is_pos"}, ["is_pos", "id"], buckets=buckets)
    tp, fp = F.col("n_pos") - F.col("n_neg") / m_fold, F.col("n_neg") / m_fold
    c = ranked.select("id", "score", (F.col("n_pos") + F.col("n_neg")).alias("rank"), tp.alias("tp"), fp.alias("fp"))
    peak = c.agg(F.max(F.struct("tp", "rank")).alias("peak")).first()["peak"]
    if peak is not None:
        c = c.where(F.col("rank") <= peak["rank"])
    last = None if peak is None else peak["tp"]
    return c.select("id", "score", "rank", "tp", "fp", (F.col("fp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1e-12))).alias("fdr"), (F.col("tp") / F.lit(last)).alias("recall"))


def mops_steps(counts: DataFrame, m_fold: float = 1.0, buckets: int | None = None) -> DataFrame:
    """The curve of ``mops_curve`` by distinct score: counts (score, pos, neg) of all windows to (score, n, tp, fp), with n the ranks kept of
    each score, and the highest tp and fp among them.

    Among equal scores null ones come first, so tp is highest at the first null one or at the last positive one.  Sorts distinct scores, not windows.
    """
    c = running(counts.select("score", "pos", "neg"), "score", {"n_pos": "pos", "n_neg": "neg"}, [], buckets=buckets)
    before_pos, before_neg = F.col("n_pos") - F.col("pos"), F.col("n_neg") - F.col("neg")
    end = F.struct((F.col("n_pos") - F.col("n_neg") / m_fold).alias("tp"), (F.col("n_pos") + F.col("n_neg")).alias("rank"))
    first = F.when(F.col("neg") > 0, F.struct((before_pos - (before_neg + 1) / m_fold).alias("tp"), (before_pos + before_neg + 1).alias("rank")))
    c = c.select("score", "pos", "neg", "n_neg", end.alias("end"), first.alias("first"), (before_neg + 1).alias("first_neg"))
    peak = c.agg(F.max(F.greatest("end", "first")).alias("peak")).first()["peak"]
    if peak is None:
        return c.select("score", F.col("pos").alias("n"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"))
    whole = F.col("end.rank") <= peak["rank"]  # the peak is one of these two places
    c = c.where(whole | (F.col("first.rank") <= peak["rank"]))
    return c.select(
        "score", F.when(whole, F.col("pos") + F.col("neg")).otherwise(1).alias("n"),
        F.when(whole, F.greatest("end.tp", "first.tp")).otherwise(F.col("first.tp")).alias("tp"), (F.when(whole, F.col("n_neg")).otherwise(F.col("first_neg")) / m_fold).alias("fp"),
    )


def cross_validated(seqs: DataFrame, negatives: DataFrame, models: dict[tuple[int, int], Motif], bg: Background, single: bool = False, negatives_single: bool = True, windows: bool = False) -> DataFrame:
    """(motif_id, id, score, is_pos): the best score of every sequence by each motif as trained on the other folds.

    seqs, negatives: (seq_id, seq, fold).  models: of (motif_id, fold).  Each side is scanned once for all motifs and folds; null sequences
    are scored by the motif of their fold.  windows: all windows instead of the best, their id with the start.
    """
    keys = sorted(models)
    names = F.array(*[F.lit(i) for i, _ in keys])
    pooled = None
    for df, label, one in ((seqs, 1, single), (negatives, 0, negatives_single)):
        scored = (all_scores if windows else best_scores)(scored_strands(df, one), [models[k] for k in keys], bg, only=[f for _, f in keys])
        key = F.struct("seq_id", "start") if windows else F.col("seq_id")
        part = scored.select(F.get(names, "motif_id").alias("motif_id"), key.alias("id"), "score", F.lit(label).alias("is_pos"))
        pooled = part if pooled is None else pooled.unionByName(part)
    return pooled


def refined(seqs: DataFrame, start: list[Motif] | dict[tuple[int, int], Motif], bg: Background, n_folds: int, single: bool = False, **options) -> dict[tuple[int, int], Motif]:
    """The motifs of (motif_id, fold), each refined by EM on the sequences (seq_id, seq, fold) of the other folds: one job an iteration for all.

    start: motifs, or those of (motif_id, fold); options: of ``em.optimize_many``.
    """
    if isinstance(start, list):
        start = {(i, f): m for i, m in enumerate(start) for f in range(n_folds)}
    keys = sorted(start)
    fits = optimize_many(scored_strands(seqs, single), [start[k] for k in keys], bg, held_out=[f for _, f in keys], **options)
    return {k: fit.motif for k, fit in zip(keys, fits)}


def occurrence_fraction(curve: DataFrame, q: float, m_fold: float = 1.0) -> DataFrame:
    """1 - the share of null sequences that rank above the floor(q N)-th positive, at its last rank."""
    n = F.broadcast(curve.agg(F.sum("is_pos").alias("n")))
    at = curve.crossJoin(n).where(F.col("tp") == F.floor(F.col("n") * q))  # one row
    return at.groupBy("n").agg(F.max("fp").alias("fp")).select((1 - F.col("fp") * m_fold / F.col("n")).alias("occ_frac"))


def occurrence_multiplicity(curve: DataFrame, n_sequences: int) -> DataFrame:
    """Sites a sequence: the peak of the true ones in the curve over all windows (``mops_curve``)."""
    return curve.agg((F.max("tp") / n_sequences).alias("occ_mult"))


def area(points: DataFrame, x: str, y: str, order: str, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Trapezoid area under y over x, the points in descending ``order`` (no window over all rows)."""
    by = by or []
    steps = scan(points, [F.desc(order)], lags={"__x": x, "__y": y}, by=by, parts=buckets)
    return steps.groupBy(*by).agg(F.coalesce(F.sum((F.col(x) - F.col("__x")) * (F.col(y) + F.col("__y")) / 2), F.lit(0.0)).alias("area"))


def average_recall(curve: DataFrame, cap: float = 100.0) -> DataFrame:
    """Half the area under log10(min(TP / FP, cap)), not below 0, over recall."""
    ratio = F.log10(F.greatest(F.lit(1.0), F.least(F.lit(cap), F.when(F.col("fp") > 0, F.col("tp") / F.col("fp")).otherwise(cap))))
    pts = curve.select("recall", ratio.alias("y"), (-F.col("rank")).alias("o"))
    return area(pts, "recall", "y", "o").select((F.col("area") / 2).alias("avrec"))


def precision_area(curve: DataFrame) -> DataFrame:
    pts = curve.select("recall", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("y"), (-F.col("rank")).alias("o"))
    return area(pts, "recall", "y", "o").select(F.col("area").alias("auprc"))


def partial_roc(curve: DataFrame, limit: float = 0.05) -> DataFrame:
    """Area under recall over the false positive rate up to ``limit``, as a share of the limit."""
    top = F.broadcast(curve.agg(F.max("fp").alias("__m")))
    pts = curve.crossJoin(top).select((F.col("fp") / F.greatest(F.col("__m"), F.lit(1e-12))).alias("x"), F.col("recall").alias("y"), (-F.col("rank")).alias("o")).where(F.col("x") <= limit)  # one row
    return area(pts, "x", "y", "o").select((F.col("area") / limit).alias("pauc"))


def sensitivity_area(curve: DataFrame, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """Normalised area under recall over log10 FDR in [low, high]."""
    pts = curve.where((F.col("fdr") >= low) & (F.col("fdr") <= high)).groupBy("fdr").agg(F.max("recall").alias("y")).select(F.log10("fdr").alias("x"), "y", (-F.log10("fdr")).alias("o"))
    return area(pts, "x", "y", "o").select((F.col("area") / float(np.log10(high) - np.log10(low))).alias("ausfc"))


def majorant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indexes of the points on the least concave majorant of (x, y), x ascending."""
    hull: list[int] = []
    for i in range(len(x)):
        while len(hull) > 1 and (y[hull[-1]] - y[hull[-2]]) * (x[i] - x[hull[-1]]) <= (y[i] - y[hull[-1]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(i)
    return np.array(hull, np.int64)


def grenander(p: np.ndarray, eta0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct p-values, q-values and local fdr from the least concave majorant of their distribution (pool adjacent violators)."""
    x, count = np.unique(p, return_counts=True)
    xs, ys = np.r_[0.0, x], np.r_[0.0, np.cumsum(count) / count.sum()]
    hull = majorant(xs, ys)
    return x, *_estimates(x, xs[hull], ys[hull], eta0)


def _estimates(x: np.ndarray, hx: np.ndarray, hy: np.ndarray, eta0: float) -> tuple[np.ndarray, np.ndarray]:
    slope = np.diff(hy) / np.maximum(np.diff(hx), 1e-12)
    density = slope[np.clip(np.searchsorted(hx, x, "left") - 1, 0, len(slope) - 1)]
    return np.minimum(eta0 * x / np.interp(x, hx, hy), 1), np.minimum(eta0 / np.maximum(density, 1e-12), 1)


def p_value_histogram(p: DataFrame, col: str = "p_value", bins: int = 30) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.round(F.col(col) * bins, 6))).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def q_values(p: DataFrame, eta0: float, col: str = "p_value", buckets: int | None = None) -> DataFrame:
    """(p, n, q, lfdr) of every distinct p-value, by Grenander's estimate on all of them.

    Tasks reduce ranges of the distribution function to their own majorants, which are short; the majorant of these is that of
    all, and is sent back to the distinct p-values.
    """
    counts = p.groupBy(F.col(col).alias("p")).agg(F.count("*").alias("n"))
    points = materialise(scan(counts, ["p"], {"upto": "n"}, parts=buckets), "p_values")
    total = points.agg(F.sum("n")).first()[0]
    if not total:
        return points.select("p", "n", F.lit(0.0).alias("q"), F.lit(0.0).alias("lfdr"))

    def reduce(it):
        x, y = np.zeros(0), np.zeros(0)
        for b in it:
            x, y = np.r_[x, np.asarray(b.column(0))], np.r_[y, np.asarray(b.column(1)).astype(float)]
            hull = majorant(x, y)
            x, y = x[hull], y[hull]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["p", "upto"])

    parts = points.select("p", "upto").repartitionByRange("p").sortWithinPartitions("p").mapInArrow(reduce, "p double, upto double").orderBy("p").toArrow()
    xs, ys = np.r_[0.0, np.asarray(parts.column("p"))], np.r_[0.0, np.asarray(parts.column("upto")) / total]
    hull = majorant(xs, ys)
    sent = p.sparkSession.sparkContext.broadcast((xs[hull], ys[hull]))

    def estimate(it):
        for b in it:
            q, lfdr = _estimates(np.asarray(b.column(0)), *sent.value, eta0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q), pa.array(lfdr)], names=["p", "n", "q", "lfdr"])

    return points.select("p", "n").mapInArrow(estimate, "p double, n long, q double, lfdr double")


def curve_window(curve: DataFrame, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """The part of a curve between two false discovery rates, with its closing point (recall 1 at the higher rate).

    Recall stays at 1 once it is there, and is 0 at the left border.
    """
    spark = curve.sparkSession
    inside = curve.where((F.col("fdr") >= low) & (F.col("fdr") <= high)).groupBy("fdr").agg(F.least(F.lit(1.0), F.max("recall")).alias("recall"))
    full = F.broadcast(inside.agg(F.min(F.when(F.col("recall") >= 1, F.col("fdr"))).alias("__full")))
    capped = inside.crossJoin(full).select("fdr", F.when(F.col("fdr") >= F.col("__full"), F.lit(1.0)).otherwise(F.col("recall")).alias("recall"))  # one row
    ends = spark.createDataFrame([(low, 0.0), (high, 1.0)], "fdr double, recall double")
    return capped.where((F.col("fdr") > low) & (F.col("fdr") < high)).unionByName(ends)


def log_odds_pairs(scores: DataFrame, buckets: int | None = None) -> DataFrame:
    """(rank, positive, negative): each positive score beside every (negatives / positives)-th null score, both by descending score."""
    sides = {}
    for side in (1, 0):
        part = scores.where(F.col("is_pos") == side).select("id", "score")
        sides[side] = running(part, "score", {"rank": "1"}, ["id"], buckets=buckets)
    n = scores.agg(F.sum("is_pos").alias("p"), F.sum(F.lit(1) - F.col("is_pos")).alias("m")).first()
    step = max(1, (n["m"] or 0) // max(1, n["p"] or 0))
    neg = sides[0].where(F.pmod("rank", F.lit(step)) == 0).select((F.col("rank") / step).cast("long").alias("rank"), F.col("score").alias("negative"))
    return sides[1].select(F.col("rank").cast("long").alias("rank"), F.col("score").alias("positive")).join(neg, "rank", "left")
