"""Global running values and p-values without one task for all rows: a sample sort, then one pass inside its parts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialise


class _Scan:
    """Running values over rows in order, from batch to batch; they restart where the group ``g`` changes."""

    def __init__(self, sums: int, lasts: int, lags: int):
        self.group, self.sums = None, [0] * sums
        self.lasts, self.lags = [None] * lasts, [None] * lags

    def step(self, g: np.ndarray, sums: list[np.ndarray], lasts: list[pa.Array], lags: list[pa.Array]) -> list[pa.Array]:
        n = len(g)
        new = np.r_[self.group is None or g[0] != self.group, g[1:] != g[:-1]]
        starts, seg, at = np.flatnonzero(new), np.cumsum(new), np.arange(n)
        first = np.r_[0, starts][seg]  # of each row's stretch of one group
        out = []
        for k, x in enumerate(sums):
            upto = np.cumsum(x)
            before = np.r_[-self.sums[k], np.where(starts > 0, upto[starts - 1], 0)][seg]
            upto = upto - before
            self.sums[k] = upto[-1]
            out.append(pa.array(upto))
        for k, x in enumerate(lasts):
            seen = np.maximum.accumulate(np.where(np.asarray(x.is_valid()), at + 1, 0))
            none = (seg > 0) & (seen <= first)
            out.append(self._taken(self.lasts, k, x, np.where(none, 0, seen), none))
            self.lasts[k] = out[-1].slice(n - 1, 1)
        for k, x in enumerate(lags):
            out.append(self._taken(self.lags, k, x, at, new))
            self.lags[k] = x.slice(n - 1, 1)
        self.group = g[-1]
        return out

    @staticmethod
    def _taken(held: list, k: int, x: pa.Array, at: np.ndarray, none: np.ndarray) -> pa.Array:
        before = held[k] if held[k] is not None else pa.nulls(1, x.type)
        return pa.concat_arrays([before, x]).take(pa.array(at, mask=none))


def scan(df: DataFrame, order: list, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, lags: dict[str, str] | None = None, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds running values over ``order``, apart for each ``by``.

    sums: name to expression, its sum up to and with the row; lasts: its last value that is not null, up to and with the row; lags:
    its value in the row before (expressions that are never null).

    A sample sort: the rows are written once and cut by sampled splitters of the whole sort key, so a score that all rows
    share is cut at its ties too; every part is scanned once, in order, and a table of one row a part (and group) carries
    sums and values over the seams.
    """
    by, sums, lasts, lags = by or [], sums or {}, lasts or {}, lags or {}
    spark = df.sparkSession
    exprs = {f"__x{i}": e for i, e in enumerate([*sums.values(), *lasts.values(), *lags.values()])}
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    held = df.select("*", group.alias("__g"), *[F.expr(e).alias(n) for n, e in exprs.items()])
    names = [*sums, *lasts, *lags]
    floating = ("double", "float")
    kinds = ["double" if held.schema[f"__x{i}"].dataType.simpleString() in floating else "bigint" for i in range(len(sums))]
    for i, kind in enumerate(kinds):
        held = held.withColumn(f"__x{i}", F.coalesce(F.col(f"__x{i}").cast(kind), F.lit(0).cast(kind)))
    held = materialise(held, "scan_input")
    keys = ["__g", *order] if by else order
    cut = held.repartitionByRange(parts, *keys) if parts else held.repartitionByRange(*keys)
    cut = cut.sortWithinPartitions(*keys)
    plain = len(df.columns)
    new = [T.StructField(f"__r{i}", cut.schema[f"__x{i}"].dataType) for i in range(len(names))]
    out = T.StructType([*cut.schema.fields[: plain + 1], *new, T.StructField("__p", T.IntegerType()), T.StructField("__n", T.LongType())])
    n_sums, n_lasts = len(sums), len(lasts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(out), TaskContext.get().partitionId()
        state, at = _Scan(n_sums, n_lasts, len(names) - n_sums - n_lasts), 0
        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(plain + 1 + i) for i in range(len(names))]
            made = state.step(np.asarray(b.column(plain)), [np.asarray(c) for c in x[:n_sums]], x[n_sums : n_sums + n_lasts], x[n_sums + n_lasts :])
            place = pa.array(np.arange(at, at + b.num_rows))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*b.columns[: plain + 1], *made, pa.array(np.full(b.num_rows, part, np.int32)), place], schema)], schema=schema)

    rows = materialise(cut.mapInArrow(run, out), "scanned")
    ends = [F.col(f"__r{i}") if i < n_sums + n_lasts else F.expr(exprs[f"__x{i}"]) for i in range(len(names))]
    seams = rows.groupBy("__g", "__p").agg(*[F.max_by(F.struct(e.alias("v")), F.col("__n"))["v"].alias(f"__e{i}") for i, e in enumerate(ends)])
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = [F.coalesce(F.sum(f"__e{i}").over(earlier), F.lit(0)) if i < n_sums else F.last(f"__e{i}", ignorenulls=True).over(earlier) for i in range(len(names))]
    seams = seams.select(F.col("__g").alias("__sg"), F.col("__p").alias("__sp"), *[c.alias(f"__b{i}") for i, c in enumerate(before)])
    if not by:
        seams = F.broadcast(seams)  # a row a part
    both = rows.join(seams, (F.col("__g") == F.col("__sg")) & (F.col("__p") == F.col("__sp")))
    final = [F.col(f"__r{i}") + F.col(f"__b{i}") if i < n_sums else F.coalesce(f"__r{i}", f"__b{i}") for i in range(len(names))]
    return both.select(*df.columns, *[c.alias(n) for n, c in zip(names, final)])


def running(df: DataFrame, score: str, sums: dict[str, str], ties: list, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds ``name`` = running sum of the expression over the order (score descending, ties), per ``by``."""
    return scan(df, [F.desc(score), *ties], sums, by=by, parts=buckets)


def beside_nulls(rows: DataFrame, negatives: DataFrame, buckets: int | None = None) -> DataFrame:
    """``rows`` (id, score, ...) with ``null``: of the lowest null score not below the row's, (score, upto, n, up, down): the null scores
    at least as high, those equal, the next higher and the next lower one.  Null where no null score is as high."""
    distinct = negatives.groupBy("score").agg(F.count("*").alias("n"))
    table = scan(distinct, [F.desc("score")], {"upto": "n"}, lags={"up": "score"}, parts=buckets)
    table = scan(table, ["score"], lags={"down": "score"}, parts=buckets)
    known = F.struct("score", "upto", "n", "up", "down")
    marked = table.select("score", known.alias("__d"), F.lit(0).alias("__k"))
    both = rows.withColumn("__k", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    return scan(both, [F.desc("score"), "__k", "id"], lasts={"null": "__d"}, parts=buckets).where("__k = 1").drop("__k", "__d")


def tail(negatives: DataFrame, score: str = "score", top: int = 100, by: list[str] | None = None) -> DataFrame:
    """(by..., m, n_top, s_top, rate): number of null scores, the n_top-th best, and the mean excess of the better ones."""
    by = by or []
    if by:
        counts = negatives.groupBy(*by).agg(F.count("*").alias("m"))
        w = Window.partitionBy(*by).orderBy(F.desc(score))
        best = negatives.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)  # pruned to ``top`` rows per group
        best = best.join(F.broadcast(counts), by)
    else:
        counts = negatives.agg(F.count("*").alias("m"))
        best = negatives.orderBy(F.desc(score)).limit(top).withColumn("__r", F.row_number().over(Window.orderBy(F.desc(score)))).crossJoin(F.broadcast(counts))
    best = best.withColumn("n_top", F.greatest(F.lit(1), F.least(F.lit(top), F.floor(F.col("m") / 10))).cast("int")).where("__r <= n_top")
    key = [*by, "m", "n_top"]
    return best.groupBy(*key).agg(F.min(score).alias("s_top"), (F.avg(score) - F.min(score)).alias("rate"))


def p_values(positives: DataFrame, negatives: DataFrame, top: int = 100, buckets: int | None = None) -> DataFrame:
    """Adds p_value and e_value to ``positives`` (id, score): the share of null scores at least as high, interpolated between neighbours,
    and beyond the n_top best of them an exponential tail."""
    rows = positives.select("id", "score", F.lit(0).alias("neg")).unionByName(negatives.select("id", "score", F.lit(1).alias("neg")))
    ranked = running(rows, "score", {"above": "neg"}, [F.desc("neg"), "id"], buckets=buckets)
    t = F.broadcast(tail(negatives, "score", top))
    n = F.broadcast(positives.agg(F.count("*").alias("n_pos")))
    joined = ranked.where("neg = 0").crossJoin(t).crossJoin(n)  # one row each
    far = F.col("n_top") * F.exp((F.col("s_top") - F.col("score")) / F.greatest(F.col("rate"), F.lit(1e-12))) / F.col("m")
    p = F.when(F.col("score") > F.col("s_top"), far).otherwise(F.col("above") / F.col("m"))
    return joined.select("id", "score", F.least(p, F.lit(1.0)).alias("p_value")).crossJoin(n).select("id", "score", "p_value", (F.col("p_value") * F.col("n_pos")).alias("e_value"))


def mid_rank_p(positives: DataFrame, negatives: DataFrame, buckets: int | None = None) -> DataFrame:
    """(id, score, p_value): 1 - (null scores below + null scores up to) / 2M, within [1e-6, 1]."""
    near = beside_nulls(positives.select("id", "score"), negatives, buckets)
    at_least = F.coalesce("null.upto", F.lit(0))
    above = at_least - F.when(F.col("null.score") == F.col("score"), F.col("null.n")).otherwise(0)
    m = F.broadcast(negatives.agg(F.count("*").alias("m")))
    p = (at_least + above) / 2 / F.col("m")
    return near.crossJoin(m).select("id", "score", F.least(F.lit(1.0), F.greatest(F.lit(1e-6), p)).alias("p_value"))  # one row


def curve_p_values(scores: DataFrame, top: int = 100, buckets: int | None = None) -> DataFrame:
    """scores: (id, score, is_pos).  Adds p_value: the null scores at least as high and the way to the next lower one, as a share of all; beyond
    the n_top best of them an exponential tail."""
    negatives = scores.where("is_pos = 0")
    near = beside_nulls(scores.select("id", "score", "is_pos"), negatives, buckets)
    highest = F.broadcast(negatives.agg(F.max("score").alias("__max")))
    t = F.broadcast(tail(negatives, "score", top))
    equal = F.col("null.score") == F.col("score")
    up = F.coalesce(F.when(equal, F.col("null.up")).otherwise(F.col("null.score")), "score")
    down = F.coalesce(F.when(F.col("null").isNull(), F.col("__max")).otherwise(F.col("null.down")), "score")
    gap = (up - F.col("score")) / (up - down + 1e-5)
    far = F.col("n_top") * F.exp((F.col("s_top") - F.col("score")) / F.greatest(F.col("rate"), F.lit(1e-12))) / F.col("m")
    p = F.when(F.col("score") > F.col("s_top"), far).otherwise((F.coalesce("null.upto", F.lit(0)) + gap) / F.col("m"))
    return near.crossJoin(t).crossJoin(highest).select("id", "score", "is_pos", F.least(p, F.lit(1.0)).alias("p_value"))  # one row each
