"""Information content, contributions, IUPAC letters and logo layout of motif tables (motif_id, j, k, kmer, v, p)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialise


def xlog2x(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def information(motif: DataFrame) -> DataFrame:
    """(motif_id, j, bits) of order 0: 2 + sum p log2 p; 0 where a probability is not positive."""
    g = motif.where("k = 0").groupBy("motif_id", "j").agg(F.min("p").alias("low"), F.sum(xlog2x(F.col("p"))).alias("h"))
    return g.select("motif_id", "j", F.when(F.col("low") > 0, 2 + F.col("h")).otherwise(0.0).alias("bits"))


def contributions(motif: DataFrame, freq: float = 0.25, max_order: int = 5) -> DataFrame:
    """(motif_id, k, j, kmer, bits): what each k-mer adds: order 0 p log2(p / f), order k p log2(v_k / v_(k-1) of its suffix), j >= k."""
    low = motif.select(F.col("motif_id").alias("m2"), F.col("j").alias("j2"), (F.col("k") + 1).alias("k2"), F.col("kmer").alias("suffix"), F.col("v").alias("v_low"))
    zero = motif.where("k = 0").select("motif_id", "k", "j", "kmer", (F.col("p") * F.log2(F.col("p") / freq)).alias("bits"))
    high = motif.where(f"k > 0 AND k <= {max_order} AND j >= k").withColumn("tail", F.expr("right(kmer, k)"))
    up = high.join(low, (F.col("motif_id") == F.col("m2")) & (F.col("j") == F.col("j2")) & (F.col("k") == F.col("k2")) & (F.col("tail") == F.col("suffix")))
    return zero.unionByName(up.select("motif_id", "k", "j", "kmer", (F.col("p") * F.log2(F.col("v") / F.col("v_low"))).alias("bits")))


def contribution_totals(parts: DataFrame) -> DataFrame:
    """(motif_id, k, j, bits, plus, minus)"""
    return parts.groupBy("motif_id", "k", "j").agg(F.sum("bits").alias("bits"), F.sum(F.greatest("bits", F.lit(0.0))).alias("plus"), F.sum(F.least("bits", F.lit(0.0))).alias("minus"))


def background_contributions(bg: DataFrame, freq: float = 0.25) -> DataFrame:
    """(k, kmer, bits) of a homogeneous model (k, kmer, v, p)."""
    low = bg.select((F.col("k") + 1).alias("k2"), F.col("kmer").alias("suffix"), F.col("v").alias("v_low"))
    zero = bg.where("k = 0").select("k", "kmer", (F.col("p") * F.log2(F.col("p") / freq)).alias("bits"))
    up = bg.where("k > 0").withColumn("tail", F.expr("right(kmer, k)")).join(low, (F.col("k") == F.col("k2")) & (F.col("tail") == F.col("suffix")))
    return zero.unionByName(up.select("k", "kmer", (F.col("p") * F.log2(F.col("v") / F.col("v_low"))).alias("bits")))


def logo_layout(parts: DataFrame, gap: float = 0.01) -> DataFrame:
    """Adds the lower edge and height of each letter group: positive and negative parts stacked apart, ascending; columns with NaN are left out."""
    ok = parts.withColumn("sign", F.when(F.col("bits") >= 0, 1).otherwise(-1)).withColumn("h", F.abs("bits")).where(~F.isnan("h"))
    by = Window.partitionBy("motif_id", "k", "j", "sign")
    w = by.orderBy("h", "kmer").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(by)
    return ok.select("motif_id", "k", "j", "kmer", "sign", (F.coalesce(F.sum("h").over(w), F.lit(0.0))).alias("base"), (F.col("h") * F.greatest(F.lit(0.0), 1 - n * gap)).alias("height"))


# IUPAC letters and the bases they stand for; the comparison background.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "S": "CG", "W": "AT", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "N": ""}
IUPAC_BACKGROUND = {"A": 0.2, "C": 0.3, "G": 0.3, "T": 0.2}


def iupac_profiles(spark: SparkSession, c: float = 0.2, t: float = 0.7) -> DataFrame:
    """(ord, letter, base, f): 11 profiles; a represented base has an equal share of t on top of c of the background."""
    rows = []
    for o, (letter, bases) in enumerate(IUPAC.items()):
        raw = {b: c * IUPAC_BACKGROUND[b] + (t if b in bases else 0.0) for b in "ACGT"}
        total = sum(raw.values())
        rows += [(o, letter, b, x / total) for b, x in raw.items()]
    return spark.createDataFrame(rows, "ord int, letter string, base string, f double")


def iupac(motif: DataFrame) -> DataFrame:
    """(motif_id, j, letter): the profile with the least symmetric divergence from the column; the first of equals."""
    table = F.broadcast(iupac_profiles(motif.sparkSession))  # 44 rows
    p = F.greatest("p", F.lit(1e-12))
    both = motif.where("k = 0").join(table, F.col("kmer") == F.col("base")).withColumn("d", (p - F.col("f")) * (F.log2(p) - F.log2("f")))
    d = both.groupBy("motif_id", "j", "letter", "ord").agg(F.round(F.sum("d"), 9).alias("d"))
    return d.groupBy("motif_id", "j").agg(F.min_by("letter", F.struct("d", "ord")).alias("letter"))


def entropies(motif: DataFrame, freq: float = 0.25) -> DataFrame:
    """(motif_id, j, h_model, h_model_bg): 0.5 sum p log2 p, and 0.5 (sum p log2 p + sum b log2 b) - sum m log2 m, m = (p + b) / 2."""
    p, b = F.col("p"), F.lit(freq)
    g = motif.where("k = 0").groupBy("motif_id", "j").agg(F.sum(xlog2x(p)).alias("a"), F.sum(xlog2x(b)).alias("b"), F.sum(xlog2x((p + b) / 2)).alias("c"))
    return g.select("motif_id", "j", (F.col("a") / 2).alias("h_model"), ((F.col("a") + F.col("b")) / 2 - F.col("c")).alias("h_model_bg"))


def position_histogram(sites: DataFrame, bins: int = 50) -> DataFrame:
    """(strand, bin, n): where sites lie, relative to the sequence's middle; sites: (start, width, L, strand) in strand coordinates."""
    centre = F.floor(F.col("start") + F.col("width") / 2) - F.floor(F.col("L") / 2)
    return sites.groupBy("strand", F.floor(centre / bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def position_density(sites: DataFrame, points: int = 101, bandwidth: float | None = None, reach: float | None = None, cut: float = 5.0) -> DataFrame:
    """(strand, x, density): a Gaussian kernel estimate of where sites lie, relative to the sequence's middle, on a grid of ``points``.

    sites: (start, width, L, strand) in strand coordinates.  bandwidth: by default 0.9 min(deviation, quartile range / 1.34) n^-1/5 of each strand (1 where that
    is 0); reach: the grid's ends, by default the next multiple of ten beyond the farthest site.  Sites are counted by place once; each
    place reaches the grid points within ``cut`` bandwidths of it.
    """
    centre = (F.floor(F.col("start") + F.col("width") / 2) - F.floor(F.col("L") / 2)).cast("double")
    h = materialise(sites.groupBy("strand", centre.alias("c")).agg(F.count("*").alias("n")), "places")  # a row a strand and place
    quartiles = F.expr("percentile(c, array(0.25, 0.75), n)")
    mean = F.sum(F.col("n") * F.col("c")) / F.sum("n")
    squares = F.sum(F.col("n") * F.col("c") * F.col("c"))
    total = F.sum("n")
    s = h.groupBy("strand").agg(total.alias("total"), F.sqrt(F.greatest(squares - total * mean * mean, F.lit(0.0)) / F.greatest(total - 1, F.lit(1))).alias("sd"), ((quartiles[1] - quartiles[0]) / 1.34).alias("iqr"))
    least = F.when(F.least("sd", "iqr") > 0, F.least("sd", "iqr")).when(F.col("sd") > 0, F.col("sd"))
    width = F.coalesce(least * 0.9 * F.pow("total", F.lit(-0.2)), F.lit(1.0)) if bandwidth is None else F.lit(bandwidth)
    ends = h.agg(((F.floor(F.max(F.abs("c")) / 10) + 1) * 10.0 if reach is None else F.lit(float(reach))).alias("reach"))
    known = F.broadcast(s.select("strand", "total", width.alias("h")).crossJoin(ends))  # a row a strand
    step = 2 * F.col("reach") / (points - 1)
    every = known.select("strand", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), (F.col("i") * step - F.col("reach")).alias("x"))
    near = h.join(known, "strand")
    low = F.greatest(F.ceil((F.col("c") - cut * F.col("h") + F.col("reach")) / step), F.lit(0))
    high = F.least(F.floor((F.col("c") + cut * F.col("h") + F.col("reach")) / step), F.lit(points - 1))
    at = near.where(low <= high).select("strand", "c", "n", "total", "h", "reach", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("i"))
    z = (F.col("i") * step - F.col("reach") - F.col("c")) / F.col("h")
    made = at.groupBy("strand", "i").agg(F.sum(F.col("n") * F.exp(-z * z / 2) / (F.col("total") * F.col("h") * 2.5066282746310002)).alias("d"))
    return every.join(made, ["strand", "i"], "left").select("strand", "x", F.coalesce("d", F.lit(0.0)).alias("density"))
