"""Alphabets, complements, k-mers: built-in column expressions."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """bases in code order (0, 1, ...), and the complement of each."""

    name: str
    bases: str
    complement: str

    @property
    def size(self) -> int:
        return len(self.bases)


# The four alphabets and their complements.
ALPHABETS = {
    a.name: a
    for a in (
        Alphabet("STANDARD", "ACGT", "TGCA"),
        Alphabet("METHYLC", "ACGTM", "TGCAG"),
        Alphabet("HYDROXYMETHYLC", "ACGTH", "TGCAG"),
        Alphabet("EXTENDED", "ACGTMH", "TGCAGG"),
    )
}
STANDARD = ALPHABETS["STANDARD"]


def alphabet(name: str) -> Alphabet:
    if name not in ALPHABETS:
        raise ValueError(f"unknown alphabet {name!r}; known: {', '.join(ALPHABETS)}")
    return ALPHABETS[name]


def base_code(c: Column, ab: Alphabet = STANDARD) -> Column:
    """0 for an unknown base, else 1, 2, ...; letters in either case."""
    return F.instr(F.lit(ab.bases), F.upper(c))


def base_letter(code: Column, ab: Alphabet = STANDARD) -> Column:
    """The letter of a code; N for 0."""
    return F.substring(F.lit("N" + ab.bases), code + 1, F.lit(1))


def complement(seq: Column, ab: Alphabet = STANDARD) -> Column:
    return F.translate(seq, ab.bases, ab.complement)


def reverse_complement(seq: Column, ab: Alphabet = STANDARD) -> Column:
    """N stays N."""
    return F.reverse(complement(seq, ab))


def doubled(seq: Column, ab: Alphabet = STANDARD) -> Column:
    """The sequence, a separator, and its reverse complement: 2 L + 1 letters."""
    return F.concat(seq, F.lit("N"), reverse_complement(seq, ab))


def kmer_index(kmer: Column, ab: Alphabet = STANDARD) -> Column:
    """The number of a k-mer in base ``size``, the last base least significant; null if a base is unknown."""
    digits = F.transform(F.split(kmer, ""), lambda c: F.instr(F.lit(ab.bases), c) - 1)
    known = ~F.exists(digits, lambda d: d < 0)
    return F.when(known, F.aggregate(digits, F.lit(0).cast("long"), lambda y, d: y * ab.size + d))


def prefix_index(y: Column, k: int, ab: Alphabet = STANDARD) -> Column:
    """The k-mer without its last base."""
    return F.floor(y / ab.size).cast("long")


def suffix_index(y: Column, k: int, ab: Alphabet = STANDARD) -> Column:
    """The last k bases of a longer k-mer."""
    return F.pmod(y, F.lit(ab.size**k)).cast("long")


def strands(seqs: DataFrame, ab: Alphabet = STANDARD, single: bool = False) -> DataFrame:
    """A row per strand: (..., strand, seq, L); strands are rows, so no window ever spans both."""
    if single:
        return seqs.withColumns({"strand": F.lit("+"), "L": F.length("seq")})
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq"), ab).alias("s"))))
    rest = [c for c in seqs.columns if c != "seq"]
    return seqs.select(*rest, both.alias("b")).select(*rest, F.col("b.strand"), F.col("b.s").alias("seq"), F.length("b.s").alias("L"))


def kmer_counts(seqs: DataFrame, order: int, by: list[str] | None = None, ab: Alphabet = STANDARD) -> DataFrame:
    """(by..., k, kmer, n) for k = 0..order in one pass: counts of (k + 1)-mers, those with an unknown base left out.

    Only the longest k-mer of each position is counted on the big side (4^(order + 1) keys, added up before the shuffle);
    shorter ones are suffixes of those.
    """
    by = by or []
    at = F.explode(F.sequence(F.lit(1), F.length("seq")))
    long = seqs.where(F.length("seq") > 0).select(*by, "seq", at.alias("i")).select(*by, F.expr(f"substring(seq, greatest(1, i - {order}), least(i, {order + 1}))").alias("w"))
    top = long.groupBy(*by, "w").agg(F.count("*").alias("n"))
    orders = F.explode(F.sequence(F.lit(0), F.length("w") - 1))
    each = top.select(*by, "w", "n", orders.alias("k")).select(*by, "k", F.expr("right(w, k + 1)").alias("kmer"), "n")
    return each.where(~F.col("kmer").rlike(f"[^{ab.bases}]")).groupBy(*by, "k", "kmer").agg(F.sum("n").alias("n"))


def base_frequencies(seqs: DataFrame, ab: Alphabet = STANDARD) -> DataFrame:
    """(base, n, freq) over the forward strands, unknown bases left out."""
    counts = [F.sum(F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(b), F.lit("")))).cast("long").alias(b) for b in ab.bases]
    one = seqs.agg(*counts)
    long = one.select(F.expr("stack({}, {}) AS (base, n)".format(ab.size, ", ".join(f"'{b}', `{b}`" for b in ab.bases))))
    total = sum((F.col(b) for b in ab.bases), F.lit(0))
    joined = long.crossJoin(one.select(total.alias("total")))  # one row
    return joined.select("base", "n", (F.col("n") / F.col("total")).alias("freq"))


def basename(path: Column) -> Column:
    """Without the directory and the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def overlap_rest(a: Column, b: Column) -> Column:
    """The longer string without the prefix that it shares with the shorter one."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(short, i, F.lit(1)) == F.substring(long, i, F.lit(1))) & (F.length(short) >= i), i).otherwise(k)
    )
    return F.substring(long, n + 1, F.length(long))


def is_short(seq: Column, width: int, single: bool = False) -> Column:
    """Shorter than a motif of ``width``; the effective length of a double strand is 2 L + 1."""
    n = F.length(seq)
    return (n if single else 2 * n + 1) < width
