"""Adaptive quality rules (built-in functions only).

Each document's counts become four integer rates.  A quantile sketch of every rate is kept per language and
source: a log-linear histogram of 32 exact values and 16 buckets per power of two (relative error 1/16), which
is a plain table of (language, source, rate, bucket, count).  Sketches merge by adding counts, so they pre-aggregate
on the map side and do not depend on partitioning.

The thresholds of a group come from quantiles of its own sketch.  Word length: the median plus and minus twice the way to the
95th and the 5th percentile.  The other rates are zero in most documents, so their limit is a quantile of the documents that
have any (``RATES`` names it), or the 95th percentile of all where that is higher.  Quantiles of a group with n documents
count n to ``PRIOR`` against those of its language, and these in the same way against those of all documents, so small
groups differ less from their language without any switch.  A join brings the thresholds back to the documents.

Defined results: null or empty text has no words and fails the base rules; null languages and sources are groups
of their own; rows repeated stay repeated; extra columns are ignored; an empty table gives an empty result.
Eight-word windows are compared by 64-bit hashes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise
from .words import SPACES, let, split_words

GRAM = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PRIOR = 100
BROADCAST_GROUPS = 100_000
#: rate name: the percentile, among the documents where it is over zero, that is its limit; None: fenced on both sides around the median
RATES = {"symbol_rate": 25, "repeat_rate": 75, "dup_line_rate": 75, "word_length": None}


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the row."""
    n = F.size(words)
    at = F.when(n >= GRAM, F.sequence(F.lit(1), n - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i, GRAM)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(p: Column) -> Column:
            again = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            gaps = let(starts, lambda s: F.transform(s, lambda x, i: F.when(i == 0, F.lit(GRAM)).otherwise(F.least(F.lit(GRAM), x - F.get(s, i - 1)))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, count))

    return let(hashes, covered)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        split_words(text, SPACES).alias("w"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
    )
    return split.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.col("lines.n").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.d")).alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    per = lambda a, b, scale: F.expr(f"({a} * {scale}) div greatest({b}, 1)")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.select(
        "*", failed.alias("base_failed"),
        per("n_symbols", "word_chars", 10000).alias("symbol_rate"),
        per("n_repeat_words", "n_words", 10000).alias("repeat_rate"),
        per("n_dup_lines", "n_lines", 10000).alias("dup_line_rate"),
        per("word_chars", "n_words", 100).alias("word_length"),
    )


def _bucket(v: str) -> Column:
    e = f"length(bin({v}))"
    return F.expr(f"CAST(CASE WHEN {v} < 32 THEN {v} ELSE 32 + ({e} - 6) * 16 + shiftright({v}, CAST({e} AS INT) - 5) - 16 END AS BIGINT)")


def _edge(b: str) -> str:
    """The least value of a bucket."""
    return f"(CASE WHEN {b} < 32 THEN {b} ELSE shiftleft(16L + ({b} - 32) % 16, CAST(({b} - 32) div 16 AS INT) + 1) END)"


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): one mergeable quantile sketch per language, source and rate."""
    stacked = rates.where(~F.col("base_failed")).select(
        "lang", "source", F.expr("stack({}, {}) AS (rate, v)".format(len(RATES), ", ".join(f"'{r}', {r}" for r in RATES)))
    )
    return stacked.groupBy("lang", "source", "rate", _bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def _percent(rate: str) -> str:
    return "CASE {} {} END".format(rate, " ".join(f"WHEN '{r}' THEN {p}" for r, p in RATES.items() if p))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, docs, some, low, mid, high, part) of each sketch; a window holds the buckets of one sketch: some hundreds at most.

    low, mid, high: 5th, 50th and 95th percentile; some: documents where the rate is over zero, part: the wanted percentile of these.
    """
    by = Window.partitionBy(*keys, "rate")
    run = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "all": F.sum("n").over(by), "zeros": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(by)})
    at = lambda test, edge: F.min(F.expr(f"CASE WHEN {test} THEN {edge} END"))
    upper = f"{_edge('(bucket + 1)')} - 1"
    return run.groupBy(*keys, "rate").agg(
        F.max("all").alias("docs"), F.max(F.col("all") - F.col("zeros")).alias("some"),
        at("100 * upto >= 5 * all", _edge("bucket")).alias("low"), at("100 * upto >= 50 * all", _edge("bucket")).alias("mid"), at("100 * upto >= 95 * all", upper).alias("high"),
        at(f"all > zeros AND 100 * (upto - zeros) >= ({_percent('rate')}) * (all - zeros)", upper).alias("part"),
    )


QUANTILES = {"low": "docs", "mid": "docs", "high": "docs", "part": "some"}


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, and for every rate its high, and maybe low, threshold) of each group in the sketches."""
    own = quantiles(sketch, ["lang", "source"])
    merged = lambda keys: sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    named = lambda q, mark: q.withColumnsRenamed({c: f"{mark}_{c}" for c in q.columns})
    lang, every = named(quantiles(merged(["lang"]), ["lang"]), "l"), named(quantiles(merged([]), []), "g")
    joined = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["rate"] == lang["l_rate"])).join(F.broadcast(every), F.col("rate") == F.col("g_rate"))  # `every` has one row per rate
    mixed = {}
    for q, n in QUANTILES.items():
        up = f"((l_{n} * coalesce(l_{q}, 0) + {prior} * coalesce(g_{q}, 0)) div (l_{n} + {prior}))"
        mixed[f"m_{q}"] = F.expr(f"({n} * coalesce({q}, 0) + {prior} * {up}) div ({n} + {prior})")
    fenced = F.col("rate").isin([r for r, p in RATES.items() if p is None])
    fences = joined.select("lang", "source", "rate", *[c.alias(q) for q, c in mixed.items()]).select(
        "lang", "source", "rate", F.expr("2 * m_low - m_mid").alias("low"), F.when(fenced, F.expr("2 * m_high - m_mid")).otherwise(F.greatest("m_part", "m_high")).alias("high")
    )
    at = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c)))
    return fences.groupBy("lang", "source").agg(*[at(r, "high").alias(f"{r}_high") for r in RATES], *[at(r, "low").alias(f"{r}_low") for r, p in RATES.items() if p is None])


def quality_verdicts(docs: DataFrame, prior: int = PRIOR, broadcast_groups: int = BROADCAST_GROUPS, **columns) -> DataFrame:
    """Counts, rates, thresholds and the verdict ``kept`` of every row of ``docs``."""
    rates = materialise(with_rates(document_counts(docs, **columns)), "quality_counts")
    limits = materialise(thresholds(sketches(rates), prior), "quality_thresholds")
    if limits.count() <= broadcast_groups:
        limits = F.broadcast(limits)
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rates.join(limits, rates["lang"].eqNullSafe(F.col("t_lang")) & rates["source"].eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for r, percent in RATES.items():
        inside = inside & (F.col(r) <= F.col(f"{r}_high"))
        if percent is None:
            inside = inside & (F.col(r) >= F.col(f"{r}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("t_lang", "t_source")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    def bucket(v):
        return f"CASE WHEN {v} < 32 THEN {v} ELSE 32 + (length(bin({v})) - 6) * 16 + ({v} >> (length(bin({v})) - 5)) - 16 END"

    def edge(b):
        return f"(CASE WHEN {b} < 32 THEN {b} ELSE (16 + ({b} - 32) % 16) << (({b} - 32) // 16 + 1) END)"

    upper = edge("(b + 1)") + " - 1"

    def levels(keys, src):
        by = ", ".join([*keys, "rate"])
        return f"""SELECT {by}, max(al) AS docs, max(al - zeros) AS some, min(CASE WHEN 100 * upto >= 5 * al THEN {edge('b')} END) AS low, min(CASE WHEN 100 * upto >= 50 * al THEN {edge('b')} END) AS mid,
            min(CASE WHEN 100 * upto >= 95 * al THEN {upper} END) AS high, min(CASE WHEN al > zeros AND 100 * (upto - zeros) >= ({_percent('rate')}) * (al - zeros) THEN {upper} END) AS part
          FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}) AS al, coalesce(sum(n) FILTER (b = 0) OVER (PARTITION BY {by}), 0) AS zeros FROM {src}) GROUP BY {by}"""

    ok = " AND ".join(f"{r} <= {r}_high" + (f" AND {r} >= {r}_low" if p is None else "") for r, p in RATES.items())

    def mixed(q):
        n = QUANTILES[q]
        up = f"((l.{n} * coalesce(l.{q}, 0) + {PRIOR} * coalesce(g.{q}, 0)) // (l.{n} + {PRIOR}))"
        return f"(o.{n} * coalesce(o.{q}, 0) + {PRIOR} * {up}) // (o.{n} + {PRIOR}) AS m_{q}"

    fenced = ", ".join(f"'{r}'" for r, p in RATES.items() if p is None)
    lims = ", ".join(f"max(CASE WHEN rate = '{r}' THEN hi END) AS {r}_high, max(CASE WHEN rate = '{r}' THEN lo END) AS {r}_low" for r in RATES)
    union = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {bucket(r)} AS b FROM r WHERE NOT base_failed" for r in RATES)
    return rf"""
WITH s AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
c AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ln) AS BIGINT) AS n_lines,
    CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN rep USING (rid)
),
r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate,
    n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM c
),
sk AS (SELECT lang, source, rate, b, count(*) AS n FROM ({union}) GROUP BY ALL),
sl AS (SELECT lang, rate, b, sum(n) AS n FROM sk GROUP BY ALL),
sg AS (SELECT rate, b, sum(n) AS n FROM sk GROUP BY ALL),
o AS ({levels(["lang", "source"], "sk")}), l AS ({levels(["lang"], "sl")}), g1 AS ({levels([], "sg")}),
mx AS (
  SELECT o.lang, o.source, o.rate, {", ".join(mixed(q) for q in QUANTILES)}
  FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN g1 g ON g.rate = o.rate
),
f AS (SELECT lang, source, rate, 2 * m_low - m_mid AS lo, CASE WHEN rate IN ({fenced}) THEN 2 * m_high - m_mid ELSE greatest(m_part, m_high) END AS hi FROM mx),
t AS (SELECT lang, source, {lims} FROM f GROUP BY lang, source)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({ok}, false) AS kept
FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""


ORACLE = _oracle()
