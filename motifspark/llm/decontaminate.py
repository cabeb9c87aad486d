"""Benchmark decontamination by exact word n-grams (built-in functions only).

The benchmark's word windows become a small hash table (24 bytes a window) that is broadcast after its size is checked; the words of
every document are hashed once inside the row, windows are hashes of word hashes, exploded and probed.  Only hits carry their words on:
they count if these are equal to the window's, which are joined by the window's number.  A sentinel hash in each document's list
keeps documents without hits, so the texts are read once.  Items are joined to the documents that hit their windows at the end.  Beyond
``broadcast_windows`` windows, (row, position, hash) is shuffled instead, and the words of the rows with hits are fetched afterwards.

Defined results: one row per row of ``docs``, also where ids are null or repeated; a null or empty text has no words and no hits; an item
without words has no windows; a null item_id counts as the string ``null``; repeated items count once; extra columns are ignored,
or kept by ``drop_contaminated``, and never clash; an empty benchmark gives no hits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .words import NOT_ALNUM, let, lower_ascii, split_words

WINDOW = 10
BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_IDS = 1_000_000, 64_000_000, 500_000


def _window_hash(h: Column, start: Column, size: int) -> Column:
    """The hash of ``size`` word hashes from ``start`` on (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(h, start + j) for j in range(size)])


def _hashes(h: Column, size: int) -> Column:
    n = F.size(h)
    at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _window_hash(h, i, size))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, hash, size, words) of each distinct window, and (wid, item) of the items that have it; both are written."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        split_words(lower_ascii(F.col(text_col)), NOT_ALNUM).alias("w"),
    ).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    cut = items.select(
        "item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words")
    )
    cut = materialise(cut.distinct(), "benchmark_windows")
    wid = F.monotonically_increasing_id()
    by_size = F.lit(None).cast("long")
    for k in range(1, window + 1):
        whole = F.xxhash64(F.lit(k), *[F.xxhash64(F.get("words", j)) for j in range(k)])  # as _window_hash
        by_size = F.when(F.col("size") == k, whole).otherwise(by_size)
    windows = materialise(cut.select("size", "words").distinct().select(wid.alias("wid"), by_size.alias("hash"), "size", "words"), "windows")
    owners = materialise(cut.join(windows, ["size", "words"]).select("wid", "item"), "window_items")
    return windows, owners


def _checked(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if table.count() <= rows else table


def _found(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, broadcast_windows: int) -> DataFrame:
    """(rid, doc_id, k1, k2, n, start, size, wid, words) for every hash hit, and a row with wid -1 for every row of ``docs``."""
    sizes = sorted((r["size"] for r in windows.select("size").distinct().collect()), reverse=True)  # at most `window` values
    keys = [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2")]
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), *keys, split_words(lower_ascii(F.col(text_col)), NOT_ALNUM).alias("w"))
    lists = let(_word_hashes(F.col("w")), lambda h: F.concat(F.array(F.lit(0).cast("long")), *[_hashes(h, k) for k in sizes]))
    first, start = F.lit(1), F.lit(0)  # first: position of the first hash of each window size in the list
    for k in sizes:
        start = F.when(F.col("size") == k, F.col("pos") - first).otherwise(start)
        first = first + F.greatest(F.col("n") - (k - 1), F.lit(0))
    probe = windows.select("hash", "size", "wid")
    # a window whose hash is 0 by chance, or the sentinel's elsewhere, is told apart by its position
    sentinel = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(0).alias("size"), F.lit(-1).cast("long").alias("wid"))
    real = (F.col("wid") < 0) == (F.col("pos") == 0)
    if probe.count() <= broadcast_windows:
        rows = words.select("rid", "doc_id", "k1", "k2", F.size("w").alias("n"), "w", F.posexplode(lists).alias("pos", "h"))
        table = F.broadcast(probe.unionByName(sentinel))
        hits = rows.join(table, (rows["h"] == table["hash"]) & real)
        return hits.select("rid", "doc_id", "k1", "k2", "n", start.alias("start"), "size", "wid", F.slice("w", start + 1, F.col("size")).alias("words"))
    words = materialise(words, "document_words")
    rows = words.select("rid", F.size("w").alias("n"), F.posexplode(lists).alias("pos", "h")).where("pos > 0")
    hits = rows.join(probe, rows["h"] == probe["hash"]).select("rid", start.alias("start"), "size", "wid")
    near = hits.join(words, "rid").select("rid", "doc_id", "k1", "k2", F.size("w").alias("n"), "start", "size", "wid", F.slice("w", F.col("start") + 1, F.col("size")).alias("words"))
    every = words.select("rid", "doc_id", "k1", "k2", F.size("w").alias("n"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(-1).cast("long").alias("wid"), F.array().cast("array<string>").alias("words"))
    return near.unionByName(every)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, k1, k2, n_words, spans, n_hit, items) of every row: hit word spans [start, end) in word positions, merged.

    k1, k2: hashes of the text.
    """
    windows, owners = benchmark_windows(benchmark, item_col, benchmark_text_col, window)
    found = materialise(_found(docs, windows, id_col, text_col, broadcast_windows), "window_hits")
    size = windows.agg(F.coalesce(F.sum(F.length(F.array_join("words", " ")) + 16 * F.size("words")), F.lit(0))).first()[0]
    known = windows.select("wid", F.col("words").alias("known"))
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    hits = found.where("wid >= 0").join(known, "wid").where("words = known").select("rid", "start", (F.col("start") + F.col("size")).alias("end"), "wid")
    owners = _checked(owners, broadcast_windows)
    # an item's windows are many in a document: the pairs are made distinct before they are gathered
    items = hits.select("rid", "wid").distinct().join(owners, "wid").select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = hits.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("hits"))
    at = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["end"] - 1)))))
    ends = lambda p, step: F.filter(p, lambda x, i: F.coalesce(F.get(p, i + step) != x + step, F.lit(True)))
    merged = lambda p: F.zip_with(ends(p, -1), ends(p, 1), lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    spans = spans.select("rid", at.alias("at")).select("rid", F.size("at").cast("long").alias("n_hit"), let(F.col("at"), merged).alias("spans"))
    hit = spans.join(items, "rid").withColumnRenamed("rid", "__rid")  # rows with hits only
    base = found.where("wid < 0").select("rid", "doc_id", "k1", "k2", F.col("n").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(hit, base["rid"] == hit["__rid"], "left").select(
        "doc_id", "k1", "k2", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of ``docs`` that share no window with the benchmark, all columns kept.

    Rows are told apart by id and text, so rows without an id, or with the same one, are judged by their own texts.
    """
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(F.col("doc_id").alias("__h0"), F.col("k1").alias("__h1"), F.col("k2").alias("__h2")).distinct()
    hits = materialise(hits, "contaminated")
    if hits.count() <= BROADCAST_IDS:
        hits = F.broadcast(hits)
    same = docs[id_col].eqNullSafe(hits["__h0"]) & (F.xxhash64(docs[text_col]) == hits["__h1"]) & (F.xxhash64(F.lit(1), docs[text_col]) == hits["__h2"])
    return docs.join(hits, same, "left_anti")


def mask_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, words): the normalised words of each document without the hit spans."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col, **options).where("n_hit > 0")
    hits = hits.select(F.col("doc_id").alias("__h0"), F.col("k1").alias("__h1"), F.col("k2").alias("__h2"), "spans").dropDuplicates(["__h0", "__h1", "__h2"])
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(1), text_col).alias("k2"), split_words(lower_ascii(F.col(text_col)), NOT_ALNUM).alias("w"))
    # the spans are in order, and the words between two of them stay
    between = lambda w, s: F.flatten(F.concat(F.transform(s, lambda p, i: F.slice(w, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)) + 1, p["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0)))), F.array(F.slice(w, F.element_at(s, -1)["end"] + 1, F.size(w)))))
    kept = F.when(F.col("spans").isNull(), F.col("w")).otherwise(between(F.col("w"), F.col("spans")))
    return words.join(hits, words["doc_id"].eqNullSafe(hits["__h0"]) & (words["k1"] == hits["__h1"]) & (words["k2"] == hits["__h2"]), "left").select("doc_id", kept.alias("words"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH low(kind, id, doc, w) AS (
  SELECT 'd', CAST(row_number() OVER () AS VARCHAR), doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
),
bw AS (
  SELECT DISTINCT id AS item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM low WHERE kind = 'b' AND len(w) > 0)
),
dw AS (
  SELECT id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM bw) WHERE kind = 'd' AND len(w) >= k)
),
m AS (SELECT dw.id, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, g)),
hit AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + k)) AS p FROM m) GROUP BY id),
its AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item FROM m) GROUP BY id)
SELECT d.doc AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM low d LEFT JOIN hit ON hit.id = d.id LEFT JOIN its ON its.id = d.id WHERE d.kind = 'd'
"""
