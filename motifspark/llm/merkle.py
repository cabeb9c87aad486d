"""Merkle manifest of a dataset: a hash tree per source, and one over the sources, with a proof for every row.

Rows are numbered per source by a range sort (a hot source is cut over many tasks) and a small table of counts by sorted part.
Runs of ``BLOCK`` leaves become one ordered array each; inside it ``sequence``, ``slice`` and ``transform`` collapse
``FAN`` nodes at a time, ``aggregate`` stacks the levels, and the blocks' roots are the leaves of the next round,
until every source has one node.  The roots of the sources go through the same rounds.  On the way back down each block gets the
siblings above it, so that a leaf's path is put together inside its block's row and never shuffled.

Defined results: one row per row of ``docs``; rows are ordered by doc_id (null first), then by leaf, so equal rows share
their results up to the place they take; a null source is a source of its own, before all others; a null doc_id is never tampered
with; extra columns are ignored; an empty table has no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import remainder
from .shared import materialise, result, scratch
from .words import let, lower_ascii

FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return digest(*[field(row[c]) for c in FIELDS])


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, changed, row): g sorts as source does, null first; changed: the tampered leaf of rows chosen by their id."""
    row = {c: F.col(c) for c in FIELDS}
    changed = F.when(remainder("doc_id", 5) == 0, leaf(row | {"text": lower_ascii(F.col("text"))}))
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(g.alias("g"), "doc_id", leaf(row).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with i, the place of each among those of its ``g`` in the given order, and n, their number.

    The rows are cut by range, so a group may span any number of tasks; the places follow from the counts of (part, group).
    """
    at = F.monotonically_increasing_id()
    rows = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    rows = materialise(rows.withColumn("at", at), "sorted_nodes")  # written, so that places stay as they are
    part = F.shiftright("at", 33)
    counts = rows.groupBy("g", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    # one row a part and group; a group is in no more parts than there are
    before = F.expr("sum(c) OVER (PARTITION BY g ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    counts = counts.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.expr("sum(c) OVER (PARTITION BY g)").alias("n"))
    return rows.withColumn("part", part).join(counts, ["g", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def collapsed(nodes: Column, fan: int) -> Column:
    """The level above ``nodes``: a digest of every ``fan`` consecutive ones."""
    last = F.floor((F.size(nodes) - 1) / fan).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * fan + 1, fan), ""), 256))


def blocks(nodes: DataFrame, carry: list[str], fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(g, b, n, items, levels) of nodes (g, i, n, node, ...): ordered arrays of fan ** depth nodes and the levels above them.

    items: (i, node, carried columns).  A block that is not alone in its group is collapsed by ``depth`` levels, one that is
    alone until a single node is left; the last level's only node is the block's root.
    """
    size = fan**depth
    b = F.floor(F.col("i") / size).cast("long")
    held = nodes.groupBy("g", b.alias("b")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "node", *carry))).alias("items"))
    alone = F.lit(0)
    for d in range(depth):
        alone = alone + (F.size("items") > fan**d).cast("int")
    steps = F.slice(F.sequence(F.lit(1), F.lit(depth)), 1, F.when(F.col("n") > size, depth).otherwise(alone))
    up = lambda levels, _: F.concat(levels, F.array(collapsed(F.element_at(levels, -1), fan)))
    return held.withColumn("levels", F.aggregate(steps, F.array(F.transform("items", lambda x: x["node"])), up))


def with_path(item: Column, path: Column) -> Column:
    return item.withField("path", path)


def paths(held: DataFrame, kept: list[str], fan: int = FAN, shape=with_path) -> DataFrame:
    """The items of blocks (items, levels, above, kept columns) as rows: ``shape`` of each item and its path.

    A path is the item's siblings to the left and right at every level in the block, then those ``above`` the block.
    The arrays are made inside the block's row; only what ``shape`` returns leaves it.
    """

    def siblings(nodes: Column, i: Column) -> Column:
        start = i - i % fan
        left, right = F.slice(nodes, start + 1, i % fan), F.slice(nodes, i + 2, fan - 1 - i % fan)
        return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

    below = F.slice("levels", 1, F.size("levels") - 1)
    inside = lambda j: F.transform(below, lambda nodes, k: let((j / F.pow(F.lit(float(fan)), k)).cast("int"), lambda i: siblings(nodes, i)))
    items = F.transform("items", lambda x, j: let(F.concat(inside(j), F.col("above")).cast(PATH), lambda path: shape(x, path)))
    return held.select(*kept, F.inline(items))


def trees(nodes: DataFrame, order: list[str], carry: list[str], fan: int = FAN, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, the lowest first, and (g, node): the root of each group."""
    rounds, now = [], numbered(nodes, order)
    while True:
        made = materialise(blocks(now, carry if not rounds else [], fan, depth), f"blocks_{len(rounds)}")
        rounds.append(made)
        tops = made.select("g", "b", "n", F.element_at(F.element_at("levels", -1), 1).alias("node"))
        most = made.agg(F.max("b")).first()[0]
        if not most:
            return rounds, tops.select("g", "node")
        # groups of one block are done; they go on as single nodes, which collapse no further
        now = tops.select("g", F.col("b").alias("i"), F.ceil(F.col("n") / fan**depth).cast("long").alias("n"), "node")


def descend(rounds: list[DataFrame], known: DataFrame, fan: int = FAN, shape=with_path) -> DataFrame:
    """``shape`` of every leaf and its path.  known: (g, above, ...) of each group; what else it has is carried along."""
    kept = [c for c in known.columns if c not in ("g", "above")]
    upper, on = known, ["g"]
    for k in range(len(rounds) - 1, 0, -1):
        rows = paths(rounds[k].join(upper, on), ["g", *kept], fan)
        upper = materialise(rows.select("g", F.col("i").alias("b"), *kept, F.col("path").alias("above")), f"paths_{k}")
        on = ["g", "b"]
    return paths(rounds[0].join(upper, on), kept, fan, shape)


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda node, x: digest(x["l"], node, x["r"]))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH, shape=with_path) -> DataFrame:
    """(subroot, root, i, node, doc_id, changed, path) for every row of ``docs``, or what ``shape`` makes of an item and its path.

    path: array of (l, r), the siblings from the leaf up; changed: the tampered leaf of the rows chosen for it.  The tables it
    reads belong to the scratch around the call.
    """
    rows = materialise(leaves(docs), "leaves").withColumnRenamed("leaf", "node")
    lower, subroots = trees(rows, ["doc_id", "node", "row"], ["doc_id", "changed"], fan, depth)
    subroots = subroots.select(F.lit(0).alias("g"), F.col("g").alias("source"), "node")
    upper, root = trees(subroots, ["source"], ["source"], fan, depth)
    top = root.select("g", F.array().cast(PATH).alias("above"), F.col("node").alias("root"))
    known = descend(upper, top, fan).select(F.col("source").alias("g"), F.col("path").alias("above"), F.col("node").alias("subroot"), "root")
    return descend(lower, known, fan, shape)


def verified(item: Column, path: Column) -> Column:
    """What the proof of an item gives: its digest, and the root folded from the tampered leaf where there is one."""
    start = F.coalesce(item["changed"], item["node"])
    return F.struct(item["doc_id"].alias("doc_id"), item["node"].alias("leaf"), proof(path).alias("proof_sha256"), folded(start, path).alias("folded_root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    with scratch(spark) as made:
        found = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), shape=verified)
        out = found.withColumn("verified", F.col("folded_root") == F.col("root"))
        return result(out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), "proofs", made)


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> CAST(b AS INT)) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, CAST({bits} AS BIGINT[])), lambda c, m: xor(c >> 1, 3988292384 * (xor(c, m) & 1))), 4294967295)"


def _leaf_sql(text: str) -> str:
    parts = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({parts})"


_UP = f"list_transform(range(0, (len(nodes) + {FAN - 1}) // {FAN}), lambda k: sha256(array_to_string(nodes[k * {FAN} + 1 : k * {FAN} + {FAN}], '')))"


def _path_sql(i: str, d: str) -> str:
    at = f"({i} // CAST(power({FAN}, {d}) AS BIGINT))"
    start = f"({at} - {at} % {FAN})"
    return f"array_to_string(nodes[{start} + 1 : {at}], '') || ',' || array_to_string(nodes[{at} + 2 : {start} + {FAN}], '')"


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH RECURSIVE lf AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(_LOW)} END AS changed FROM documents),
nb AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM lf),
tr AS (SELECT g, 0 AS d, list(leaf ORDER BY i) AS nodes FROM nb GROUP BY g UNION ALL SELECT g, d + 1, {_UP} FROM tr WHERE len(nodes) > 1),
sb AS (SELECT g, nodes[1] AS node, row_number() OVER (ORDER BY g) - 1 AS s FROM tr WHERE len(nodes) = 1),
tt AS (SELECT 0 AS d, list(node ORDER BY s) AS nodes FROM sb HAVING count(*) > 0 UNION ALL SELECT d + 1, {_UP} FROM tt WHERE len(nodes) > 1),
lp AS (SELECT nb.doc_id, nb.g, nb.i, list({_path_sql("nb.i", "d")} ORDER BY d) FILTER (len(nodes) > 1) AS p FROM nb JOIN tr ON tr.g = nb.g GROUP BY ALL),
up AS (SELECT sb.g, sb.node, list({_path_sql("sb.s", "d")} ORDER BY d) FILTER (len(nodes) > 1) AS p FROM sb, tt GROUP BY ALL),
al AS (SELECT nb.doc_id, nb.leaf, up.node AS subroot, (SELECT nodes[1] FROM tt WHERE len(nodes) = 1) AS root, coalesce(nb.changed, nb.leaf) AS start, list_concat(coalesce(lp.p, []), coalesce(up.p, [])) AS p
  FROM nb JOIN lp ON lp.g = nb.g AND lp.i = nb.i JOIN up ON up.g = nb.g),
fd AS (SELECT *, list_reduce(list_prepend(start, p), lambda a, x: sha256(split_part(x, ',', 1) || a || split_part(x, ',', 2))) AS folded_root FROM al)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fd"""
