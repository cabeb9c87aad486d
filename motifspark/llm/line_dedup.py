"""Lines that many documents hold, found with levelled sorted runs of line hashes (built-in functions only).

The index is a few runs, tables of (h, keeper, n) bucketed and sorted by the hash h of a line's key: the largest id seen to
hold the line, and in how many documents it was seen.  Each new batch of documents is counted by hash, merge-anti-joined with
the runs (without moving those), and what they do not settle already becomes a new run.  Whenever ``FAN`` runs of a level
are there they are compacted into one of the next level.  Batches go from the largest ids down, so that a line that is
common in one batch is settled for all later ones.  At the end the runs' common lines meet the documents' lines, and texts are put together
from the stretches between the lines they lose.

Hashes are MD5 of the whole key, 128 bits.  A key's rows are added up before they are moved; lines that hold a large share
of all rows are few, so they are joined by broadcast, all others by a shuffle.

Defined results: one row per row of ``docs``; every row counts as a document, rows that share the largest id keep the line all;
rows without an id count, never name the keeper, and lose a common line unless no holder has an id; null and empty texts are one
empty line; other columns are kept by ``dedup_lines`` and never clash; an empty table has no rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_path, bucketed, dropped, materialise, result, scratch
from .textbatch import new_name, quoted
from .words import let, lower_ascii

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FAN = 6, 3
WHITE = " \t\n\x0b\x0c\r"
HOT_SHARE = 2_000


def keys_of(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """(h, pos, first) of every line whose key has ``least_chars`` code points, in order of h and pos; first: of those in this text."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1)
    keyed = F.transform(lines, lambda line, i: F.struct(F.btrim(line, F.lit(WHITE)).alias("key"), i.alias("pos")))
    long = F.filter(keyed, lambda x: F.length(x["key"]) >= least_chars)
    hashed = F.sort_array(F.transform(long, lambda x: F.struct(F.unhex(F.md5(x["key"])).alias("h"), x["pos"].alias("pos"))))
    first = lambda s: F.transform(s, lambda x, i: F.struct(x["h"].alias("h"), x["pos"].alias("pos"), ((i == 0) | (F.get(s, i - 1)["h"] != x["h"])).alias("first")))
    return let(hashed, first)


class LineRuns:
    """A levelled index of line hashes; ``add`` a batch of (h, id) pairs at a time, ids in any order."""

    def __init__(self, spark, fan: int = FAN, buckets: int | None = None, least_docs: int = LEAST_DOCS):
        self.spark, self.fan, self.least_docs = spark, fan, least_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that joins with runs move the batch only
        self.levels: list[list[str]] = []  # names of the runs of each level
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made, self.id_type = 0, "long"

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        bucketed(rows, name, "h", self.buckets)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Count the lines of a batch, leave out what a run settles, and keep the rest as a run."""
        self.id_type = lines.schema["id"].dataType.simpleString()
        new = lines.groupBy("h").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
        for run in self.runs():
            # enough documents hold the line, and the id that keeps it is at least as large
            done = run.where(F.col("n") >= self.least_docs).select(F.col("h").alias("r"), F.col("keeper").alias("k")).hint("merge")
            new = new.join(done, (new["h"] == done["r"]) & ((new["keeper"] <= done["k"]) | new["keeper"].isNull()), "left_anti")
        self._write(new, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            self._compact(level)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        # by their files: over a union of bucketed scans Spark leaves the shuffle out, and then reads them unbucketed
        out = self.spark.read.schema("h binary, keeper " + self.id_type + ", n long").parquet(*[bucket_path(self.spark, name) for name in names])
        return out.groupBy("h").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self._write(self._merged(old), level + 1)
        self.levels[level] = []
        dropped(self.spark, old)

    def common(self) -> DataFrame:
        """(h, keeper, n) of the lines that enough documents hold; n is at least that number, not always all there are."""
        return self._merged([name for level in self.levels for name in level]).where(F.col("n") >= self.least_docs)

    def close(self) -> None:
        dropped(self.spark, [name for level in self.levels for name in level])
        self.levels = []


def _batches(docs: DataFrame, id_col: str, batches: int) -> Column:
    """The number of each row's batch, from the largest ids (0) down; rows without an id go last."""
    cuts = docs.agg(F.percentile_approx(id_col, F.array(*[F.lit(k / batches) for k in range(1, batches)]), F.lit(10_000))).first()[0] or []
    return F.when(F.col(id_col).isNull(), len(cuts)).otherwise(sum(((F.col(id_col) <= c).cast("int") for c in sorted(set(cuts))), F.lit(0)))


def lost_lines(rows: DataFrame, batches: int = BATCHES, fan: int = FAN, buckets: int | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, t, lost) of the rows (id, t, text) that lose lines: the sorted places of those, from 0."""
    spark = rows.sparkSession
    lines = rows.select(_batches(rows, "id", batches).alias("batch"), "id", "t", F.inline(keys_of(F.col("text"), least_chars)))
    lines = materialise(lines, "lines")
    index = LineRuns(spark, fan, buckets, least_docs)
    try:
        for k in range(batches):
            index.add(lines.where((F.col("batch") == k) & F.col("first")).select("h", "id"))
        common = materialise(index.common().select(F.col("h").alias("c"), "keeper", "n"), "common_lines")
    finally:
        index.close()
    total = lines.count()
    is_hot = F.col("n") * HOT_SHARE > total  # fewer than HOT_SHARE lines
    loses = (F.col("h") == F.col("c")) & (F.col("id").isNull() | (F.col("id") < F.col("keeper"))) & F.col("keeper").isNotNull()
    hot, rest = F.broadcast(common.where(is_hot)), common.where(~is_hot)
    found = [lines.join(hot, loses), lines.join(hot, F.col("h") == F.col("c"), "left_anti").join(rest, loses)]
    at = found[0].select("id", "t", "pos").unionByName(found[1].select("id", "t", "pos"))
    return at.groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def without(text: Column, lost: Column) -> Column:
    """``text`` without its lines number ``lost`` (sorted): the stretches between these, joined."""
    lines = F.split(text, "\n", -1)

    def stretches(lines: Column) -> Column:
        ends = F.concat(lost, F.array(F.size(lines)))
        parts = F.transform(ends, lambda end, k: let(F.when(k == 0, 0).otherwise(F.get(lost, k - 1) + 1), lambda start: F.slice(lines, start + 1, end - start)))
        return F.array_join(F.flatten(parts), "\n")

    return let(lines, stretches)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``docs`` with its text but for the lost lines, and n_lines and n_dropped (new columns, named apart from others).

    options: see ``lost_lines``.  The tables it reads belong to the scratch around the call.
    """
    taken = [*docs.columns]
    names = []
    for wanted in ("n_lines", "n_dropped"):
        names.append(new_name(wanted, taken))
        taken.append(names[-1])
    text = F.col(quoted(text_col))
    of = F.xxhash64(text)  # tells rows apart that share an id
    rows = docs.select(F.col(quoted(id_col)).alias("id"), of.alias("t"), text.alias("text"))
    lost = lost_lines(rows, **options).select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("lost").alias("__lost"))
    plain = docs.select(*[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(docs.columns)])
    at, where = f"__c{docs.columns.index(id_col)}", f"__c{docs.columns.index(text_col)}"
    both = plain.join(lost, plain[at].eqNullSafe(lost["__id"]) & (F.xxhash64(plain[where]) == lost["__t"]), "left")
    whole = F.coalesce(F.col(where), F.lit(""))
    kept = F.when(F.col("__lost").isNull(), F.col(where)).otherwise(without(whole, F.col("__lost")))
    out = [kept.alias(c) if c == text_col else F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    n_lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return both.select(*out, n_lines.cast("long").alias(names[0]), F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias(names[1]))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    with scratch(spark) as made:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        out = dedup_lines(docs)
        return result(out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), "kept_lines", made)


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS} AND max(doc_id) IS NOT NULL),
m AS (SELECT k.*, c.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id < c.keeper) AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""
