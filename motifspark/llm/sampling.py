"""Bounded, deterministic samples of labelled rows for fitting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have none."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def first_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows with different keys, the first by a hash of ``key``; of rows that share a key, one counts.

    Rows that cannot be among them, given how many keys there are, go before the top-k, so that what tasks send to the
    driver does not grow with their number.
    """
    df = df.dropDuplicates([key])
    n = df.count()
    span = 1 << 62
    h = F.pmod(F.xxhash64(F.col(key).cast("string") if df.schema[key].dataType.simpleString() != "binary" else F.col(key)), F.lit(span))
    near = df if n <= 2 * most else df.where(h < int(span * min(1.0, (most + 10 * most**0.5 + 100) / n)))
    return near.orderBy(h, key).limit(most)


def within(sizes: list[int], most: int) -> list[bool]:
    """Which of the sizes, in order, are taken so that their sum stays within ``most``."""
    total, out = 0, []
    for x in sizes:
        out.append(total + x <= most)
        total += x if out[-1] else 0
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 48_000_000) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) pairs of each class 0 and 1, the first by a hash of the id, of at most ``most_bytes`` each class.

    ``allowed`` is a condition on ``id_col`` of ``labels``.  The ids are chosen first, then texts by their sizes, so
    only the chosen texts reach the driver.  Ids labelled both ways count as 0; of texts that share an id, the first in order counts.
    """
    base = labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    ids = [(r["__id"], r["y"]) for y in (0, 1) for r in first_by_hash(base.where(F.col("y") == y), "__id", per_class).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, f"__id {docs.schema[id_col].dataType.simpleString()}, y int")
    texts = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__t"))
    picked = texts.join(F.broadcast(chosen), texts["__d"] == chosen["__id"]).groupBy("__id", "y").agg(F.min("__t").alias("__t"))
    picked = materialise(picked, "labelled_texts")  # 2 * per_class rows
    size = {r["__id"]: r["n"] for r in picked.select("__id", F.coalesce(F.octet_length("__t"), F.lit(0)).alias("n")).collect()}
    taken = []
    for y in (0, 1):
        mine = [i for i, k in ids if k == y and i in size]
        taken += [i for i, ok in zip(mine, within([size[i] for i in mine], most_bytes)) if ok]
    rows = picked.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], f"__k {docs.schema[id_col].dataType.simpleString()}")), F.col("__id") == F.col("__k")).collect() if taken else []
    return [(r["__t"] or "", r["y"]) for r in sorted(rows, key=lambda r: (str(r["__id"]), r["__t"] or ""))]
