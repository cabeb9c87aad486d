"""Five stages that turn ``documents`` into token ids; each keeps what the one before it kept.

toxicity       documents that score as toxic go
near_dedup     one document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the least id
decontaminate  documents that share a window with the benchmark go
secrets        found secrets are replaced in the text
tokenize       the texts as ids of a byte-level vocabulary, and the check that they decode to the text

Each stage writes what it needs more than once to the shared folder; ``run`` deletes that, and what the stage before it
returned, as soon as the stage's own result is written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.llm import bpe, decontaminate, near_copies, secret_scan, simhash, toxicity
from motifspark.llm.sampling import remainder
from motifspark.llm.shared import materialise, scratch
from motifspark.llm.textbatch import quoted
from motifspark.ship import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept.

    Null, empty and very long texts are scored like any other; repeated rows stay or go together; without labels of both
    classes nothing goes; an empty table stays empty.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels, remainder("doc_id", 4) != 2))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies, all columns kept.

    Texts without words are copies of each other; rows that share an id stay or go together; rows without an id stay; an
    empty table stays empty.
    """
    ship(spark)
    return simhash.keep_one(docs, classes=near_copies.near_copies(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, all columns kept.

    Null and empty texts stay; rows that share an id, or have none, are judged by their own texts; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of ``docs`` with the secrets in its text replaced, and n_chars brought up to date where there were any.

    Null texts stay null; repeated rows stay repeated; an empty table stays empty.
    """
    ship(spark)
    with scratch(spark):
        found = materialise(secret_scan.findings(docs), "secret_findings")
        net = secret_scan.fit(found)
    return secret_scan.redact(docs, net)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of ``docs`` with ``ids``, ``n_tokens`` and whether they decode to the text (``decodes``).

    Null is encoded like the empty text, as no ids; columns of ``docs`` with these names are replaced; repeated rows stay
    repeated; an empty table stays empty.
    """
    ship(spark)
    old = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens", "decodes")]
    plain = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(old)])
    out = bpe.round_trip(plain, text_col=f"c{old.index('text')}")
    same = F.col("decoded") == F.coalesce(F.col(f"c{old.index('text')}"), F.lit(""))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(old)], "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("tokenize", tokenize_stage),
]

#: A trained network and the vocabulary's merges are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialise(stage(spark, docs, sf_dir), name)
            written = made.pop()
            if read:
                made.append(read)  # what the stage read goes with its own tables
            read = written
    return STAGES[-1][1](spark, docs, sf_dir)
