"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""
import duckdb
import pytest

from motifspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(f"{x + 0.0:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine = registry.queries()[name](spark, SF)
    cols = sorted(mine.columns)
    theirs = duck.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert canonical(tuple(r) for r in mine.select(*cols).collect()) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"bg_sample_rescaled"}))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
