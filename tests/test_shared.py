"""Tables of one scratch stay apart from those of another thread's."""
import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from motifspark import shared


def test_two_queries_at_once(spark):
    both = Barrier(2, timeout=60)

    def work(k):
        with shared.scratch(spark) as made:
            df = shared.materialise(spark.range(k), "numbers")
            both.wait()
            assert len(made) == 1
            both.wait()
            if k == 5:
                both.wait()  # the other scratch has ended
                return df.count()
            paths = list(made)
        both.wait()
        assert not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths)
        return k

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(work, (5, 7))) == [5, 7]


def test_bucketed_joins_move_one_side(spark):
    shared.bucketed(spark.range(1000).selectExpr("id AS h", "id * 2 AS v"), "bucketed_test", "h", 4)
    try:
        run = spark.table("bucketed_test").selectExpr("h AS r").hint("merge")
        left = spark.range(0, 2000).selectExpr("id AS h")
        out = left.join(run, left["h"] == run["r"], "left_anti")
        assert out.count() == 1000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1
    finally:
        shared.dropped(spark, ["bucketed_test"])
    assert not spark.catalog.tableExists("bucketed_test")
