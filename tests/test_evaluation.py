import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.functions import numeric
from motifspark.operators import evaluate, ranking


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(round(rng.normal(1.0, 1.0), 1)), 1) for i in range(300)] + [(1000 + i, float(round(rng.normal(0, 1), 1)), 0) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id long, score double, is_pos int")


def brute_curve(rows):
    out, tp, fp = [], 0, 0
    for i, s, p in sorted(rows, key=lambda r: (-r[1], r[2], r[0])):
        tp, fp = tp + p, fp + 1 - p
        out.append((i, tp, fp))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 200])
def test_curve_against_brute_force(scores, buckets):
    rows, df = scores
    got = sorted((r["rank"], r["id"], r["tp"], r["fp"]) for r in evaluate.zoops_curve(df, buckets=buckets).collect())
    assert [x[1:] for x in got] == brute_curve(rows)
    assert [x[0] for x in got] == list(range(1, 801))


def test_areas_against_brute_force(scores):
    rows, df = scores
    c = evaluate.zoops_curve(df)
    curve = brute_curve(rows)
    trap = lambda p: sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(p, p[1:]))
    assert abs(evaluate.precision_area(c).first()[0] - trap([(tp / 300, tp / (tp + fp)) for _, tp, fp in curve])) < 1e-9
    assert abs(evaluate.partial_roc(c).first()[0] - trap([(fp / 500, tp / 300) for _, tp, fp in curve if fp / 500 <= 0.05]) / 0.05) < 1e-9
    y = lambda tp, fp: math.log10(max(1, min(100, tp / fp if fp else 100)))
    assert abs(evaluate.average_recall(c).first()[0] - trap([(tp / 300, y(tp, fp)) for _, tp, fp in curve]) / 2) < 1e-9


def test_p_values(spark, scores):
    rows, df = scores
    pos, neg = df.where("is_pos = 1"), df.where("is_pos = 0")
    null = sorted((s for _, s, p in rows if not p), reverse=True)
    got = {r["id"]: r for r in ranking.p_values(pos, neg).collect()}
    top = max(1, min(100, len(null) // 10))
    s_top, rate = null[top - 1], sum(null[:top]) / top - null[top - 1]
    by_score = sorted(got.values(), key=lambda r: r["score"])
    assert all(a["p_value"] >= b["p_value"] - 1e-12 for a, b in zip(by_score, by_score[1:]))
    for i, s, p in rows:
        if p:
            want = top * math.exp((s_top - s) / rate) / 500 if s > s_top else sum(x >= s for x in null) / 500
            assert abs(got[i]["p_value"] - min(1, want)) < 1e-9 and abs(got[i]["e_value"] - got[i]["p_value"] * 300) < 1e-9
    mid = {r["id"]: r["p_value"] for r in ranking.mid_rank_p(pos, neg).collect()}
    for i, s, p in rows:
        if p:
            want = 1 - (sum(x < s for x in null) + sum(x <= s for x in null)) / 1000
            assert abs(mid[i] - min(1, max(1e-6, want))) < 1e-9
    h = evaluate.p_value_histogram(ranking.mid_rank_p(pos, neg))
    assert h.agg(F.sum("n")).first()[0] == 300
    q = evaluate.q_values(ranking.mid_rank_p(pos, neg), 0.5).orderBy("p").collect()
    assert all(a["q"] <= b["q"] + 1e-9 for a, b in zip(q, q[1:]))
    by = ranking.tail(df.where("is_pos = 0").withColumn("g", F.lit("x")), by=["g"]).first()
    assert (by["n_top"], round(by["s_top"], 9)) == (top, round(s_top, 9))


def test_grenander_is_concave():
    p = np.r_[np.random.default_rng(1).random(500), np.random.default_rng(2).random(300) * 0.05]
    x, q, l = evaluate.grenander(np.round(p, 3), 0.6)
    assert (np.diff(l) >= -1e-12).all() and (q <= 1).all() and q[0] < 0.2


def test_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "seq_id")
    a, b = ({r["seq_id"]: r["fold"] for r in evaluate.folds(df.repartition(k)).collect()} for k in (1, 5))
    assert a == b and set(a.values()) == {0, 1, 2, 3}
    n = evaluate.numbered_folds(df, 4, buckets=5).collect()
    assert sorted((r["seq_id"], r["idx"], r["fold"]) for r in n) == [(i, i, i % 4) for i in range(103)]


def test_mops(spark, scores):
    rows, df = scores
    curve = brute_curve(rows)
    peak = max(tp - fp for _, tp, fp in curve)
    last = max(k for k, (_, tp, fp) in enumerate(curve, 1) if tp - fp == peak)
    got = evaluate.mops_curve(df).collect()
    assert len(got) == last and max(r["recall"] for r in got) == 1


def test_numeric():
    assert abs(numeric.digamma(1) + 0.5772156649015329) < 1e-9 and abs(numeric.digamma(0.3) + 3.5025242222001332) < 1e-9
    assert np.allclose(numeric.posterior([-1000, -1001, -2000]), [1 / (1 + math.exp(-1)), 1 / (1 + math.e), 0])
    assert numeric.argsort([3, 1, 2]).tolist() == [1, 2, 0] and numeric.power(4, 3) == 64
    with pytest.raises(ValueError):
        numeric.digamma(0)


def test_window_and_pairs(scores):
    rows, df = scores
    w = {r["fdr"]: r["recall"] for r in evaluate.curve_window(evaluate.zoops_curve(df)).collect()}
    assert w[0.01] == 0 and w[0.5] == 1 and all(0.01 <= f <= 0.5 for f in w)
    pos = sorted((s for _, s, p in rows if p), reverse=True)
    neg = sorted((s for _, s, p in rows if not p), reverse=True)
    got = {r["rank"]: (r["positive"], r["negative"]) for r in evaluate.log_odds_pairs(df).collect()}
    assert got == {i + 1: (pos[i], neg[i]) for i in range(300)}


@pytest.mark.parametrize("parts", [1, 5])
def test_scan_over_groups_and_seams(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(g) if g else None, i, int(v), None if v % 3 else f"v{i}", float(i)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400)))]
    df = spark.createDataFrame(rows, "g int, id long, v int, s string, x double")
    out = ranking.scan(df, [F.desc("v"), "id"], {"upto": "v", "n": "1"}, {"seen": "s"}, {"before": "x"}, by=["g"], parts=parts).collect()
    got = {r["id"]: (r["upto"], r["n"], r["seen"], r["before"]) for r in out}
    for g in (None, 1, 2):
        total, seen, before = 0, None, None
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])), 1):
            total, seen = total + r[2], r[3] or seen
            assert got[r[1]] == (total, k, seen, before)
            before = r[4]


def test_equal_scores_are_cut(spark):
    """A score that all rows share spans many parts, none with much more than its share."""
    df = spark.range(40_000).select("id", F.lit(1.0).alias("score"), (F.col("id") % 2).alias("is_pos"))
    c = evaluate.zoops_curve(df, buckets=8).cache()
    assert c.agg(F.max("rank"), F.countDistinct("rank"), F.max("tp"), F.max("fp")).first() == (40_000, 40_000, 20_000.0, 20_000.0)
    cut = df.repartitionByRange(8, F.desc("score"), "is_pos", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(cut) == 8 and max(r["count"] for r in cut) < 10_000
    p = {r["p_value"] for r in ranking.mid_rank_p(df.where("is_pos = 1"), df.where("is_pos = 0"), buckets=8).collect()}
    assert p == {0.5}
