"""Window look-ups by grams, letters of texts, and plans that read the texts no more often than they must."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.functions.sequence import ALPHABETS
from motifspark.operators import background as B
from motifspark.operators import evaluate, score
from motifspark.operators import motif as M
from motifspark.operators.score import Batch, Grams
from motifspark.plans import registry
from motifspark.sources import adapter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, order", [("STANDARD", 2), ("STANDARD", 0), ("EXTENDED", 2), ("METHYLC", 5), ("STANDARD", 8)])
def test_grams_against_contexts(name, order):
    ab, rng, W = ALPHABETS[name], np.random.default_rng(1), 10
    off = np.r_[0, np.cumsum(rng.integers(0, 40, 60))]
    data = rng.choice(np.frombuffer((ab.bases * 6 + "N" + ab.bases.lower()).encode(), np.uint8), off[-1])
    size, offset = ab.size, np.concatenate([[0], np.cumsum([ab.size ** (i + 1) for i in range(order + 1)])])
    ctx, run = [], []
    for a, b in zip(off, off[1:]):
        r = 0
        for p in range(a, b):
            r = r + 1 if chr(data[p]).upper() in ab.bases else 0
            y = 0
            for q in range(p - min(r, order + 1) + 1, p + 1):
                y = y * size + ab.bases.index(chr(data[q]).upper())
            ctx.append(offset[min(r, order + 1) - 1] + y if r else 0)
            run.append(r)
    ctx, run = np.array(ctx), np.array(run)
    batch = Batch(data, off, order, ab)
    s = batch.windows(W)
    assert (batch.ctx == ctx).all() and (batch.run == run).all() and (s == np.flatnonzero(run >= W) - W + 1).all() and (batch.rows(s) == batch.row[s]).all()
    table, w = rng.normal(size=(offset[-1], W)), rng.random(len(s))
    grams = Grams(table, order, ab)
    sums = grams.empty()
    grams.add(sums, batch, s, w)
    assert np.allclose(grams.of(batch, s), sum(table[ctx[s + j], j] for j in range(W)))
    assert np.allclose(grams.by_context(sums), np.stack([np.bincount(ctx[s + j], w, len(table)) for j in range(W)], axis=1))


def test_letters_are_those_of_the_text(spark):
    """A ligature that has a T only once it is spelled out has none here, as in SQL."""
    docs = spark.createDataFrame([(1, "caﬅt-GATTACA"), (2, None), (3, ""), (4, "acgt" * 5)], "doc_id long, text string")
    assert [tuple(r) for r in adapter.sequences(docs, min_length=1).orderBy("seq_id").collect()] == [(1, "CATGATTACA"), (4, "ACGT" * 5)]


def test_curve_by_distinct_scores(spark):
    rng = np.random.default_rng(3)
    for shift in (1.0, -3.0):  # with few true ones the peak is the first row
        rows = [(i, float(round(rng.normal(shift if i % 2 else 0, 1), 1)), i % 2) for i in range(400)]
        df = spark.createDataFrame(rows, "id long, score double, is_pos int")
        want = evaluate.mops_curve(df).groupBy("score").agg(F.count("*").alias("n"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))
        counts = df.groupBy("score").agg(F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg"))
        assert sorted(map(tuple, evaluate.mops_steps(counts).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["occurrence_pvalue", "occurrences", "midrank_pvalue", "curve_pvalue", "mops_curve", "q_values"])
def test_texts_are_not_read_again(spark, name):
    assert not [f for f in registry.queries()[name](spark, SF).inputFiles() if "documents" in f]


def test_join_scores_moves_no_windows(spark):
    st = registry.strands(spark, SF)
    m, bg = registry.models(spark, SF)
    assert "hashpartitioning" not in score.join_scores(st, m, bg)._jdf.queryExecution().executedPlan().toString()


def test_positional_likelihoods_and_counts_take_small_batches(spark):
    bg = B.fit(adapter.read(spark, SF), 2)
    assert "BroadcastHashJoin" not in B.positional_likelihoods(adapter.read(spark, SF), bg)._jdf.queryExecution().executedPlan().toString()
    assert score.CHUNK <= 250_000 and M.site_counts(spark.createDataFrame([("ACG",)] * 3, "site string"), 0, 3).where("n = 3").count() == 3


def test_sites_drawn_together_are_those_drawn_alone():
    from motifspark.operators import gibbs
    from motifspark.operators.background import from_counts
    from motifspark.operators.motif import alphas

    rng, W = np.random.default_rng(4), 6
    bg = from_counts([(k, B.kmer_of(y, k + 1), int(rng.integers(5, 50))) for k in range(3) for y in range(4 ** (k + 1))], 2)
    data, off = rng.choice(np.frombuffer(b"ACGT", np.uint8), 90), np.array([0, 30, 33, 90])
    batch, alpha = Batch(data, off, 2), np.repeat(alphas(2)[:, None], W, axis=1)
    n, log_bg = rng.integers(1, 30, (84, W)).astype(float), gibbs._log_background(bg, 2)
    s = batch.windows(W)
    own = np.stack([batch.ctx[3 + np.arange(W)], np.full(W, -1), batch.ctx[40 + np.arange(W)]])
    tables = gibbs.site_tables(n, own, alpha, bg, log_bg)
    odds = np.exp(sum(tables[batch.rows(s), batch.ctx[s + j], j] for j in range(W)))
    for u in rng.random((200, 3)):
        got = gibbs.draw_sites(batch, s, odds, np.arange(3), 0.6, u)
        for r in range(3):
            mine = s[batch.rows(s) == r]
            at = gibbs.draw_site(n, None if own[r, 0] < 0 else own[r], batch.ctx, mine, alpha, 0.6, bg, log_bg, u[r])
            assert got[r] == (mine[at] if at >= 0 else -1)
