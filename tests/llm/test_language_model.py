import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from motifspark.llm import language_model as lm
from motifspark.llm.textbatch import Chunk


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def base(rows):
    count = Counter(t for i, x in rows if i is not None and crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return n, {i: (len(t := tokens(x)), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for i, x in rows}


def test_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)  # most words take the distributed way
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "Ünknown ÜNKNOWN the The"), (-4, "zz " * 30000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    n, want = base(rows)
    got = lm.scores(docs, lm.remainder("doc_id", 7) != 2, least_texts=60).collect()
    assert len(got) == len(rows)
    for r in got:
        size, known, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert abs(r["base_score"] - score) < 1e-6 * max(1, abs(score))
        assert r["score"] < 0


def test_score_against_a_loop_over_tokens(spark, monkeypatch):
    """The network step by step in plain Python, with the unknown words' shares, from the fitted weights."""
    monkeypatch.setattr(lm, "FREQUENT", 1500)
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")  # a repeated row counts twice
    allowed = lm.remainder("doc_id", 7) != 2
    counts = lm.token_counts(docs.where(allowed))
    model = lm.fit(docs, counts, allowed, least_texts=60)
    again = lm.fit(docs, counts, allowed, least_texts=60)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-5) for k in model.p)
    count = Counter(t for i, x in [*rows, rows[0]] if crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    ids = {}
    for t in {t for _, x in rows for t in tokens(x)} - {"\n"}:
        at = model.look_up(Chunk.of([t]).word_hash.view(np.int64))[0]
        ids[t] = int(model.word[at]) if at >= 0 else lm.UNKNOWN
    ids["\n"] = 0
    other = [t for t in count if ids[t] == lm.UNKNOWN]
    n, v = sum(count[t] for t in other), len(other)
    p, H, K = {k: x.astype(float) for k, x in model.p.items()}, lm.HIDDEN, lm.MEMBERS
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def by_hand(text):
        h, total = np.zeros(H), 0.0
        for t in tokens(text):
            w = ids[t]
            a, b = h @ p["C"] + p["cb"], h @ p["M"][w // K] + p["mb"][w // K]
            total += (a[w // K] - np.log(np.exp(a).sum()) + b[w % K] - np.log(np.exp(b).sum())) / np.log(10)
            if w == lm.UNKNOWN:
                total += math.log10((count[t] + 1) / (n + v + 1))
            x, u = p["E"][w] @ p["W"] + p["b"], h @ p["U"]
            z, r = sigmoid(x[:H] + u[:H]), sigmoid(x[H : 2 * H] + u[H : 2 * H])
            h = h + z * (np.tanh(x[2 * H :] + r * u[2 * H :]) - h)
        return total

    got = {r["doc_id"]: r["score"] for r in lm.scores(docs, allowed, least_texts=60).collect()}
    some = sorted(rows, key=lambda r: len(r[1] or ""))[:: len(rows) // 25]
    for i, x in some:
        assert abs(got[i] - by_hand(x)) < 1e-3 * max(1, abs(got[i])), i


def test_weights_are_averaged_in_steps(spark):
    v = [np.arange(5, dtype=np.float32) * k for k in range(1, 201)]
    parts = spark.createDataFrame([(float(k), bytearray(x.tobytes())) for k, x in zip(range(1, 201), v)], "tokens double, weights binary")
    want = sum(k * x.astype(float) for k, x in zip(range(1, 201), v)) / sum(range(1, 201))
    assert np.allclose(lm._averaged(parts), want, rtol=1e-4) and lm._averaged(parts.where("false")) is None


def test_model_beats_the_base_on_texts_held_out(spark):
    r = lm.op9_language_model(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("base_score", "score", "n_tokens").first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_empty_table_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = lm.scores(docs, lm.remainder("doc_id", 7) != 2).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert lm.scores(docs.where("false"), lm.remainder("doc_id", 7) != 2).count() == 0


def test_probabilities_add_up_and_do_not_depend_on_the_batch():
    p = lm.fresh(np.arange(lm.WORDS))
    h = np.random.default_rng(0).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    logp, _, _ = lm._output(p, np.repeat(h, lm.WORDS, axis=0), np.arange(lm.WORDS))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, lm.WORDS, n) for n in (1, 5, 31, 32, 33, 100, 257)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = lm.log_likelihood(p, np.concatenate(texts), first)
    alone = [lm.log_likelihood(p, t, np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)
    assert lm.Chunk is Chunk


def test_all_training_texts_are_learned_at_every_size(spark, monkeypatch):
    """More texts than the bound below which all were learned; before, one in eight of them was."""
    docs = spark.range(3600).selectExpr("id as doc_id", "concat('a b ', id % 7) as text")
    seen = []
    averaged = lm._averaged
    monkeypatch.setattr(lm, "_averaged", lambda parts: (seen.append(parts.groupBy().sum("tokens").first()[0]), averaged(parts))[1])
    allowed = lm.remainder("doc_id", 7) != 2
    n = docs.where(allowed).count()
    assert n > lm.LEAST_TEXTS
    lm.scores(docs, allowed)
    assert sum(seen) == 4 * n


def test_gradients_against_differences():
    """The first step of training goes down the slope of the cost, texts that begin inside a window included."""
    rng = np.random.default_rng(4)
    p = {k: v.astype(float) for k, v in lm.fresh(rng.integers(1, 9, lm.WORDS)).items()}
    ids = rng.integers(0, lm.WORDS, (6, 3))
    active, goes_on = np.ones((6, 3), np.float32), np.ones((6, 3), np.float32)
    goes_on[0], goes_on[4, 1], active[5, 2] = 0, 0, 0
    h = np.zeros((3, lm.HIDDEN))
    on = active > 0
    cost = lambda: -lm._output(p, lm._states(p, ids, active, h, goes_on=goes_on)[0][on], ids[on])[0].mean()
    _, g, _ = lm._output(p, lm._states(p, ids, active, h, goes_on=goes_on)[0][on], ids[on], keep=True)
    for k in ("C", "mb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, ends = p[k][at], []
        for step in (0.05, -0.05):
            p[k][at] = was + step
            ends.append(cost())
        p[k][at] = was
        assert abs((ends[0] - ends[1]) / 0.1 - g[k][at]) < 0.02 * abs(g[k][at])


def test_recurrent_gradients_against_differences():
    """The gradients by the inputs of the gates and by the states' share of them, made for all steps at once around a short loop."""
    rng = np.random.default_rng(6)
    p = {k: v.astype(float) for k, v in lm.fresh(rng.integers(1, 9, lm.WORDS)).items()}
    T, B, H = 7, 3, lm.HIDDEN
    ids = rng.integers(0, lm.WORDS, (T, B))
    active, goes_on = np.ones((T, B), np.float32), np.ones((T, B), np.float32)
    goes_on[0], goes_on[4, 1], active[5:, 2] = 0, 0, 0
    pull = rng.normal(0, 1, (T, B, H)).astype(np.float32)
    cost = lambda: float((lm._states(p, ids, active, np.zeros((B, H), np.float32), goes_on=goes_on)[0].astype(float) * pull).sum())
    before, _, tape = lm._states(p, ids, active, np.zeros((B, H), np.float32), keep=True, goes_on=goes_on)
    gx, gu = lm._back(p, tape, before, active, goes_on, pull)
    for k, g in (("b", gx.reshape(-1, 3 * H).sum(axis=0)), ("U", before.reshape(-1, H).T @ gu.reshape(-1, 3 * H))):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:5], g.shape)):
            was, ends = p[k][at], []
            for step in (0.01, -0.01):
                p[k][at] = was + step
                ends.append(cost())
            p[k][at] = was
            assert abs((ends[0] - ends[1]) / 0.02 - g[at]) < 0.02 * abs(g[at]), (k, at)


def test_large_outputs_do_not_overflow():
    rng = np.random.default_rng(7)
    h, ids = rng.uniform(-1, 1, (50, lm.HIDDEN)).astype(np.float32), rng.integers(0, lm.WORDS, 50)
    p = lm.fresh(np.ones(lm.WORDS))
    for scale in (1, 3000):
        q = p | {k: p[k] * np.float32(scale) for k in ("C", "M")}
        assert lm._safe(q["C"], q["cb"]) == (scale == 1)
        logits = h @ q["C"] + q["cb"]
        own = np.einsum("nh,nhm->nm", h, q["M"][ids // lm.MEMBERS]) + q["mb"][ids // lm.MEMBERS]
        say = lambda x, at: x[np.arange(50), at] - x.max(axis=1) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1))
        want = say(logits.astype(float), ids // lm.MEMBERS) + say(own.astype(float), ids % lm.MEMBERS)
        assert np.allclose(lm._output(q, h, ids)[0], want, rtol=1e-4, atol=1e-3)
