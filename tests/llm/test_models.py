"""Language identification, quality and toxicity models: accuracy on rows held out, odd rows, gradients."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.llm import langid, quality_model, toxicity
from motifspark.llm.sampling import first_by_hash, labelled_texts, remainder
from motifspark.llm.textbatch import Chunk, span_hash

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.op5_langid(spark, SF).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] > 0.97 and got[1] > 200


def test_languages_of_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en"), (101, "123 --- !!", "de"), (102, "", None), (103, "the mat " * 20000, "xx"), (None, "der hund", "de"), (104, "日本", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.learn(docs, remainder("doc_id", 4) != 2)
    got = {r["doc_id"]: r for r in langid.identify(docs, models, carry=["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[0]["lang_pred"] == "en" and got[1]["lang_pred"] == "de" and got[None]["lang_pred"] == "de"
    assert got[104]["lang_pred"] in models.langs
    none = langid.identify(docs, langid.learn(docs, F.lit(False)), carry=["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(docs.where("false"), models).count() == 0


def test_kneser_ney_sums_to_one():
    chunk = Chunk.of(["banana bandana", "an bad nab"])
    key, first, _ = langid.grams(chunk)
    k, n = np.unique(key, return_counts=True)
    m = langid.train({"x": (k, n)})
    for context in np.unique(k >> np.uint64(16)):
        allw = (context << np.uint64(16)) | np.arange(65536, dtype=np.uint64)
        assert abs(np.exp(m.log_probability(allw).astype(float)).sum() - 1) < 1e-3


def codes_by_hand(text):
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower())
        elif not out or out[-1] != " ":
            out.append(" ")
    return out


def kneser_ney_by_hand(texts, gram):
    """p of the last character of ``gram`` after the others, by the textbook; blanks stand before each text."""
    counts = {}
    for t in texts:
        c = [" ", " ", " ", *codes_by_hand(t)]
        for i in range(3, len(c)):
            counts[tuple(c[i - 3 : i + 1])] = counts.get(tuple(c[i - 3 : i + 1]), 0) + 1
    tables = {4: counts}
    for k in (3, 2, 1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / 65536
        t = {x: n for x, n in tables[len(g)].items() if x[:-1] == g[:-1]}
        if not t:
            return p(g[1:])
        total = sum(t.values())
        return max(t.get(g, 0) - 0.75, 0) / total + 0.75 * len(t) / total * p(g[1:])

    return p(tuple(gram))


def test_kneser_ney_against_the_textbook():
    learnt = {"x": ["banana bandana!", "Éan bad nab", "кот и кит"], "y": ["nab a bad кот", "zzz"]}
    m = langid.train({lang: np.unique(langid.grams(Chunk.of(texts))[0], return_counts=True) for lang, texts in learnt.items()})
    for text in ("banana кот", "zab иba", "日本 nan", "Банан"):
        c = [" ", " ", " ", *codes_by_hand(text)]
        want = [[kneser_ney_by_hand(learnt[x], c[i - 3 : i + 1]) for x in m.langs] for i in range(3, len(c))]
        assert np.allclose(np.exp(m.log_probability(langid.grams(Chunk.of([text]))[0]).astype(float)), want, rtol=1e-4)


def test_alphabets_are_told_apart_and_odd_texts_rejected(spark):
    rng = np.random.default_rng(1)
    alphabets = {"ru": "оеаинтсрвл", "bg": "ъаоеинтрсщ", "el": "αοιετσνηυρ", "ja": "のにはをたがでてと本", "ar": "املينتربدع", "en": "etaoinshrd"}
    text = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(rng.integers(5, 60)))
    rows = [(6 * i + k, text(letters), lang) for i in range(80) for k, (lang, letters) in enumerate(alphabets.items())]
    rows += [(10_000 + i, text("qxzjkwvy"), None) for i in range(50)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows + rows[:12]], "doc_id long, text string, lang string, lang_pred string, score int")
    models = langid.learn(docs, remainder("doc_id", 4) != 2)
    out = langid.identify(docs.select("doc_id", "text", "lang"), models)
    got = out.where(remainder("doc_id", 4) == 2).where("lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    own = out.where("lang is not null").collect()
    assert len(own) == 492 and np.mean([r["rejected"] for r in own]) < 0.05
    strange = out.where("doc_id >= 10000").collect()
    assert np.mean([r["rejected"] for r in strange]) > 0.9
    assert langid.identify(docs, models).columns[:5] == docs.columns


def test_the_sample_never_vanishes():
    for n in (1, 600, 10**9, 10**12, 10**14):
        assert 0 < langid.sample_share(n, 3000 * n) <= langid.SPAN
        assert langid.sample_share(n, 3000 * n) * n / langid.SPAN <= langid.DOCS_PER_LANG + 1


def test_ties_go_to_the_first_language():
    counts = np.unique(langid.grams(Chunk.of(["abc abc"]))[0], return_counts=True)
    m = langid.train({"zz": counts, "aa": counts})
    h, _, _ = m.cross_entropy(Chunk.of(["abc"]))
    assert m.langs[int(h.argmin(axis=1)[0])] == "aa"


def test_quality_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_model.op7_quality_model(spark, SF).join(labels, "doc_id").where("held_out")
    a = r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert a[0] > 0.93 and a[1] > 40


def test_quality_statistics_do_not_depend_on_the_batch_and_take_odd_texts(spark):
    texts = [None, "", " ", "a", "Ünï códe ### 12!", "x\n" * 5000, "word " * 20000]
    together = quality_model.statistics(Chunk.of(texts))
    assert np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality_model.statistics(Chunk.of([t]))[0])
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.quality_scores(docs, labels, F.lit(True)).collect()} == {1.0}
    assert {r["score"] for r in quality_model.quality_scores(docs, labels, F.lit(False)).collect()} == {0.5}


def test_toxicity_learns_words_and_stems():
    rng = np.random.default_rng(0)
    syllables = ["an", "the", "re", "ing", "ion", "er", "st", "ou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))

    def text(toxic):
        w = [word() for _ in range(rng.integers(20, 200))]
        if toxic:
            for i in rng.choice(len(w), 2):
                w[i] = rng.choice(["moron", "lowei" + word()])
        return " ".join(w)

    data = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    net = toxicity.train(data[:600], epochs=5)
    y = np.array([t[1] for t in data[600:]])
    p = net.scores(Chunk.of([t[0] for t in data[600:]])) >= toxicity.THRESHOLD
    assert (p == y).mean() > 0.9
    long = " ".join(word() for _ in range(9000))
    odd = net.scores(Chunk.of([None, "", " ", "!!!", long + " moron moron " + long, long]))
    assert odd[0] < 0.1 and odd[1] == odd[0] and np.isfinite(odd).all() and odd[4] > odd[0]


def test_toxicity_gradients():
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, mask = rng.normal(0, 1, (5, 3, toxicity.INPUT)), np.ones((5, 3), np.float64)
    mask[3:, 1] = 0

    def loss():
        proj = {d: x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}
        out, cache = net.forward(proj, mask, keep=True)
        return float((out * np.array([1.0, -2.0, 0.5])).sum()), cache

    g, _ = net.backward(np.array([1.0, -2.0, 0.5]), loss()[1], mask)
    for k in ("Uf", "Ub", "bf", "bb", "A", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()[0]
        net.p[k][at] = old - 1e-3
        down = loss()[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * max(0.2, abs(g[k][at]))


def test_drop_toxic_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6)], "doc_id long, text string, score int")
    net = toxicity.train([("x", 0)])
    assert toxicity.drop_toxic(docs, net).columns == docs.columns
    assert sorted(r["score"] for r in toxicity.drop_toxic(docs, net).collect()) == [5, 6]
    assert toxicity.toxicity_scores(docs, net).columns == ["doc_id", "text", "score", "score"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = ([r["k"] for r in first_by_hash(df.repartition(n), "k", 100).collect()] for n in (1, 7))
    assert a == b and len(a) == 100


@pytest.mark.parametrize("texts", [["a bb ccc", None, "", "bb\ta"], ["é é x"]])
def test_words_and_hashes(texts):
    chunk = Chunk.of(texts)
    starts, ends, first = chunk.words
    got = [[chunk.data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(t or "").replace("\t", " ").split(" ") if t else [] for t in texts]
    h = span_hash(chunk.lower, starts, ends)
    flat = [w for g in got for w in g]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_samples_of_repeated_keys(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS k", "id AS v")
    assert sorted(r["k"] for r in first_by_hash(df, "k", 3000).collect()) == [0, 1, 2]
    assert len(first_by_hash(spark.range(20_000).selectExpr("id AS k"), "k", 300).collect()) == 300


def test_texts_for_the_driver_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(60)] + [(100, "y" * 100_000), (1, "another"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled_texts(docs, labels, "toxic", F.lit(True), 1000, most_bytes=20_000)
    assert sum(len(t) for t, y in got if y == 1) <= 20_000 and sum(len(t) for t, y in got if y == 0) <= 20_000 and len(got) > 30
    assert ("another", 1) in got or ("x" * 1000, 1) in got
    assert labelled_texts(docs, labels.where("false"), "toxic", F.lit(True), 10) == [] and labelled_texts(docs.where("false"), labels, "toxic", F.lit(True), 10) == []


def statistics_by_hand(text):
    import math
    import re

    t = text or ""
    raw, low = t.encode(), "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    lines = [x for x in low.split("\n") if x]
    share = lambda a, b: math.log((a + 0.5) / (max(b - a, 0) + 0.5))
    upper = sum("A" <= c <= "Z" for c in t)
    letter = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 for c in raw)
    digit, symbol = sum("0" <= c <= "9" for c in t), sum(c in "#*$%&|<>" for c in t)
    mark = sum(32 < ord(c) < 127 and not ("0" <= c <= "9" or "a" <= c.lower() <= "z") and c not in "#*$%&|<>" for c in t)
    total = sum(len(w.encode()) for w in words)
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(words)), math.log((total + 4) / (len(words) + 1)), share(upper, letter), share(digit, len(t)), share(symbol, len(t)), share(mark, len(t)),
        share(t.count("!"), len(words)), share(t.count("."), len(words)), share(len(set(words)), len(words)), share(len(set(pairs)), len(pairs)),
        math.log((len(words) + 1) / (len(lines) + 1)), share(len(lines) - len(set(lines)), len(lines)), share(sum(len(w.encode()) > 14 for w in words), len(words)),
    ]


def test_quality_statistics_and_discriminant_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()
    texts = [r["text"] for r in docs] + [None, "", " \n\t", "A!", "Ünï CÖDE ### 12!\nx y\nX Y\n"]
    x = quality_model.statistics(Chunk.of(texts))
    assert np.allclose(x, [statistics_by_hand(t) for t in texts])
    rng = np.random.default_rng(0)
    y = (rng.random(len(texts)) < 0.4).astype(int)
    sums = {c: (float((y == c).sum()), x[y == c].sum(axis=0), x[y == c].T @ x[y == c]) for c in (0, 1)}
    model = quality_model.fit(sums)
    spread = np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = (x - x.mean(axis=0)) / spread
    density = []
    for c in (0, 1):
        own = z[y == c]
        cov = 0.9 * np.cov(own.T, bias=True) + 0.1 * np.eye(x.shape[1])
        d = np.clip(z, -8, 8) - own.mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.margin(x), density[1] - density[0], atol=1e-6)


def test_quality_is_calibrated_and_takes_odd_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_model.op7_quality_model(spark, SF).join(labels, "doc_id").where("quality is not null").collect()
    p, y = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.05
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (None, None, 7)], "doc_id long, text string, x int")
    none = labels.where("false")
    assert quality_model.quality_scores(docs.where("false"), none, F.lit(True)).count() == 0
    out = quality_model.quality_scores(docs, none, F.lit(True)).collect()
    assert len(out) == 3 and {r["score"] for r in out} == {0.5}


def test_toxicity_query_finds_held_out_rows_and_takes_odd_tables(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.op3_toxicity(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(labels, "doc_id").where("toxic is not null and held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out.collect())
    odd = spark.createDataFrame([(1, "same text", 1.0), (1, "same text", 2.0), (None, None, 3.0), (3, "", 4.0)], "doc_id long, text string, score double")
    net = toxicity.learn(odd, labels, F.lit(False))
    got = toxicity.toxicity_scores(odd.select("doc_id", "text"), net).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.0}
    assert toxicity.toxicity_scores(odd.where("false"), net).count() == 0
    assert toxicity.drop_toxic(odd, net).columns == odd.columns and toxicity.drop_toxic(odd, net).count() == 4


def toxic_score_by_hand(net, text):
    """Window by window and word by word: both directions, attention, the worst window."""
    words = (text or "").split()
    feats = {w: toxicity.word_features(Chunk.of([w]))[0][0] for w in set(words)}
    p, H = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def run(x, d):
        h, out = np.zeros(H), []
        for v in x:
            g, u = v @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r = sigmoid(g[:H] + u[:H]), sigmoid(g[H : 2 * H] + u[H : 2 * H])
            h = (1 - z) * h + z * np.tanh(g[2 * H :] + r * u[2 * H :])
            out.append(h)
        return out

    logits, a = [-8.0], 0
    while words and (a == 0 or a + toxicity.WINDOW - toxicity.STRIDE < len(words)):
        x = [p["E"][feats[w]].sum(axis=0) for w in words[a : a + toxicity.WINDOW]]
        h = np.concatenate([run(x, "f"), run(x[::-1], "b")[::-1]], axis=1)
        e = np.exp(4 * (np.tanh(h) @ p["A"])[:, 0])
        logits.append((e / e.sum()) @ h @ p["o"] + p["c"][0])
        a += toxicity.STRIDE
    return sigmoid(net.scale * max(logits) + net.shift)


def test_toxicity_scores_against_a_loop():
    rng = np.random.default_rng(5)
    net = toxicity.Network.fresh()
    net.p["E"] = rng.normal(0, 0.7, net.p["E"].shape).astype(np.float32)
    net.scale, net.shift = 1.3, 0.4
    word = lambda: "".join(rng.choice(list("abcdeABC!.9é"), rng.integers(1, 9)))
    texts = [None, "", " \n", "one", *[" ".join(word() for _ in range(n)) for n in (2, 31, 32, 33, 56, 57, 80, 81, 300, 1000)]]
    got = net.scores(Chunk.of(texts))
    assert np.allclose(got, [toxic_score_by_hand(net, t) for t in texts], atol=1e-4)


def test_a_language_of_few_long_texts_is_learned(spark):
    """However little of a language the bounds allow, one of its texts is counted."""
    from pyspark.sql import functions as F

    from motifspark.llm import langid

    rows = [(i, "the cat sat on the mat and ran away " * 20, "en") for i in range(200)] + [(1000 + i, "der hund lief durch den wald und bellte laut " * 3000, "de") for i in range(3)]
    rows += [(2000 + i, "le chat dort sous la vieille table ronde " * 400, "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.learn(docs, F.lit(True), docs_per_lang=100, bytes_per_lang=50)
    assert models.langs == ["de", "en", "fr"]
    got = {r["lang"]: r["lang_pred"] for r in langid.identify(docs, models).select("lang", "lang_pred").distinct().collect()}
    assert got == {"de": "de", "en": "en", "fr": "fr"}
