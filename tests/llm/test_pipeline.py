"""The pipeline's stages against brute force, on the whole smallest table and planted rows."""
import os
import re

import numpy as np
from test_bpe import LIB
from test_rules_and_scans import brute_hits
from test_secret_scan import brute

import corpus_pipeline
from motifspark.llm import near_copies, toxicity
from motifspark.llm.sampling import remainder
from motifspark.llm.textbatch import Chunk

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    s = []
    for t in (a, b):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        s.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1])) if s[0] or s[1] else 1.0


def test_stages_against_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "tokenize"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    longest = max(rows.values(), key=lambda r: len(r["text"]) if len(r["text"]) < 4000 else 0)["text"]
    near = longest.split()
    near[len(near) // 2] = "changed"
    planted = [(10_001, longest, "en", "x", 1), (10_002, " ".join(near), None, None, None), (10_003, "token = 'abcdef0123456789abcdef'", "en", "x", 9), (10_004, None, None, None, None), (10_005, "and now " + bench[0][1], "en", "x", 3)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).persist()
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    one = stage["toxicity"](spark, docs, SF).persist()
    net = toxicity.learn(docs, labels, remainder("doc_id", 4) != 2)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, t in before.items() if net.scores(Chunk.of([t]))[0] < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns

    two = stage["near_dedup"](spark, one, SF).persist()
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    classes = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(one).collect()}
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if jaccard(texts[i], texts[j]) >= 0.8:
                assert classes[i] == classes[j], (i, j)
    assert set(kept) == set(classes.values()) and {10_001, 10_002}.isdisjoint(kept)
    apart = [i for i in ids if i not in kept]
    assert all(max(jaccard(texts[i], texts[j]) for j in ids if j != i) >= 0.8 for i in apart)

    three = stage["decontaminate"](spark, two, SF).persist()
    assert {r["doc_id"] for r in three.collect()} == {i for i, t in kept.items() if not brute_hits(t, bench)[1]}
    assert 10_005 not in {r["doc_id"] for r in three.select("doc_id").collect()}

    four = stage["secrets"](spark, three, SF).persist()
    assert four.columns == docs.columns and four.count() == three.count()
    was = {r["doc_id"]: r for r in three.collect()}
    for r in four.collect():
        text = was[r["doc_id"]]["text"]
        if not brute(text or ""):
            assert r["text"] == text or "[secret]" in r["text"]
        else:
            assert not brute(r["text"]) and "[secret]" in r["text"] and r["n_chars"] == len(r["text"])

    final = {r["doc_id"]: r for r in stage["tokenize"](spark, four, SF).collect()}
    after = {r["doc_id"]: r["text"] for r in four.collect()}
    assert set(final) == set(after)
    for i, r in final.items():
        assert r["ids"] == LIB.encode(after[i] or "", add_special_tokens=False).ids and r["decodes"]
    assert np.array([r["n_tokens"] == len(r["ids"]) for r in final.values()]).all()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() > 100


def test_stages_on_an_empty_table_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["ids", "decoded", "n_tokens", "one", "redacted", "hit", "extra", "y", "dotted.name", "k1"]
    odd = docs.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, odd.where("false"), SF).count() == 0
        if name != "tokenize":
            assert out.columns == odd.columns and out.selectExpr("max(`dotted.name`)").first()[0] == 8
    assert {r["decodes"] for r in out.collect()} == {True} and len(out.columns) == len(set(out.columns)) == len(odd.columns) + 1


def test_scratch_tables_go(spark, tmp_path):
    from motifspark.llm import shared

    with shared.scratch(spark) as made:
        a = shared.materialise(spark.range(3), "a")
        with shared.scratch(spark) as inner:
            b = shared.result(spark.range(4), "b", inner)
        assert a.count() == 3 and b.count() == 4 and len(made) == 2
        paths = [p.removeprefix("file:") for p in made]
        assert all(os.path.exists(re.sub("^/+", "/", p)) for p in paths)
    assert not any(os.path.exists(re.sub("^/+", "/", p)) for p in paths)
