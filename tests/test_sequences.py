import pytest
from pyspark.sql import functions as F

from motifspark.functions import sequence as S
from motifspark.operators import background as B
from motifspark.sources import adapter, files


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def brute_counts(texts, order):
    out = {}
    for s in texts:
        for k in range(order + 1):
            for i in range(k, len(s)):
                w = s[i - k : i + 1]
                if set(w) <= set("ACGT"):
                    out[k, w] = out.get((k, w), 0) + 1
    return out


def test_kmer_counts_against_brute_force(spark):
    texts = ["ACGT", "ACNGTT", "A", "", "NNN", "GATTACA" * 30]
    got = {(r["k"], r["kmer"]): r["n"] for r in S.kmer_counts(seqs(spark, *texts), 2).collect()}
    assert got == brute_counts(texts, 2)


def test_complements_and_codes(spark):
    df = seqs(spark, "ACGT", "AACN")
    r = df.select(S.reverse_complement(F.col("seq")).alias("rc"), S.doubled(F.col("seq")).alias("d"), S.kmer_index(F.col("seq")).alias("y")).collect()
    assert [x["rc"] for x in r] == ["ACGT", "NGTT"] and r[1]["d"] == "AACNNNGTT" and r[0]["y"] == 27 and r[1]["y"] is None
    twice = df.select(S.reverse_complement(S.reverse_complement(F.col("seq"))).alias("s")).collect()
    assert [x["s"] for x in twice] == ["ACGT", "AACN"]
    m = S.alphabet("METHYLC")
    assert seqs(spark, "ACGTM").select(S.reverse_complement(F.col("seq"), m).alias("s")).first()["s"] == "GACGT"
    c = spark.createDataFrame([("a",), ("T",), ("N",)], "c string").select(S.base_code(F.col("c")).alias("k"), S.base_letter(S.base_code(F.col("c"))).alias("b")).collect()
    assert [(x["k"], x["b"]) for x in c] == [(1, "A"), (4, "T"), (0, "N")]
    with pytest.raises(ValueError):
        S.alphabet("RNA")


def test_strings(spark):
    df = spark.createDataFrame([("/a/b.c/x.y.fa", "motif_1", "motif_22"), ("plain", "abc", "xyz")], "p string, a string, b string")
    r = df.select(S.basename(F.col("p")).alias("n"), S.overlap_rest(F.col("a"), F.col("b")).alias("o")).collect()
    assert [x["n"] for x in r] == ["x.y", "plain"]
    assert [x["o"] for x in r] == ["22", "xyz"]


def test_frequencies_and_filter(spark):
    f = {r["base"]: (r["n"], r["freq"]) for r in S.base_frequencies(seqs(spark, "AACN", "T")).collect()}
    assert f["A"] == (2, 0.5) and f["G"] == (0, 0.0)
    got = seqs(spark, "ACGT", "ACGTAC").select(S.is_short(F.col("seq"), 12).alias("d"), S.is_short(F.col("seq"), 6, True).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in got] == [(True, True), (False, False)]


def test_background_model(spark):
    texts = ["ACGTACGTTTGA", "CCATG", "GNA"]
    bg = B.fit(seqs(spark, *texts), 2)
    n = brute_counts(texts, 2)
    total = sum(v for (k, _), v in n.items() if k == 0)
    v0 = {b: (n.get((0, b), 0) + 0.25) / (total + 1) for b in "ACGT"}
    assert abs(bg.v[0].sum() - 1) < 1e-12
    for y in range(16):
        w = B.kmer_of(y, 2)
        assert B.index_of(w) == y
        want = (n.get((1, w), 0) + 10 * v0[w[1]]) / (n.get((0, w[0]), 0) + 10)
        assert abs(bg.v[1][y] - want) < 1e-12
    assert abs(bg.joint()[2][B.index_of("ACG")] - bg.v[2][B.index_of("ACG")] * bg.joint()[1][B.index_of("AC")]) < 1e-15
    lik = B.positional_likelihoods(seqs(spark, "ACG"), bg).orderBy("i").collect()
    assert [round(r["lik"], 12) for r in lik] == [round(float(x), 12) for x in (bg.v[0][0], bg.v[1][1], bg.v[2][6])]
    text = files.background_text(bg)
    again = files.parse_background(text)
    assert again.order == 2 and abs(again.v[2] - bg.v[2]).max() < 1e-6
    with pytest.raises(ValueError):
        files.parse_background("# K = 2\n# A = 1\n0 0 0 0\n")


def test_classification(spark):
    a, b = ["AAAATAAAATAAAA"] * 5, ["GCGCGCCGCGGC"] * 5
    df = spark.createDataFrame([("x", s) for s in a] + [("y", s) for s in b], "name string, seq string")
    models = B.fit_by(df, "name", 1)
    post = B.posteriors(B.log_likelihoods(df, models, ["name"]), "name")
    top = {r["name"]: r["model"] for r in B.best_two(post, "name").where("rank = 1").collect()}
    assert top == {"x": "x", "y": "y"}


def test_fasta(spark, tmp_path):
    p = tmp_path / "in.fa"
    p.write_text(">chr1\tx\r\nacgt\r\nAC\r\n\r\n>\nGG\n>empty\n>chr1\nTTNA\n")
    rows = files.read_fasta(spark, str(p)).collect()
    assert sorted((r["header"], r["seq"], r["L"], r["file"]) for r in rows) == [(">", "GG", 2, "in"), (">chr1", "ACGTAC", 6, "in"), (">chr1", "TTNA", 4, "in")]
    assert len({r["seq_id"] for r in rows}) == 3
    out = str(tmp_path / "out")
    files.write_fasta(files.read_fasta(spark, str(p)), out)
    assert sorted((r["header"], r["seq"]) for r in files.read_fasta(spark, out).collect()) == sorted((r["header"], r["seq"]) for r in rows)
    bad = tmp_path / "bad.fa"
    bad.write_text(">a\nAC GT\n")
    with pytest.raises(Exception, match="white space"):
        files.read_fasta(spark, str(bad)).collect()


def test_adapter(spark):
    docs = spark.createDataFrame([(1, "Cat, tag a gattaca"), (2, None), (3, "xyz")], "doc_id long, text string")
    assert [(r["seq_id"], r["seq"]) for r in adapter.sequences(docs, min_length=1).collect()] == [(1, "CATTAGAGATTACA")]
    got = adapter.sites(adapter.sequences(docs, min_length=1), "TA", 4).collect()
    assert sorted((r["i"], r["site"]) for r in got) == [(4, "TAGA"), (11, "TACA")]


def test_fasta_ids_do_not_depend_on_splits(spark, tmp_path):
    p = tmp_path / "many.fa"
    p.write_text("".join(f">s{i % 90}\nACGT{'ACGT'[i % 4] * (i % 90)}\n" for i in range(300)))
    found = []
    for size in ("128m", "400b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(sorted((r["seq_id"], r["header"], r["seq"]) for r in files.read_fasta(spark, str(p)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == 300
