"""Records in pieces give what whole records give."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import background as B
from motifspark.operators import em, pieces, score
from motifspark.operators import motif as M
from motifspark.sources import files

HALO = 12


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("ACGTN"), n, p=[0.3, 0.2, 0.2, 0.28, 0.02]))) for i, n in enumerate([1, 9, 10, 100, 101, 2500, 799, 0])]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    bg = B.fit(seqs, 2)
    sites = spark.createDataFrame([("".join(rng.choice(list("ACGT"), 8, p=[0.6, 0.1, 0.2, 0.1])),) for _ in range(80)], "site string")
    return rows, seqs, bg, M.from_sites(sites, 8, bg, 2)


def in_pieces(seqs, piece, halo=HALO):
    return pieces.cut(seqs.select("seq_id", F.lit(0).cast("long").alias("offset"), F.col("seq").alias("letters")), halo, piece)


def counts(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("piece", [13, 100, 5000])
def test_scores_and_counts(data, piece):
    _, seqs, bg, m = data
    cut = in_pieces(seqs, piece)
    own = cut.groupBy("seq_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.max("L").alias("L"))
    assert all(r["n"] == r["L"] for r in own.collect())
    st, whole = pieces.strands(cut), score.scored_strands(seqs)
    a = {(r["seq_id"], r["start"]): r["score"] for r in pieces.all_scores(st, [m], bg).collect()}
    b = {(r["seq_id"], r["start"]): r["score"] for r in score.all_scores(whole, [m], bg).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    x = {r["seq_id"]: (r["start"], round(r["score"], 9), r["windows"], r["L"]) for r in pieces.best_scores(st, [m], bg).collect()}
    y = {r["seq_id"]: (r["start"], round(r["score"], 9), r["windows"], r["L"]) for r in score.best_scores(whole, [m], bg).collect()}
    assert x == y
    assert counts(pieces.kmer_table(cut, 2, by=False)) == counts(B.kmer_table(seqs, 2))


def test_expected_counts(data):
    _, seqs, bg, m = data
    st = pieces.strands(in_pieces(seqs, 37))
    a, b = pieces.expected_counts(st, m, bg), em.expected_counts(score.scored_strands(seqs), m, bg)
    assert all(np.allclose(x, y) for x, y in zip(a[0], b[0])) and np.allclose(a[1:], b[1:])
    f, g = pieces.fit(st, m, bg, max_iterations=3, optimize_q=True), em.optimize(score.scored_strands(seqs), m, bg, max_iterations=3, optimize_q=True)
    assert np.allclose(f.motif.v[-1], g.motif.v[-1]) and abs(f.motif.q - g.motif.q) < 1e-9


def test_single_strand(data):
    _, seqs, bg, m = data
    a = counts(pieces.all_scores(pieces.strands(in_pieces(seqs, 50), single=True), [m], bg).select("seq_id", "start"))
    assert a == counts(score.all_scores(score.scored_strands(seqs, True), [m], bg).select("seq_id", "start"))


@pytest.mark.parametrize("cut_at", [50, 400, 10_000])
def test_files_cut_anywhere(spark, tmp_path, cut_at):
    rng = np.random.default_rng(cut_at)
    text = "ACGT\n"  # before any header
    for i in range(12):
        s = "".join(rng.choice(list("acgtACGTN"), int(rng.integers(0, 300))))
        text += f">r{i}\tmore\n" + "".join(s[k : k + 61] + ("\r\n" if i % 2 else "\n") for k in range(0, len(s), 61)) + "\n" * (i % 3)
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">only\nACGT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut_at))
    try:
        got, headers = pieces.read(spark, str(tmp_path / "*.fa"), 5, 40)
        named = got.join(headers, "seq_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    made = {}
    for r in sorted(named, key=lambda r: r["at"]):
        own = r["text"][r["lo"] : r["hi"]]
        made[r["header"]] = made.get(r["header"], "") + own
        assert r["lo"] == min(5, r["at"] + r["lo"]) and len(r["text"]) - r["hi"] == min(5, r["L"] - r["at"] - r["hi"])
    (tmp_path / "a.fa").write_text(text.removeprefix("ACGT\n"))
    want = {r["header"]: r["seq"] for r in files.read_fasta(spark, str(tmp_path / "*.fa")).collect()}
    assert {">" + k.removeprefix(">"): v for k, v in made.items()} == want


def test_white_space_is_an_error(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAC GT\n")
    with pytest.raises(Exception, match="white space"):
        pieces.read(spark, str(tmp_path / "a.fa"), 5)


def test_empty(spark):
    none = spark.createDataFrame([], "seq_id long, offset long, letters string")
    assert pieces.cut(none, 5).count() == 0
