import numpy as np
import pytest

from motifspark import cli
from motifspark.sources import files


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(1)
    with open(d / "in.fa", "w") as f:
        for i in range(60):
            s = "".join(rng.choice(list("ACGT"), 50))
            p = int(rng.integers(0, 42))
            f.write(f">chr1:{i * 100}-{i * 100 + 50}\n{s[:p] + 'TGACTCAT' + s[p + 8 :] if i % 4 else s}\n")
    (d / "sites").write_text("TGACTCAT\n" * 30 + "TGAGTCAT\n" * 10)
    return d


def test_programs(spark, inputs, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "MIN_NEGATIVES", 300)
    base = [str(tmp_path), str(inputs / "in.fa"), "--bindingSiteFile", str(inputs / "sites"), "-K", "1", "-k", "1"]
    cli.run(spark, ["train", *base, "--EM", "--scoreSeqset", "--pvalCutoff", "0.01"])
    assert {p.name for p in tmp_path.iterdir()} >= {"result.hbcp", "result.hbp", "result_motif_1.ihbcp", "result_motif_1.ihbp", "result_motif_1.counts", "result_motif_1.occurrence"}
    hits = spark.read.csv(str(tmp_path / "result_motif_1.occurrence"), sep="\t", header=True)
    assert hits.where("pattern = 'TGACTCAT'").count() > 30
    cli.run(spark, ["evaluate", *base, "--basename", "e", "--cvFold", "2", "--savePvalues", "--saveLogOdds", "--saveInitialModel", "--mops"])
    stats = files.read_curve(spark, str(tmp_path / "e_motif_1.zoops.stats"))
    assert {"rank", "tp", "fp", "fdr", "recall", "p_value", "m_fold", "occ_frac"} <= set(stats.columns) and stats.where("p_value BETWEEN 0 AND 1").count() == stats.count() > 300
    mops = files.read_curve(spark, str(tmp_path / "e_motif_1.mops.stats"))
    assert "occ_mult" in mops.columns and mops.count() > 10
    assert {"e_motif_1.zoops.logOdds", "e_motif_1.mops.logOdds", "e_motif_1.mops.pvalues", "e_motif_1_init.ihbcp"} <= {p.name for p in tmp_path.iterdir()}
    scores = dict(x.split("\t") for x in (tmp_path / "e_motif_1.scores.tsv").read_text().splitlines()[1:])
    assert float(scores["auprc"]) > 0.6
    cli.run(spark, ["scan", str(tmp_path), str(inputs / "in.fa"), "--modelFile", str(tmp_path / "result_motif_1.ihbcp"), "--bgModelFile", str(tmp_path / "result.hbcp"), "--basename", "s", "--pvalCutoff", "0.01"])
    assert spark.read.csv(str(tmp_path / "s_motif_1.occurrence"), sep="\t", header=True).count() > 30
    cli.run(spark, ["simulate", *base, "--basename", "m", "--sampleBgset", "--embedSeqset", "--maskSeqset"])
    assert (tmp_path / "m_background").exists() and (tmp_path / "m_motif_1_embedded").exists() and (tmp_path / "m_motif_1_masked").exists()
    cli.run(spark, ["joint", str(tmp_path / "result_motif_1.ihbcp"), str(tmp_path / "result.hbcp"), str(tmp_path / "j")])
    assert (tmp_path / "j" / "motif.joint").exists()
    cli.run(spark, ["topwm", str(tmp_path / "result_motif_1.ihbcp"), str(tmp_path / "a.pwm")])
    rows = [[float(x) for x in line.split()] for line in (tmp_path / "a.pwm").read_text().splitlines()]
    assert len(rows) == 8 and all(abs(sum(r) - 1) < 1e-4 for r in rows)
    cli.run(spark, ["evaluate", *base, "--basename", "g", "--cvFold", "2", "--EM", "--negN", "100", "--genericNeg", "--no-zoops", "--mops"])
    made = {p.name for p in tmp_path.iterdir()}
    assert "g_motif_1.mops.stats" in made and "g_motif_1.zoops.stats" not in made
    cli.run(spark, ["simulate", *base, "--basename", "c", "--copySeqset", "-m", "2"])
    assert files.read_fasta(spark, str(tmp_path / "c_copies")).count() == 120


def test_guards(spark, inputs, tmp_path):
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train", "a", "b", "--unknown"])
    with pytest.raises(ValueError, match="folds"):
        cli.run(spark, ["train", str(tmp_path), str(inputs / "in.fa"), "--bindingSiteFile", str(inputs / "sites"), "--cvFold", "99"])
