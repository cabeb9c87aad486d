import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifspark.operators import background as B
from motifspark.operators import compare, em, gibbs, info, score, simulate
from motifspark.operators import motif as M
from motifspark.sources import files
from motifspark.streaming import scan_stream


@pytest.fixture(scope="module")
def world(spark):
    """200 random sequences, 70 % of them with a planted site."""
    rng = np.random.default_rng(8)
    plan = "TGACTCAT"
    rows = []
    for i in range(200):
        s = "".join(rng.choice(list("ACGT"), 60))
        if rng.random() < 0.7:
            p = int(rng.integers(0, 52))
            site = "".join(c if rng.random() < 0.95 else str(rng.choice(list("ACGT"))) for c in plan)
            s = s[:p] + site + s[p + 8 :]
        rows.append((i, s))
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    return df, rows, B.fit(df, 1, (1.0, 10.0)), plan


def start_motif(bg, plan, sure=0.55):
    pwm = np.full((len(plan), 4), (1 - sure) / 3)
    pwm[np.arange(len(plan)), ["ACGT".index(c) for c in plan]] = sure
    return M.from_pwm(pwm, bg, 0, q=0.5)


def brute_scores(dseq, m, bg, pseudo=M.PSEUDO):
    table, out = M.score_table(m, bg, pseudo), {}
    for s in range(len(dseq) - m.width + 1):
        if "N" in dseq[s : s + m.width]:
            continue
        total = 0.0
        for j in range(m.width):
            i, k = s + j, 0
            while k < m.order and i - k - 1 >= 0 and dseq[i - k - 1] != "N":
                k += 1
            total += table[k][B.index_of(dseq[i - k : i + 1]), j]
        out[s] = total
    return out


def test_three_scorers_agree(spark, world):
    df, rows, bg, plan = world
    sites = spark.createDataFrame([(s[i : i + 8],) for _, s in rows[:80] for i in range(0, 40, 7)], "site string")
    m = M.from_sites(sites, 8, bg, 2)
    few = spark.createDataFrame([*rows[:20], (900, "ACGNACGTACGTA"), (901, "ACG")], "seq_id long, seq string")
    st = score.scored_strands(few)
    fast = {(r["seq_id"], r["start"]): r["score"] for r in score.all_scores(st, [m], bg).collect()}
    join = {(r["seq_id"], r["start"]): r["score"] for r in score.join_scores(st, m, bg).collect()}
    want = {(r["seq_id"], s): x for r in st.collect() for s, x in brute_scores(r["dseq"], m, bg).items()}
    assert fast.keys() == join.keys() == want.keys()
    for k in want:
        assert abs(fast[k] - want[k]) < 1e-9 and abs(join[k] - want[k]) < 1e-9
    best = {r["seq_id"]: r for r in score.best_scores(st, [m], bg).collect()}
    for i in {k[0] for k in want}:
        top = max(x for (j, _), x in want.items() if j == i)
        assert abs(best[i]["score"] - top) < 1e-9
        assert best[i]["start"] == min(s for (j, s), x in fast.items() if j == i and x == best[i]["score"])


def test_site_motif_contexts_sum_to_one(spark, world):
    _, rows, bg, _ = world
    m = M.from_sites(spark.createDataFrame([(s[3:11],) for _, s in rows], "site string"), 8, bg, 2)
    for k in range(3):
        assert np.allclose(m.v[k][:, k:].reshape(-1, 4, 8 - k).sum(axis=1), 1, atol=1e-2 if k else 1e-12)
    assert np.allclose(m.p[0].sum(axis=0), 1)
    with pytest.raises(Exception, match="bases wide"):
        M.site_counts(M.checked_sites(spark.createDataFrame([("ACG",)], "site string"), 8, 1), 1, 8).collect()
    with pytest.raises(ValueError):
        M.checked_sites(None, 2, 2)
    wide = M.extended(m, 2, 1, bg)
    assert wide.width == 11 and np.allclose(wide.v[0][:, 0], 0.25)


def test_expectation_and_counts_against_brute_force(spark, world):
    df, rows, bg, plan = world
    m = start_motif(bg, plan)
    st = score.scored_strands(df)
    r = {(x["seq_id"], x["start"]): x["r"] for x in em.responsibilities(st, m, bg).collect()}
    llh, counts, total = 0.0, np.zeros((4, 8)), 0.0
    for x in st.collect():
        s = {k: math.exp(v) for k, v in brute_scores(x["dseq"], m, bg, 0.0).items()}
        norm = 1 - m.q + m.q / len(s) * sum(s.values())
        llh += math.log(norm)
        for k, v in s.items():
            want = m.q / len(s) * v / norm
            assert abs(r[x["seq_id"], k] - want) < 1e-9
            total += want
            for j in range(8):
                counts["ACGT".index(x["dseq"][k + j]), j] += want
    n, got, sum_r, n_seqs = em.expected_counts(st, m, bg)
    assert abs(got - llh) < 1e-6 and abs(sum_r - total) < 1e-6 and n_seqs == 200
    assert np.allclose(n[0], counts)


def test_planted_motif_is_recovered_whatever_the_partitions(spark, world):
    df, _, bg, plan = world
    fits = [em.optimize(score.scored_strands(df.repartition(k)), start_motif(bg, plan, 0.4), bg, optimize_q=True, max_iterations=15).motif for k in (1, 5)]
    for m in fits:
        assert "".join("ACGT"[i] for i in m.v[0].argmax(axis=0)) == plan
        assert 0.5 < m.q < 0.9
    assert np.allclose(fits[0].v[0], fits[1].v[0], atol=1e-9)
    masked = em.masked_optimize(score.scored_strands(df), start_motif(bg, plan, 0.4), bg, max_iterations=5).motif
    assert "".join("ACGT"[i] for i in masked.v[0].argmax(axis=0)) == plan
    at = em.positions(score.scored_strands(df), fits[0], bg, 0.5)
    assert at.where(F.col("pattern") == plan).count() > 60


@pytest.mark.parametrize("alpha", ["adam", "metropolis", "grid", "fixed"])
def test_gibbs_recovers_the_motif(spark, world, alpha):
    df, _, bg, plan = world
    m = gibbs.optimize(score.scored_strands(df), start_motif(bg, plan, 0.45), bg, iterations=6, seed=3, alpha=alpha)
    assert "".join("ACGT"[i] for i in m.v[0].argmax(axis=0)) == plan
    assert (m.alpha > 0).all()


def test_gradient_of_the_strengths():
    rng = np.random.default_rng(2)
    n = [rng.integers(0, 30, (4, 3)).astype(float), rng.integers(0, 9, (16, 3)).astype(float)]
    low = np.full((16, 3), 0.25)
    for a in (0.5, 3.0, 20.0):
        h = 1e-5
        num = (gibbs.log_posterior_alpha(a * math.exp(h), 1, 1, n, low) - gibbs.log_posterior_alpha(a * math.exp(-h), 1, 1, n, low)) / (2 * h)
        assert abs(num - gibbs.gradient_alpha(a, 1, 1, n, low)) < 1e-3 * max(1, abs(num))


def test_simulation(spark, world):
    df, _, bg, plan = world
    one, many = (sorted(map(tuple, simulate.background_copies(df.repartition(k), bg, 2).collect())) for k in (1, 6))
    assert one == many and len(one) == 400 and all(len(s) == 60 for _, _, s in one)
    big = simulate.background_number(spark, bg, 50, 2000)
    n = big.agg(F.sum(F.length("seq") - F.length(F.replace("seq", F.lit("A"), F.lit("")))).alias("a")).first()["a"]
    p = bg.v[0][0]
    assert abs(n - 100_000 * p) < 5 * math.sqrt(100_000 * p * (1 - p)) + 500
    m = start_motif(bg, plan, 0.97)
    put = simulate.embed(df, m, seed=1).collect()
    share = sum(r["start"] is not None for r in put) / 200
    assert 0.35 < share < 0.65 and all(len(r["seq"]) == 60 for r in put)
    assert sum(plan in r["seq"] for r in put if r["start"]) > 0.6 * share * 200
    sites = spark.createDataFrame([(0, 2), (0, 5), (1, 50)], "seq_id long, start int")
    for mode, check in (("mask", lambda s: s[2:13] == "N" * 11), ("delete", lambda s: s.endswith("N" * 11) and "N" not in s[:49])):
        got = {r["seq_id"]: r["seq"] for r in simulate.mask(df, sites, 8, mode).collect()}
        assert check(got[0]) and len(got[0]) == 60 and len(got) == 200
    masked = spark.createDataFrame([(1, "ACNGTTTTACGTAA")], "seq_id long, seq string")
    site = spark.createDataFrame([(1, 4)], "seq_id long, start int")
    assert simulate.mask(masked, site, 4, "delete").first()["seq"] == "ACNGACGTAANNNN"


def test_comparison(spark):
    rng = np.random.default_rng(0)
    make = lambda w: rng.dirichlet(np.full(4, 0.3), w)
    m = {f"m{i}": make(8) for i in range(5)}
    m["m0_again"] = 0.97 * m["m0"] + 0.03 * 0.25
    m["m1_reverse"] = m["m1"][::-1, ::-1]
    for a in m:
        own = compare.similarity(m[a], m[a])
        assert own[0] >= max(compare.similarity(m[a], m[b])[0] for b in m if b[:2] != a[:2])
        assert own[1:] == (0, "+")
        assert abs(compare.similarity(m["m2"], m[a])[0] - compare.similarity(m["m2"][::-1, ::-1], m[a])[0]) < 1e-9
    assert compare.similarity(m["m1"], m["m1_reverse"])[2] == "-"
    assert compare.offsets(3, 5, 2) == [-3, -2, -1, 0, 1]
    c = compare.clusters(spark, m)
    assert c["m0_again"] == c["m0"] and c["m1_reverse"] == c["m1"]
    got = compare.search(compare.as_table(spark, {"q": m["m0"]}), compare.as_table(spark, m), permutations=20).orderBy("e_value").first()
    assert got["db_id"] == "m0"


def test_files(spark, tmp_path, world):
    bg = world[2]
    m = M.from_sites(spark.createDataFrame([("ACGTAC",), ("ACGTTT",)], "site string"), 6, bg, 1)
    back = files.parse_model(files.model_text(m.v, 9))
    assert all(np.allclose(a, b, atol=1e-8) for a, b in zip(back, m.v))
    assert files.motif_from_model(back, bg).width == 6
    text = files.meme_text({"a": m.pwm(), "b": m.pwm()[:4]})
    parsed = files.parse_meme(text, version_needed=True)
    assert [(x["name"], x["width"]) for x in parsed] == [("a", 6), ("b", 4)] and parsed[0]["background"]["A"] == 0.25
    (tmp_path / "x.meme").write_text(text.replace("w= 6", "w= 6 occur= 0.4"))
    assert files.read_meme(spark, str(tmp_path / "x.meme"))[0]["q"] == 0.4
    with pytest.raises(ValueError):
        files.parse_meme("nothing", version_needed=True)
    motif, joint = files.extract_joint(files.model_text(m.v, 9), files.background_text(bg))
    assert np.allclose(files.parse_model(motif)[1], m.p[1], atol=1e-3) and joint.startswith("# K = 1")
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "one_motif.model").write_text(files.model_text(m.v))
    (tmp_path / "db" / "one.bg").write_text(files.background_text(bg))
    db = files.read_database(spark, f"{tmp_path}/db/*.model", f"{tmp_path}/db/*.bg")
    assert list(db) == ["one_motif"] and db["one_motif"][1].order == 1
    occ = spark.createDataFrame([(">chr2:100-160", 60, "+", 3, 10, "TGACTCAT", 1e-5, 1e-3), (">chr2:100-160", 60, "-", 62, 69, "TGACTCAT", 2e-5, 2e-3)], "seq string, length int, strand string, start int, end int, pattern string, p_value double, e_value double")
    files.write_occurrences(occ, str(tmp_path / "occ"))
    read = files.read_occurrences(spark, str(tmp_path / "occ"))
    assert read.count() == 2
    bed = {r["strand"]: (r["chrom"], r["start"], r["end"]) for r in files.bed_coordinates(read).collect()}
    assert bed["+"] == ("chr2", 102, 110) and bed["-"] == ("chr2", 152, 160)


def test_information(spark, world):
    bg = world[2]
    m = M.from_pwm(np.array([[1, 0, 0, 0], [0.25] * 4, [0, 0.5, 0.5, 0]]), bg).to_df(spark)
    bits = {r["j"]: r["bits"] for r in info.information(m).collect()}
    assert abs(bits[0] - 2) < 1e-4 and abs(bits[1]) < 1e-9 and abs(bits[2] - 1) < 1e-4
    assert "".join(r["letter"] for r in info.iupac(m).orderBy("j").collect()) == "ANS"
    totals = {r["j"]: r["bits"] for r in info.contribution_totals(info.contributions(m)).collect()}
    assert all(abs(totals[j] - bits[j]) < 1e-6 for j in bits)
    d = info.position_density(spark.createDataFrame([(20, 8, 50, "+")], "start int, width int, L int, strand string"), points=1001, reach=100)
    assert abs(d.agg(F.sum("density")).first()[0] * 0.2 - 1) < 1e-2


def test_streaming_scan_equals_the_batch(spark, tmp_path, world):
    df, _, bg, plan = world
    m = start_motif(bg, plan, 0.9)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = scan_stream(stream, [m], bg, 2.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = score.best_scores(score.scored_strands(df), [m], bg).where("score > 2")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_sinks_and_pwm_sites(spark, tmp_path, world):
    df, rows, bg, plan = world
    st = score.scored_strands(df)
    m = em.sites_from_pwm(st, start_motif(bg, plan, 0.8).pwm(), bg, 2, q=0.5)
    assert m.order == 2 and "".join("ACGT"[i] for i in m.v[0].argmax(axis=0)) == plan
    at = score.sites_of(score.best_scores(st, [m], bg), st, 8).select(F.col("seq_id").cast("string").alias("seq"), F.col("L").alias("length"), "strand", F.col("begin").alias("start"), "end", "pattern", "score")
    files.write_best_sites(at, str(tmp_path / "best"))
    files.write_positions(at, str(tmp_path / "pos"))
    assert spark.read.csv(str(tmp_path / "best"), sep="\t", header=True).count() == spark.read.csv(str(tmp_path / "pos"), sep="\t", header=True).count() == 200
    files.write_positional_likelihoods(B.positional_likelihoods(df, bg), str(tmp_path / "lhs"))
    lines = [r["value"].split(" ") for r in spark.read.text(str(tmp_path / "lhs")).collect()]
    assert len(lines) == 200 and {len(x) for x in lines} == {60}
    named = df.select("seq", F.when(F.col("seq_id") % 2 == 0, "a").otherwise("b").alias("name"))
    post = B.posteriors(B.log_likelihoods(named, B.fit_by(named, "name", 1), ["name"]), "name")
    files.write_posteriors(post, "name", str(tmp_path / "posterior"))
    assert spark.read.csv(str(tmp_path / "posterior.matrix"), sep="\t", header=True).columns == ["name", "a", "b"]
    hits = compare.search(compare.as_table(spark, {"q": m.pwm()}), compare.as_table(spark, {"q": m.pwm(), "x": m.pwm()[::-1]}), max_p=1.1)
    files.write_matches(hits, str(tmp_path / "match"))
    assert spark.read.csv(str(tmp_path / "match"), sep="\t", header=True).columns[2] == "p-value"


def test_many_models_at_once(spark):
    """A stack of motifs and folds gives what each gives alone, in the jobs of one."""
    from motifspark.operators import background as B
    from motifspark.operators import em, evaluate, score
    from motifspark.operators import motif as M

    rng = np.random.default_rng(11)
    rows = [(i, "".join(rng.choice(list("ACGT"), 40)), i % 3) for i in range(60)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string, fold int")
    bg = B.fit(seqs, 2)
    motifs = [M.from_pwm(rng.dirichlet(np.ones(4), w), bg, k) for w, k in ((6, 1), (5, 2))]
    counts = {}
    for name, todo in (("one", lambda: em.optimize(score.scored_strands(seqs), motifs[1], bg, max_iterations=3, epsilon=0)), ("many", lambda: evaluate.refined(seqs, motifs, bg, 3, max_iterations=3, epsilon=0))):
        spark.sparkContext.setJobGroup(name, name)
        counts[name] = (todo(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts["many"][1] == counts["one"][1]
    models = counts["many"][0]
    for (i, f), m in models.items():
        alone = em.optimize(score.scored_strands(seqs.where(f"fold <> {f}")), motifs[i], bg, max_iterations=3, epsilon=0).motif
        assert np.allclose(m.v[-1], alone.v[-1])
    got = {(r["motif_id"], r["id"]): r["score"] for r in evaluate.cross_validated(seqs, seqs.where("1 = 0"), models, bg).collect()}
    assert len(got) == 120
    for f in range(3):
        alone = score.best_scores(score.scored_strands(seqs.where(f"fold = {f}")), [models[0, f], models[1, f]], bg).collect()
        assert all(abs(got[r["motif_id"], r["seq_id"]] - r["score"]) < 1e-9 for r in alone)


def test_collapsed_chains_against_a_serial_one(spark):
    """Site marginals as of a chain that takes out one sequence at a time."""
    from motifspark.operators import background as B
    from motifspark.operators import gibbs, score
    from motifspark.operators import motif as M

    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        s = rng.choice(list("ACGT"), 25)
        if i % 3:
            at = int(rng.integers(0, 20))
            s[at : at + 5] = [c if rng.random() < 0.85 else rng.choice(list("ACGT")) for c in "TTACG"]
        rows.append((i, "".join(s)))
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    bg = B.fit(seqs, 0)
    m = M.from_pwm(np.full((5, 4), 0.15) + np.eye(4)[[3, 3, 0, 1, 2]] * 0.4, bg, 0, q=0.5)
    got = gibbs.collapsed(score.scored_strands(seqs, single=True), m, bg, rounds=60, chains=16, share=0.4, alpha="fixed", r_hat=0)
    made = np.zeros((40, 21))
    for r in got.marginals.collect():
        made[r["seq_id"], r["start"]] = r["p"]
    code = np.array([["ACGT".index(c) for c in s] for _, s in rows])
    log_bg, starts = np.log(bg.v[0]), np.arange(21)
    serial, z, n = np.zeros((40, 21)), np.full(40, -1), np.zeros((4, 5))
    for t in range(1500):
        for i in range(40):
            old = code[i, z[i] : z[i] + 5] if z[i] >= 0 else None
            q = ((z >= 0).sum() - (z[i] >= 0) + 1) / 41
            z[i] = gibbs.draw_site(n, old, code[i], starts, m.alpha, q, bg, log_bg, rng.random())
            if old is not None:
                n[old, np.arange(5)] -= 1
            if z[i] >= 0:
                n[code[i, z[i] : z[i] + 5], np.arange(5)] += 1
        if t >= 500:
            serial[z >= 0, z[z >= 0]] += 1 / 1000
    assert np.abs(made - serial).max() < 0.2 and np.abs(made.sum(axis=1) - serial.sum(axis=1)).mean() < 0.05
    assert np.corrcoef(made.ravel(), serial.ravel())[0, 1] > 0.97
    assert gibbs.split_r_hat(rng.normal(size=(4, 100))) < 1.1 < gibbs.split_r_hat(rng.normal(size=(4, 100)) + np.arange(4)[:, None])


def test_sparse_messages_as_dense_ones(spark):
    """The same exemplars as on the whole matrix; with only near pairs, the same groups."""
    from motifspark.operators import compare

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 3)) * 6
    points = np.concatenate([c + rng.normal(size=(6, 3)) for c in centres])
    s = -((points[:, None] - points[None]) ** 2).sum(axis=2)
    dense = compare.affinity_propagation(s)
    rows = [(f"m{i:02}", f"m{j:02}", float(s[i, j])) for i in range(24) for j in range(24)]
    df = spark.createDataFrame(rows, "a string, b string, sim_score double")
    got = {r["model_id"]: r["exemplar"] for r in compare.propagated(df).collect()}
    assert got == {f"m{i:02}": f"m{k:02}" for i, k in enumerate(dense)}
    near = {r["model_id"]: r["exemplar"] for r in compare.propagated(df.where("sim_score > -60")).collect()}
    assert all((near[f"m{i:02}"] == near[f"m{j:02}"]) <= (i // 6 == j // 6) for i in range(24) for j in range(24))


@pytest.mark.parametrize("order, bg_order", [(0, 0), (1, 2), (2, 1), (2, 2), (3, 2)])
def test_stretches_give_the_odds_of_whole_tables(order, bg_order):
    """Products over stretches of places, with the letters before a window apart, are the odds by context; draws are the same."""
    from motifspark.operators import gibbs, score
    from motifspark.operators.background import from_counts, kmer_of
    from motifspark.operators.motif import alphas

    rng, W = np.random.default_rng(8), 7
    bg = from_counts([(k, kmer_of(y, k + 1), int(rng.integers(5, 50))) for k in range(bg_order + 1) for y in range(4 ** (k + 1))], bg_order)
    texts = ["".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (50, 3, 0, 90, 20)]
    off, codes = score.coded(pa.array(texts))
    batch, alpha = score.Batch(codes, off, order, coded=True), np.repeat(alphas(order)[:, None], W, axis=1)
    plain = score.Batch(np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])], order)
    assert (batch.ctx[codes > 0] == plain.ctx[plain.base > 0]).all() and batch.whole(W).sum() == len(plain.windows(W))
    contexts = sum(4 ** (k + 1) for k in range(order + 1))
    n = np.stack([rng.integers(2, 30, (contexts, W)).astype(float) for _ in range(2)])
    rows = [np.stack(x) for x in zip(*[em.roll_up(x, order, 4) for x in n])]
    s = batch.windows(W)
    own, chain = np.full((5, W), -1), np.array([0, 1, 1, 0, 1])
    letters = own.copy()
    for r in (0, 3):
        at = s[batch.rows(s) == r][-1] + np.arange(W)
        own[r], letters[r] = batch.ctx[at], codes[at].astype(int) - 1
    stretches = gibbs.Stretches(order, W, bg)
    tables = stretches.tables(rows, chain, letters, np.stack([alpha, alpha]))
    got = stretches.odds(batch, batch.whole(W), tables, np.arange(5))
    want, log_bg = np.zeros(len(codes)), gibbs._log_background(bg, order)
    for c in (0, 1):
        by_context = gibbs.site_tables(n[c], own, alpha, bg, log_bg)
        mine = s[chain[batch.rows(s)] == c]
        want[mine] = np.exp(sum(by_context[batch.row[mine], batch.ctx[mine + j], j] for j in range(W)))
    assert np.allclose(got, want, rtol=1e-10, atol=0)
    whole = np.add.reduceat(batch.whole(W), off[:-1], dtype=np.intp)
    for u in rng.random((50, 5)):
        at = gibbs.drawn(want, off[1:], whole, np.full(5, 0.6), u)
        assert (at == gibbs.draw_sites(batch, s, want[s], np.arange(5), 0.6, u)).all()


def test_gibbs_rounds_move_blocks_not_sequences(spark, world):
    """A round reads and joins a row a block; ids of any kind, and the same sites whatever the blocks."""
    from motifspark.operators import gibbs, score

    df, _, bg, plan = world
    st = score.scored_strands(df)
    rows = gibbs.blocks(st.coalesce(1), bg.ab).collect()
    assert len(rows) < 5 and sum(len(r["ids"]) for r in rows) == df.count()
    assert all(len(r["codes"]) == sum(r["sizes"]) for r in rows)
    m = start_motif(bg, plan, 0.45)
    fits = [gibbs.collapsed(x, m, bg, rounds=4, r_hat=0) for x in (st, st.repartition(7), st.withColumn("seq_id", F.col("seq_id").cast("string")))]
    sites = [sorted((int(r["seq_id"]), r["start"], r["p"]) for r in f.marginals.collect()) for f in fits]
    assert sites[0] == sites[1] == sites[2] and np.array_equal(fits[0].motif.n[-1], fits[1].motif.n[-1])


def _odd_texts(spark, world):
    """The world's sequences, some of them several times, and short, empty and masked ones."""
    _, rows, _, _ = world
    texts = [*rows, *[(1000 + i, rows[i % 7][1]) for i in range(60)], (2000, "ACGTACG"), (2001, ""), (2002, "NNNNNNNNNNNN"), (2003, "ACGTNACGTTGCAAGTCNACGTAACG")]
    return score.scored_strands(spark.createDataFrame(texts, "seq_id long, seq string").withColumn("fold", F.col("seq_id").cast("int") % 3))


def test_copies_are_read_once_and_count_as_often_as_they_stand(spark, world):
    _, rows, bg, plan = world
    st, m = _odd_texts(spark, world), start_motif(bg, plan)
    texts = em.distinct(st, bg.ab)
    per_fold = {(i % 3, s) for i, s in [(r["seq_id"], r["dseq"]) for r in st.collect()]}
    assert texts.count() == len(per_fold) and texts.agg(F.sum("many")).first()[0] == st.count()
    for options in ({}, {"at_least": 0.05}, {"held_out": [1, 2]}):
        motifs = [m, start_motif(bg, plan, 0.3)][: len(options.get("held_out", [0]))]
        for a, b in zip(em.expected_counts_many(st, motifs, bg, **options), em.expected_counts_many(texts, motifs, bg, **options)):
            assert all(np.allclose(x, y) for x, y in zip(a[0], b[0])) and np.allclose(a[1:], b[1:])
    assert em.top_cells(st, m, bg).cutoff == em.top_cells(texts, m, bg).cutoff


@pytest.mark.parametrize("share", [0.0, 0.01, 0.05, 0.5])
def test_masked_steps_read_only_the_chosen_windows(spark, world, share):
    """The same sums as over all windows with the others left out, and a table that is as large as the chosen ones."""
    _, _, bg, plan = world
    st, m = _odd_texts(spark, world).drop("fold"), start_motif(bg, plan)
    texts = em.distinct(st, bg.ab)
    cells = em.top_cells(texts, m, bg, share)
    kept = em.chosen_grams(texts, cells, bg)
    for at_least in (0.0, 0.02):
        a, b = em.expected_counts(st, m, bg, at_least, cells=cells), em._chosen_counts(kept, m, bg, at_least)
        assert all(np.allclose(x, y) for x, y in zip(a[0], b[0])) and np.allclose(a[1:], b[1:])
    chosen = em.chosen_windows(st, cells, bg).groupBy("seq_id").count()
    different = st.join(chosen, "seq_id").select("dseq", "count").distinct().agg(F.sum("count")).first()[0]
    assert kept.agg(F.sum(F.length("grams"))).first()[0] == 4 * len(cells.grams(m.order, bg.ab).parts) * different
    one, all_windows = em.masked_optimize(st, m, bg, share, max_iterations=3), em.optimize(st, m, bg, max_iterations=3, cells=cells)
    assert np.allclose(one.motif.v[-1], all_windows.motif.v[-1]) and np.allclose(one.log_likelihood, all_windows.log_likelihood)


def test_rounds_have_a_few_tasks_a_core(spark, world):
    """Not as many as shuffles have partitions: a Python task costs time before its first row."""
    df, _, bg, _ = world
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert em.distinct(score.scored_strands(df), bg.ab).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
