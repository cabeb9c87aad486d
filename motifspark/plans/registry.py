"""Every query of the engine over the driver's tables, and the same in SQL.

The sequences of all queries are the letters A, C, G and T of whole texts; even ids are the positive set and odd ids the
negative one, languages are model sets, and sites are all windows of ten bases that begin with CAT.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import background as B
from ..operators import compare, em, evaluate, gibbs, info, pieces, ranking, score, simulate
from ..operators import motif as M
from ..shared import materialise
from ..sources import adapter, files
from . import sql

WIDTH, SEED, Q = 10, "CAT", 0.3
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def background(spark: SparkSession, d: str) -> B.Background:
    return B.fit(adapter.read(spark, d), 2)


def models(spark: SparkSession, d: str) -> tuple[M.Motif, B.Background]:
    bg = background(spark, d)
    return M.from_sites(adapter.sites(adapter.read(spark, d), SEED, WIDTH), WIDTH, bg, 2, q=Q), bg


def scored(spark: SparkSession, d: str) -> tuple[list[M.Motif], B.Background]:
    m, bg = models(spark, d)
    return [m], bg


def motif(spark: SparkSession, d: str) -> M.Motif:
    return models(spark, d)[0]


def language_models(spark: SparkSession, d: str) -> dict[str, B.Background]:
    return B.fit_by(adapter.read(spark, d, ["lang"]), "lang", 2)


def strands(spark: SparkSession, d: str) -> DataFrame:
    return score.scored_strands(adapter.read(spark, d))


def best(spark: SparkSession, d: str) -> DataFrame:
    return score.best_scores(strands(spark, d), *scored(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """The best score of every sequence and its side; written once, as curves and p-values read it several times."""
    split = best(spark, d).select(F.col("seq_id").alias("id"), F.round("score", 9).alias("score"), (1 - F.pmod("seq_id", F.lit(2))).cast("int").alias("is_pos"))
    return materialise(split, "best_scores")


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.zoops_curve(_split(spark, d))


# --- sequences and k-mers ---


@query(sql.kmer_count_k3)
def kmer_count_k3(spark, d):
    return B.kmer_table(adapter.read(spark, d), 2)


@query(sql.kmer_count_k3)
def kmer_count_join(spark, d):
    """The same by built-in operators only."""
    return S.kmer_counts(adapter.read(spark, d), 2)


@query(sql.base_freq)
def base_freq(spark, d):
    return S.base_frequencies(adapter.read(spark, d)).select("base", "n", _r("freq", 9))


@query(sql.base_codes)
def base_codes(spark, d):
    """Codes, letters and complements of all alphabets' bases as they occur in the texts' first and last letters."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    ext = S.ALPHABETS["EXTENDED"]
    code = S.base_code(F.col("c"), ext)
    return docs.where("c <> ''").groupBy(code.cast("int").alias("code")).agg(F.sum("n").alias("n")).select("code", S.base_letter(F.col("code"), ext).alias("letter"), S.complement(S.base_letter(F.col("code"), ext), ext).alias("complement"), "n")


@query(sql.length_stats)
def length_stats(spark, d):
    n = F.length("seq").cast("long")
    return adapter.read(spark, d).agg(F.count("*").alias("sequences"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("bases"))


@query(sql.revcomp)
def revcomp(spark, d):
    return adapter.read(spark, d).select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(sql.double_strand)
def double_strand(spark, d):
    return S.strands(adapter.read(spark, d)).select("seq_id", "strand", "seq", F.col("L").cast("long").alias("L"))


@query(sql.doubled)
def doubled(spark, d):
    return adapter.read(spark, d).select("seq_id", S.doubled(F.col("seq")).alias("dseq"))


@query(sql.kmer_index)
def kmer_index(spark, d):
    c = S.kmer_counts(adapter.read(spark, d), 2)
    y = c.withColumn("y", S.kmer_index(F.col("kmer")))
    return y.select("k", "kmer", "y", S.prefix_index(F.col("y"), 1).alias("prefix"), S.suffix_index(F.col("y"), 1).alias("suffix"), "n")


@query(sql.kmer_rollup)
def kmer_rollup(spark, d):
    """Counts of the longest k-mers, and lower orders added up from them."""
    top = S.kmer_counts(adapter.read(spark, d), 2).where("k = 2")
    return top.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "kmer", "n").select("k", F.expr("right(kmer, k + 1)").alias("kmer"), "n").groupBy("k", "kmer").agg(F.sum("n").alias("n"))


@query(sql.seq_kmer_counts)
def seq_kmer_counts(spark, d):
    return S.kmer_counts(adapter.read(spark, d), 1, ["seq_id"])


@query(sql.short_filter)
def short_filter(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return adapter.sequences(docs, min_length=0).select("seq_id", S.is_short(F.col("seq"), 60).alias("short_double"), S.is_short(F.col("seq"), 60, True).alias("short_single"))


@query(sql.basename)
def basename(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.basename(F.col("url")).alias("name"))


@query(sql.cv_folds)
def cv_folds(spark, d):
    return evaluate.numbered_folds(adapter.read(spark, d).select("seq_id"), 4).select("seq_id", F.col("idx").cast("long").alias("idx"), "fold")


# --- background models ---


@query(sql.bg_order2)
def bg_order2(spark, d):
    return background(spark, d).to_df(spark).select("k", "kmer", "y", "n", _r("v", 9))


@query(sql.bg_joint)
def bg_joint(spark, d):
    return background(spark, d).to_df(spark).select("k", "kmer", _r("p", 9))


@query(sql.bg_noninterp)
def bg_noninterp(spark, d):
    return B.fit(adapter.read(spark, d), 2, interpolate=False).to_df(spark).select("k", "kmer", _r("v", 9))


@query(sql.cdf_table)
def cdf_table(spark, d):
    return background(spark, d).cumulative(spark).select("k", "kmer", _r("upto", 9))


def _llh(spark, d):
    return B.log_likelihoods(adapter.read(spark, d, ["lang"]), language_models(spark, d), ["lang"])


@query(sql.bg_loglik)
def bg_loglik(spark, d):
    return _llh(spark, d).select("lang", "model", _r("llh", 4))


@query(sql.bg_posterior)
def bg_posterior(spark, d):
    return B.posteriors(_llh(spark, d), "lang").select("lang", "model", _r("posterior"))


@query(sql.bg_top2)
def bg_top2(spark, d):
    return B.best_two(B.posteriors(_llh(spark, d), "lang"), "lang").select("lang", "rank", "model", _r("posterior"))


@query(sql.seq_model)
def seq_model(spark, d):
    """The likeliest language model of every sequence."""
    llh = B.log_likelihoods(adapter.read(spark, d), language_models(spark, d), ["seq_id"])
    top = llh.groupBy("seq_id").agg(F.max_by(F.struct("model", "llh"), F.struct(F.round("llh", 9), "model")).alias("b"))
    return top.select("seq_id", F.col("b.model").alias("model"), F.round("b.llh", 4).alias("llh"))


@query(sql.bg_pos_lik)
def bg_pos_lik(spark, d):
    return B.positional_likelihoods(adapter.read(spark, d), background(spark, d)).select("seq_id", F.col("i").cast("int").alias("i"), _r("lik"))


# --- motif models ---


@query(sql.sites)
def sites(spark, d):
    return adapter.sites(adapter.read(spark, d), SEED, WIDTH).groupBy("site").agg(F.count("*").alias("n"))


@query(sql.site_counts)
def site_counts(spark, d):
    return M.site_counts(adapter.sites(adapter.read(spark, d), SEED, WIDTH), 2, WIDTH).select("k", "j", "kmer", "n")


@query(sql.motif_v)
def motif_v(spark, d):
    return motif(spark, d).to_df(spark).select("k", "j", "kmer", _r("v", 9))


@query(sql.motif_p)
def motif_p(spark, d):
    return motif(spark, d).to_df(spark).select("k", "j", "kmer", _r("p", 9))


@query(sql.logodds_table)
def logodds_table(spark, d):
    return M.score_table_df(spark, *models(spark, d)).select("kmer", "j", _r("s"))


@query(sql.info_content)
def info_content(spark, d):
    return info.information(motif(spark, d).to_df(spark)).select("j", _r("bits"))


@query(sql.kmer_contrib)
def kmer_contrib(spark, d):
    return info.contributions(motif(spark, d).to_df(spark)).select("k", "j", "kmer", _r("bits", 9))


@query(sql.contrib_totals)
def contrib_totals(spark, d):
    return info.contribution_totals(info.contributions(motif(spark, d).to_df(spark))).select("k", "j", _r("bits"), _r("plus"), (F.round("minus", 6) + 0.0).alias("minus"))


@query(sql.bg_contrib)
def bg_contrib(spark, d):
    return info.background_contributions(background(spark, d).to_df(spark)).select("k", "kmer", _r("bits", 9))


@query(sql.logo_layout)
def logo_layout(spark, d):
    out = info.logo_layout(info.contributions(motif(spark, d).to_df(spark)))
    return out.select("k", "j", "sign", F.round(F.col("base") + F.col("height"), 6).alias("top")).groupBy("k", "j", "sign").agg(F.max("top").alias("top"), F.count("*").alias("letters"))


@query(sql.iupac)
def iupac(spark, d):
    return info.iupac(motif(spark, d).to_df(spark)).select("j", "letter")


@query(sql.pwm_entropy)
def pwm_entropy(spark, d):
    return info.entropies(motif(spark, d).to_df(spark)).select("j", _r("h_model"), _r("h_model_bg"))


@query(sql.pwm_revcomp)
def pwm_revcomp(spark, d):
    return M.reverse_complement(*models(spark, d)).to_df(spark).select("j", "kmer", _r("v", 9))


# --- scoring and p-values ---


@query(sql.window_scores)
def window_scores(spark, d):
    """Over all windows of each sequence: how many, the mean and the extreme scores."""
    s = score.all_scores(strands(spark, d), *scored(spark, d))
    return s.groupBy("seq_id").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))


@query(sql.window_scores)
def window_scores_join(spark, d):
    """The same by built-in operators only: positions joined with the broadcast score table."""
    s = score.join_scores(strands(spark, d), *models(spark, d))
    return s.groupBy("seq_id").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))


@query(sql.zoops_best)
def zoops_best(spark, d):
    return best(spark, d).select("seq_id", _r("score"), "windows")


@query(sql.motif_cross)
def motif_cross(spark, d):
    """Two motifs on all sequences at once: the motif and its order-0 part."""
    m, bg = models(spark, d)
    zero = M.Motif(m.v[:1], m.p[:1], m.n[:1], m.alpha[:1], m.q)
    return score.best_scores(strands(spark, d), [m, zero], bg).groupBy("motif_id").agg(F.count("*").alias("sequences"), F.sum("windows").alias("windows"), F.round(F.avg("score"), 6).alias("mean_best"))


@query(sql.frequent_windows)
def frequent_windows(spark, d):
    """All windows above a score, with strand, range and pattern, by pattern."""
    st = strands(spark, d)
    s = score.all_scores(st, *scored(spark, d)).where("score > 3")
    at = score.sites_of(s, st, WIDTH)
    return at.groupBy("strand", "pattern").agg(F.count("*").alias("n"), F.min("begin").cast("long").alias("first"), F.max("end").cast("long").alias("last"))


@query(sql.neg_lambda)
def neg_lambda(spark, d):
    t = ranking.tail(_split(spark, d).where("is_pos = 0"))
    return t.select("m", F.col("n_top").cast("long").alias("n_top"), _r("s_top"), _r("rate"))


@query(sql.occurrence_pvalue)
def occurrence_pvalue(spark, d):
    s = _split(spark, d)
    return ranking.p_values(s.where("is_pos = 1"), s.where("is_pos = 0")).select("id", _r("p_value", 9), _r("e_value", 6))


@query(sql.occurrences)
def occurrences(spark, d):
    """Positives with p < 0.05."""
    s = _split(spark, d)
    return ranking.p_values(s.where("is_pos = 1"), s.where("is_pos = 0")).where("p_value < 0.05").select("id", _r("p_value", 9))


@query(sql.midrank_pvalue)
def midrank_pvalue(spark, d):
    s = _split(spark, d)
    return ranking.mid_rank_p(s.where("is_pos = 1"), s.where("is_pos = 0")).select("id", _r("p_value", 9))


@query(sql.pvalue_hist)
def pvalue_hist(spark, d):
    s = _split(spark, d)
    return evaluate.p_value_histogram(ranking.mid_rank_p(s.where("is_pos = 1"), s.where("is_pos = 0")))


# --- evaluation ---


@query(sql.zoops_curve)
def zoops_curve(spark, d):
    return _curve(spark, d).select("id", F.col("rank").cast("long").alias("rank"), "tp", "fp", _r("fdr", 9), _r("recall", 9))


def _mops(spark: SparkSession, d: str) -> DataFrame:
    m, bg = models(spark, d)
    sides = strands(spark, d).withColumn("is_pos", 1 - F.pmod("seq_id", F.lit(2)))
    return evaluate.mops_steps(materialise(score.score_counts(sides, m, bg, 6), "score_counts"))


@query(sql.mops_curve)
def mops_curve(spark, d):
    """Over all windows, ranked by score; one row per 0.5 of score."""
    return _mops(spark, d).groupBy(F.floor(F.col("score") * 2).cast("long").alias("bin")).agg(F.sum("n").alias("n"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))


@query(sql.auprc)
def auprc(spark, d):
    return evaluate.precision_area(_curve(spark, d)).select(_r("auprc"))


@query(sql.pauc)
def pauc(spark, d):
    return evaluate.partial_roc(_curve(spark, d)).select(_r("pauc"))


@query(sql.avrec)
def avrec(spark, d):
    return evaluate.average_recall(_curve(spark, d)).select(_r("avrec"))


@query(sql.ausfc)
def ausfc(spark, d):
    return evaluate.sensitivity_area(_curve(spark, d)).select(_r("ausfc"))


@query(sql.occ_frac)
def occ_frac(spark, d):
    return evaluate.occurrence_fraction(_curve(spark, d), 0.3).select(_r("occ_frac"))


@query(sql.occ_mult)
def occ_mult(spark, d):
    return evaluate.occurrence_multiplicity(_mops(spark, d), adapter.read(spark, d).where("seq_id % 2 = 0").count()).select(_r("occ_mult"))


@query(sql.q_values)
def q_values(spark, d):
    s = _split(spark, d)
    p = ranking.mid_rank_p(s.where("is_pos = 1"), s.where("is_pos = 0")).select(_r("p_value", 9))
    return evaluate.q_values(p, 0.5).select("p", "n", _r("q"), _r("lfdr"))


@query(sql.curve_pvalue)
def curve_pvalue(spark, d):
    return ranking.curve_p_values(_split(spark, d)).select("id", "is_pos", _r("p_value"))


def _folds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Positives and negatives with four folds by rank of id."""
    folded = evaluate.numbered_folds(adapter.read(spark, d), 4).drop("idx")
    positive = F.pmod("seq_id", F.lit(2)) == 0
    return folded.where(positive), folded.where(~positive)


def _fold_models(seqs: DataFrame, bg: B.Background) -> dict:
    """The motif of a fold is counted on the sites of the other folds' positives."""
    found = M.from_sites_by_fold(adapter.sites(seqs, SEED, WIDTH, ["fold"]), WIDTH, bg, 2, q=Q)
    return {(0, f): m for f, m in found.items()}


def _cross_validated(spark: SparkSession, d: str) -> DataFrame:
    bg = background(spark, d)
    pos, neg = _folds(spark, d)
    scores = evaluate.cross_validated(pos, neg, _fold_models(pos, bg), bg, negatives_single=False)
    return scores.select("id", F.round("score", 9).alias("score"), "is_pos")


@query(sql.cv_scores)
def cv_scores(spark, d):
    return _cross_validated(spark, d).select("id", _r("score"), "is_pos")


@query(sql.cv_curve)
def cv_curve(spark, d):
    c = evaluate.zoops_curve(_cross_validated(spark, d))
    return c.select("id", F.col("rank").cast("long").alias("rank"), "tp", "fp", _r("fdr", 9), _r("recall", 9))


@query(sql.cv_em_scores)
def cv_em_scores(spark, d):
    """As cv_scores, each fold's motif refined by one iteration of EM on the other folds' positives."""
    bg = background(spark, d)
    pos, neg = _folds(spark, d)
    models = evaluate.refined(pos, _fold_models(pos, bg), bg, 4, max_iterations=1)
    return evaluate.cross_validated(pos, neg, models, bg, negatives_single=False).select("id", _r("score", 5), "is_pos")


@query(sql.position_hist)
def position_hist(spark, d):
    b = best(spark, d)
    fwd = F.when(F.col("start") < F.col("L"), F.col("start")).otherwise(F.col("start") - F.col("L") - 1)
    return info.position_histogram(b.select(fwd.alias("start"), F.lit(WIDTH).alias("width"), "L", score.strand_of(F.col("start"), F.col("L")).alias("strand")))


@query(sql.position_density)
def position_density(spark, d):
    b = best(spark, d)
    fwd = F.when(F.col("start") < F.col("L"), F.col("start")).otherwise(F.col("start") - F.col("L") - 1)
    made = info.position_density(b.select(fwd.alias("start"), F.lit(WIDTH).alias("width"), "L", score.strand_of(F.col("start"), F.col("L")).alias("strand")))
    return made.select("strand", _r("x"), _r("density", 8))


@query(sql.bed_coords)
def bed_coords(spark, d):
    st = strands(spark, d)
    s = score.sites_of(score.all_scores(st, *scored(spark, d)).where("score > 5"), st, WIDTH)
    head = F.concat(F.lit(">chr"), F.pmod("seq_id", F.lit(7)).cast("string"), F.lit(":"), (F.col("seq_id") * 1000).cast("string"), F.lit("-"), (F.col("seq_id") * 1000 + F.col("L")).cast("string"))
    bed = files.bed_coordinates(s.select(head.alias("seq"), F.col("L").alias("length"), "strand", F.col("begin").alias("start"), "end", F.lit(0.0).alias("p_value")))
    return bed.groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


# --- refinement ---


@query(sql.estep_r)
def estep_r(spark, d):
    return em.responsibilities(strands(spark, d), *models(spark, d), 0.05).groupBy("seq_id").agg(F.count("*").alias("n"), F.round(F.sum("r"), 5).alias("r"))


@query(sql.em_llh)
def em_llh(spark, d):
    _, llh, total, n = em.expected_counts(strands(spark, d), *models(spark, d))
    return spark.createDataFrame([(round(float(llh), 4), round(float(total), 4), n)], "llh double, total double, sequences long")


@query(sql.mstep_counts)
def mstep_counts(spark, d):
    n = em.expected_counts(strands(spark, d), *models(spark, d))[0]
    rows = [(k, j, B.kmer_of(y, k + 1), round(float(n[k][y, j]), 4)) for k in range(3) for y in range(len(n[k])) for j in range(WIDTH) if n[k][y, j] >= 0.05]
    return spark.createDataFrame(rows, "k int, j int, kmer string, n double")


@query(sql.em_step)
def em_step(spark, d):
    """The conditionals after one iteration."""
    fit = em.optimize(strands(spark, d), *models(spark, d), max_iterations=1)
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v"))


@query(sql.em_rounds)
def em_rounds(spark, d):
    """The conditionals after three iterations."""
    fit = em.optimize(strands(spark, d), *models(spark, d), max_iterations=3)
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v", 5))


@query(sql.sampled_start)
def sampled_start(spark, d):
    """The motif counted on sites drawn with a weight matrix, one a sequence or none."""
    m, bg = models(spark, d)
    start = em.sites_from_pwm(strands(spark, d), m.pwm(), bg, 2, Q)
    return start.to_df(spark).select("k", "j", "kmer", _r("v"))


@query(sql.em_masked_cells)
def em_masked_cells(spark, d):
    """How many windows of each sequence the order-0 step chooses."""
    st, (m, bg) = strands(spark, d), models(spark, d)
    return em.chosen_windows(st, em.top_cells(st, m, bg), bg).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


@query(sql.em_masked_step)
def em_masked_step(spark, d):
    """The conditionals after one iteration over the chosen windows."""
    fit = em.masked_optimize(strands(spark, d), *models(spark, d), max_iterations=1)
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v"))


@query()
def em_fit(spark, d):
    """Until convergence, with the operator's defaults."""
    fit = em.optimize(strands(spark, d), *models(spark, d), optimize_q=True)
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v"))


@query()
def em_masked_fit(spark, d):
    """Until convergence, with the operator's defaults."""
    fit = em.masked_optimize(strands(spark, d), *models(spark, d))
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v"))


@query(sql.em_positions)
def em_positions(spark, d):
    return em.positions(strands(spark, d), *models(spark, d)).select("seq_id", "strand", F.col("begin").cast("long").alias("first_base"), F.col("end").cast("long").alias("last_base"), "pattern")


@query()
def gibbs_fit(spark, d):
    return gibbs.collapsed(strands(spark, d), *models(spark, d)).motif.to_df(spark).select("k", "j", "kmer", _r("v"))


# --- long records in pieces ---

PIECE = 20_000


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A record per language: the sequences of its documents, end to end by id."""
    seqs = adapter.read(spark, d, ["lang"]).select("seq_id", F.coalesce("lang", F.lit("")).alias("lang"), "seq")
    return pieces.cut(pieces.laid_out(seqs, "lang", "seq_id"), WIDTH + 2, PIECE)


@query(sql.record_kmers)
def record_kmers(spark, d):
    return pieces.kmer_table(_records(spark, d), 2)


@query(sql.record_best)
def record_best(spark, d):
    b = pieces.best_scores(pieces.strands(_records(spark, d)), *scored(spark, d))
    return b.select("seq_id", "L", "start", _r("score"), "windows")


@query(sql.record_em_step)
def record_em_step(spark, d):
    """The conditionals after one iteration over whole records."""
    fit = pieces.fit(pieces.strands(_records(spark, d)), *models(spark, d), max_iterations=1)
    return fit.motif.to_df(spark).select("k", "j", "kmer", _r("v"))


# --- simulation ---


@query(sql.bg_sample)
def bg_sample(spark, d):
    return simulate.background_copies(adapter.read(spark, d), background(spark, d), 1)


@query(sql.bg_sample_rescaled)
def bg_sample_rescaled(spark, d):
    return simulate.background_copies(adapter.read(spark, d), background(spark, d), 1, rescaled=True)


@query(sql.bg_sample_number)
def bg_sample_number(spark, d):
    return simulate.background_number(spark, background(spark, d), 500, 200)


@query(sql.embed)
def embed(spark, d):
    return simulate.embed(adapter.read(spark, d), motif(spark, d))


@query(sql.bg_sample_shape)
def bg_sample_shape(spark, d):
    """Lengths of the sampled sequences, and letters outside the alphabet."""
    made = simulate.background_copies(adapter.read(spark, d), background(spark, d), 2)
    return made.select("seq_id", "copy", F.length("seq").cast("long").alias("L"), F.length(F.translate("seq", "ACGT", "")).cast("long").alias("others"))


@query(sql.raw_copies)
def raw_copies(spark, d):
    return simulate.raw_copies(adapter.read(spark, d), 2)


@query(sql.mask_seqs)
def mask_seqs(spark, d):
    seqs = adapter.read(spark, d)
    hits = adapter.sites(seqs, SEED, WIDTH).select("seq_id", (F.col("i") - 1).alias("start"))
    return simulate.mask(seqs, hits, WIDTH)


@query(sql.delete_sites)
def delete_sites(spark, d):
    """Sites deleted from sequences with unknown bases (every G is one here), which stay."""
    seqs = adapter.read(spark, d)
    hits = adapter.sites(seqs, SEED, WIDTH).select("seq_id", (F.col("i") - 1).alias("start"))
    return simulate.mask(seqs.select("seq_id", F.translate("seq", "G", "N").alias("seq")), hits, WIDTH, "delete")


# --- comparison ---


def _by_language(spark, d) -> dict[str, np.ndarray]:
    """A motif per language from its own sites."""
    counts = adapter.sites(adapter.read(spark, d, ["lang"]).select("seq_id", "seq"), SEED, WIDTH).join(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("seq_id"), "lang"), "seq_id")
    at = counts.select("lang", F.posexplode(F.split("site", "")).alias("j", "b")).where(f"b <> '' AND j < {WIDTH}")
    out: dict[str, np.ndarray] = {}
    for r in at.groupBy("lang", "j", "b").agg(F.count("*").alias("n")).collect():  # languages x 40
        out.setdefault(str(r["lang"]), np.full((WIDTH, 4), 0.25))[r["j"], "ACGT".index(r["b"])] += r["n"]
    return {k: v / v.sum(axis=1, keepdims=True) for k, v in sorted(out.items())}


@query(sql.pwm_similarity)
def pwm_similarity(spark, d):
    return compare.all_pairs(spark, _by_language(spark, d)).select("a", "b", _r("sim_score"))


@query()
def motif_search(spark, d):
    m = _by_language(spark, d)
    return compare.search(compare.as_table(spark, m), compare.as_table(spark, m))


@query()
def pwm_clusters(spark, d):
    c = compare.clusters(spark, _by_language(spark, d))
    return spark.createDataFrame(list(c.items()), "model_id string, exemplar string")


@query(sql.exemplars)
def exemplars(spark, d):
    """The first document of every source."""
    return compare.exemplars(spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", "lang"), "source", "doc_id")
