"""Command line: train, scan, evaluate, simulate, joint.  One subcommand per program; options have the library's defaults."""
from __future__ import annotations

import argparse
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import ALPHABETS, alphabet
from .operators import background as B
from .operators import em, evaluate, gibbs, ranking, score, simulate
from .operators import motif as M
from .shared import materialise, put_text, scratch
from .sources import files

MIN_NEGATIVES = 5000


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("out", help="folder of the results")
    p.add_argument("sequences", help="sequence file(s)")
    p.add_argument("--basename", default="result")
    p.add_argument("--alphabet", default="STANDARD", choices=sorted(ALPHABETS))
    p.add_argument("--ss", action="store_true", help="single strand")
    p.add_argument("--negSeqFile", help="sequences of the background")
    source = p.add_mutually_exclusive_group()
    source.add_argument("--bindingSiteFile")
    source.add_argument("--PWMFile")
    source.add_argument("--modelFile")
    p.add_argument("--maxPWM", type=int)
    p.add_argument("--sampleSites", action=argparse.BooleanOptionalAction, default=True, help="start from sites drawn with the weight matrix")
    p.add_argument("-k", type=int, default=2, help="motif order")
    p.add_argument("-b", type=float, default=7.0)
    p.add_argument("-r", type=float, default=3.0)
    p.add_argument("-K", type=int, default=2, help="background order")
    p.add_argument("-A", type=float, nargs="+", default=list(B.ALPHA))
    p.add_argument("--bgModelFile")
    p.add_argument("--extend", type=int, nargs=2, default=(0, 0))
    p.add_argument("-q", type=float, default=0.3)
    p.add_argument("-m", type=int, default=1, help="background sequences per sequence")
    p.add_argument("--negN", type=int, help="so many background sequences at least")
    p.add_argument("--genericNeg", action="store_true", help="background sequences of one length from the common model, not of each sequence")
    p.add_argument("--seed", type=int, default=42)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="motifspark")
    sub = top.add_subparsers(dest="program", required=True)
    for name in ("train", "scan", "evaluate", "simulate"):
        p = sub.add_parser(name)
        _common(p)
        if name in ("train", "evaluate"):
            p.add_argument("--EM", action="store_true")
            p.add_argument("--CGS", action="store_true")
            p.add_argument("--advanceEM", action="store_true")
            p.add_argument("--optimizeQ", action="store_true")
            p.add_argument("-f", type=float, default=0.05)
            p.add_argument("--alphaOptimizer", default="adam", choices=["adam", "metropolis", "grid", "fixed"])
            p.add_argument("--noQSampling", action="store_true")
        if name in ("train", "scan"):
            p.add_argument("--pvalCutoff", type=float, default=1e-4)
        if name == "train":
            p.add_argument("--scoreSeqset", action="store_true")
            p.add_argument("--savePositions", action="store_true")
            p.add_argument("--FDR", action="store_true")
        if name in ("train", "evaluate"):
            p.add_argument("-n", "--cvFold", type=int, default=4)
        if name == "evaluate":
            p.add_argument("--maxPosN", type=int)
            p.add_argument("--mops", action="store_true")
            p.add_argument("--zoops", action=argparse.BooleanOptionalAction, default=True, help="curves of each sequence's best site")
            p.add_argument("--savePvalues", action="store_true")
            p.add_argument("--saveLogOdds", action="store_true")
        if name in ("train", "evaluate"):
            p.add_argument("--saveInitialModel", action="store_true")
        if name == "simulate":
            p.add_argument("--copySeqset", action="store_true")
            p.add_argument("--sampleBgset", action="store_true")
            p.add_argument("--maskSeqset", action="store_true")
            p.add_argument("--embedSeqset", action="store_true")
            p.add_argument("--at", type=int, default=0)
    j = sub.add_parser("joint")
    for x in ("model", "background", "out"):
        j.add_argument(x)
    for name in ("topwm", "tomodel"):
        c = sub.add_parser(name)
        c.add_argument("model")
        if name == "tomodel":
            c.add_argument("background")
        c.add_argument("out")
    return top


def _background(spark: SparkSession, o, seqs: DataFrame) -> B.Background:
    ab = alphabet(o.alphabet)
    if o.bgModelFile:
        return files.parse_background(files._whole(spark, o.bgModelFile)[0][1], ab)
    base = files.read_fasta(spark, o.negSeqFile) if o.negSeqFile else seqs
    return B.fit(base, o.K, tuple(o.A), ab)


def _motifs(spark: SparkSession, o, bg: B.Background) -> list[M.Motif]:
    alpha = M.alphas(o.k, o.b, o.r)
    if o.bindingSiteFile:
        sites = files.read_sites(spark, o.bindingSiteFile)
        found = [M.from_sites(sites, len(sites.first()["site"]), bg, o.k, alpha, o.q)]
    elif o.PWMFile:
        found = [M.from_pwm(m["pwm"], bg, o.k, q=m["q"] or o.q, name=m["name"]) for m in files.read_meme(spark, o.PWMFile, o.maxPWM)]
    elif o.modelFile:
        found = [files.motif_from_model(files.parse_model(t), bg, o.q, n) for n, t in files._whole(spark, o.modelFile)]
    else:
        return []
    return [M.extended(m, *o.extend, bg) for m in found] if any(o.extend) else found


def _trained(o, m: M.Motif, bg: B.Background, strands: DataFrame) -> M.Motif:
    if o.EM and o.advanceEM:
        return em.masked_optimize(strands, m, bg, o.f, optimize_q=o.optimizeQ).motif
    if o.EM:
        return em.optimize(strands, m, bg, o.optimizeQ).motif
    if o.CGS:
        return gibbs.collapsed(strands, m, bg, seed=o.seed, sample_q=not o.noQSampling, alpha=o.alphaOptimizer).motif
    return m


def _negatives(o, seqs: DataFrame, bg: B.Background, n: int) -> tuple[DataFrame, float]:
    """Background sequences and how many there are for each sequence."""
    least = o.negN or MIN_NEGATIVES
    fold = max(o.m, math.ceil(least / max(n, 1))) if n < least else o.m
    if o.genericNeg:
        length = int(seqs.agg(F.avg("L")).first()[0] or 0)
        made = simulate.background_number(seqs.sparkSession, bg, fold * n, length if o.ss else 2 * length + 1, o.seed)
        return made.select("seq_id", "seq"), fold
    made = simulate.background_copies(seqs, bg, fold, o.seed, doubled=not o.ss)
    return made.select(F.xxhash64("seq_id", "copy").alias("seq_id"), "seq"), fold


def _scan(o, m: M.Motif, bg: B.Background, seqs: DataFrame, negatives: DataFrame, strands: DataFrame, path: str) -> None:
    pos = score.all_scores(strands, [m], bg).select(F.struct("seq_id", "start", "L").alias("id"), "score")
    neg = score.all_scores(score.scored_strands(negatives, True), [m], bg).select(F.struct("seq_id", "start", "L").alias("id"), "score")
    hits = ranking.p_values(pos, neg).where(F.col("p_value") < o.pvalCutoff).select("id.seq_id", "id.start", "id.L", "p_value", "e_value")
    at = score.sites_of(hits, strands, m.width).join(seqs.select(F.col("seq_id").alias("h"), "header"), F.col("seq_id") == F.col("h"))
    files.write_occurrences(at.select(F.col("header").alias("seq"), F.col("L").alias("length"), "strand", F.col("begin").alias("start"), "end", "pattern", "p_value", "e_value"), path)


def _fold_models(o, motifs: list[M.Motif], bg: B.Background, held: DataFrame) -> dict[tuple[int, int], M.Motif]:
    """Every motif trained without each fold; EM runs for all of them at once."""
    start = {(i, f): m for i, m in enumerate(motifs) for f in range(o.cvFold)}
    strands = score.scored_strands(held, o.ss)
    if o.EM:
        cells = [em.top_cells(strands.where(F.col("fold") != f), m, bg, o.f) for (_, f), m in start.items()] if o.advanceEM else None
        return evaluate.refined(held, start, bg, o.cvFold, o.ss, optimize_q=o.optimizeQ, cells=cells)
    return {k: _trained(o, m, bg, strands.where(F.col("fold") != k[1])) for k, m in start.items()} if o.CGS else start


def _evaluate(o, motifs: list[M.Motif], bg: B.Background, seqs: DataFrame, negatives: DataFrame, fold: int, paths: list[str]) -> None:
    """All motifs: models of all folds first, then one scan of each side for all of them."""
    held, against = evaluate.folds(seqs, o.cvFold, o.seed), evaluate.folds(negatives, o.cvFold, o.seed)
    models = _fold_models(o, motifs, bg, held)
    pooled = materialise(evaluate.cross_validated(held, against, models, bg, o.ss), "cv_scores")
    mops = getattr(o, "mops", False)
    every = materialise(evaluate.cross_validated(held, against, models, bg, o.ss, windows=True), "cv_windows") if mops else None
    n = seqs.count()
    for i, path in enumerate(paths):
        mine = [None if df is None else df.where(F.col("motif_id") == i).drop("motif_id") for df in (pooled, every)]
        _write_evaluation(o, *mine, n, fold, path)


def _write_evaluation(o, pooled: DataFrame, every: DataFrame | None, n: int, fold: int, path: str) -> None:
    if getattr(o, "zoops", True):
        _write_best(o, pooled, n, fold, path)
    if every is not None:
        sites = evaluate.mops_curve(every, fold)
        files.write_curve(sites, f"{path}.mops.stats", {"occ_mult": float(sites.agg(F.max("tp")).first()[0] or 0.0) / max(n, 1)})
        if getattr(o, "savePvalues", False):
            ranking.mid_rank_p(every.where("is_pos = 1"), every.where("is_pos = 0")).select("p_value").write.csv(f"{path}.mops.pvalues")
        if getattr(o, "saveLogOdds", False):
            files.write_log_odds(evaluate.log_odds_pairs(every), f"{path}.mops.logOdds")


def _write_best(o, pooled: DataFrame, n: int, fold: int, path: str) -> None:
    spark = pooled.sparkSession
    curve = evaluate.zoops_curve(pooled, fold)
    p = ranking.curve_p_values(pooled).select(F.col("id").alias("i"), F.col("is_pos").alias("l"), "p_value")
    with_p = curve.join(p, (curve["id"] == p["i"]) & (curve["is_pos"] == p["l"])).drop("i", "l")
    extra = {"m_fold": float(fold), "occ_frac": float(evaluate.occurrence_fraction(curve, o.q, fold).first()[0] or 0.0) if n else 0.0}
    files.write_curve(with_p, f"{path}.zoops.stats", extra)
    if getattr(o, "savePvalues", False):
        ranking.mid_rank_p(pooled.where("is_pos = 1"), pooled.where("is_pos = 0")).select("p_value").write.csv(f"{path}.zoops.pvalues")
    if getattr(o, "saveLogOdds", False):
        files.write_log_odds(evaluate.log_odds_pairs(pooled), f"{path}.zoops.logOdds")
    one = [evaluate.precision_area(curve), evaluate.partial_roc(curve), evaluate.average_recall(curve), evaluate.sensitivity_area(curve)]
    values = [(c, float(df.first()[0] or 0.0)) for df in one for c in df.columns]
    put_text(spark, f"{path}.scores.tsv", "metric\tvalue\n" + "".join(f"{k}\t{v:.6f}\n" for k, v in values))


def run(spark: SparkSession, args: list[str]) -> None:
    o = parser().parse_args(args)
    if o.program == "joint":
        motif, back = files.extract_joint(*[files._whole(spark, x)[0][1] for x in (o.model, o.background)])
        put_text(spark, f"{o.out}/motif.joint", motif)
        put_text(spark, f"{o.out}/background.joint", back)
        return
    if o.program in ("topwm", "tomodel"):
        text = files._whole(spark, o.model)[0][1]
        if o.program == "topwm":
            put_text(spark, o.out, "".join(" ".join(f"{x:.6f}" for x in row) + "\n" for row in files.model_to_pwm(files.parse_model(text))))
        else:
            bg = files.parse_background(files._whole(spark, o.background)[0][1])
            put_text(spark, o.out, files.model_text(files.pwm_to_model(files.parse_meme(text)[0]["pwm"], bg).v))
        return
    seqs = files.read_fasta(spark, o.sequences).persist()
    try:
        with scratch(spark):
            _run(spark, o, seqs)
    finally:
        seqs.unpersist()


def _run(spark: SparkSession, o: argparse.Namespace, seqs: DataFrame) -> None:
    out = o.out.rstrip("/")
    bg = _background(spark, o, seqs)
    put_text(spark, f"{out}/{o.basename}.hbcp", files.background_text(bg))
    put_text(spark, f"{out}/{o.basename}.hbp", files.background_text(bg, joint=True))
    motifs = _motifs(spark, o, bg)
    if motifs:
        widest = max(m.width for m in motifs)
        seqs = seqs.where((F.col("L") if o.ss else 2 * F.col("L") + 1) >= widest)
    n = seqs.count()
    if o.program == "simulate":
        if o.copySeqset:
            made = simulate.raw_copies(seqs, o.m).join(seqs.select("seq_id", "header"), "seq_id")
            files.write_fasta(made, f"{out}/{o.basename}_copies")
        if o.sampleBgset:
            made = simulate.background_copies(seqs, bg, o.m, o.seed)
            files.write_fasta(made.withColumn("header", F.concat_ws("_", F.lit("background"), "seq_id", "copy")), f"{out}/{o.basename}_background")
        for i, m in enumerate(motifs, 1):
            if o.embedSeqset:
                made = simulate.embed(seqs, m, o.seed, o.at).join(seqs.select("seq_id", "header"), "seq_id")
                files.write_fasta(made, f"{out}/{o.basename}_motif_{i}_embedded")
            if o.maskSeqset:
                hits = em.responsibilities(score.scored_strands(seqs, True), m, bg, em.SITE_CUTOFF)
                made = simulate.mask(seqs.select("seq_id", "seq"), hits, m.width).join(seqs.select("seq_id", "header"), "seq_id")
                files.write_fasta(made, f"{out}/{o.basename}_motif_{i}_masked")
        return
    if o.program in ("train", "evaluate") and n < o.cvFold:
        raise ValueError("fewer sequences than folds")
    if o.program == "evaluate" and o.maxPosN:
        seqs = seqs.orderBy(F.xxhash64(F.lit(o.seed), "seq_id")).limit(o.maxPosN)
    negatives, fold = _negatives(o, seqs, bg, n)
    strands = score.scored_strands(seqs, o.ss)
    if o.PWMFile and o.sampleSites:
        motifs = [em.sites_from_pwm(strands, files.model_to_pwm(m.v), bg, o.k, m.q, o.seed, m.name) for m in motifs]
    for i, m in enumerate(motifs, 1):
        path = f"{out}/{o.basename}_motif_{i}"
        if getattr(o, "saveInitialModel", False):
            put_text(spark, f"{path}_init.ihbcp", files.model_text(m.v))
        if o.program == "train":
            trained = _trained(o, m, bg, strands)
            put_text(spark, f"{path}.ihbcp", files.model_text(trained.v))
            put_text(spark, f"{path}.ihbp", files.model_text(trained.p))
            put_text(spark, f"{path}.counts", files.counts_text(trained.n))
            if o.CGS:
                put_text(spark, f"{path}.alphas", files.alphas_text(trained.alpha))
            if o.savePositions:
                at = em.positions(strands, trained, bg).join(seqs.select(F.col("seq_id").alias("h"), "header"), F.col("seq_id") == F.col("h"))
                files.write_positions(at.select(F.col("header").alias("seq"), F.col("L").alias("length"), "strand", F.col("begin").alias("start"), "end", "pattern"), f"{path}.positions")
            if o.scoreSeqset:
                _scan(o, trained, bg, seqs, negatives, strands, f"{path}.occurrence")
        elif o.program == "scan":
            _scan(o, m, bg, seqs, negatives, strands, f"{path}.occurrence")
    if motifs and (o.program == "evaluate" or getattr(o, "FDR", False)):
        _evaluate(o, motifs, bg, seqs, negatives, fold, [f"{out}/{o.basename}_motif_{i}" for i in range(1, len(motifs) + 1)])


def main() -> None:
    import sys

    from .ship import ship

    spark = SparkSession.builder.appName("motifspark").getOrCreate()
    ship(spark)
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
