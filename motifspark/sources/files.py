"""Sequence and model files.  Sequence files are Spark scans; model files are small and are parsed whole."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import STANDARD, Alphabet, basename
from ..operators.background import Background
from ..operators.motif import Motif, alphas, from_pwm, joints


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, header, seq, L, file): one row per record; headers end at a tab or carriage return, blank lines and
    records without sequence are left out.  seq_id is a hash of the file's name, the record and, for records that are the same, their
    running number, so it does not depend on splits or partitions.  A record is a row; ``operators.pieces`` reads long ones in pieces."""
    raw = spark.read.option("lineSep", ">").text(path).select("value", F.col("_metadata.file_path").alias("f")).where(F.trim("value") != "")
    same = Window.partitionBy("h", "h2").orderBy("f")  # the records with equal hashes
    raw = raw.select("value", "f", F.xxhash64("f", "value").alias("h"), F.xxhash64(F.lit(1), "f", "value").alias("h2"))
    # only records that occur again are numbered, so that the others stay where they are read
    again = raw.groupBy("h", "h2").count().where("count > 1").select("h", "h2")
    once = raw.join(again, ["h", "h2"], "left_anti").withColumn("k", F.lit(1))
    raw = once.unionByName(raw.join(again, ["h", "h2"], "left_semi").withColumn("k", F.row_number().over(same)))
    rec = raw.select(F.xxhash64("h", "h2", "k").alias("seq_id"), "f", F.split("value", "\n", 2).alias("p"))
    seq = F.upper(F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), "[\r\n]", ""))
    out = rec.select("seq_id", F.concat(F.lit(">"), F.regexp_extract(F.get("p", F.lit(0)), "^([^\t\r]*)", 1)).alias("header"), seq.alias("seq"), basename(F.col("f")).alias("file"))
    bad = F.col("seq").rlike("[ \t]")
    checked = out.where(F.length("seq") > 0).withColumn("seq", F.when(bad, F.raise_error(F.lit("white space inside a sequence")).cast("string")).otherwise(F.col("seq")))
    return checked.select("seq_id", "header", "seq", F.length("seq").alias("L"), "file")


def write_fasta(seqs: DataFrame, path: str, header: str = "header") -> None:
    seqs.select(F.concat_ws("\n", F.when(F.col(header).startswith(">"), F.col(header)).otherwise(F.concat(F.lit(">"), F.col(header).cast("string"))), "seq").alias("value")).write.text(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site): one site per line."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("site")).where("site <> ''")


def _whole(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, text) of small files."""
    rows = spark.read.text(path, wholetext=True).select("value", basename(F.col("_metadata.file_path")).alias("name")).collect()
    return [(r["name"], r["value"]) for r in rows]


def parse_meme(text: str, version_needed: bool = False) -> list[dict]:
    """Motifs of a version-4 file: name, width, q (``occur=``, if given), pwm, and the file's background."""
    lines = text.splitlines()
    if version_needed and not (lines and lines[0].startswith("MEME version 4")):
        raise ValueError("the first line must say MEME version 4")
    out, name, bg = [], "", None
    i = 0
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith("MOTIF"):
            name = s.split(maxsplit=1)[1].split()[0] if len(s.split()) > 1 else ""
        elif s.startswith("Background letter frequencies"):
            f = lines[i + 1].split()
            bg = {f[k]: float(f[k + 1]) for k in range(0, len(f) - 1, 2)}
            i += 1
        elif s.startswith("letter-probability matrix"):
            w = int(re.search(r"w=\s*(\d+)", s)[1])
            occur = re.search(r"occur=\s*([\d.eE+-]+)", s)
            pwm = np.array([[float(x) for x in lines[i + 1 + j].split()] for j in range(w)])
            out.append({"name": name or f"motif_{len(out) + 1}", "width": w, "q": float(occur[1]) if occur else None, "pwm": pwm, "background": bg})
            i += w
        i += 1
    return out


def read_meme(spark: SparkSession, path: str, most: int | None = None) -> list[dict]:
    return [m for _, text in _whole(spark, path) for m in parse_meme(text)][:most]


def meme_text(motifs: dict[str, np.ndarray], bases: str = "ACGT", bg: dict[str, float] | None = None) -> str:
    bg = bg or {b: 1 / len(bases) for b in bases}
    out = ["MEME version 4", "", f"ALPHABET= {bases}", "", "Background letter frequencies", " ".join(f"{b} {f:.4f}" for b, f in bg.items()), ""]
    for name, pwm in motifs.items():
        out += [f"MOTIF {name}", f"letter-probability matrix: alength= {len(bases)} w= {len(pwm)}"]
        out += [" ".join(f"{x:.4f}" for x in row) for row in pwm] + [""]
    return "\n".join(out) + "\n"


def parse_model(text: str) -> list[np.ndarray]:
    """Blocks (one per position) of lines (one per order) to arrays [k][y, j]."""
    blocks = [[[float(x) for x in line.split()] for line in b.splitlines() if line.strip()] for b in re.split(r"\n\s*\n", text.strip())]
    order = len(blocks[0]) - 1
    if order > 8:
        raise ValueError("model order above 8")
    if any([len(line) for line in b] != [len(line) for line in blocks[0]] for b in blocks):
        raise ValueError("blocks differ")
    return [np.array([b[k] for b in blocks]).T for k in range(order + 1)]


def model_text(x: list[np.ndarray], digits: int = 3) -> str:
    return "".join("\n".join(" ".join(f"{v:.{digits}e}" for v in x[k][:, j]) for k in range(len(x))) + "\n\n" for j in range(x[0].shape[1]))


def motif_from_model(v: list[np.ndarray], bg: Background, q: float = 0.3, name: str = "motif") -> Motif:
    p = joints(v, bg)
    return Motif(v, p, [x * 100 for x in p], np.repeat(alphas(len(v) - 1)[:, None], v[0].shape[1], axis=1), q, name, bg.ab)


def parse_background(text: str, ab: Alphabet = STANDARD) -> Background:
    lines = [x for x in text.splitlines() if x.strip()]
    k = re.match(r"#\s*K\s*=\s*(\d+)", lines[0])
    a = re.match(r"#\s*A\s*=\s*(.+)", lines[1])
    if not k or not a or len(lines) != 3 + int(k[1]):
        raise ValueError("bad background file")
    v = [np.array([float(x) for x in line.split()]) for line in lines[2:]]
    if any(len(x) != ab.size ** (i + 1) for i, x in enumerate(v)):
        raise ValueError("bad background file: a line has another number of values")
    return Background(v, [x * 0 for x in v], tuple(float(x) for x in a[1].split()), ab)


def background_text(bg: Background, joint: bool = False) -> str:
    rows = bg.joint() if joint else bg.v
    return f"# K = {bg.order}\n# A = {' '.join(f'{x:g}' for x in bg.alpha[: bg.order + 1])}\n" + "".join(" ".join(f"{v:.6e}" for v in x) + "\n" for x in rows)


def background_from_meme(text: str, ab: Alphabet = STANDARD, order: int = 0, alpha: float = 1.0) -> Background:
    """Order 0 from the header of a MEME file, copied upwards."""
    found = next((m["background"] for m in parse_meme(text) if m["background"]), None)
    v = [np.array([found[b] for b in ab.bases]) if found else np.full(ab.size, 1 / ab.size)]
    for k in range(1, order + 1):
        v.append(v[0][np.arange(ab.size ** (k + 1)) % ab.size])
    return Background(v, [x * 0 for x in v], (alpha,) * (order + 1), ab)


def read_database(spark: SparkSession, models: str, backgrounds: str | None = None) -> dict[str, tuple[list[np.ndarray], Background | None]]:
    """Model files of a glob, each with the background file of the same name, if there is one."""
    bgs = {n: parse_background(t) for n, t in _whole(spark, backgrounds)} if backgrounds else {}

    def of(name: str) -> Background | None:
        """The background of that very name, or of the longest name that the model's goes on from with a mark."""
        fits = [k for k in bgs if name == k or name.startswith(k) and not name[len(k)].isalnum()]
        return bgs[max(fits, key=len)] if fits else None

    return {n: (parse_model(t), of(n)) for n, t in _whole(spark, models)}


def model_to_pwm(v: list[np.ndarray]) -> np.ndarray:
    p = v[0].T
    return p / p.sum(axis=1, keepdims=True)


def pwm_to_model(pwm: np.ndarray, bg: Background) -> Motif:
    return from_pwm(pwm + 1e-16, bg, 0)


def extract_joint(model: str, background: str) -> tuple[str, str]:
    """Texts of conditional files to texts of joint files: (motif, background)."""
    bg = parse_background(background)
    return model_text(joints(parse_model(model), bg)), background_text(bg, joint=True)


def counts_text(n: list[np.ndarray]) -> str:
    return "".join("\n".join(" ".join(str(int(v)) for v in n[k][:, j]) for k in range(len(n))) + "\n\n" for j in range(n[0].shape[1]))


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """(seq, length, strand, start, end, pattern, p_value, e_value)."""
    raw = spark.read.csv(path, sep="\t", header=True)
    c = raw.columns
    at = F.split(F.col(f"`{c[3]}`"), "\\.\\.")
    return raw.select(F.col(c[0]).alias("seq"), F.col(c[1]).cast("int").alias("length"), F.col(c[2]).alias("strand"), at[0].cast("int").alias("start"), at[1].cast("int").alias("end"), F.col(c[4]).alias("pattern"), F.col(f"`{c[5]}`").cast("double").alias("p_value"), F.col(f"`{c[6]}`").cast("double").alias("e_value"))


def write_occurrences(rows: DataFrame, path: str) -> None:
    at = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    rows.select("seq", "length", "strand", at.alias("start..end"), "pattern", F.format_string("%.2e", "p_value").alias("p-value"), F.format_string("%.2e", "e_value").alias("e-value")).write.csv(path, sep="\t", header=True)


def write_curve(curve: DataFrame, path: str, extra: dict[str, float]) -> None:
    """Ordered by rank; the scalars are named columns of every row."""
    out = curve.select("rank", *[F.col(c) for c in ("tp", "fp", "fdr", "recall", "p_value") if c in curve.columns], *[F.lit(v).alias(k) for k, v in extra.items()])
    out.repartitionByRange("rank").sortWithinPartitions("rank").write.csv(path, sep="\t", header=True)


def bed_coordinates(occurrences: DataFrame) -> DataFrame:
    """(chrom, start, end, strand, p_value), half-open, from headers >chrom:low-high and ranges in doubled coordinates."""
    chrom, low = F.regexp_extract("seq", "^>?([^:]+):", 1), F.regexp_extract("seq", ":([0-9]+)-", 1).cast("long")
    forward = F.when(F.col("strand") == "+", F.col("start")).otherwise(2 * F.col("length") - (F.col("end") - 1) + 1)
    wide = F.col("end") - F.col("start") + 1
    return occurrences.select(chrom.alias("chrom"), (low + forward - 1).alias("start"), (low + forward - 1 + wide).alias("end"), "strand", "p_value")


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """(rank, tp, fp, fdr, recall, ...) as ``write_curve`` wrote it."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*[F.col(c).cast("long" if c == "rank" else "double").alias(c) for c in raw.columns])


def write_log_odds(pairs: DataFrame, path: str) -> None:
    """(rank, positive, negative) by rank."""
    pairs.repartitionByRange("rank").sortWithinPartitions("rank").write.csv(path, sep="\t", header=True)


def alphas_text(alpha: np.ndarray) -> str:
    """A line per order, a column per position."""
    return "".join(" ".join(f"{x:.6g}" for x in np.atleast_1d(row)) + "\n" for row in np.asarray(alpha))


def write_bed(bed: DataFrame, path: str) -> None:
    bed.select("chrom", "start", "end", "strand", F.format_string("%.2e", "p_value").alias("p_value")).write.csv(path, sep="\t")


def write_positions(rows: DataFrame, path: str) -> None:
    """Sites (seq, length, strand, start, end, pattern)."""
    at = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    rows.select("seq", "length", "strand", at.alias("start..end"), "pattern").write.csv(path, sep="\t", header=True)


def write_best_sites(rows: DataFrame, path: str) -> None:
    """The best site of each sequence with its score."""
    at = F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))
    rows.select("seq", "length", "strand", at.alias("start..end"), "pattern", F.round("score", 6).alias("zoops_score")).write.csv(path, sep="\t", header=True)


def write_positional_likelihoods(rows: DataFrame, path: str) -> None:
    """(seq_id, i, lik) as one line per sequence, in order of position.  A line is as long as its sequence."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "lik"))), lambda x: F.format_string("%.6f", x["lik"])), " ")
    rows.groupBy("seq_id").agg(line.alias("value")).select("value").write.text(path)


def write_posteriors(post: DataFrame, of: str, path: str, most_models: int = 1000) -> None:
    """posterior.summary (the two likeliest models of each set) and posterior.matrix (a column per model, by name)."""
    from ..operators.background import best_two

    best_two(post, of).write.csv(f"{path}.summary", sep="\t", header=True)
    names = [r["model"] for r in post.select("model").distinct().orderBy("model").limit(most_models + 1).collect()]
    if len(names) > most_models:
        raise ValueError("too many models for a matrix")
    post.groupBy(of).pivot("model", names).agg(F.round(F.first("posterior"), 6)).write.csv(f"{path}.matrix", sep="\t", header=True)


def write_matches(hits: DataFrame, path: str) -> None:
    """Database hits of each query, by e-value."""
    hits.select("model_id", "db_id", F.col("p_value").alias("p-value"), F.col("e_value").alias("e-value"), "sim_score", "model_width").repartition("model_id").sortWithinPartitions("model_id", "e-value").write.csv(path, sep="\t", header=True)
