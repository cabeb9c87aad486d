"""Long sequences in pieces, so that scans, counts and fits split inside a record.

A piece is a row (seq_id, L, at, text, lo, hi): letters of record ``seq_id`` from ``at`` on, of which those from ``lo`` up to
``hi`` (places in ``text``) are its own; the others are the halo, shared with the neighbours.  A window belongs to the piece
in which its leftmost base on the forward strand lies, a k-mer to that of its last base.  With a halo of at least the
window's width and the model's order, results are those of whole records.  No task holds a record whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import STANDARD, Alphabet, reverse_complement
from ..shared import materialise
from .background import Background, kmer_of
from .em import _table, optimize_many, roll_up
from .motif import PSEUDO, Motif
from .ranking import scan
from .score import Batch, Grams, _tables, batches_of, by_grams

PIECE = 1_000_000
BROADCAST_RECORDS = 1_000_000


def laid_out(parts: DataFrame, by: str, order: str, text: str = "seq") -> DataFrame:
    """(seq_id, offset, letters) of ``parts`` laid end to end in the order of the unique ``order``, one record per ``by``.

    Only keys and lengths are sorted.
    """
    lengths = parts.select(F.col(by).alias("seq_id"), F.col(order).alias("o"), F.length(text).cast("long").alias("n"))
    at = scan(lengths, ["o"], {"upto": "n"}, by=["seq_id"]).select("seq_id", F.col("o").alias("__o"), (F.col("upto") - F.col("n")).alias("offset"))
    return parts.select(F.col(order).alias("o"), F.col(text).alias("letters")).join(at, F.col("o") == F.col("__o")).select("seq_id", "offset", "letters")


def cut(fragments: DataFrame, halo: int, piece: int = PIECE) -> DataFrame:
    """Pieces of records given as fragments (seq_id, offset, letters) of any length, in any order, without gaps or overlaps.

    Every fragment is cut at the pieces' borders inside its row; pieces that several fragments make up are put together by
    (record, piece), so a long record is dealt out.
    """
    fragments = fragments.where(F.length("letters") > 0)
    raw = fragments.select("seq_id", "offset", F.col("letters").cast("binary").alias("raw"), F.length("letters").cast("long").alias("n"))
    size = raw.groupBy("seq_id").agg(F.max(F.col("offset") + F.col("n")).alias("L"))
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - halo) / piece).cast("long"))
    last = F.floor((F.col("offset") + F.col("n") - 1 + halo) / piece).cast("long")

    def part(k):
        start = F.greatest(k * piece - halo - F.col("offset"), F.lit(0))
        end = F.least((k + 1) * piece + halo - F.col("offset"), F.col("n"))
        return F.struct(k.alias("k"), (F.col("offset") + start).alias("o"), F.substring("raw", (start + 1).cast("int"), (end - start).cast("int")).alias("t"))

    parts = raw.select("seq_id", F.inline(F.transform(F.sequence(first, last), part)))
    held = parts.groupBy("seq_id", "k").agg(F.sort_array(F.collect_list(F.struct("o", "t"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: p["t"].cast("string")), "")
    at = F.get("x", F.lit(0))["o"]
    one = held.select("seq_id", "k", at.alias("at"), text.alias("text")).join(size.withColumnRenamed("seq_id", "__s"), F.col("seq_id").eqNullSafe(F.col("__s")))
    own = [(F.col("k") * piece - F.col("at")).cast("int").alias("lo"), (F.least((F.col("k") + 1) * piece, F.col("L")) - F.col("at")).cast("int").alias("hi")]
    return one.select("seq_id", "L", "at", "text", *own).where(F.col("hi") > F.col("lo"))


def strands(pieces: DataFrame, single: bool = False, ab: Alphabet = STANDARD) -> DataFrame:
    """(seq_id, L, at, text, lo, hi, minus): a row per strand; ``at`` counts in the record, a separator and its reverse complement."""
    n = F.length("text")
    forward = pieces.withColumn("minus", F.lit(False))
    if single:
        return forward
    at = 2 * F.col("L") + 1 - F.col("at") - n
    return forward.unionByName(pieces.select("seq_id", "L", at.alias("at"), reverse_complement(F.col("text"), ab).alias("text"), "lo", "hi", F.lit(True).alias("minus")))


class _Piece:
    """A batch of strand pieces and the windows that are their own."""

    def __init__(self, batch: Batch, first: int, b: pa.RecordBatch):
        part = b.slice(first, batch.n)
        self.batch, self.part = batch, part
        self.lo, self.hi, self.at, self.L = (np.asarray(part.column(c)).astype(np.int64) for c in ("lo", "hi", "at", "L"))
        self.minus = part.column("minus").to_numpy(zero_copy_only=False)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the batch and their rows."""
        s = self.batch.windows(width)
        row = self.batch.rows(s)
        local = s - self.batch.off[row]
        left = np.where(self.minus[row], np.diff(self.batch.off)[row] - width - local, local)
        own = (left >= self.lo[row]) & (left < self.hi[row])
        return s[own], row[own]

    def starts(self, s: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.at[row] + s - self.batch.off[row]


COLUMNS = ["seq_id", "L", "at", "text", "lo", "hi", "minus"]


def _pieces(b: pa.RecordBatch, order: int, ab: Alphabet) -> Iterator[_Piece]:
    for i, batch in batches_of(b.column("text"), order, ab):
        yield _Piece(batch, i, b)


def kmer_table(pieces: DataFrame, order: int, by: bool = True, ab: Alphabet = STANDARD) -> DataFrame:
    """(seq_id, k, kmer, n), or over all records: k-mers of up to ``order`` + 1 bases on the forward strand."""
    names = np.array([kmer_of(y, k + 1, ab) for k in range(order + 1) for y in range(ab.size ** (k + 1))], dtype=object)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, batch in batches_of(b.column("text"), order, ab):
                lo, hi = (np.asarray(b.column(c))[i : i + batch.n] for c in ("lo", "hi"))
                local = np.arange(len(batch.row)) - batch.off[batch.row]
                own = (batch.run > 0) & (local >= lo[batch.row]) & (local < hi[batch.row])
                both, n = np.unique(batch.row[own] * len(names) + batch.ctx[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column("seq_id").take(pa.array(i + both // len(names))), pa.array(names[both % len(names)], pa.string()), pa.array(n.astype(np.int64))], names=["seq_id", "w", "n"])

    keys = ["seq_id"] if by else []
    kind = pieces.schema["seq_id"].dataType.simpleString()
    long = pieces.select("seq_id", "text", "lo", "hi").mapInArrow(run, f"seq_id {kind}, w string, n long").groupBy(*keys, "w").agg(F.sum("n").alias("n"))
    each = long.select(*keys, "w", "n", F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("k"))
    return each.select(*keys, "k", F.expr("right(w, k + 1)").alias("kmer"), "n").groupBy(*keys, "k", "kmer").agg(F.sum("n").alias("n"))


def all_scores(strand_pieces: DataFrame, motifs: list[Motif], bg: Background, pseudo: float = PSEUDO) -> DataFrame:
    """(motif_id, seq_id, L, start, score) of every window, as ``score.all_scores`` of whole records; starts are 64-bit."""
    sent, order, ab = strand_pieces.sparkSession.sparkContext.broadcast(_tables(motifs, bg, pseudo)), [m.order for m in motifs], bg.ab

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = by_grams(sent.value, order, ab)
        for b in it:
            for m, table in enumerate(tables):
                for p in _pieces(b, order[m], ab):
                    s, row = p.windows(table.width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), m, np.int32)), p.part.column("seq_id").take(pa.array(row)), pa.array(p.L[row]), pa.array(p.starts(s, row)), pa.array(table.of(p.batch, s))],
                        names=["motif_id", "seq_id", "L", "start", "score"],
                    )

    kind = strand_pieces.schema["seq_id"].dataType.simpleString()
    return strand_pieces.select(*COLUMNS).mapInArrow(run, f"motif_id int, seq_id {kind}, L long, start long, score double")


def best_scores(strand_pieces: DataFrame, motifs: list[Motif], bg: Background, pseudo: float = PSEUDO, digits: int = 9) -> DataFrame:
    """(motif_id, seq_id, L, start, score, windows): each record's best window, the first of those equal to ``digits`` places.

    A piece sends one row a motif.
    """
    sent, order, ab = strand_pieces.sparkSession.sparkContext.broadcast(_tables(motifs, bg, pseudo)), [m.order for m in motifs], bg.ab

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = by_grams(sent.value, order, ab)
        for b in it:
            for m, table in enumerate(tables):
                for p in _pieces(b, order[m], ab):
                    s, row = p.windows(table.width)
                    if not len(s):
                        continue
                    score = table.of(p.batch, s)
                    near = np.round(score, digits)
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    count = np.diff(np.r_[first, len(s)])
                    top = np.repeat(np.maximum.reduceat(near, first), count)
                    at = np.minimum.reduceat(np.where(near == top, np.arange(len(s)), len(s)), first)
                    r = row[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), m, np.int32)), p.part.column("seq_id").take(pa.array(r)), pa.array(p.L[r]), pa.array(p.starts(s[at], r)), pa.array(score[at]), pa.array(count)],
                        names=["motif_id", "seq_id", "L", "start", "score", "windows"],
                    )

    kind = strand_pieces.schema["seq_id"].dataType.simpleString()
    each = strand_pieces.select(*COLUMNS).mapInArrow(run, f"motif_id int, seq_id {kind}, L long, start long, score double, windows long")
    best = F.max_by(F.struct("start", "score"), F.struct(F.round("score", digits), -F.col("start")))
    return each.groupBy("motif_id", "seq_id", "L").agg(best.alias("b"), F.sum("windows").alias("windows")).select("motif_id", "seq_id", "L", "b.start", "b.score", "windows")


def _norms(strand_pieces: DataFrame, m: Motif, bg: Background) -> DataFrame:
    """(r_id, odds, windows) of every record: the sum of its windows' odds, and their number."""
    sent, order, ab = strand_pieces.sparkSession.sparkContext.broadcast(_table(m, bg)), m.order, bg.ab

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Grams(sent.value, order, ab, exp=True)
        for b in it:
            for p in _pieces(b, order, ab):
                s, row = p.windows(table.width)
                odds = np.bincount(row, table.of(p.batch, s), p.batch.n)
                yield pa.RecordBatch.from_arrays([p.part.column("seq_id"), pa.array(odds), pa.array(np.bincount(row, minlength=p.batch.n))], names=["r_id", "odds", "windows"])

    kind = strand_pieces.schema["seq_id"].dataType.simpleString()
    each = strand_pieces.select(*COLUMNS).mapInArrow(run, f"r_id {kind}, odds double, windows long")
    return each.groupBy("r_id").agg(F.sum("odds").alias("odds"), F.sum("windows").alias("windows"))


def expected_counts(strand_pieces: DataFrame, m: Motif, bg: Background, at_least: float = 0.0) -> tuple[list[np.ndarray], float, float, int]:
    """As ``em.expected_counts``, in two passes: the norm of each record, then the counts of its pieces.  Tasks send sums only."""
    spark, W, K, ab, size = strand_pieces.sparkSession, m.width, m.order, bg.ab, bg.ab.size
    norms = materialise(_norms(strand_pieces, m, bg), "norms")
    norm = F.when(F.col("windows") > 0, (1 - m.q) + m.q * F.col("odds") / F.col("windows"))
    llh, n_seqs = norms.agg(F.sum(F.log(norm)), F.count(norm)).first()
    sides = norms.select("r_id", (m.q / F.greatest("windows", F.lit(1)) / F.coalesce(norm, F.lit(1.0))).alias("factor"))
    if norms.count() <= BROADCAST_RECORDS:
        sides = F.broadcast(sides)
    both = strand_pieces.select(*COLUMNS).join(sides, F.col("seq_id").eqNullSafe(F.col("r_id"))).select(*COLUMNS, "factor")
    sent = spark.sparkContext.broadcast(_table(m, bg))
    contexts = len(sent.value)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Grams(sent.value, K, ab, exp=True), 0.0
        sums = table.empty()
        for b in it:
            for p in _pieces(b, K, ab):
                s, row = p.windows(W)
                r = table.of(p.batch, s) * np.asarray(p.part.column("factor"))[row]
                if at_least:
                    r = np.where(r >= at_least, r, 0.0)
                total += r.sum()
                table.add(sums, p.batch, s, r)
        flat = np.r_[table.by_context(sums).ravel(), total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    flat = np.zeros(contexts * W + 1)
    for r in both.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # contexts * W + 1 rows
        flat[r["i"]] = r["x"]
    return roll_up(flat[:-1].reshape(contexts, W), K, size), float(llh or 0.0), float(flat[-1]), int(n_seqs)


def fit(strand_pieces: DataFrame, m: Motif, bg: Background, **options):
    """``em.optimize`` over pieces."""
    counts = lambda rows, motifs, bg, at_least, cells, held_out: [expected_counts(rows, x, bg, at_least) for x in motifs]
    return optimize_many(strand_pieces, [m], bg, counts=counts, **options)[0]


# --- files ---


def read_fragments(spark, path: str, most: int = 256_000) -> tuple[DataFrame, DataFrame]:
    """Records of sequence files as fragments (seq_id, offset, letters), and (seq_id, header, file).

    Spark cuts the files at fixed bytes; a task reads the lines of its cuts and knows only what happened inside them.  Where a cut's
    first record goes on from the cut before follows from a table of one row a cut.  seq_id is a hash of the file and the record's number
    in it, so it does not depend on the cuts.  The unit of reading is a line: one very long line is read by one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record, at, held, size, rows = None, 0, 0, [], 0, []

        def flush():
            nonlocal at, held, size
            letters = "".join(held).replace("\r", "").upper()
            if " " in letters or "\t" in letters:
                raise ValueError("white space inside a sequence")
            if letters:
                rows.append((*now, record, at, letters, None))
                at += len(letters)
            held, size = [], 0

        for b in it:
            for file, block, line in zip(*[c.to_pylist() for c in b.columns]):
                if (file, block) != now:
                    if now is not None:
                        flush()
                    now, record, at = (file, block), 0, 0
                    rows.append((*now, 0, 0, None, None))  # the cut itself, should it hold nothing else
                if line.startswith(">"):
                    flush()
                    record, at = record + 1, 0
                    rows.append((*now, record, 0, None, line.split("\t")[0].split("\r")[0]))
                else:
                    held.append(line.strip("\r\n"))
                    size += len(line)
                    if size >= most:
                        flush()
            if sum(len(r[4] or "") for r in rows) >= 8 * most:
                yield _rows(rows)
                rows = []
        if now is not None:
            flush()
        yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "record", "at", "letters", "header"])

    made = materialise(lines.select("file", "block", "value").mapInArrow(run, "file string, block long, record long, at long, letters string, header string"), "fragments")
    n = F.coalesce(F.length("letters"), F.lit(0)).cast("long")
    by_record = made.groupBy("file", "block", "record").agg(F.sum(n).alias("n"))
    cuts = by_record.groupBy("file", "block").agg(F.max("record").alias("records"), F.sum("n").alias("n"), F.max_by("n", "record").alias("tail"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a cut of a file
    cuts = cuts.withColumns({"records_before": F.coalesce(F.sum("records").over(earlier), F.lit(0)), "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    begun = F.max(F.when(F.col("records") > 0, F.col("before") + F.col("n") - F.col("tail"))).over(earlier)
    cuts = cuts.select(F.col("file").alias("c_file"), F.col("block").alias("c_block"), "records_before", (F.col("before") - F.coalesce(begun, F.lit(0))).alias("carry"))
    both = made.join(cuts, (F.col("file") == F.col("c_file")) & (F.col("block") == F.col("c_block")))
    number = F.col("records_before") + F.col("record")
    both = both.where(number > 0).withColumn("seq_id", F.xxhash64("file", number))  # letters before the first header have no record
    offset = F.col("at") + F.when(F.col("record") == 0, F.col("carry")).otherwise(0)
    fragments = both.where(F.col("letters").isNotNull()).select("seq_id", offset.alias("offset"), "letters")
    return fragments, both.where(F.col("header").isNotNull()).select("seq_id", "header", "file")


def read(spark, path: str, halo: int, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The records of sequence files as pieces, and (seq_id, header, file)."""
    fragments, headers = read_fragments(spark, path)
    return cut(fragments, halo, piece), headers
