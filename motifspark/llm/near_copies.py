"""Near copies at a wanted Jaccard similarity of word shingles: operator 6's trie join of SimHashes, verified, and an exact join for what its bit budget misses.

The tries come first.  Each 64 bits of a text's SimHash (WIDE bits of its shingles' hashes) are filed under TRIES tries, pairs of nodes
are walked together with a budget of REACH bits, and every text is compared with the nearest and the least of the partners found.

The rest is exact.  Two sets with a similarity of at least ``similarity`` share one of the first n - ceil(similarity * n) + 1 shingles of each, in any
order that is the same for all sets.  The order puts shingles first that are rare in a share of the texts, so that common passages seldom
count; the result does not depend on that share.  Texts with equal sets are one node.  Only texts that the links so far leave in different
classes are compared: a shingle whose texts are in one class makes no pairs.  While many pairs are left,
a shingle's texts are compared with some of them, drawn anew each turn, with
some candidates a text, for as long as that joins many classes.  In the end texts outside the largest class of a shingle are
compared with all that are in other classes.

Every pair that shares enough of these for the similarity to be possible is a candidate.  Candidates whose SimHashes
differ in more than BUDGET bits go at once: of pairs at the similarity, one in some billions differs by so
much.  A candidate, of the tries or of a shingle, is a link if the Jaccard similarity of the two whole sets, counted on 40 bits of each shingle's hash, is reached; only the
sets that such candidates need are moved.
Shingles that the same texts have (a shared passage makes one for each of its words) are one row a text, with their number as weight.

Defined results: as in ``simhash``; texts without words are copies of each other; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, result, scratch
from .simhash import _majority, components, labelled, near_partners, shingle_hashes
from .textbatch import PRIME, Chunk, map_text, mix, quoted, released

SHINGLE, SIMILARITY = 5, 0.8
SHARE, AT_LEAST, LISTED = 0.4, 3, 1_000_000  # of the texts from which the order is taken, counts and shingles it lists
HOT_SHARE, HOT_BYTES = 10_000, 32_000_000
WIDE, BUDGET, FEW = 256, 80, 64  # at 0.8, 39 bits differ, with a deviation of 6; sets under FEW shingles are not judged by it
TRIES, REACH = 4, 12  # of each 64 bits of a SimHash, so many tries (blocks of 16 bits in front); at 0.8, 10 of 64 bits differ
BROADCAST_SETS = 1_000_000
PIVOTS, BLOCK = 16, 4_000
LISTS = 256  # of a text's open shingles, so many are sent along with it; beyond, its pairs are made at each of them
ENOUGH, GAIN = 8, 0.7  # go on while over ENOUGH pairs a row are ahead, and a turn leaves less than this share of them


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _some_shingles(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(token): the distinct shingle hashes of a share of the texts, drawn by a hash of the text."""
    span = 1 << 62
    drawn = docs.select(F.col(quoted(text_col)).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(span)) < int(span * SHARE)).distinct()

    def each(it):
        held, n = [], 0
        for b in it:
            for text in b.column(0):
                held.append(np.unique(np.array(shingle_hashes((text.as_py() or "").encode(), shingle), dtype=np.uint64)))
                n += len(held[-1])
                if n >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["token"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["token"])
        released()

    return drawn.mapInArrow(each, "token long")


def _common(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a share have, sorted, and their counts in it: all from the least count on of which no more than LISTED have it."""
    counts = materialise(tokens.groupBy("token").count().where(F.col("count") >= AT_LEAST), "shingle_counts")
    least, total = AT_LEAST, 0
    for r in counts.groupBy(F.col("count").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():  # distinct counts
        total += r["n"]
        if total > LISTED:
            least = r["c"] + 1
            break
    top = counts.where(F.col("count") >= least).toArrow()
    found = np.asarray(top.column("token")).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.asarray(top.column("count"))[order].astype(np.int32)


def _sketch(s: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, WIDE bits: each 64 of them from the hashes mixed anew."""
    with np.errstate(over="ignore"):
        return b"".join(_majority(mix(s + np.uint64(k) * PRIME)).to_bytes(8, "little") for k in range(WIDE // 64))


def _pack(s: np.ndarray) -> bytes:
    """40 bits of each hash."""
    return s.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def shingle_sets(docs: DataFrame, sent, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, n, shingles, sketch, prefix): the distinct shingle hashes of each row, a hash of them, their number, their SimHash and
    the first of them in the order of ``sent``; of texts that a task has had, only the fp."""

    def make():
        listed, counts = sent.value
        seen = set()

        def one(raw: bytes):
            s = np.unique(np.array(shingle_hashes(raw, shingle), dtype=np.uint64))
            fp = xxhash.xxh3_64_intdigest(s.tobytes())
            if fp in seen:
                return fp, len(s), None, None, None
            seen.add(fp)
            first = s
            if len(listed) and len(s):
                at = np.minimum(np.searchsorted(listed, s), len(listed) - 1)
                first = s[np.argsort(np.where(listed[at] == s, counts[at], 0), kind="stable")]
            return fp, len(s), _pack(s), _sketch(s), first[: prefix_length(len(s), similarity)].view(np.int64)

        def apply(chunk: Chunk) -> dict:
            raw, off = chunk.data.tobytes(), chunk.off.tolist()
            fp, n, sets, sketch, prefix = zip(*[one(raw[a:b]) for a, b in zip(off[:-1], off[1:])])
            return {
                "fp": pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), "n": np.array(n, np.int32), "shingles": pa.array(sets, pa.binary()),
                "sketch": pa.array(sketch, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())),
            }

        return apply

    return map_text(docs, text_col, make, "fp long, n int, shingles binary, sketch binary, prefix array<long>", [id_col]).withColumnRenamed(id_col, "doc_id")


def _shared(it):
    """Rows (token, fp, n) sorted by token and fp: those whose token has several fps, without repeats, and the token's first fp as ``pivot``, of ``pn`` shingles."""
    held = [np.zeros(0, np.int64)] * 3
    first = before = None  # the first and last fp of the token that the held row belongs to

    def emit(x, upto):
        nonlocal first, before
        token, fp, n = x
        new = np.r_[first is None or token[0] != first[0], token[1:] != token[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        pivot, pn = (np.where(start < 0, first[i] if first else 0, x[i][np.maximum(start, 0)]) for i in (1, 2))
        follows = np.r_[not new[0], ~new[1:]]
        goes_on = np.r_[token[1:] == token[:-1], False]
        keep = (follows | goes_on)[:upto]
        if upto:
            first = (token[upto - 1], pivot[upto - 1], pn[upto - 1])
        return pa.RecordBatch.from_arrays([pa.array(v[:upto][keep]) for v in (token, fp, n.astype(np.int32), pivot, pn.astype(np.int32))], names=["token", "fp", "n", "pivot", "pn"])

    for b in it:
        x = [np.concatenate([h, np.asarray(b.column(i)).astype(np.int64)]) for i, h in enumerate(held)]
        if not len(x[0]):
            continue
        once = np.r_[before is None or (x[0][0], x[1][0]) != before, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])]
        x = [v[once] for v in x]
        if len(x[0]) > 1:
            before = (x[0][-2], x[1][-2])
            yield emit(x, len(x[0]) - 1)
        held = [v[-1:] for v in x]
    if len(held[0]):
        yield emit(held, 1)


def _merged(shared: DataFrame) -> DataFrame:
    """``shared`` with ``w``: of the shingles that just the same texts have, the least stands for all w of them.

    Sets of texts are compared by their sizes and 128 bits of hashes of their fps.
    """
    texts = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    sets = shared.groupBy("token").agg(F.count("*").alias("texts"), *texts)
    kept = materialise(sets.groupBy("texts", "h1", "h2").agg(F.min("token").alias("token"), F.count("*").cast("int").alias("w")).select("token", "w"), "passages")
    return materialise(shared.join(kept, "token"), "shared_passages")


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, b, an, bn, k), k shared prefix shingles each, whose sets of an and bn shingles can be that similar.

    Of two sets, the one whose prefix ends first in the order shares nothing more than these and what follows its prefix.
    """
    rest = F.greatest(*[F.ceil(F.col(c) * similarity - 1e-9) - 1 for c in ("an", "bn")])
    need = (F.col("an") + F.col("bn")) * (similarity / (1 + similarity)) - 1e-9
    return pairs.groupBy("a", "b", "an", "bn").agg(F.sum("k").alias("k")).where(F.col("k") + rest >= need).select("a", "b")


def _alike(similarity: float):
    def run(it):
        for b in it:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["a", "b"])
        released()

    return run


def _words(it):
    """Rows (fp, sketch): each 64 bits of the sketch as a row (fp, word, key)."""
    for b in it:
        fp = np.asarray(b.column(0))
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, WIDE // 64)
        word = np.tile(np.arange(WIDE // 64, dtype=np.int32), len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, WIDE // 64)), pa.array(word), pa.array(keys.ravel())], names=["fp", "word", "key"])


def trie_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): for every text that the tries of its SimHash find partners for, the nearest of them and the least.

    Each 64 bits of the SimHash are a fingerprint with tries of its own.  Texts with equal ones are partners of the least of them.
    """
    words = materialise(nodes.select("fp", "sketch").mapInArrow(_words, "fp long, word int, key long"), "sketch_words")
    least = materialise(words.groupBy("word", "key").agg(F.min("fp").alias("id"), F.count("*").alias("texts")), "least_of_words")
    met = near_partners(least.select(F.col("key").alias("fp"), "word", "id"), REACH, TRIES)
    several = materialise(least.where("texts > 1"), "shared_words")
    hot = F.broadcast(several.where(F.col("texts") * HOT_SHARE > max(words.count(), HOT_SHARE)))  # under HOT_SHARE rows
    plain = words.join(hot, ["word", "key"], "left_anti").join(several, ["word", "key"])
    equal = [x.where("fp <> id").select(F.col("fp").alias("a"), F.col("id").alias("b"), F.lit(0).alias("d")) for x in (words.join(hot, ["word", "key"]), plain)]
    chosen = met.unionByName(equal[0]).unionByName(equal[1]).groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("nearest"), F.min("b").alias("least"))
    partner = lambda often, c: F.struct(F.lit(often).alias("often"), F.col(c).alias("to"))
    pairs = chosen.select("a", F.explode(F.array(partner(0, "nearest"), partner(1, "least"))).alias("p")).select("p.often", "p.to", "a")
    pairs = pairs.groupBy(F.least("a", "to").alias("low"), F.greatest("a", "to").alias("high"))
    return pairs.agg(F.max(F.struct("often", "to", "a")).alias("p")).select(F.col("p.to").alias("a"), F.col("p.a").alias("b"))


def _close(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose numbers of shingles and SimHashes allow the similarity."""
    look = lambda c, k: nodes.select(F.col("fp").alias(c), F.col("sketch").alias(f"{k}s"), F.col("size").alias(f"{k}n"))
    both = pairs.join(look("a", "a"), "a").join(look("b", "b"), "b")

    def near(it):
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, WIDE // 64) for i in (2, 3))
            an, bn = np.asarray(b.column(4)), np.asarray(b.column(5))
            least, most = np.minimum(an, bn), np.maximum(an, bn)
            ok = pa.array((least >= most * similarity - 1e-9) & ((least < FEW) | (np.bitwise_count(x ^ y).sum(axis=1) <= BUDGET)))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "as", "bs", "an", "bn").mapInArrow(near, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of fps whose sets are that similar; many pairs may have the same a."""
    pairs = materialise(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = materialise(nodes.join(ids, "fp", "left_semi").select("rid"), "wanted_sets")
    if wanted.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    sets = materialise(rows.select("rid", "fp", "shingles").join(wanted, "rid", "left_semi").select("fp", "shingles"), "candidate_sets")
    total = pairs.count()
    often = pairs.groupBy("a").count().where(F.col("count") * HOT_SHARE > max(total, 10 * HOT_SHARE)).select("a")
    often = materialise(often, "hot_pivots")  # under HOT_SHARE rows
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = ["a", "b", "x", "y"]
    size = left.join(F.broadcast(often), "a", "left_semi").agg(F.coalesce(F.sum(F.length("x")), F.lit(0))).first()[0]
    if not size or size > HOT_BYTES:  # beyond the bound, skewed joins are split at run time
        joined = pairs.join(left, "a").join(right, "b").select(*both)
    else:
        hot = pairs.join(F.broadcast(often), "a", "left_semi").join(right, "b").join(F.broadcast(left.join(F.broadcast(often), "a", "left_semi")), "a")
        joined = hot.select(*both).unionByName(pairs.join(F.broadcast(often), "a", "left_anti").join(left, "a").join(right, "b").select(*both))
    return materialise(joined.mapInArrow(_alike(similarity), "a long, b long"), "verified")


def _open(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """(token, fp, n, w, c, main, main_n, total): the rows of shingles whose texts are in several classes c, and the largest of these."""
    linked = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    of = shared.join(linked, shared["fp"] == linked["node"], "left").select("token", "fp", "n", "w", F.coalesce("root", "fp").alias("c"))
    of = materialise(of, "shared_classes")
    sizes = of.groupBy("token", "c").count()
    mixed = sizes.groupBy("token").agg(F.count("*").alias("classes"), F.max_by("c", F.struct("count", "c")).alias("main"), F.max("count").alias("main_n"), F.sum("count").alias("total"))
    mixed = materialise(mixed.where("classes > 1").drop("classes"), "mixed")
    return materialise(of.join(mixed, "token"), "open")


def _common_tokens(x: list, y: list, upto: int, wide: int = 1024, weights: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For lists of tokens x and y: how many each pair shares, and how many of these are below ``upto``; ``wide`` tokens at a time.

    weights: of the tokens of x, by which they count.
    """
    flat = lambda lists: (np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(t) for t in lists]))
    (left, i), (right, j) = flat(x), flat(y)
    heavy = np.ones(len(left), np.float32) if weights is None else np.concatenate(weights).astype(np.float32)
    name, left = np.unique(left, return_inverse=True)
    at = np.minimum(np.searchsorted(name, right), len(name) - 1)
    known = name[at] == right
    right, j = at[known], j[known]
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    left, i, right, j, heavy = left[by_left], i[by_left], right[by_right], j[by_right], heavy[by_left]
    shared, below = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    cut = int(np.searchsorted(name, upto))
    for low, high in ((0, cut), (cut, len(name))):
        for c in range(low, high, wide):
            d = min(c + wide, high)
            part = []
            for code, row, n, w in ((left, i, len(x), heavy), (right, j, len(y), np.ones(len(right), np.float32))):
                u, v = np.searchsorted(code, [c, d])
                made = np.zeros((n, d - c), np.float32)
                made[row[u:v], code[u:v] - c] = w[u:v]
                part.append(made)
            both = part[0] @ part[1].T
            shared += both
            if d <= cut:
                below += both
    return shared, below


def _within_groups(similarity: float):
    """mapInArrow over rows (token, xb, yb, y, also, fp, n, c, sketch, w, tokens, weights) sorted by token, xb, yb, y: the pairs of x and y rows of each group
    that can be alike, as (a, b, an, bn, k).

    A pair that shares several tokens is made at the least of them, with k the sum of their weights; where a row's tokens are not
    listed, at each of them with k = w.
    """

    def pairs(g: dict, token: int) -> Iterator[pa.RecordBatch]:
        first = int(np.searchsorted(g["y"], 1))
        fp, n, c, also, sketch, tokens, weights = (g[k] for k in ("fp", "n", "c", "also", "sketch", "tokens", "weights"))
        if not first or first == len(fp):
            return
        step = max(1, 400_000 // (len(fp) - first))
        for lo in range(0, first, step):
            x, y = slice(lo, min(lo + step, first)), slice(first, None)
            most, least = np.maximum(n[x, None], n[None, y]), np.minimum(n[x, None], n[None, y])
            ok = (c[x, None] != c[None, y]) & (~also[None, y] | (fp[x, None] < fp[None, y])) & (least >= most * similarity - 1e-9)
            i, j = np.nonzero(ok)
            i, j = i + lo, j + first
            near = (np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= BUDGET) | (np.minimum(n[i], n[j]) < FEW)
            i, j = i[near], j[near]
            if not len(i):
                continue
            k, keep = np.full(len(i), g["w"], np.int64), np.ones(len(i), bool)
            listed = np.array([tokens[r] is not None for r in range(len(fp))])
            both = np.flatnonzero(listed[i] & listed[j])
            if len(both):
                xs, xi = np.unique(i[both], return_inverse=True)
                ys, yi = np.unique(j[both], return_inverse=True)
                shared, below = _common_tokens([tokens[r] for r in xs], [tokens[r] for r in ys], token, weights=[weights[r] for r in xs])
                k[both] = shared[xi, yi]
                rest = np.ceil(np.maximum(n[i], n[j]) * similarity - 1e-9) - 1
                enough = k + rest >= (n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-9
                keep[both] = (below[xi, yi] == 0) & enough[both]
            i, j, k = i[keep], j[keep], k[keep]
            turned = fp[i] > fp[j]
            a, b = np.where(turned, j, i), np.where(turned, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (fp[a], fp[b], n[a].astype(np.int32), n[b].astype(np.int32), k)], names=["a", "b", "an", "bn", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(k)) for k in range(3)]
            cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in keys], axis=0)) + 1
            ends = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(ends, ends[1:]):
                part = batch.slice(lo, hi - lo)
                if held and any(held[-1].column(k)[0].as_py() != part.column(k)[0].as_py() for k in range(3)):
                    yield from group(held)
                    held = []
                held.append(part)
        if held:
            yield from group(held)
        released()

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        g = {k: np.asarray(t.column(k).combine_chunks()) for k in ("y", "fp", "n", "c")}
        g["n"] = g["n"].astype(np.int64)
        g["also"] = t.column("also").to_numpy()
        g["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
        g["w"] = t.column("w")[0].as_py()
        for k in ("tokens", "weights"):
            lists = t.column(k).combine_chunks()
            off, flat, null = np.asarray(lists.offsets), np.asarray(lists.values), np.asarray(lists.is_null())
            g[k] = [None if z else flat[u:v] for u, v, z in zip(off[:-1], off[1:], null)]
        yield from pairs(g, t.column("token")[0].as_py())

    return run


def _by_text(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, n, c, most, open, sketch): a row a text, with its open shingles as a list; ``most``: of its shingles, the largest total."""
    of = F.struct("token", "w", "total", (F.col("c") != F.col("main")).alias("other"), (F.col("total") - F.col("main_n")).alias("others"))
    texts = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.max("total").alias("most"), F.collect_list(of).alias("open"))
    return texts.join(nodes.select("fp", "sketch"), "fp")


def _compared(texts: DataFrame, similarity: float, x_side, x_total) -> DataFrame:
    """(a, b, an, bn, k): of each shingle, the texts on the x side with all texts of other classes, if they can be alike.

    x_side, x_total: whether a text is on the x side of its shingle ``at``, and about how many are; columns over ``_by_text`` and ``at``.
    The texts of a shingle are dealt out to groups of at most about BLOCK by BLOCK of them, and compared inside the task by their numbers
    of shingles, SimHashes and shared shingles.  Only pairs that pass leave it.  A text is joined with its SimHash once, not at each shingle.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("fp"), blocks(n)).cast("int")
    place = lambda xb, yb, y: F.struct(xb.alias("xb"), yb.alias("yb"), F.lit(y).alias("y"))
    numbers = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    few = F.size("open") <= LISTS
    held = ["fp", "n", "c", "most", "sketch", F.when(few, F.col("open.token")).alias("tokens"), F.when(few, F.col("open.w")).alias("weights")]
    wide = texts.select(*held, F.explode("open").alias("at"))
    wide = wide.withColumn("also", x_side).withColumn("xt", F.greatest(x_total, F.lit(1))).withColumn("total", F.col("at.total"))
    as_x = F.transform(numbers(F.col("total")), lambda yb: place(mine(F.col("xt")), yb, 0))
    as_y = F.transform(numbers(F.col("xt")), lambda xb: place(xb, mine(F.col("total")), 1))
    dealt = wide.withColumn("p", F.explode(F.when(F.col("also"), F.concat(as_x, as_y)).otherwise(as_y)))
    dealt = dealt.select(F.col("at.token").alias("token"), "p.xb", "p.yb", "p.y", "also", "fp", "n", "c", "sketch", F.col("at.w").alias("w"), "tokens", "weights")
    dealt = dealt.repartition("token", "xb", "yb").sortWithinPartitions("token", "xb", "yb", "y")
    return dealt.mapInArrow(_within_groups(similarity), "a long, b long, an int, bn int, k long")


def _to_some(rows: DataFrame, turn: int, nodes: DataFrame, similarity: float) -> DataFrame:
    """Every text with about PIVOTS others of each of its shingles, of other classes, drawn anew each turn.

    A text is drawn for all its shingles or none, by the largest of them, so that the shingles that a pair shares are all met.
    """
    drawn = F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("most")) < PIVOTS
    return _compared(_by_text(rows, nodes), similarity, drawn, F.lit(1))


def _across(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different classes of a shingle: its largest class against the others, and the others among themselves."""
    return _compared(_by_text(rows, nodes), similarity, F.col("at.other"), F.col("at.others"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row: classes of the links between texts whose shingle sets are at least ``similarity`` alike."""
    spark = docs.sparkSession
    with scratch(spark) as made:
        sent = spark.sparkContext.broadcast(_common(_some_shingles(docs, text_col, shingle)))
        rows = shingle_sets(docs, sent, id_col, text_col, shingle, similarity).withColumn("rid", F.monotonically_increasing_id())
        rows = materialise(rows, "shingle_sets")
        whole = F.when(F.col("sketch").isNotNull(), F.col("rid"))  # the first such row of a task has the set
        nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.min(whole).alias("rid"), F.min("sketch").alias("sketch"), F.max("n").alias("size"))
        nodes = materialise(nodes, "set_nodes")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        filed = rows.select(F.explode("prefix").alias("token"), "fp", "n")
        dealt = filed.repartition(n, "token").sortWithinPartitions("token", "fp")
        shared = materialise(dealt.mapInArrow(_shared, "token long, fp long, n int, pivot long, pn int"), "shared_shingles")
        shared = _merged(shared)
        linked = components(_verified(_close(trie_pairs(nodes), nodes, similarity), rows, nodes, similarity))
        rest, before, turn = shared.select("token", "fp", "n", "w"), None, 0
        while True:
            rest = _open(rest, linked)
            # decimals: the number of pairs may pass 2^63
            pairs = F.when(F.col("c") != F.col("main"), F.col("w") * F.col("total").cast("decimal(20,0)"))
            held, ahead = rest.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(pairs), F.lit(0))).first()
            ahead, turn = int(ahead), turn + 1
            if ahead <= ENOUGH * held or before is not None and ahead > before * GAIN:
                break
            more = _verified(_possible(_to_some(rest, turn, nodes, similarity), similarity), rows, nodes, similarity)
            linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
            rest, before = rest.select("token", "fp", "n", "w"), ahead
        more = _verified(_possible(_across(rest, nodes, similarity), similarity), rows, nodes, similarity)
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        return result(labelled(rows.select("doc_id", "fp"), nodes, linked).select("doc_id", "component_id"), "near_copies", made)
