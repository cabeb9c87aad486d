"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: 64-bit SimHash of word shingles (XXH64, seed 42), computed in Arrow batches.  Equal fingerprints are
one node.  Two fingerprints within ``max_bits`` bits share at least one of ``max_bits + 1`` blocks, so each
is filed under its blocks (rotated to the front), and every block group is a subtree of one of ``max_bits + 1`` tries:
above it the error budget is zero, below it the join walks pairs of nodes together, adds the differing bits, and
prunes a pair as soon as they exceed the budget.  A group larger than ``split_above`` fingerprints is cut further
into pairs of its own subtrees, so that no task holds a hot group whole.  Each task sends only a spanning
forest of the links it finds; the classes follow from distributed hooking and
shortcutting, written to shared storage after each round.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like any other; rows that share
a doc_id count as one; rows with a null doc_id keep their fingerprint, link their class, and never name it
unless the whole class has no id (then component_id is null); an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, result, scratch
from .textbatch import Chunk, map_text, new_name

SHINGLE = 3
MAX_BITS = 2
SPLIT_ABOVE = 20_000
REACH_ROWS = 4_000
BROADCAST_IDS = 1_000_000
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of the word shingles of one text, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    joined, k = b" ".join(words), min(size, len(words)) - 1
    hash64 = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends[: len(ends) - 1 - k]]]
    return [hash64(joined[s:e], 42) for s, e in zip(starts, ends[k:])]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.empty(64, np.int64)
    for s in range(8):
        lanes = (hashes >> np.uint64(s)) & LANES
        sums = np.add.reduceat(lanes, np.arange(0, n, 255)).view(np.uint8).reshape(-1, 8)
        counts[s::8] = sums.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def _fingerprinter(size: int):
    def apply(chunk: Chunk) -> dict:
        raw, off = chunk.data.tobytes(), chunk.off.tolist()
        made = [_majority(np.array(shingle_hashes(raw[a:b], size), dtype=np.uint64)) for a, b in zip(off[:-1], off[1:])]
        return {"fp": pa.array(np.array(made, dtype=np.uint64).view(np.int64))}

    return apply


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the SimHash of each row as a signed 64-bit integer."""
    return map_text(docs, text_col, lambda: _fingerprinter(shingle), "fp long", [id_col]).withColumnRenamed(id_col, "doc_id")


# --- the trie join -------------------------------------------------------------------------------------------


def trie_links(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int, most: int = 2_000_000, end: int = 64, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (a, b) of keys within ``budget`` bits of each other.

    keys: unsigned, sorted inside each node.  pairs: rows (a_lo, a_hi, b_lo, b_hi, differing bits so far) of pairs of
    trie nodes at ``depth`` bits; a node is a range of keys with a common prefix, and a pair of a node with itself has
    equal ranges.  end: the depth at which keys are told apart.  skip: a label of each key; pairs of keys with equal labels are
    left out (it may change between the results).
    """
    stack = [(depth, pairs)]
    while stack:
        depth, p = stack.pop()
        while depth < end and len(p):
            if len(p) > most:
                half = len(p) // 2
                stack.append((depth, p[half:]))
                p = p[:half]
            a_lo, a_hi, b_lo, b_hi, d = p.T
            leaf = (a_hi - a_lo) * (b_hi - b_lo) <= 4
            if leaf.any():
                yield from _leaves(keys, p[leaf], budget, skip)
                p = p[~leaf]
                if not len(p):
                    break
                a_lo, a_hi, b_lo, b_hi, d = p.T
            bit = np.uint64(63 - depth)
            ones = np.concatenate([[0], np.cumsum((keys >> bit) & np.uint64(1)).astype(np.int64)])
            a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
            own = (a_lo == b_lo) & (a_hi == b_hi)
            parts = [
                (a_lo, a_mid, b_lo, b_mid, d, True),
                (a_mid, a_hi, b_mid, b_hi, d, True),
                (a_lo, a_mid, b_mid, b_hi, d + 1, True),
                (a_mid, a_hi, b_lo, b_mid, d + 1, ~own),
            ]
            made = []
            for w, x, y, z, e, wanted in parts:
                keep = (x > w) & (z > y) & (e <= budget) & wanted
                keep &= ~((w == y) & (x == z) & (x - w == 1))  # one key with itself
                made.append(np.stack([w[keep], x[keep], y[keep], z[keep], e[keep]], axis=1))
            p = np.concatenate(made)
            depth += 1
        if len(p):
            yield from _leaves(keys, p, budget, skip)


def _leaves(keys: np.ndarray, p: np.ndarray, budget: int, skip: np.ndarray | None = None, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    big = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) > most
    if big.any():  # wide nodes in strips
        for a_lo, a_hi, b_lo, b_hi, d in p[big].tolist():
            step = max(1, most // (b_hi - b_lo))
            for a in range(a_lo, a_hi, step):
                yield from _pairs(keys, np.array([[a, min(a + step, a_hi), b_lo, b_hi, d]]), budget, skip, own=(a_lo, b_lo))
        p = p[~big]
    upto = np.cumsum((p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]))
    cuts = np.searchsorted(upto, np.arange(0, (int(upto[-1]) if len(upto) else 0) + most, most), "left")
    for a, b in zip(cuts, [*cuts[1:], len(p)]):
        if b > a:
            yield from _pairs(keys, p[a:b], budget, skip)


def _pairs(keys: np.ndarray, p: np.ndarray, budget: int, skip: np.ndarray | None, own: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    wide, high = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
    count = wide * high
    row = np.repeat(np.arange(len(p)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a, b = p[row, 0] + k // high[row], p[row, 2] + k % high[row]
    itself = p[row, 0] == p[row, 2] if own is None else np.full(len(row), own[0] == own[1])
    near = ~(itself & (a >= b))  # each pair of a node with itself once
    if skip is not None:
        near &= skip[a] != skip[b]
    near &= np.bitwise_count(keys[a] ^ keys[b]) <= budget
    if near.any():
        yield a[near], b[near]


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of n keys reaches."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            off = x != y
            if not off.any():
                break
            hi, lo = np.maximum(x[off], y[off]), np.minimum(x[off], y[off])
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
            a, b = a[off], b[off]
    while (root[root] != root).any():
        root = root[root]
    return root


def _rotations(tries: int) -> list[tuple[int, int]]:
    """(bits of left rotation, bits of the block then in front) of each trie."""
    cuts = [round(64 * i / tries) for i in range(tries + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _nearest(keys: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``links`` handed on; ``best`` takes differing bits << 32 | index of the partner of each key that differs least."""
    for a, b in links:
        d = np.bitwise_count(keys[a] ^ keys[b]).astype(np.int64) << 32
        np.minimum.at(best, a, d | b)
        np.minimum.at(best, b, d | a)
        yield a, b


def _join_groups(max_bits: int, tries: int, reach: int | None = None):
    """mapInArrow over rows (grp, bits, side, key, r) sorted by grp, side, key: the forest links of each group.

    bits: of the common prefix.  A group with side -1 is one node joined with itself; with sides 0 and 1, a pair of nodes.
    r: the trie; its rotation is undone in the result.  reach: see ``near_partners``; a sixth column, id, names the fingerprints.
    """
    turns = np.array([by for by, _ in _rotations(tries)], dtype=np.uint64)

    def back(key: np.ndarray, r: np.ndarray) -> pa.Array:
        by, k = turns[r % tries], key.view(np.uint64)
        turned = np.where(by == 0, k, (k >> by) | (k << (np.uint64(64) - by & np.uint64(63))))
        return pa.array(turned.view(np.int64))

    def work(grp, bits, side, key, r, *names) -> Iterator[pa.RecordBatch]:
        keys = key.view(np.uint64)
        order = np.lexsort((keys, side, grp))  # Spark sorts keys as signed numbers
        grp, bits, side, key, keys, r, *names = (x[order] for x in (grp, bits, side, key, keys, r, *names))
        starts = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1])])
        ends = np.r_[starts[1:], len(grp)]
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        budgets = np.full(len(starts), max_bits)
        if reach is not None:
            budgets[ends - starts <= REACH_ROWS] = reach
        made = []
        for d, budget in np.unique(np.stack([bits[starts], budgets], axis=1), axis=0).tolist():
            mine = (bits[starts] == d) & (budgets == budget)
            s, e = starts[mine], ends[mine]
            whole = side[s] < 0
            ws, we = s[whole], e[whole]
            pairs = [np.stack([ws, we, ws, we, np.zeros_like(ws)], axis=1)]
            ps, pe = s[~whole], e[~whole]
            if len(ps):
                ones = np.concatenate([[0], np.cumsum(side == 1)])
                mid = pe - (ones[pe] - ones[ps])
                ok = (mid > ps) & (pe > mid)
                ps, pe, mid = ps[ok], pe[ok], mid[ok]
                low = np.uint64(64 - int(d))
                gap = np.bitwise_count((keys[ps] >> low) ^ (keys[mid] >> low)).astype(np.int64)
                pairs.append(np.stack([ps, mid, mid, pe, gap], axis=1))
            made.append((d, budget, np.concatenate(pairs)))
        most = 2_000_000 if reach is None else 50_000
        links = (x for d, budget, p in made for x in trie_links(keys, p, d, budget, most))
        if reach is None:
            root = _forest(len(keys), links)
            linked = np.flatnonzero(root != np.arange(len(keys)))
            if len(linked):
                to = root[linked]
                yield pa.RecordBatch.from_arrays([back(key[linked], r[linked]), back(key[to], r[to])], names=["a", "b"])
        else:
            best = np.full(len(keys), np.iinfo(np.int64).max)
            root = _forest(len(keys), _nearest(keys, links, best))
            off, met = np.flatnonzero(root != np.arange(len(keys))), np.flatnonzero(best < np.iinfo(np.int64).max)
            linked, to = np.r_[off, met], np.r_[root[off], best[met] & 0xFFFFFFFF]
            if len(linked):
                d = np.bitwise_count(keys[linked] ^ keys[to]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[0][linked], names[0][to], d)], names=["a", "b", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []  # batches not yet joined, so that a long group is put together once
        for batch in batches:
            now = [np.asarray(column).astype(np.int64) for column in batch.columns]
            if not len(now[0]):
                continue
            parts.append(now)
            if now[0][-1] == parts[0][0][0]:
                continue  # one group so far
            held = [np.concatenate(x) for x in zip(*parts)]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if last >= 20_000 or len(held[0]) - last >= 20_000:
                yield from work(*[x[:last] for x in held])
                held = [x[last:] for x in held]
            parts = [held]
        if parts:
            yield from work(*[np.concatenate(x) for x in zip(*parts)])

    return run


def _rotl(c, by: int):
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))


def _filed(fps: DataFrame, max_bits: int, tries: int, split_above: int, sub: int) -> DataFrame:
    """Rows (grp, bits, side, key, r) for ``_join_groups``: each fingerprint under its block of every trie.

    fps: (fp), or (fp, word, id) for fingerprints of several kinds (words), each with its own tries; id is handed on.
    """
    spark = fps.sparkSession
    rotations, word = _rotations(tries), F.col("word") if "word" in fps.columns else F.lit(0)
    names = [c for c in fps.columns if c == "id"]
    filed = None
    for r, (by, wide) in enumerate(rotations):
        key = _rotl(F.col("fp"), by)
        one = fps.select((word * tries + r).alias("r"), F.shiftrightunsigned(key, 64 - wide).alias("block"), F.lit(wide).alias("bits"), key.alias("key"), *names)
        filed = one if filed is None else filed.unionByName(one)
    hot = materialise(filed.groupBy("r", "block").count().where(F.col("count") > split_above).select("r", "block"), "hot_blocks")
    n_hot = hot.count()  # under tries * fingerprints / split_above
    table = F.broadcast(hot) if n_hot <= 100_000 else hot
    plain = filed.join(table, ["r", "block"], "left_anti") if n_hot else filed
    whole = plain.select((F.col("block") * 64 + F.col("r")).alias("grp"), "bits", F.lit(-1).alias("side"), "key", "r", *names)
    if n_hot:
        # the subtrees ``sub`` bits further down, each beside those within the budget: a fixed number of them
        near = [m for m in range(1 << sub) if m.bit_count() <= max_bits]
        head = F.shiftrightunsigned("key", 64 - rotations[0][1] - sub)
        for r, (_, wide) in enumerate(rotations):
            head = F.when(F.pmod("r", F.lit(tries)) == r, F.shiftrightunsigned("key", 64 - wide - sub)).otherwise(head)
        cut = filed.join(table, ["r", "block"], "left_semi").withColumn("head", head.bitwiseAND((1 << sub) - 1))
        cut = cut.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in near])))
        other = F.col("head").bitwiseXOR(F.col("m"))
        number = ((F.col("block") * (1 << sub) + F.least("head", other)) * (1 << sub) + F.greatest("head", other)) * 64 + F.col("r")
        side = F.when(F.col("m") == 0, -1).when(F.col("head") < other, 0).otherwise(1)
        whole = whole.unionByName(cut.select((-1 - number).alias("grp"), (F.col("bits") + sub).alias("bits"), side.alias("side"), "key", "r", *names))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(n, "grp").sortWithinPartitions("grp", "side", "key").select("grp", "bits", "side", "key", "r", *names)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE, sub: int = 10) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all those within ``max_bits`` bits.

    The links are spanning forests of the groups' links, so their closure is that of all links.
    """
    if not max_bits:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    return _filed(fps, max_bits, max_bits + 1, split_above, sub).mapInArrow(_join_groups(max_bits, max_bits + 1), "a long, b long")


def near_partners(fps: DataFrame, reach: int, tries: int, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE, sub: int = 10) -> DataFrame:
    """(a, b, d): ids of fingerprints of one word that differ in d bits.  fps: distinct (fp, word), and the id of each.

    The same walk with a budget of ``reach`` bits, in groups over REACH_ROWS of ``max_bits``.  Pairs within tries - 1 bits share a block; of those
    that differ by more, up to the budget, a share does.  Of a group, each a has the partner that differs least, and the root of its links,
    which may be further away.
    """
    return _filed(fps, max_bits, tries, split_above, sub).mapInArrow(_join_groups(max_bits, tries, reach), "a long, b long, d int")


# --- classes -------------------------------------------------------------------------------------------------


def _with_least(edges: DataFrame, least: DataFrame, total: int, hot_share: int = 2_000) -> DataFrame:
    """``edges`` (u, v) with the least ``m`` of each u.  least: (x, m, c), c rows of u = x.

    The rows of hubs, of which there are fewer than ``hot_share``, stay where they are: their least is broadcast.
    """
    limit = max(total // hot_share, 500)
    hubs = F.broadcast(least.where(F.col("c") > limit))
    plain = edges.join(hubs, edges["u"] == hubs["x"], "left_anti")
    rest = least.where(F.col("c") <= limit)
    return edges.join(hubs, edges["u"] == hubs["x"]).select("u", "v", "m").unionByName(plain.join(rest, plain["u"] == rest["x"]).select("u", "v", "m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each linked node reaches, by alternating large and small stars.

    Every round is one distributed step over the remaining links and is written to shared storage.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "links")
    total, before = edges.count(), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "c")
        large = _with_least(both, least, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large_stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumnRenamed("u", "x")
        small = _with_least(large, least, total)
        edges = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(edges.where("u <> v").distinct(), "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        total, before = seen[0], seen


def labelled(rows: DataFrame, nodes: DataFrame, linked: DataFrame, hot_share: int = 10_000) -> DataFrame:
    """(doc_id, fp, component_id): the least id of each row's class.

    rows: (doc_id, fp); nodes: (fp, least_id, n), one per fingerprint with its number of rows; linked: (node, root).
    Fingerprints with more than one row in ``hot_share`` are fewer than that number, so their classes are broadcast; the
    other rows are joined by a shuffle.
    """
    linked = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    members = linked.join(nodes, linked["node"] == nodes["fp"]).select("node", "root", "least_id")
    least = members.groupBy("root").agg(F.min("least_id").alias("class_id"))
    classes = members.join(least, "root").select("node", "class_id")
    of = nodes.join(classes, nodes["fp"] == classes["node"], "left").select(F.col("fp").alias("n_fp"), "n", F.coalesce("class_id", "least_id").alias("component_id"))
    of = materialise(of, "classes")
    total = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(of.where(F.col("n") * hot_share > max(total, hot_share)))  # under ``hot_share`` rows
    out = [rows.join(hot, rows["fp"] == hot["n_fp"]), rows.join(hot, rows["fp"] == hot["n_fp"], "left_anti").join(of, rows["fp"] == of["n_fp"])]
    return out[0].select("doc_id", "fp", "component_id").unionByName(out[1].select("doc_id", "fp", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    with scratch(docs.sparkSession) as made:
        rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "nodes")
        return result(labelled(rows, nodes, components(near_links(nodes.select("fp"), max_bits, split_above))), "near_duplicates", made)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: DataFrame | None = None, **options) -> DataFrame:
    """The document with the least id of each class, all columns kept; rows without an id stay.

    classes: (doc_id, component_id), where they are known already.
    """
    found = near_duplicates(docs, id_col, text_col, **options) if classes is None else classes
    extra = found.where("doc_id <> component_id").select(F.col("doc_id").alias(new_name("extra", docs.columns))).distinct()
    extra = materialise(extra, "extra_copies")
    if extra.count() <= BROADCAST_IDS:
        extra = F.broadcast(extra)
    return docs.join(extra, docs[id_col] == extra[extra.columns[0]], "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
