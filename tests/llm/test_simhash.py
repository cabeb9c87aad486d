import numpy as np
import xxhash
from pyspark.sql import functions as F

from motifspark.llm import simhash


def brute_fp(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_classes_against_brute_force(spark):
    texts = [None, "", " \t\n", "one", "One two", "a b c", "A  B\nC", "ÄB c d e f", "x " * 3000, "x y " * 2000 + "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "zz yy xx ww")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [brute_fp(t) for t in texts]
    want = brute_classes(fps)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] & (2**64 - 1) == fps[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_trie_join_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(8):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            fps.add(x)
    hot = int(base[0]) >> 43 << 43  # many that share the first block
    fps |= {hot | int(x) for x in rng.integers(0, 2**43, 300)}
    fps = sorted(fps)
    want = brute_classes(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for split in (20_000, 50):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, split_above=split)).collect()}
        groups, theirs = {}, {}
        for x, w in zip(fps, want):
            groups.setdefault(w, set()).add(signed(x))
            theirs.setdefault(found.get(signed(x), signed(x)), set()).add(signed(x))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))


def test_keep_one_and_empty(spark):
    long = "the quick brown fox jumps over the lazy dog " * 5
    docs = spark.createDataFrame([(5, long, 1), (2, long, 2), (9, "other words entirely here", 3), (None, "null id", 4)], "doc_id long, text string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["fp"]) for r in kept.collect()) == [2, 3, 4]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs).agg(F.count("*")).first()[0] == 4


def test_hot_and_cold_rows_get_the_same_classes(spark):
    rows = [(i, "same text in many rows") for i in range(300)] + [(1000 + i, f"text {i} of its own with words {i * 7}") for i in range(40)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(300)} == {0} and got[2001] == 2000
    nodes = spark.createDataFrame([(1, 5, 300), (2, 9, 1)], "fp long, least_id long, n long")
    r = spark.createDataFrame([(5, 1), (6, 1), (9, 2)], "doc_id long, fp long")
    none = spark.createDataFrame([], "node long, root long")
    for share in (2, 10_000_000):
        assert sorted(map(tuple, simhash.labelled(r, nodes, none, share).collect())) == [(5, 1, 5), (6, 1, 5), (9, 2, 9)]


def test_near_partners_against_brute_force(spark):
    """Of all fingerprints of its word that share a block and are within reach, a text gets one that differs least; in groups over the bounds at least those within max_bits."""
    rng = np.random.default_rng(12)
    keys = []
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(5):
            flips = rng.choice(64, int(rng.integers(0, 14)), replace=False)
            keys.append(base ^ sum(1 << int(b) for b in flips))
    keys = sorted(set(keys))
    rows = [(np.uint64(k).astype(np.int64).item(), i % 2, 1000 + i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "fp long, word int, id long")
    blocks = lambda k: [(k >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    of = {1000 + i: (k, i % 2) for i, k in enumerate(keys)}
    for split, wide in ((20_000, 4_000), (3, 0)):
        simhash_rows, simhash.REACH_ROWS = simhash.REACH_ROWS, wide
        try:
            got = [tuple(r) for r in simhash.near_partners(df, 12, 4, split_above=split).collect()]
        finally:
            simhash.REACH_ROWS = simhash_rows
        least = {}
        for a, b, d in got:
            assert a != b and of[a][1] == of[b][1] and (of[a][0] ^ of[b][0]).bit_count() == d
            least[a] = min(d, least.get(a, 64))
        reach = 12 if wide else 2
        for a, (k, w) in of.items():
            near = [(k ^ j).bit_count() for b, (j, v) in of.items() if b != a and v == w and any(x == y for x, y in zip(blocks(k), blocks(j)))]
            if near and min(near) <= reach:
                assert least[a] == min(near)
