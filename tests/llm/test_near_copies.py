import numpy as np
import pyarrow as pa

from motifspark.llm import near_copies as nc


def jaccard(a, b, k=5):
    s = [{" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_copies_at_the_wanted_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    rows, pairs = [], []
    for f in range(120):
        base = rng.choice(words, 300).tolist()
        rows.append((10 * f, " ".join(base)))
        for c, edits in enumerate((0, 2, 6, 40)):
            new = list(base)
            for i in rng.choice(300, edits, replace=False):
                new[i] = "zz" + str(rng.integers(10**9))
            rows.append((10 * f + c + 1, " ".join(new)))
            pairs.append((10 * f, 10 * f + c + 1, jaccard(rows[-1 - c - 1][1], rows[-1][1])))
    rows += [(9001, None), (9002, ""), (None, "no id here at all"), (9003, "a b"), (9004, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs).collect()}
    assert len(got) == len(rows)
    high = [got[a] == got[b] for a, b, j in pairs if j >= 0.8]
    low = [got[a] == got[b] for a, b, j in pairs if j < 0.6]
    assert np.mean(high) > 0.97 and np.mean(low) == 0
    assert got[9001] == got[9002] and got[9003] != got[9004]
    assert nc.near_copies(docs.where("false")).count() == 0


def test_a_large_group(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 300).tolist()
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        new = list(base)
        new[rng.integers(300)] = f"z{i}"
        rows.append((i, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in nc.near_copies(docs).collect()} == {0}


def test_shared_rows_do_not_depend_on_batches():
    rng = np.random.default_rng(5)
    rows = sorted((int(t), int(f)) for t, f in zip(rng.integers(0, 60, 300), rng.integers(-9, 9, 300)))
    group = {}
    for t, f in rows:
        group.setdefault(t, []).append(f)
    want = [(t, f, g[0]) for t, g in group.items() if len(set(g)) > 1 for f in sorted(set(g))]
    for step in (1, 2, 7, 300):
        parts = [rows[i : i + step] for i in range(0, 300, step)]
        made = nc._shared(pa.RecordBatch.from_pydict({"token": [t for t, _ in p], "fp": [f for _, f in p], "n": [1] * len(p)}) for p in parts)
        assert [(r["token"], r["fp"], r["pivot"]) for b in made for r in b.to_pylist()] == want


def classes_by_hand(texts):
    """The least id of each class of the pairs at 0.8 or more."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_exact_at_the_limit_and_no_link_below(spark):
    """Pairs from 0.6 to 1 and chains of them: every pair at 0.8 or more is linked, none below."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for f in range(60):
        base = rng.choice(words, int(rng.integers(60, 200))).tolist()
        for c in range(6):
            new = list(base)
            for i in rng.choice(len(base), int(rng.integers(0, len(base) // 20 + 2)), replace=False):
                new[i] = f"z{rng.integers(10**9)}"
            texts[10 * f + c] = " ".join(new)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs).collect()}
    assert got == classes_by_hand(texts)


def test_blocks_and_lists_do_not_matter(spark, monkeypatch):
    """Groups in many blocks, and shingles that are not sent along, give the same classes."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choice(words, 120).tolist()
    texts = {}
    for i in range(70):
        new = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            new[k] = f"z{rng.integers(10**9)}"
        texts[i] = " ".join(new)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes_by_hand(texts)
    assert len(set(want.values())) > 3
    for block, lists in ((7, 256), (4000, 0), (5, 3)):
        monkeypatch.setattr(nc, "BLOCK", block)
        monkeypatch.setattr(nc, "LISTS", lists)
        assert {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs).collect()} == want


def test_common_tokens():
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(-50, 50, rng.integers(1, 30))) for _ in range(n)] for n in (7, 9))
    for wide in (3, 1024):
        shared, below = nc._common_tokens(x, y, 5, wide)
        for i in range(7):
            for j in range(9):
                both = np.intersect1d(x[i], y[j])
                assert (shared[i, j], below[i, j]) == (len(both), (both < 5).sum())


def test_a_shared_passage_is_one_row_a_text(spark):
    """A passage of 200 words that 50 texts share; before, each of its shingles was a row of each text, with the list of all of them."""
    rows = [(t, fp, 300, 0, 300) for t in range(196) for fp in range(50)] + [(1000 + k, fp, 300, k, 300) for k in range(9) for fp in (k, k + 1)]
    got = nc._merged(spark.createDataFrame(rows, "token long, fp long, n int, pivot long, pn int")).collect()
    assert sorted((r["token"], r["fp"], r["w"]) for r in got) == [(0, fp, 196) for fp in range(50)] + sorted((1000 + k, fp, 1) for k in range(9) for fp in (k, k + 1))


def test_weights_of_common_tokens():
    x, y = [np.array([1, 4, 9]), np.array([4])], [np.array([4, 9]), np.array([1, 7])]
    shared, below = nc._common_tokens(x, y, 9, 2, weights=[np.array([5, 1, 3]), np.array([1])])
    assert shared.tolist() == [[4, 5], [1, 0]] and below.tolist() == [[1, 5], [1, 0]]


def test_a_text_is_joined_once_for_all_its_shingles(spark):
    """40 texts that share 30 open shingles: 40 rows joined; before, one for each of the 1,200 (text, shingle)."""
    rows = spark.createDataFrame([(t, fp, 30, 1, fp, 0, 1, 40) for t in range(30) for fp in range(40)], "token long, fp long, n int, w int, c long, main long, main_n long, total long")
    nodes = spark.createDataFrame([(fp, bytearray(32)) for fp in range(40)], "fp long, sketch binary")
    texts = nc._by_text(rows, nodes).collect()
    assert sorted(r["fp"] for r in texts) == list(range(40)) and {len(r["open"]) for r in texts} == {30}
    want = [(a, b, 30) for a in range(40) for b in range(a + 1, 40)]
    assert sorted((r["a"], r["b"], r["k"]) for r in nc._across(rows, nodes, 0.8).collect()) == want


def test_near_dedup_walks_the_tries_first(spark, monkeypatch):
    """The tries of the SimHashes find nearly all copies over 0.9 by themselves; the exact join gives the same classes without them.

    Before, no trie was asked: candidates came from shared shingles alone.
    """
    import corpus_pipeline

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for f in range(150):
        base = rng.choice(words, 250).tolist()
        texts[2 * f] = " ".join(base)
        base[int(rng.integers(5, 245))] = f"z{f}"
        if f % 3 == 0:
            base[int(rng.integers(5, 245))] = f"y{f}"
        texts[2 * f + 1] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked, linked = [], []
    walk, verified = nc.near_partners, nc._verified

    def partners(*args, **options):
        asked.append(args)
        return walk(*args, **options)

    def links(*args, **options):
        out = verified(*args, **options)
        linked.append(out.count())
        return out

    monkeypatch.setattr(nc, "near_partners", partners)
    monkeypatch.setattr(nc, "_verified", links)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert kept == set(range(0, 300, 2)) and len(asked) == 1
    assert linked[0] >= 140  # of 150, before any shingle is joined
    monkeypatch.setattr(nc, "near_partners", lambda *args, **options: walk(*args, **options).where("false"))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == kept
