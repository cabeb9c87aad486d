"""Merkle manifest, line dedup and conversation repair against plain versions and SQL."""
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from motifspark.llm import line_dedup, merkle, turn_repair
from motifspark.llm.shared import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def saved(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def duck(tmp_path, name, sql, cols):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)


def collected(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- manifest ---


def plain_tree(nodes, fan):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            a = p - p % fan
            run = nodes[a : a + fan]
            paths[k].append(("".join(run[: p - a]), "".join(run[p - a + 1 :])))
            at[k] = p // fan
        nodes = [sha("".join(nodes[a : a + fan])) for a in range(0, len(nodes), fan)]
    return nodes[0], paths


def plain_manifest(rows, fan):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    made = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((mine, *plain_tree([leaf(r, r[1]) for r in mine], fan)))
    root, tops = plain_tree([m[1] for m in made], fan)
    out = []
    for (mine, sub, paths), top in zip(made, tops):
        for r, path in zip(mine, paths):
            node = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf(r, None if r[1] is None else r[1].translate(LOW))
            for a, b in path + top:
                node = sha(a + node + b)
            out.append((r[0], leaf(r, r[1]), sub, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
ODD = [(None, None, None, None, None), (None, "A", "en", None, 1), (7, "", None, "é", 0), (7, "", None, "é", 0), (7, "Ünï Code\nX", "", "e", 10), (8, "Z" * 50_000, "de", "e", 50_000)]


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300])
def test_manifest(spark, tmp_path, n):
    rows = ODD * (n > 1) + [(100 + i, f"Text {i}", "en", None if i % 7 == 0 else f"s{i % 3 if i % 3 else 'big'}", i) for i in range(n)]
    d = saved(spark, tmp_path, rows, DOCS, "documents")
    mine = collected(merkle.op11_merkle(spark, d), MANIFEST)
    assert mine == (plain_manifest(rows, 16) if rows else [])
    assert mine == duck(tmp_path, "documents", merkle.ORACLE, MANIFEST)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest_does_not_depend_on_blocks(spark, depth):
    """Several rounds: 300 rows of one source, runs of 2 or 3."""
    rows = [(i, f"Text {i}", "en", "one", i) for i in range(300)] + [(1000 + i, "x", None, f"s{i}", i) for i in range(9)]
    fan = 3 if depth == 1 else 2
    with scratch(spark):
        docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS path", "1 AS g", "'y' AS node")
        found = merkle.manifest(docs, fan, depth, merkle.verified)
        out = collected(found.selectExpr("*", "folded_root = root AS verified"), MANIFEST)
    assert out == plain_manifest(rows, fan)


def test_manifest_paths_fold_to_the_root(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 4}", i) for i in range(40)]
    with scratch(spark):
        for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect():
            node = r["node"]
            for x in r["path"]:
                node = sha(x["l"] + node + x["r"])
            assert node == r["root"]


# --- lines ---


def plain_lines(rows, least=3, chars=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    split = [(t or "").split("\n") for _, t in rows]
    held = {}
    for k, lines in enumerate(split):
        for x in {key(line) for line in lines}:
            held.setdefault(x, []).append(k)
    out = []
    for (i, _), lines in zip(rows, split):
        kept = []
        for line in lines:
            docs = held[key(line)]
            ids = [rows[k][0] for k in docs if rows[k][0] is not None]
            gone = len(key(line)) >= chars and len(docs) >= least and ids and (i is None or i < max(ids))
            if not gone:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


LINES = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def line_rows(seed, n):
    rnd = random.Random(seed)
    pool = [f"This line number {k} is long enough" for k in range(12)] + ["short", "", "Ein Satz mit Ümläuten, lang genug", "THIS LINE NUMBER 1 IS LONG ENOUGH", "\t This line number 2 is long enough \r", "x" * 20, "y" * 19]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8)))) for i in range(n)]
    return [*rows, (None, pool[0] + "\n" + pool[1]), (None, None), (3, pool[0]), (3, pool[0]), (n, ""), (n + 1, "\n\n"), (n + 2, "\n".join([pool[3], *[f"A long text's own line number {k}" for k in range(3000)], pool[3]]))]


@pytest.mark.parametrize("n", [0, 40])
def test_lines(spark, tmp_path, n):
    rows = line_rows(n, n) if n else []
    d = saved(spark, tmp_path, [(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_lines int, h string, lost int", "documents")
    mine = collected(line_dedup.op12_line_dedup(spark, d), LINES)
    assert mine == plain_lines(rows)
    assert mine == duck(tmp_path, "documents", line_dedup.ORACLE, LINES)


def test_lines_only_held_by_rows_without_ids_stay(spark):
    df = spark.createDataFrame([(None, "a line that is long enough to count")] * 4, "doc_id long, text string")
    with scratch(spark):
        assert {r["text"] for r in line_dedup.dedup_lines(df).collect()} == {"a line that is long enough to count"}


def test_lines_keep_other_columns(spark):
    line = "the same long line in all of them"
    df = spark.createDataFrame([(i, i * 10, f"{line}\nown {i}") for i in range(5)], "`my.id` long, n_lines long, body string")
    with scratch(spark):
        out = sorted(tuple(r) for r in line_dedup.dedup_lines(df, "my.id", "body").collect())
    assert out[0] == (0, 0, "own 0", 2, 1) and out[4] == (4, 40, f"{line}\nown 4", 2, 0)


@pytest.mark.parametrize("seed", range(3))
def test_runs_in_any_order(spark, seed):
    """Batches in any order of ids give the same lines, and runs are compacted."""
    rnd = random.Random(seed)
    pairs = [(bytes([rnd.randint(0, 9)]) * 2, rnd.randint(0, 30)) for _ in range(60)]
    pairs = sorted(set(pairs), key=lambda _: rnd.random())
    index = line_dedup.LineRuns(spark, fan=2, buckets=3)
    try:
        for k in range(5):
            index.add(spark.createDataFrame([p for i, p in enumerate(pairs) if i % 5 == k], "h binary, id long"))
            assert all(len(level) < 2 for level in index.levels)
        got = {bytes(r["h"]): r["keeper"] for r in index.common().collect()}
    finally:
        index.close()
    held = {}
    for h, i in pairs:
        held.setdefault(h, []).append(i)
    assert got == {h: max(v) for h, v in held.items() if len(v) >= 3}


# --- conversations ---


def plain_repair(rows):
    """By Dijkstra over (row, state), with the whole audit as part of the cost."""
    import heapq

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, facts = set(), []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else ""
        seen.add((role, text))
        facts.append(fault)
        if fault:
            count[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, end, lines = heapq.heappop(heap)
        if i == len(rows) and end in ("", "a"):
            return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
        if (i, end) in done:
            continue
        done.add((i, end))
        role = "assistant" if end == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, end, lines))
        if facts[i] in ("blank", "duplicate"):
            continue
        more = 3 if facts[i] else 0
        _, mine, text = rows[i]
        if mine[:1] == role[0] or (mine[:1] == "s" and end == ""):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, mine[0], (*lines, f"{mine}:{text}")))
        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, role[0], (*lines, f"{role}:{text}")))


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if x == 1 else "".join(c for c in text if c not in ".!?") if x == 2 else text
        mine += [(turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    return out


TURNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CONV = "conv_id long, turn long, role string, text string"


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "and then", " ", "", "Why? ", "Ünï.", None, "End.\n", "a" * 3000]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent"]
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, longest)):
            turn = None if rnd.random() < 0.05 else t + (rnd.random() < 0.1) * 3
            rows.append((c if c else None, turn, rnd.choice(roles if c % 2 else roles[:3]), rnd.choice(texts) if rnd.random() < 0.3 else f"Turn {rnd.randint(0, 50)}."))
    return rows


@pytest.mark.parametrize("n,longest", [(0, 1), (120, 7), (12, 150)])
def test_conversations(spark, tmp_path, n, longest):
    rows = conversations(n, n, longest)
    rows += rows[:5]
    d = saved(spark, tmp_path, [(*r, 1, "x") for r in rows], CONV + ", place int, gone string", "conversations")
    mine = collected(turn_repair.op13_turn_repair(spark, d), TURNS)
    assert mine == sorted(((c, *plain_repair(v)) for c, v in plain_damage(rows).items()), key=str)
    assert mine == duck(tmp_path, "conversations", turn_repair.ORACLE, TURNS)


def test_cheapest_of_all_edits():
    """All edit sequences of short conversations, with up to two inserted turns at every place."""
    import re

    words = ["".join(w) for k in range(3) for w in itertools.product("ua", repeat=k)]
    for roles in itertools.product("sua", repeat=3):
        for cut in (0, 1):
            rows = [(i, {"s": "system", "u": "user", "a": "assistant"}[r], "ok" if cut and i == 1 else f"{i}.") for i, r in enumerate(roles)]
            best = None
            for ops in itertools.product("DKua", repeat=3):
                for ins in itertools.product(words, repeat=4):
                    made = ins[0] + "".join(({"D": "", "K": roles[i]}.get(o, o)) + ins[i + 1] for i, o in enumerate(ops))
                    if not re.fullmatch("(s?(ua)+)?", made):
                        continue
                    cost = sum(3 * len(w) for w in ins) + sum({"D": 4, "K": 0}.get(o, 3) + 3 * (o != "D" and rows[i][2] == "ok") for i, o in enumerate(ops))
                    audit = "I" * len(ins[0]) + "".join(("R" if o in "ua" else o) + "I" * len(ins[i + 1]) for i, o in enumerate(ops))
                    if best is None or (cost, audit) < best:
                        best = (cost, audit)
            conv = turn_repair.Repair(lambda role, text: None)
            for turn, role, text in rows:
                conv.add(turn, role, text, False)
            got = conv.finish()
            assert (got["cost"], got["audit"]) == best


def test_repaired_turns(spark):
    rows = conversations(5, 30, 90)
    out = {}
    for r in turn_repair.repaired(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in turn_repair.reports(spark.createDataFrame(rows, CONV)).collect()}
    for c, h in hashes.items():
        turns = out.get(c, [])
        assert [t[0] for t in turns] == list(range(len(turns)))
        assert sha("\n".join(f"{r}:{t}" for _, r, t in turns)) == h
        assert "".join(r[0] for _, r, _ in turns).removeprefix("s").replace("ua", "") == ""


def test_paths_are_settled_on_the_way():
    """A long conversation's texts do not pile up."""
    sent = []
    conv = turn_repair.Repair(lambda role, text: sent.append(role))
    for i in range(5000):
        conv.add(i, "user" if i % 3 else "assistant", f"{i}.", i % 7 == 0)
        assert max(len(v[2]) for v in conv.live.values()) < 100
    conv.finish()
    assert len(sent) > 3000
