"""Repair of conversations: the cheapest edits after which the roles read ``(system? (user assistant)+)?``.

The rows of a conversation go by turn through a forward Viterbi pass over four grammar states (nothing yet, after system, after
user, after assistant).  Each state carries the least (cost, audit string); every row keeps, re-roles or deletes, and the layer
is closed by at most two inserted turns, more never pay.  Costs and audits order the same way at every later row, so one path a
state is enough.

Conversations are dealt out by id and streamed in order through the tasks; Spark sorts and spills.  A task holds the paths only back to
where they part: what they share is emitted, to a hash or as rows, so texts do not pile up.  States that cost over ``SLACK`` more than the
best one can never win and go.  A conversation's repaired text has one hash, so a conversation stays with one task, as a stream.

Defined results: rows of a conversation are ordered by turn (null first), role and text; a null role or text is one space;
a role's initial is its first character, and an empty role has none and is never kept; a null conv_id is a conversation of its own;
repeated rows are duplicates; extra columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .merkle import crc32_sql
from .shared import result, scratch

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SLACK = 7  # from any state, whatever another one can still do costs at most this much more
HOLD = 32
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
EMIT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
LEGAL = {"su", "ua", "au"}


class Repair:
    """One conversation, row by row; ``emit(role, text)`` is called for every turn of the repaired one, in order."""

    def __init__(self, emit):
        self.emit = emit
        self.live = self._closed({START: (0, "", ())})
        self.done: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None
        self.low = self.high = None
        self.turns = 0

    @staticmethod
    def _closed(live: dict) -> dict:
        """With up to two inserted turns after each path."""
        for _ in range(2):
            for state, (cost, audit, lines) in list(live.items()):
                role = NEXT[state]
                to = EMIT[role[0], state]
                made = (cost + INSERT, audit + "I", (*lines, (role, "")))
                if to not in live or made[:2] < live[to][:2]:
                    live[to] = made
        return live

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high  # turns ascend
            self.low, self.high = turn if self.low is None else self.low, turn
        now = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + now not in LEGAL
        self.initial = now
        end = text.rstrip(WHITE)
        must_go, extra = not end or repeated, 0
        if not end:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif end[-1] not in ".!?":
            self.truncated += 1
            extra = TRUNCATED
        new: dict = {}

        def offer(state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in self.live.items():
            offer(state, cost + DELETE, audit + "D", lines)
            if must_go:
                continue
            if (to := EMIT.get((now, state))) is not None:
                offer(to, cost + extra, audit + "K", (*lines, (role, text)))
            other = NEXT[state]
            offer(EMIT[other[0], state], cost + extra + REROLE, audit + "R", (*lines, (other, text)))
        self._closed(new)
        best = min(v[0] for v in new.values())
        self.live = {s: v for s, v in new.items() if v[0] <= best + SLACK}
        if len(next(iter(self.live.values()))[1]) >= HOLD:
            self._settle()

    def _settle(self) -> None:
        """Emit what all paths share: equal audits over the same rows give equal turns."""
        audits = [v[1] for v in self.live.values()]
        a, b = min(audits), max(audits)
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if not n:
            return
        self.done.append(a[:n])
        kept = n - a.count("D", 0, n)
        for role, text in next(iter(self.live.values()))[2][:kept]:
            self.emit(role, text)
        self.live = {s: (cost, audit[n:], lines[kept:]) for s, (cost, audit, lines) in self.live.items()}

    def finish(self) -> dict:
        cost, audit, lines = min((self.live[s] for s in (START, ASSISTANT) if s in self.live), key=lambda v: v[:2])
        for role, text in lines:
            self.emit(role, text)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.done) + audit}


def in_order(rows: DataFrame, gone: str | None) -> DataFrame:
    """(c, turn, role, text, repeated, gone) by conversation, in order; one shuffle, sorts that spill."""
    left = F.lit(False) if gone is None else F.col(gone)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col("conv_id").alias("c"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), left.alias("gone"))
    same = Window.partitionBy("c", "gone", "role", "text").orderBy("turn")
    dealt = plain.repartition("c").withColumn("repeated", F.row_number().over(same) > 1)
    return dealt.sortWithinPartitions("c", "turn", "role", "text", "repeated").select("c", "turn", "role", "text", "repeated", "gone")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*[column.to_pylist() for column in batch.slice(at, 256).columns])


def _over(rows: DataFrame, gone: str | None, make, schema: str) -> DataFrame:
    """``make()`` gives, for each task, a function of (id, emit) -> what to do at a conversation's end, and the rows made so far."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make()
        now, conv = (), None
        for c, turn, role, text, repeated, left in _streamed(batches):
            if (c,) != now:
                if conv is not None:
                    out.close(now[0], conv)
                now, conv = (c,), Repair(out.open())
            if not left:
                conv.add(turn, role, text, repeated)
            if out.full():
                yield out.take(now[0])
        if conv is not None:
            out.close(now[0], conv)
        yield out.take(None)

    return in_order(rows, gone).mapInArrow(run, f"conv_id {kind}, {schema}")


class _Reports:
    NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows = kind, []

    def open(self):
        self.hash, self.first = hashlib.sha256(), True

        def emit(role: str, text: str) -> None:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False

        return emit

    def close(self, conv_id, conv: Repair) -> None:
        self.rows.append({"conv_id": conv_id, **conv.finish(), "repaired_sha256": self.hash.hexdigest()})

    def full(self) -> bool:
        return len(self.rows) >= 2_000

    def take(self, _) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [self.kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(self.NAMES, kinds)], names=self.NAMES)


class _Turns:
    NAMES = ["conv_id", "place", "role", "text"]

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.held, self.place, self.bytes = kind, [], [], 0, 0

    def open(self):
        self.place = 0

        def emit(role: str, text: str) -> None:
            self.held.append((self.place, role, text))
            self.bytes += len(text)
            self.place += 1

        return emit

    def _name(self, conv_id) -> None:
        self.rows += [(conv_id, *x) for x in self.held]
        self.held = []

    def close(self, conv_id, conv: Repair) -> None:
        conv.finish()
        self._name(conv_id)

    def full(self) -> bool:
        return len(self.rows) + len(self.held) >= 5_000 or self.bytes >= 8_000_000

    def take(self, conv_id) -> pa.RecordBatch:
        self._name(conv_id)
        rows, self.rows, self.bytes = self.rows, [], 0
        kinds = [self.kind, pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=self.NAMES)


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def repaired(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, numbered from 0.

    rows: (conv_id, turn, role, text); ``gone`` names a boolean column, true for rows that only stand for their conversation.
    """
    kind = _arrow(rows)
    return _over(rows, gone, lambda: _Turns(kind), "place long, role string, text string")


def reports(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost and audit of the edits, and a digest of the repaired text."""
    kind = _arrow(rows)
    return _over(rows, gone, lambda: _Reports(kind), "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows dropped (``gone``), emptied, stripped of stops, repeated or given to the user, by a hash of (conv_id, turn)."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn")).cast("binary")) % 20
    text = F.when(x == 1, "").when(x == 2, F.regexp_replace(at("text"), "[.!?]", "")).otherwise(at("text"))
    gone = F.when(x == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(x == 0))
    return rows.select("conv_id", "turn", F.when(x == 4, "user").otherwise(at("role")).alias("role"), text.alias("text"), F.explode(gone).alias("gone"))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    with scratch(spark) as made:
        return result(reports(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "gone"), "conversation_reports", made)


def _add(s: str, cost: str, mark: str, line: str | None = None) -> str:
    """A state's path with one more edit; null stays null."""
    text = f"{s}.t" if line is None else f"{s}.t || {line} || chr(10)"
    return f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{mark}', 't': {text}}} END"


def _close(cols: str, inner: str) -> str:
    ins = lambda s, role: _add(s, str(INSERT), "I", f"'{role}:'")
    return f"(SELECT {cols}, s0, s1, least(s2, {ins('s0', 'user')}, {ins('s1', 'user')}, {ins('s3', 'user')}) AS s2, least(s3, {ins('s2', 'assistant')}) AS s3 FROM {inner})"


def _oracle() -> str:
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    start = _close("conv_id, i", _close("conv_id, i", f"(SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM conversations)"))
    keep = lambda s, initial: f"CASE WHEN NOT f.must AND f.role[1] = '{initial}' THEN {_add(s, 'f.extra', 'K', line)} END"
    line = "(f.role || ':' || f.text)"
    again = lambda s, role: f"CASE WHEN NOT f.must THEN {_add(s, f'f.extra + {REROLE}', 'R', f"""('{role}:' || f.text)""")} END"
    gone = lambda s: _add(s, str(DELETE), "D")
    user = ", ".join(f"{keep(s, 'u')}, {again(s, 'user')}" for s in ("s0", "s1", "s3"))
    step = f"""(SELECT v.conv_id, v.i + 1 AS i, {gone('s0')} AS s0, least({gone('s1')}, {keep('s0', 's')}) AS s1, least({gone('s2')}, {user}) AS s2,
  least({gone('s3')}, {keep('s2', 'a')}, {again('s2', 'assistant')}) AS s3 FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1)"""
    crc = crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    white = r"\x20\x09-\x0D"
    return rf"""WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS x FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT * FROM x UNION ALL SELECT * FROM x WHERE x = 3) WHERE x <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  NOT regexp_matches(text, '[^{white}]') AS blank, NOT regexp_matches(text, '[.!?][{white}]*$') AS cut FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS extra, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM e),
v AS ((SELECT * FROM {start}) UNION ALL (SELECT * FROM {_close('conv_id, i', _close('conv_id, i', step))})),
w AS (SELECT conv_id, unnest([least(s0, s3)], recursive := true) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS r FROM v) WHERE r = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra > 0) AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT w.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(c AS BIGINT) AS cost, a AS audit, sha256(CASE WHEN t = '' THEN '' ELSE left(t, length(t) - 1) END) AS repaired_sha256
FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLE = _oracle()
