"""Secret scans: fixed rules, and a character convolutional network for what the rules do not name.

One pass over the whole texts finds the rule findings (assignments, access keys, hex runs) and every other candidate: a run of
16 or more key characters with both letters and digits.  The network (numpy) sees a candidate with its surroundings.
It learns from all findings, at every size: the values that the rules found against candidates that no rule explains and other long
runs, each value once.  Tasks train on their own values, their weights are averaged, and calibration and threshold come from counts of all outputs.  Rule findings stand beside the words that gave them away, so in half of the training they are set into the surroundings of others.
The values are split three ways, so that none is in two parts: for the weights, for the calibration, and for the threshold, which keeps
the wanted recall on values set into surroundings of others; ``CharCNN.measured`` has what it reaches there.  Among the candidates
are secrets that no rule knows, so its false alarms are an upper bound.  Rule findings always stay; the network adds spans of kind ``model``.

Defined results: null and empty texts have no spans; without findings to learn from nothing is added; spans are in code
points, end exclusive, ordered by start and kind; rows repeated stay repeated; extra columns are kept by ``redact``
and never clash.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_model import _averaged
from .shared import materialise
from .textbatch import BYTES, Chunk, map_text, new_name, quoted, released

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
KINDS = ["assign", "access", "hex", "model"]
SHORTEST, LEFT, BODY, RIGHT = 16, 16, 64, 16
WIDTH = LEFT + BODY + RIGHT
TURNS, TASK_VALUES = 3, 8000  # of training; about so many values a task
BINS, REACH = 4096, 32.0  # of the network's outputs, for calibration and threshold
RECALL = 0.95

_HEX = (BYTES >= 48) & (BYTES <= 57) | (BYTES >= 97) & (BYTES <= 102)
_DIGIT = (BYTES >= 48) & (BYTES <= 57)
_ALPHA = (BYTES >= 65) & (BYTES <= 90) | (BYTES >= 97) & (BYTES <= 122)
_KEY = _DIGIT | _ALPHA | np.isin(BYTES, [ord(c) for c in "+/_.=-"])
_CODE = np.where((BYTES >= 32) & (BYTES < 127), BYTES - 31, 96).astype(np.uint8)  # 0 is padding


def _finds(raw: bytes, word: bytes) -> list[int]:
    out, at = [], raw.find(word)
    while at >= 0:
        out.append(at)
        at = raw.find(word, at + 1)
    return out


def _rows(chunk: Chunk, at: list[int]) -> list[int]:
    return np.unique(np.searchsorted(chunk.off, np.array(at, dtype=np.int64), "right") - 1).tolist() if at else []


def _windows(raw: bytes, a: int, b: int, low: int, high: int) -> list[bytes]:
    """The candidate [a, b) in pieces of BODY bytes, each a fixed-width record: flags of the body, then the bytes with surroundings."""
    out = []
    for s in range(a, b, BODY):
        e = min(s + BODY, b)
        left, right = raw[max(low, s - LEFT) : s], raw[e : min(high, e + RIGHT)]
        out.append(bytes([LEFT, e - s]) + left.rjust(LEFT, b"\0") + (raw[s:e] + right).ljust(BODY + RIGHT, b"\0"))
    return out


@dataclass
class Found:
    spans: dict[int, list[tuple[int, int, int]]]  # row: (byte start, kind, byte end)
    candidates: dict[int, list[tuple[int, int, list[bytes]]]]
    positive: dict[int, list[bytes]]
    negative: dict[int, list[bytes]]


def scan(chunk: Chunk, examples: bool = True) -> Found:
    raw, off = chunk.data.tobytes(), chunk.off.tolist()
    low = chunk.lower.tobytes()
    found = Found({}, {}, {}, {})
    bodies: dict[int, list[tuple[int, int]]] = {}

    def add(row: int, kind: int, a: int, b: int, body: tuple[int, int]) -> None:
        found.spans.setdefault(row, []).append((a, kind, b))
        bodies.setdefault(row, []).append(body)

    for row in _rows(chunk, [x for w in WORDS for x in _finds(low, w)]):
        for m in ASSIGN.finditer(raw, off[row], off[row + 1]):
            if m.end(2) - m.start(2) >= 6:
                add(row, 0, m.start(), m.end(), m.span(2))
    for row in _rows(chunk, _finds(raw, b"AKIA")):
        for m in ACCESS.finditer(raw, off[row], off[row + 1]):
            if m.end() - m.start() >= 20:
                add(row, 1, m.start(), m.end(), m.span())
    starts, ends, first = chunk.runs(_HEX[chunk.data])
    rows = chunk.rows_of(first)
    for i in np.flatnonzero(ends - starts >= 24).tolist():
        add(int(rows[i]), 2, int(starts[i]), int(ends[i]), (int(starts[i]), int(ends[i])))

    merged: list[list[int]] = []  # the spans of all rows, in order and disjoint
    for x, y in sorted((x, y) for spans in found.spans.values() for x, _, y in spans):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    until = [y for _, y in merged]

    def free(a: int, b: int) -> bool:
        i = bisect_right(until, a)
        return i == len(merged) or merged[i][0] >= b

    starts, ends, first = chunk.runs(_KEY[chunk.data])
    rows = chunk.rows_of(first)
    size = ends - starts
    digits, letters = np.concatenate([[0], np.cumsum(_DIGIT[chunk.data])]), np.concatenate([[0], np.cumsum(_ALPHA[chunk.data])])
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    for i in np.flatnonzero((size >= SHORTEST) & mixed).tolist():
        row, a, b = int(rows[i]), int(starts[i]), int(ends[i])
        while b > a and raw[b - 1] in b".=-_":
            b -= 1
        if b - a >= SHORTEST and free(a, b):
            found.candidates.setdefault(row, []).append((a, b, _windows(raw, a, b, off[row], off[row + 1])))
    if examples:
        for row, spans in bodies.items():
            found.positive[row] = [w for a, b in spans for w in _windows(raw, a, b, off[row], off[row + 1])[:1]]
        plain = np.flatnonzero((size >= 10) & ~mixed)
        order = plain[np.lexsort((chunk.lower[starts[plain]].astype(int) * 7919 + starts[plain] - chunk.off[rows[plain]], rows[plain]))]
        one = order[np.unique(rows[order], return_index=True)[1]] if len(order) else order  # one a row
        for i in one.tolist():
            row, a, b = int(rows[i]), int(starts[i]), int(ends[i])
            if free(a, b):
                found.negative.setdefault(row, []).extend(_windows(raw, a, b, off[row], off[row + 1])[:1])
    return found


def _points(chunk: Chunk, row: int):
    """Byte offsets of the chunk to code points of the row."""
    part = chunk.data[chunk.off[row] : chunk.off[row + 1]]
    lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return lambda at: int(lead[at - int(chunk.off[row])])


# --- the network -----------------------------------------------------------------------------------------------


@dataclass
class CharCNN:
    """Embedding, one convolution of width 5, largest value over the window, logistic output; then calibration and threshold."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    measured: dict[str, float] = field(default_factory=dict)  # on the values kept for the threshold

    def _input(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rec = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH + 2)
        text = rec[:, 2:]
        code = np.where(text == 0, 0, _CODE[text])
        at = np.arange(WIDTH)
        body = (at >= LEFT) & (at < LEFT + rec[:, 1:2])
        return code, body

    def _forward(self, code, body):
        x = np.concatenate([self.embed[code], body[:, :, None]], axis=2).astype(np.float32)
        cols = np.concatenate([x[:, i : WIDTH - 4 + i] for i in range(5)], axis=2)
        pre = cols @ self.kernel + self.bias
        top = pre.argmax(axis=1)
        peak = np.take_along_axis(pre, top[:, None, :], axis=1)[:, 0]
        hidden = np.maximum(peak, 0)
        return cols, top, hidden, hidden @ self.out + self.out_bias

    def logit(self, windows: list[bytes]) -> np.ndarray:
        out = [self._forward(*self._input(windows[i : i + 2000]))[3] for i in range(0, len(windows), 2000)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logit(windows) + self.shift, -30, 30)))


def _body(w: bytes) -> bytes:
    return w[2 + LEFT : 2 + LEFT + w[1]]


def _within(w: bytes, other: bytes) -> bytes:
    """The candidate of a window in the surroundings of another."""
    n, m = w[1], other[1]
    right = other[2 + LEFT + m : 2 + LEFT + m + RIGHT]
    return w[:2] + other[2 : 2 + LEFT] + (_body(w) + right).ljust(BODY + RIGHT, b"\0")


def _parts(windows: list[bytes]) -> list[list[bytes]]:
    """One window of each value, in three parts: for the weights, the calibration and the threshold."""
    parts: list[list[bytes]] = [[], [], []]
    for body, w in {_body(w): w for w in sorted(windows)}.items():
        parts[(0, 0, 0, 1, 2)[xxhash.xxh64_intdigest(body, 9) % 5]].append(w)
    return [p or [w for q in parts for w in q] for p in parts]  # of a handful of values, all serve everywhere


PARAMS = ["embed", "kernel", "bias", "out", "out_bias"]


def _fresh(rng: np.random.Generator) -> CharCNN:
    return CharCNN(rng.normal(0, 0.3, (97, 8)).astype(np.float32), rng.normal(0, 0.15, (45, 16)).astype(np.float32), np.zeros(16, np.float32), rng.normal(0, 0.3, 16).astype(np.float32), 0.0)


def _set_in(windows: list[bytes], others: list[bytes], rng: np.random.Generator) -> list[bytes]:
    return [_within(w, others[rng.integers(len(others))]) for w in windows] if others else windows


def _label_weights(positive: int, negative: int) -> tuple[float, float]:
    """Of a negative and a positive value."""
    share = positive / max(positive + negative, 1)
    return min(0.5 / max(1 - share, 1e-3), 8.0), min(0.5 / max(share, 1e-3), 8.0)


def _epochs(epochs: int, values: int) -> int:
    return max(epochs, min(60, -(-1500 * epochs // max(values, 1))))  # few values are seen more often


def _learn(net: CharCNN, windows: list[bytes], y: np.ndarray, weight: np.ndarray, others: list[bytes], epochs: int, rng: np.random.Generator, rate: float = 0.01) -> None:
    """Epochs over the windows, half of them set into the surroundings of others."""
    m = {p: 0.0 for p in PARAMS}
    v = {p: 0.0 for p in PARAMS}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            pick = order[i : i + 128]
            batch = [_within(windows[j], others[rng.integers(len(others))]) if others and rng.random() < 0.5 else windows[j] for j in pick]
            code, body = net._input(batch)
            cols, top, hidden, logit = net._forward(code, body)
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            dh = np.outer(d, net.out) * (hidden > 0)
            picked = cols[np.arange(len(pick))[:, None], top]  # (n, 16, 45)
            dcol = dh[:, :, None] * net.kernel.T[None]
            dembed = np.zeros_like(net.embed)
            for w in range(5):
                np.add.at(dembed, np.take_along_axis(code, top + w, axis=1), dcol[:, :, 9 * w : 9 * w + 8])
            grad = {"embed": dembed, "kernel": np.einsum("nf,nfc->cf", dh, picked), "bias": dh.sum(axis=0), "out": hidden.T @ d, "out_bias": d.sum()}
            step += 1
            for p in PARAMS:
                m[p] = 0.9 * m[p] + 0.1 * grad[p]
                v[p] = 0.999 * v[p] + 0.001 * np.square(grad[p])
                setattr(net, p, getattr(net, p) - rate * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.999**step)) + 1e-8))


def _bins(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def _settle(net: CharCNN, counts: np.ndarray) -> CharCNN:
    """Calibration and threshold from ``counts`` (part, label, bin) of the outputs, parts 0 for the calibration and 1 for the threshold."""
    edge = (np.arange(BINS + 1) * (2 * REACH / BINS)) - REACH
    logit, n = (edge[:-1] + edge[1:]) / 2, max(counts[0].sum(), 1)
    scale, shift = 1.0, 0.0
    for _ in range(300):  # Platt's calibration
        p = 1 / (1 + np.exp(-np.clip(scale * logit + shift, -30, 30)))
        off = (counts[0].sum(axis=0) * p - counts[0, 1]) / n
        scale -= 0.05 * (off * logit).sum()
        shift -= 0.05 * off.sum()
    net.scale, net.shift = float(max(scale, 0.05)), float(shift)
    others, kept = counts[1]
    p = 1 / (1 + np.exp(-np.clip(net.scale * edge + net.shift, -30, 30)))
    p[0] = 0.0
    limit = float(p[np.searchsorted(np.cumsum(kept), int((1 - RECALL) * kept.sum()), "right")])  # any threshold up to this one keeps the recall
    false = float(p[min(np.searchsorted(np.cumsum(others), 0.999 * others.sum()) + 1, BINS)])
    net.threshold = min(limit, (limit + false) / 2) if false < limit else limit
    net.measured = {
        "recall": float(kept[p[:-1] >= net.threshold].sum() / max(kept.sum(), 1)), "false_alarms": float(others[p[1:] >= net.threshold].sum() / max(others.sum(), 1)),
        "values": float(kept.sum()), "others": float(others.sum()),
    }
    return net


def train(positive: list[bytes], negative: list[bytes], epochs: int = 12, seed: int = 7) -> CharCNN | None:
    """A network from lists of windows, in this process."""
    if len(positive) < 10 or len(negative) < 10:
        return None
    rng = np.random.default_rng(seed)
    pos, neg = _parts(positive), _parts(negative)
    net = _fresh(rng)
    y = np.r_[np.ones(len(pos[0])), np.zeros(len(neg[0]))]
    _learn(net, pos[0] + neg[0], y, np.where(y > 0, *_label_weights(len(pos[0]), len(neg[0]))[::-1]), neg[0], _epochs(epochs, len(y)), rng)
    counts = np.zeros((2, 2, BINS), np.int64)
    for part in (1, 2):
        for label, windows in ((0, neg[part]), (1, _set_in(pos[part], neg[part], rng))):
            counts[part - 1, label] = np.bincount(_bins(net.logit(windows)), minlength=BINS)
    return _settle(net, counts)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: bool = True) -> DataFrame:
    """(doc_id, spans, candidates, positive, negative) of every row, without the network's verdict."""

    def make():
        def apply(chunk: Chunk) -> dict:
            found = scan(chunk, examples)
            spans, cands = [[]] * chunk.n, [[]] * chunk.n
            for row in {*found.spans, *found.candidates}:
                at = _points(chunk, row)
                spans[row] = [{"start": at(a), "kind": k, "end": at(b)} for a, k, b in sorted(found.spans.get(row, []))]
                cands[row] = [{"start": at(a), "end": at(b), "windows": w} for a, b, w in found.candidates.get(row, [])]
            return {"spans": spans, "candidates": cands, "positive": [found.positive.get(i, []) for i in range(chunk.n)], "negative": [found.negative.get(i, []) for i in range(chunk.n)]}

        return apply

    out = "spans array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,windows:array<binary>>>, positive array<binary>, negative array<binary>"
    return map_text(docs, text_col, make, out, [id_col]).withColumnRenamed(id_col, "doc_id")


def _values(found: DataFrame) -> DataFrame:
    """(y, w, part, h): one window of each value and label; parts 0 to 2 for the weights, 3 for the calibration, 4 for the threshold."""
    some = lambda c, y: found.where(F.size(c) > 0).select(F.explode(c).alias("w")).select(F.lit(y).alias("y"), "w")
    candidates = found.where(F.size("candidates") > 0).select(F.explode("candidates.windows").alias("ws")).select(F.lit(0).alias("y"), F.col("ws")[0].alias("w"))
    listed = some("positive", 1).unionByName(candidates).unionByName(some("negative", 0))
    size = F.conv(F.hex(F.substring("w", 2, 1)), 16, 10).cast("int")
    one = listed.groupBy("y", F.col("w").substr(F.lit(3 + LEFT), size).alias("body")).agg(F.max("w").alias("w"))
    h = F.xxhash64("body")
    return one.select("y", "w", F.pmod(h, F.lit(5)).cast("int").alias("part"), F.xxhash64(h).alias("h"))


def _windows_of(batches) -> tuple[np.ndarray, list[bytes]]:
    y, windows = [], []
    for b in batches:
        y += b.column(0).to_pylist()
        windows += b.column(1).to_pylist()
    return np.array(y, np.float64), windows


def _trainer(sent, weights: tuple[float, float], epochs: int, rate: float, seed: int):
    """Batches (y, w) of a task to one row (tokens, weights): the network after the epochs over them."""

    def run(batches):
        y, windows = _windows_of(batches)
        if len(y):
            net = CharCNN(*[getattr(sent.value, p) for p in PARAMS])
            others = [w for w, t in zip(windows, y) if t == 0]
            _learn(net, windows, y, np.where(y > 0, weights[1], weights[0]), others, epochs, np.random.default_rng(seed), rate)
            flat = np.concatenate([np.ravel(getattr(net, p)) for p in PARAMS]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([float(len(y))]), pa.array([flat.tobytes()], pa.binary())], names=["tokens", "weights"])
        released()

    return run


def _outputs(sent, seed: int):
    """Batches (y, w, part) of a task, part 0 or 1, to the counts (part, y, bin, c) of the network's outputs."""

    def run(batches):
        counts, rng = np.zeros((2, 2, BINS), np.int64), np.random.default_rng(seed)
        for b in batches:
            y, windows = _windows_of([b])
            part = np.asarray(b.column(2))
            for k in (0, 1):
                mine = np.flatnonzero(part == k)
                others = [windows[i] for i in mine if y[i] == 0]
                counts[k, 0] += np.bincount(_bins(sent.value.logit(others)), minlength=BINS)
                counts[k, 1] += np.bincount(_bins(sent.value.logit(_set_in([windows[i] for i in mine if y[i] > 0], others, rng))), minlength=BINS)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in at], pa.array(counts[at])], names=["part", "y", "bin", "c"])
        released()

    return run


def fit(found: DataFrame, epochs: int = 12, seed: int = 7) -> CharCNN | None:
    """A network from all findings: trained in tasks whose weights are averaged, calibrated on counts of its outputs."""
    spark = found.sparkSession
    values = materialise(_values(found), "secret_values")
    held = np.zeros((2, 5), np.int64)
    for r in values.groupBy("y", "part").count().collect():  # ten rows
        held[r["y"], r["part"]] = r["count"]
    if held.sum(axis=1).min() < 10:
        return None

    def of(parts: list[int]) -> DataFrame:
        """The values of some parts; of a label of a handful of values, all serve everywhere."""
        spare = [y for y in (0, 1) if not held[y, parts].sum()]
        return values.where(F.col("part").isin(parts) | F.col("y").isin(spare))

    learned = of([0, 1, 2])
    size = [int(held[y, :3].sum() or held[y].sum()) for y in (0, 1)]
    tasks = max(1, round(sum(size) / TASK_VALUES))
    net = _fresh(np.random.default_rng(seed))
    for turn in range(TURNS):
        sent = spark.sparkContext.broadcast(net)
        dealt = learned.repartition(tasks, "h").sortWithinPartitions("h", "y", "w").select("y", "w")
        run = _trainer(sent, _label_weights(size[1], size[0]), -(-_epochs(epochs, sum(size)) // TURNS), 0.01 / 2**turn, seed + turn)
        flat, at, read = _averaged(materialise(dealt.mapInArrow(run, "tokens double, weights binary"), "weights")), 0, {}
        for p in PARAMS:
            shape = np.shape(getattr(net, p))
            n = int(np.prod(shape))
            read[p], at = flat[at : at + n].reshape(shape).astype(np.float32), at + n
        net = CharCNN(**read)
    sent, counts = spark.sparkContext.broadcast(net), np.zeros((2, 2, BINS), np.int64)
    judged = of([3]).select("y", "w", "h", F.lit(0).alias("p")).unionByName(of([4]).select("y", "w", "h", F.lit(1).alias("p")))
    dealt = judged.repartition(max(1, round(tasks * 2 / 3)), "h").sortWithinPartitions("h", "y", "w").select("y", "w", "p")
    for r in dealt.mapInArrow(_outputs(sent, seed), "part int, y int, bin int, c long").groupBy("part", "y", "bin").agg(F.sum("c").alias("c")).collect():  # at most 4 * BINS
        counts[r["part"], r["y"], r["bin"]] = r["c"]
    return _settle(net, counts)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all spans (start, kind, end) of every row; kinds are indexes into KINDS."""
    found = materialise(findings(docs, id_col, text_col), "secret_findings")
    net = fit(found)
    base = found.select("doc_id", "spans", "candidates")
    if net is None:
        return base.select("doc_id", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def judge(batches):
        for b in batches:
            cands = b.column(2)
            sizes = np.asarray(pa.compute.list_value_length(cands)) if len(b) else np.zeros(0, int)
            spans = b.column(1).to_pylist()
            some = np.flatnonzero(sizes)
            lists = [(i, c) for i in some.tolist() for c in cands[i].as_py()]
            if lists:
                p = sent.value.probability([w for _, c in lists for w in c["windows"]])
                k = np.cumsum([0, *[len(c["windows"]) for _, c in lists]])
                for (i, c), a, e in zip(lists, k, k[1:]):
                    if p[a:e].max() >= sent.value.threshold:
                        spans[i].append({"start": c["start"], "kind": 3, "end": c["end"]})
            spans = [sorted(s, key=lambda x: (x["start"], x["kind"])) for s in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, b.schema.field(1).type)], names=["doc_id", "spans"])

    return base.mapInArrow(judge, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:long,kind:int,end:long>>")


def redact(docs: DataFrame, net: CharCNN | None, text_col: str = "text", mark: str = "[secret]", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``count_col``, if there, is brought up to date.  Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    text, hit = new_name("redacted", docs.columns), new_name("hit", docs.columns)

    def make():
        model, new = sent.value, mark.encode()

        def apply(chunk: Chunk) -> dict:
            found = scan(chunk, False)
            cuts = {row: [(a, b) for a, _, b in s] for row, s in found.spans.items()}
            listed = [(row, c) for row, cs in found.candidates.items() for c in cs]
            if model is not None and listed:
                p = model.probability([w for _, c in listed for w in c[2]])
                k = np.cumsum([0, *[len(c[2]) for _, c in listed]])
                for (row, (a, b, _)), x, y in zip(listed, k, k[1:]):
                    if p[x:y].max() >= model.threshold:
                        cuts.setdefault(row, []).append((a, b))
            raw, off = chunk.data.tobytes(), chunk.off.tolist()
            out: list[str | None] = []
            for row in range(chunk.n):
                parts, at = [], off[row]
                for a, b in sorted(cuts.get(row, [])):
                    if a >= at:
                        parts += [raw[at:a], new]
                    at = max(at, b)
                out.append(None if chunk.null[row] else b"".join([*parts, raw[at : off[row + 1]]]).decode("utf-8", "replace"))
            return {text: out, hit: [row in cuts for row in range(chunk.n)]}

        return apply

    made = map_text(docs, text_col, make, f"{text} string, {hit} boolean", docs.columns)
    counted = F.when(F.col(hit), F.length(text).cast(docs.schema[count_col].dataType)).otherwise(F.col(quoted(count_col))) if count_col in docs.columns else None
    return made.select(*[F.col(text).alias(c) if c == text_col else counted.alias(c) if c == count_col else F.col(quoted(c)) for c in docs.columns])


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 3), say), ",")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", say), ",").alias("spans"),
    )
