"""Language-model scores of whole documents from a gated recurrent network with a class-factored softmax, in numpy.

1. Spark counts every token of the training rows (each task adds up its own first).  The counts of the
   ``FREQUENT`` most frequent tokens, a fixed number, are broadcast; the rest stay a distributed table.
2. The network knows the ``WORDS`` most frequent tokens in ``CLASSES`` classes.  Texts are written once as the numbers of their words.  It is trained
   by truncated backpropagation in Spark tasks, on every training text, at every size: each text is in one of ``ROUNDS`` rounds, in which tasks
   start from the broadcast weights, go once over their own part of the round's texts, and their weights, of fixed size, are averaged by the
   tokens they saw, in steps that hold at most ``TREE`` of them at once.  Its output biases start from the counts of the whole corpus.
3. Every text is scored in windows of ``STEPS`` tokens with the state carried from one to the next, so a score is the
   log-likelihood of the whole text.  A token outside the network's words costs the unknown word, times its
   smoothed share of the counts of such words, so the probabilities of all texts add up to one.
4. Tokens that are not in the broadcast table are joined with the distributed counts.

Defined results: null and empty texts have one token, the end; without training rows both scores are the base score, 0; rows with a null
id are not learned; rows repeated stay repeated and count each time; extra columns are ignored.  Tokens are
compared by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import remainder
from .shared import materialise
from .textbatch import Chunk, map_text, released

FREQUENT = 65_536
CLASSES, MEMBERS = 32, 32
WORDS = CLASSES * MEMBERS  # with the unknown word
EMBED, HIDDEN, STEPS = 16, 16, 32
SHARE, LEAST_TEXTS, ROUNDS = 1, 3000, 3  # one in SHARE texts is learned from: all
TASK_TEXTS, BATCH_TOKENS, PIECE, TREE, STREAMS = 3200, 600_000, 4096, 64, 128
SPAN = 1 << 62
SCORED_TOKENS = 500_000  # of texts scored side by side: long texts leave few lanes busy
END = np.int64(1)  # the hash that stands for the end of a text
UNKNOWN = WORDS - 1


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c): how often each token hash occurs, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textbatch import chunks

        for b in batches:
            for chunk in chunks(b.column(0)):
                if chunk.n:
                    h, n = np.unique(chunk.word_hash.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[END, h]), pa.array(np.r_[chunk.n, n].astype(np.int64))], names=["token", "c"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """tokens: sorted hashes of the frequent tokens; count, word: their counts and network words (UNKNOWN if none)."""

    tokens: np.ndarray
    count: np.ndarray
    word: np.ndarray
    p: dict[str, np.ndarray] | None = None

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash in ``tokens``, or -1."""
        if not len(self.tokens):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return np.where(self.tokens[at] == h, at, -1)


def _states(p, ids: np.ndarray, active: np.ndarray, h: np.ndarray, keep: bool = False, goes_on: np.ndarray | None = None):
    """ids (T, B): states before each token is read, (T, B, H), and the state after the last; inactive places keep theirs.

    goes_on (T, B): 0 where a text begins, so that its state is zero; else 1.  With ``keep`` also what ``_back`` needs of each step.
    """
    H = HIDDEN
    sign = np.r_[np.full(2 * H, -1, np.float32), np.ones(H, np.float32)]  # the gates are logistic functions of minus these
    gates = np.take(((p["E"] @ p["W"] + p["b"]) * sign).astype(np.float32), ids, axis=0)
    U = p["U"] * sign
    T, B = ids.shape
    before = np.empty((T, B, H), np.float32)
    zr, uc, c = (np.empty((T if keep else 1, B, w), np.float32) for w in (2 * H, H, H))
    some = np.ones(T, bool) if goes_on is None else goes_on.all(axis=1)
    full = active.all(axis=1)
    for t in range(T):
        if not some[t]:
            h = h * goes_on[t][:, None]
        before[t] = h
        x, u, k = gates[t], h @ U, t if keep else 0
        g, new = zr[k], c[k]
        np.add(x[:, : 2 * H], u[:, : 2 * H], out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        if keep:
            uc[k] = u[:, 2 * H :]
        np.multiply(g[:, H:], u[:, 2 * H :], out=new)
        new += x[:, 2 * H :]
        np.tanh(new, out=new)
        d = new - h
        d *= g[:, :H]
        if not full[t]:
            d *= active[t][:, None]
        d += h
        h = d
    return before, h, (zr, uc, c) if keep else None


def _back(p, tape, before: np.ndarray, active: np.ndarray, goes_on: np.ndarray, dhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the gradients by the states before each token, those by the inputs (T, B, 3H) of the gates and by what the state adds to them."""
    zr, uc, c = tape
    H = HIDDEN
    T, B, _ = before.shape
    z, r = zr[:, :, :H], zr[:, :, H:]
    mz = z * active[:, :, None]
    gx, gu = np.empty((T, B, 3, H), np.float32), np.empty((T, B, 3, H), np.float32)  # first by the state after the token
    inner = gx[:, :, 2]
    np.multiply(c, c, out=inner)
    np.subtract(1, inner, out=inner)
    inner *= mz
    np.subtract(c, before, out=gx[:, :, 0])
    gx[:, :, 0] *= mz
    gx[:, :, 0] *= 1 - z
    np.multiply(inner, r, out=gu[:, :, 2])
    np.multiply(gu[:, :, 2], uc, out=gx[:, :, 1])
    gx[:, :, 1] *= 1 - r
    gu[:, :, :2] = gx[:, :, :2]
    stays = 1 - mz
    Ut = np.ascontiguousarray(p["U"].T)
    after, carry = np.empty((T, B, H), np.float32), np.zeros((B, H), np.float32)
    begins = ~goes_on.all(axis=1)
    for t in range(T - 1, -1, -1):
        after[t] = carry
        gu[t] *= carry[:, None, :]
        carry = carry * stays[t]
        carry += gu[t].reshape(B, 3 * H) @ Ut
        carry += dhs[t]
        if begins[t]:
            carry *= goes_on[t][:, None]
    gx *= after[:, :, None, :]
    return gx.reshape(T, B, 3 * H), gu.reshape(T, B, 3 * H)


def _safe(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether the exponentials of the outputs stay within single precision without taking the largest off; states are in [-1, 1]."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max(initial=0.0)) < 40


def _exps(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """In the place of the logits their exponentials, over the largest unless ``safe``; gives their sums and the logarithms to take off."""
    top = None
    if not safe:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return total, np.log(total) if top is None else np.log(total) + top


def _output(p, h: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Natural log-probability of each id (n,) from the states h (n, H); with ``keep`` also the gradients of their mean cost, by the weights and by the states."""
    n, cls = len(ids), ids // MEMBERS
    order = np.argsort(cls.astype(np.int8), kind="stable")  # of eight bits: a radix sort
    h, member = np.take(h, order, axis=0), np.take(ids, order) % MEMBERS
    ends = np.r_[0, np.cumsum(np.bincount(cls, minlength=CLASSES))]
    parts = [(k, slice(ends[k], ends[k + 1])) for k in range(CLASSES) if ends[k + 1] > ends[k]]
    soft = h @ p["C"] + p["cb"]
    found = np.empty(n, soft.dtype)
    for k, rows in parts:
        found[rows] = soft[rows, k]
    total, off = _exps(soft, _safe(p["C"], p["cb"]))
    found -= off
    g, dh = None, None
    if keep:
        soft *= (1 / (total * n))[:, None]
        for k, rows in parts:
            soft[rows, k] -= 1 / n
        g = {"C": h.T @ soft, "cb": soft.sum(axis=0), "M": np.zeros_like(p["M"]), "mb": np.zeros_like(p["mb"])}
        dh = soft @ p["C"].T
    safe = _safe(p["M"], p["mb"])
    for k, rows in parts:
        mine, at = h[rows], member[rows]
        inner = mine @ p["M"][k]
        inner += p["mb"][k]
        flat, place = inner.ravel(), np.arange(0, MEMBERS * len(at), MEMBERS) + at
        picked = flat[place]
        total, off = _exps(inner, safe)
        found[rows] += picked - off
        if keep:
            inner *= (1 / (total * n))[:, None]
            flat[place] -= 1 / n
            g["M"][k], g["mb"][k] = mine.T @ inner, np.ones(len(at), inner.dtype) @ inner
            dh[rows] += inner @ p["M"][k].T
    back = np.empty_like(order)
    back[order] = np.arange(n)
    return np.take(found, back), g, np.take(dh, back, axis=0) if keep else None


def fresh(count: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """count: of each network word in the whole corpus."""
    r = np.random.default_rng(seed)
    mass = (count + 1.0).reshape(CLASSES, MEMBERS)
    p = {
        "E": r.normal(0, 0.2, (WORDS, EMBED)), "W": r.normal(0, 0.3, (EMBED, 3 * HIDDEN)), "U": r.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN),
        "C": r.normal(0, 0.05, (HIDDEN, CLASSES)), "cb": np.log(mass.sum(axis=1) / mass.sum()), "M": r.normal(0, 0.05, (CLASSES, HIDDEN, MEMBERS)), "mb": np.log(mass / mass.sum(axis=1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def train(p: dict[str, np.ndarray], texts: list[np.ndarray], streams: int = STREAMS, epochs: int = 3, rate: float = 0.01, state: dict | None = None) -> dict:
    """Truncated backpropagation over texts (arrays of network words, the end last) laid into streams; gives the optimiser's state, to go on with."""
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
    load, lanes = np.zeros(streams, np.int64), [[] for _ in range(streams)]
    for i in order:
        k = int(load.argmin())
        lanes[k].append(i)
        load[k] += len(texts[i])
    T = int(-(-load.max() // STEPS) * STEPS)
    ids, active, reset = np.zeros((T, streams), np.int64), np.zeros((T, streams), np.float32), np.zeros((T, streams), bool)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            n = len(texts[i])
            ids[at : at + n, k], active[at : at + n, k], reset[at, k] = texts[i], 1, True
            at += n
    state = state or {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()} | {"step": 0}
    step = state["step"]
    for _ in range(epochs):
        h = np.zeros((streams, HIDDEN), np.float32)
        for a in range(0, T, STEPS):
            x, m = ids[a : a + STEPS], active[a : a + STEPS]
            goes_on = (~reset[a : a + STEPS]).astype(np.float32)
            hs, h, tape = _states(p, x, m, h, keep=True, goes_on=goes_on)
            on = m > 0
            if not on.any():
                continue
            _, g, dh = _output(p, hs[on], x[on], keep=True)
            dhs = np.zeros_like(hs)
            dhs[on] = dh
            gx, gu = _back(p, tape, hs, m, goes_on, dhs)
            H = HIDDEN
            flat_x, words = gx.reshape(-1, 3 * H), x.ravel()
            order = np.argsort(words.astype(np.int16), kind="stable")
            named = words[order]
            first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
            per_word = np.zeros((WORDS, 3 * H), np.float32)
            per_word[named[first]] = np.add.reduceat(np.take(flat_x, order, axis=0), first, axis=0)
            g |= {"U": hs.reshape(-1, H).T @ gu.reshape(-1, 3 * H), "b": flat_x.sum(axis=0), "W": p["E"].T @ per_word, "E": per_word @ p["W"].T}
            step += 1
            norm = float(np.sqrt(sum(float((v**2).sum()) for v in g.values())))
            shrink = min(1.0, 1.0 / max(norm, 1e-9))
            for k in p:
                d = g[k] * shrink
                mean, square = state[k]
                mean *= 0.9
                mean += 0.1 * d
                d *= d
                d *= 0.01
                square *= 0.99
                square += d
                size = np.sqrt(square * (1 / (1 - 0.99**step)))
                size += 1e-6
                p[k] -= rate / (1 - 0.9**step) * mean / size
        rate /= 2
    state["step"] = step
    return state


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _numbers(coded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The network words of rows of ``words``, and the first of each row."""
    off = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1] if len(coded) else np.zeros(1, np.int32)
    raw = coded.buffers()[2] if len(coded) else None
    words = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(np.int16) if raw is not None else np.zeros(0, np.int16)
    return words, (off - off[0]).astype(np.int64) // 2


def _trainer(sent, rate: float):
    """Batches of ``words`` to one row (tokens, weights): the weights after one pass over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in sent.value.p.items()}
        held, size, seen, state = [], 0, 0, None

        def learn():
            nonlocal held, size, seen, state
            pieces = [x[a : a + PIECE] for x in held for a in range(0, len(x), PIECE)]
            state = train(p, pieces, streams=int(min(STREAMS, max(4, len(pieces) // 8))), epochs=1, rate=rate, state=state)
            held, size, seen = [], 0, seen + size

        for b in batches:
            words, first = _numbers(b.column(0))
            for a, e in zip(first[:-1], first[1:]):
                held.append(words[a:e])
                size += int(e - a)
                if size >= BATCH_TOKENS:
                    learn()
        if held:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([_pack(p)], pa.binary())], names=["tokens", "weights"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, flat = 0.0, None
    for b in batches:
        for n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(w, np.float32).astype(np.float64) * n
            total, flat = total + n, part if flat is None else flat + part
    if flat is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(flat / total).astype(np.float32).tobytes()], pa.binary())], names=["tokens", "weights"])


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the rows (tokens, weights); no task and not the driver holds more than about TREE of them."""
    n = parts.count()
    while n > TREE:
        n = -(-n // TREE)
        parts = materialise(parts.repartition(n).mapInArrow(_mean, parts.schema), "weights")
    rows = parts.orderBy("tokens").collect()
    total = sum(r["tokens"] for r in rows)
    return sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["tokens"] / total) for r in rows) if rows else None


def log_likelihood(p: dict[str, np.ndarray], words: np.ndarray, first: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """Natural log-probability of each text words[first[i]:first[i + 1]], in windows with the state carried over."""
    size = np.diff(first)
    out = np.zeros(len(size))
    order = np.argsort(-size, kind="stable")
    for i in range(0, len(order), lanes):
        rows = order[i : i + lanes]
        n, start = size[rows], first[:-1][rows]
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for a in range(0, int(n[0]) if len(n) else 0, STEPS):
            live = int(np.searchsorted(-n, -a, "left"))  # those with more than a tokens: the longest come first
            t = a + np.arange(min(STEPS, int(n[0]) - a))[:, None]
            on = t < n[:live]
            ids = np.where(on, words[np.minimum(start[:live] + t, len(words) - 1)], 0)
            before, h, _ = _states(p, ids, on.astype(np.float32), h[:live])
            logp, _, _ = _output(p, before[on], ids[on])
            where = np.broadcast_to(np.arange(live), on.shape)[on]
            out[rows[:live]] += np.bincount(where, logp, live)
    return out


def _tokens(model: Model, chunk: Chunk) -> dict[str, np.ndarray]:
    """Per chunk: network words with ends, their first per row, and the sums over the broadcast counts."""
    _, _, first = chunk.words
    h = chunk.word_hash.view(np.int64)
    at = model.look_up(h)
    top = at >= 0
    word = np.where(top, model.word[at], UNKNOWN) if len(model.tokens) else np.full(len(h), UNKNOWN)
    row = chunk.rows_of(first)
    logc = np.where(top, np.log10(model.count[at] + 1.0), 0.0) if len(model.tokens) else np.zeros(len(h))
    n = np.diff(first)
    ends = first[1:] + np.arange(chunk.n)
    words = np.zeros(len(h) + chunk.n, np.int64)
    inner = np.ones(len(words), bool)
    inner[ends] = False
    words[inner] = word
    words[ends] = 0  # the end is network word 0
    count = lambda m, w=None: np.bincount(row[m], None if w is None else w[m], chunk.n)
    every = np.ones(len(h), bool)
    rare = np.flatnonzero(~top)
    return {
        "words": words, "first": np.concatenate([[0], np.cumsum(n + 1)]), "n": n + 1, "top": count(top), "sum": count(every, logc),
        "n_unknown": count(word == UNKNOWN), "unknown_sum": count(word == UNKNOWN, logc), "rare": h[rare], "rare_first": np.searchsorted(rare, first),
    }


def encoded(docs: DataFrame, sent, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, learn, row, words, ...): each text as network words of 16 bits, its sums over the broadcast counts and its other tokens."""

    def make():
        rows = 0
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        model = sent.value

        def apply(chunk: Chunk) -> dict:
            nonlocal rows
            x = _tokens(model, chunk)
            rows += chunk.n
            words, first = x["words"].astype(np.int16), x["first"]
            return {
                "row": task + np.arange(rows - chunk.n, rows), "n_tokens": x["n"].astype(np.int64), "top": x["top"].astype(np.int64), "top_sum": x["sum"],
                "n_unknown": x["n_unknown"].astype(np.int64), "unknown_sum": x["unknown_sum"],
                "words": pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(words)]),
                "rare": pa.ListArray.from_arrays(pa.array(x["rare_first"].astype(np.int32)), pa.array(x["rare"])),
            }

        return apply

    text = F.col(text_col).cast("string")
    some = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.coalesce(learn, F.lit(False)).alias("learn"))
    out = "row long, n_tokens long, top long, top_sum double, n_unknown long, unknown_sum double, words binary, rare array<long>"
    return map_text(some, "text", make, out, ["doc_id", "h", "learn"])


def vocabulary(counts: DataFrame) -> Model:
    """The broadcast counts, and the network before it has learned."""
    words = counts.where(F.col("token") != int(END))
    size = F.floor(F.log2("c") * 8).cast("int")  # a histogram of the counts bounds the top-k before it is taken
    least, seen = 0, 0
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # some hundred rows
        least, seen = r["size"], seen + r["count"]
        if seen >= FREQUENT:
            break
    top = words.where(size >= least).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()  # a fixed number of rows
    token, count = np.asarray(top.column("token")), np.asarray(top.column("c"))
    word = np.full(len(token), UNKNOWN)
    word[: WORDS - 2] = 1 + np.arange(min(len(token), WORDS - 2))
    order = np.argsort(token)
    model = Model(token[order], count[order], word[order])
    if len(token):
        totals = counts.agg(F.sum(F.when(F.col("token") == int(END), F.col("c"))).alias("ends"), F.sum("c").alias("n")).first()
        mass = np.zeros(WORDS)
        mass[1 : 1 + min(len(token), WORDS - 2)] = count[: WORDS - 2]
        mass[0] = totals["ends"]
        mass[UNKNOWN] = totals["n"] - mass.sum()
        model.p = fresh(mass)
    return model


def learned(model: Model, coded: DataFrame, texts: int, share: int = SHARE, least_texts: int = LEAST_TEXTS) -> Model:
    """``model`` trained on the rows of ``coded`` to learn from, of which there are ``texts``.

    share, least_texts: a caller may want one text in ``share`` only, or about ``least_texts`` if that is more.
    """
    if model.p is None:
        return model
    drawn = coded.where("learn")
    part = 1.0
    if share > 1:
        part = min(1.0, max(1 / share, least_texts / texts))
        drawn = drawn.where(F.pmod("h", F.lit(SPAN)) < int(part * SPAN))
    tasks = max(1, round(part * texts / ROUNDS / TASK_TEXTS))
    spark = coded.sparkSession
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        mine = drawn.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(ROUNDS)) == turn).select("h", "words")
        dealt = mine.repartition(tasks, "h").sortWithinPartitions("h").select("words")
        mean = _averaged(materialise(dealt.mapInArrow(_trainer(sent, 0.01 / 2**turn), "tokens double, weights binary"), "weights"))
        if mean is not None:
            model.p = _unpack(mean, model.p)
        sent.destroy()
    return model


def _ends(counts: DataFrame) -> int:
    return counts.where(F.col("token") == int(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]


def fit(docs: DataFrame, counts: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """A model from the rows that meet ``allowed``; ``counts`` are their tokens."""
    model = vocabulary(counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    coded = materialise(encoded(docs.where(allowed), sent, F.lit(True), id_col, text_col), "encoded")
    return learned(model, coded, _ends(counts), **options)


def _network(sent):
    """Batches of (..., words) to the same rows with the network's log10 probability in the place of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value.p
        for b in batches:
            words, first = _numbers(b.column(b.num_columns - 1))
            logp, i = np.zeros(b.num_rows), 0
            while i < b.num_rows and p is not None:
                j = max(i + 1, int(np.searchsorted(first, first[i] + SCORED_TOKENS, "right")) - 1)
                logp[i:j] = log_likelihood(p, words[first[i] : first[j]], first[i : j + 1] - first[i]) / np.log(10)
                i = j
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(logp)], names=[*b.schema.names[:-1], "network"])
        released()

    return run


def scores(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows that meet ``allowed``."""
    counts = materialise(token_counts(docs.where(allowed), text_col), "token_counts")
    model = vocabulary(counts)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    coded = materialise(encoded(docs, sent, allowed, id_col, text_col), "encoded")
    model = learned(model, coded, _ends(counts), **options)
    sent = spark.sparkContext.broadcast(model)
    plain = coded.select("doc_id", "row", "n_tokens", "top", "top_sum", "n_unknown", "unknown_sum", "words")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    scored = materialise(plain.mapInArrow(_network(sent), f"{out}, network double"), "scored")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("token") == int(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = total["n"], total["v"], total["ends"]
    in_network = model.word != UNKNOWN
    n_unknown = n - ends - int(model.count[in_network].sum())
    v_unknown = v - (ends > 0) - int(in_network.sum())

    rare = coded.select("row", F.explode("rare").alias("token"))
    known = rare.join(counts, "token").groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    back = scored.join(known, "row", "left").fillna(0, ["rare_known"]).fillna(0.0, ["rare_sum"])
    base = F.col("top_sum") + F.col("rare_sum") + float(np.log10(ends + 1.0)) - F.col("n_tokens") * float(np.log10(n + v + 1.0))
    spelled = F.col("unknown_sum") + F.col("rare_sum") - F.col("n_unknown") * float(np.log10(n_unknown + v_unknown + 1.0))
    return back.select(
        "doc_id", "n_tokens",
        (F.col("top") + F.col("rare_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("network") + spelled if model.p is not None else base).alias("score"),
    )


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = remainder("doc_id", 7)
    out = scores(docs, rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
