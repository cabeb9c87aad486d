"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of embeddings of the whole word and of its character n-grams at the beginning (3 to 5) and the end (3),
all by hash.  Every text is cut into overlapping windows of ``WINDOW`` words; each
direction runs over all windows at once, attention weighs the positions of a window, and a logistic
layer scores it.  A text's score is that of its worst window, calibrated on training texts held out.

The network learns on the driver from a bounded sample of labelled texts (``PER_CLASS`` of each class); a toxic text
need only have one toxic window, so in training the worst window of a text stands for it.  Scoring runs in Spark tasks over
whole texts; the weights, of fixed size, are broadcast.

Defined results: null, empty and blank texts score as a window without words, close to 0; without training texts of both
classes every score is 0; rows repeated stay repeated; extra columns are kept by ``drop_toxic`` and never clash.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_texts, remainder
from .textbatch import Chunk, map_text, mix, span_hash

WINDOW, STRIDE = 32, 24
HIDDEN, INPUT = 8, 12
BUCKETS = 1 << 15
PER_CLASS = 1500
THRESHOLD = 0.3
CHUNK = 400_000  # bytes of text scored at once
N_FEATURES = 5  # the word, its first 3, 4, 5 bytes, its last 3


def word_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of the chunk as rows of N_FEATURES buckets, and the distinct word of each word.

    Marks at both ends are left out of a word; what has no letter or digit is one feature of its own.
    """
    starts, ends, _ = chunk.words
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.int64), np.zeros(0, np.int64)
    data = chunk.lower
    solid = (data >= 0x80) | (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57)
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        a += (a < b - 1) & ~solid[a]
        b -= (b - 1 > a) & ~solid[b - 1]
    h = span_hash(data, a, b)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    a, b, h = a[first], b[first], h[first]
    order = np.argsort(a)  # span_hash wants spans that ascend
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    a, b, h = a[order], b[order], h[order]
    out = [h]
    for k in (3, 4, 5):
        out.append(span_hash(data, a, np.minimum(b, a + k)) + np.uint64(k))
    out.append(span_hash(data, np.maximum(a, b - 3), b) ^ np.uint64(0x5555))
    feats = np.stack([(mix(x + np.uint64(i)) & np.uint64(BUCKETS - 1)).astype(np.int64) for i, x in enumerate(out)], axis=1)
    return feats, back[inverse]


def windows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, and row of every window; a row without words has none."""
    _, _, first = chunk.words
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(chunk.n), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][row] + k * STRIDE
    return start, np.minimum(WINDOW, first[1:][row] - start), row


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """p: word embeddings E, and per direction d the gates W{d} (input), U{d} (state), b{d}; attention A, a; output o, c."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    empty: bool = field(default=False)  # nothing was learned

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.1, (BUCKETS, INPUT)), "A": r.normal(0, 0.3, (2 * HIDDEN, 1)), "o": r.normal(0, 0.3, 2 * HIDDEN), "c": np.array([-2.0])}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, 0.4, (INPUT, 3 * HIDDEN)), f"U{d}": r.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (T, B, 3H) projected inputs.  States (T, B, H), and what the backward pass needs."""
        U, H = self.p[f"U{d}"], HIDDEN
        T, B = mask.shape
        h = np.zeros((B, H), np.float32)
        out = np.empty((T, B, H), np.float32)
        tape = []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            u = h @ U
            zr = x[t, :, : 2 * H] + u[:, : 2 * H]
            zr = 1 / (1 + np.exp(-zr))
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[t, :, 2 * H :] + r * u[:, 2 * H :])
            new = h + mask[t][:, None] * z * (c - h)
            if keep:
                tape.append((t, h, z, r, c, u[:, 2 * H :]))
            h = new
            out[t] = h
        return out, tape

    def forward(self, proj: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of the windows.  proj: projected inputs (T, B, 3H) by direction; mask (T, B) float."""
        hf, tf = self._direction(proj["f"], mask, "f", keep)
        hb, tb = self._direction(proj["b"], mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        e = (np.tanh(h) @ self.p["A"])[:, :, 0]
        e = np.where(mask > 0, 4 * e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w = w * mask / np.maximum((w * mask).sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return logit, (h, w, pooled, tf, tb)

    def backward(self, dlogit, cache, mask):
        """Gradients by parameter, and of the projected inputs by direction."""
        h, w, pooled, tf, tb = cache
        H = HIDDEN
        g = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * self.p["o"]
        dh = w[:, :, None] * dpool[None]
        dw = (h * dpool[None]).sum(axis=2)
        de = 4 * w * (dw - (w * dw).sum(axis=0))
        th = np.tanh(h)
        g["A"] = np.einsum("tb,tbh->h", de, th)[:, None]
        dh += de[:, :, None] * (1 - th**2) * self.p["A"][:, 0]
        dproj = {}
        for d, tape, part in (("f", tf, dh[:, :, :H]), ("b", tb, dh[:, :, H:])):
            U = self.p[f"U{d}"]
            gU, gx = np.zeros_like(U), np.zeros((*mask.shape, 3 * H), np.float32)
            carry = np.zeros(part.shape[1:], np.float32)
            for t, before, z, r, c, uc in reversed(tape):
                dn = (part[t] + carry) * 1.0
                m = mask[t][:, None]
                dz = dn * m * (c - before) * z * (1 - z)
                dc = dn * m * z * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                gx[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                gU += before.T @ du
                carry = dn * (1 - m * z) + du @ U.T
            g[f"U{d}"], g[f"b{d}"], dproj[d] = gU, gx.sum(axis=(0, 1)), gx
        return g, dproj

    def project(self, feats: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Embeddings of the distinct words and their gate inputs; a last row of zeros stands for no word."""
        x = np.zeros((len(feats) + 1, INPUT), np.float32)
        for i in range(N_FEATURES):
            x[:-1] += self.p["E"][feats[:, i]]
        return x, {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def logits(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The logit and the row of every window of the chunk."""
        feats, word = word_features(chunk)
        start, size, row = windows(chunk)
        return self.window_logits(feats, word, start, size), row

    def window_logits(self, feats: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray, batch: int = 1024) -> np.ndarray:
        _, gates = self.project(feats)
        out = np.zeros(len(size), np.float32)
        order = np.argsort(size, kind="stable")
        word = np.append(word, len(feats))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            T = int(size[pick].max())
            t = np.arange(T)[:, None]
            mask = t < size[pick]
            at = np.where(mask, word[np.minimum(start[pick] + t, len(word) - 1)], len(feats))
            out[pick] = self.forward({d: gates[d][at] for d in "fb"}, mask.astype(np.float32))[0]
        return out

    def text_logits(self, chunk: Chunk) -> np.ndarray:
        return worst(*self.logits(chunk), chunk.n)

    def scores(self, chunk: Chunk) -> np.ndarray:
        if self.empty:
            return np.zeros(chunk.n)
        return _sigmoid(np.clip(self.scale * self.text_logits(chunk) + self.shift, -30, 30))


def worst(logit: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The largest logit of each row; rows without windows are clean."""
    best = np.full(n, -8.0)
    np.maximum.at(best, row, logit)
    return best


def _prepared(texts: list[str], some: int = 100) -> tuple[np.ndarray, ...]:
    """Features, words, windows (start, size, row) and rows of words of the texts, some texts at a time."""
    parts, n_feats, n_words = [], 0, 0
    for i in range(0, len(texts), some):
        chunk = Chunk.of(texts[i : i + some])
        feats, word = word_features(chunk)
        start, size, row = windows(chunk)
        parts.append((feats.astype(np.int32), (word + n_feats).astype(np.int32), start + n_words, size, row + i, (chunk.rows_of(chunk.words[2]) + i).astype(np.int32)))
        n_feats, n_words = n_feats + len(feats), n_words + len(word)
    feats, word, *rest = (np.concatenate(x) for x in zip(*parts))
    key = mix((feats.astype(np.uint64) * np.uint64(BUCKETS + 1) ** np.arange(N_FEATURES, dtype=np.uint64)).sum(axis=1))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)  # the parts have most words in common
    return feats[first], inverse.astype(np.int32)[word], *rest


def _evidence(feats: np.ndarray, word: np.ndarray, row: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A start for one dimension of the embeddings: in how many toxic and clean training texts a bucket occurs, as shrunk log-odds."""
    keep = np.flatnonzero(used[row])
    pairs = np.unique(np.concatenate([np.unique((row[k][:, None].astype(np.int64) * BUCKETS + feats[word[k]]).ravel()) for k in np.array_split(keep, 1 + len(keep) // 200_000)]))
    toxic = y[pairs // BUCKETS] > 0
    bucket = pairs % BUCKETS
    t, c = np.bincount(bucket[toxic], minlength=BUCKETS), np.bincount(bucket[~toxic], minlength=BUCKETS)
    nt, nc = max((y[used] > 0).sum(), 1), max((y[used] == 0).sum(), 1)
    prior = 3 * nt / (nt + nc)
    odds = np.log((t + prior) / (c * nt / nc + prior))
    return (0.4 * np.clip(odds, -1, 4)).astype(np.float32)


def train(texts: list[tuple[str, int]], epochs: int = 6, batch: int = 256, seed: int = 11) -> Network:
    """texts: (text, 0 or 1)."""
    y = np.array([t[1] for t in texts], dtype=np.float32)
    net = Network.fresh()
    if len(set(y.tolist())) < 2:
        net.empty = True
        return net
    rng = np.random.default_rng(seed)
    feats, word, start, size, row, word_row = _prepared([t[0] for t in texts])
    held = rng.random(len(y)) < 0.2
    net.p["E"][:, 0] = _evidence(feats, word, word_row, y, ~held)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.02 if epoch < epochs - 2 else 0.007
        # the worst window of every text, and for clean texts some others
        logit = net.window_logits(feats, word, start, size)
        noisy = logit + (rng.gumbel(size=len(logit)) * (2.0 if epoch == 0 else 0.3))
        order = np.lexsort((-noisy, row))
        lead = np.r_[True, row[order][1:] != row[order][:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        wanted = order[(rank < np.where(y[row[order]] > 0, 3 if epoch == 0 else 1, 4))]
        wanted = rng.permutation(wanted[~held[row[wanted]]])
        share = y[row[wanted]].mean()
        for i in range(0, len(wanted), batch):
            pick = wanted[i : i + batch]
            T = int(size[pick].max())
            t = np.arange(T)[:, None]
            mask = (t < size[pick]).astype(np.float32)
            at = np.where(mask > 0, word[np.minimum(start[pick] + t, len(word) - 1)], len(feats))
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            real = used < len(feats)
            x = np.zeros((len(used), INPUT), np.float32)
            x[real] = net.p["E"][feats[used[real]]].sum(axis=1)
            xt = x[local]
            proj = {d: xt @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}
            out, cache = net.forward(proj, mask, keep=True)
            weight = np.where(y[row[pick]] > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).clip(0, 4)
            dlogit = ((_sigmoid(out) - y[row[pick]]) * weight / len(pick)).astype(np.float32)
            g, dproj = net.backward(dlogit, cache, mask)
            dx = np.zeros_like(xt)
            for d in "fb":
                g[f"W{d}"] = np.einsum("tbi,tbg->ig", xt, dproj[d], optimize=True)
                dx += dproj[d] @ net.p[f"W{d}"].T
            dused = np.zeros((len(used), INPUT), np.float32)
            np.add.at(dused, local.ravel(), dx.reshape(-1, INPUT))
            ids = feats[used[real]]
            rows = np.unique(ids)
            dE = np.zeros((len(rows), INPUT), np.float32)
            np.add.at(dE, np.searchsorted(rows, ids.ravel()), np.repeat(dused[real], N_FEATURES, axis=0))
            step += 1
            for k in net.p:
                grad, at_rows = (dE, rows) if k == "E" else (g[k].astype(np.float32), slice(None))
                m, v = state[k]
                m[at_rows] = 0.9 * m[at_rows] + 0.1 * grad
                v[at_rows] = 0.99 * v[at_rows] + 0.01 * grad**2
                net.p[k][at_rows] -= rate * (m[at_rows] / (1 - 0.9**step)) / (np.sqrt(v[at_rows] / (1 - 0.99**step)) + 1e-6)
    best, target = worst(net.window_logits(feats, word, start, size), row, len(y))[held], y[held]
    if len(set(target.tolist())) == 2:
        scale, shift = 1.0, 0.0
        smooth = np.where(target > 0, 1 - 1 / (target.sum() + 2), 1 / ((1 - target).sum() + 2))
        for _ in range(400):
            p = _sigmoid(np.clip(scale * best + shift, -30, 30))
            scale -= 0.02 * ((p - smooth) * best).mean()
            shift -= 0.1 * (p - smooth).mean()
        net.scale, net.shift = float(max(scale, 0.1)), float(shift)
    return net


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> Network:
    return train(labelled_texts(docs, labels, "toxic", allowed, per_class))


def toxicity_scores(docs: DataFrame, net: Network, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) and the ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return map_text(docs, text_col, lambda: lambda chunk: {"score": sent.value.scores(chunk)}, "score double", carry, CHUNK)


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        def apply(chunk: Chunk) -> dict:
            return {"__keep": sent.value.scores(chunk) < threshold}

        return apply

    return map_text(docs, text_col, make, "", docs.columns, CHUNK)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = remainder("doc_id", 4)
    scores = toxicity_scores(docs, learn(docs, labels, rest != 2), carry=["doc_id"])
    held = F.coalesce(rest == 2, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
