"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be joined, so a text may be cut between them:
the merges left and right of the cut do not interact.  Where the pre-tokenisation pattern could look across
such a cut (after white space, inside a character, before an apostrophe that follows a symbol), the cut is not
made.  The fragments, mostly single words, are encoded on their own (a bounded table per task remembers them) and
their ids are concatenated.  The ids are those of the ``tokenizers`` library for the same file.

Defined results: null is encoded like the empty text, as no ids; the strings of special tokens in a text become
their ids; ids outside the vocabulary decode to nothing, and bytes that are not UTF-8 to U+FFFD; rows repeated stay
repeated; extra columns are kept by the stage functions and never clash.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Chunk, map_text

REMEMBERED = 250_000  # fragments a task remembers
LONGEST = 48  # bytes of a remembered fragment
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = regex.compile(rb" ?[A-Za-z]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, source: str):
        """source: the JSON text of a byte-level BPE tokenizer."""
        spec = json.loads(source)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * self.size
        for s, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        for s, i in self.special.items():
            self.token[i] = s
        self.byte_id = [-1] * 256
        for s, i in vocab.items():
            if len(s) == 1:
                self.byte_id[letters[s]] = i
        self.merge = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.joined = np.zeros((256, 256), bool)  # byte pairs inside tokens
        for s in vocab:
            t = self.token[vocab[s]]
            self.joined[list(t[:-1]), list(t[1:])] = True
        self.pool = np.frombuffer(b"".join(self.token), np.uint8)
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.memory: dict[bytes, tuple[int, ...]] = {}
        self.splitter = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether the text is cut before each byte."""
        cut = np.zeros(len(data), bool)
        left, right = data[:-1], data[1:]
        ok = ~self.joined[left, right] & ((right & 0xC0) != 0x80)
        ok &= ~((left == 32) | (left >= 9) & (left <= 13))
        before = np.concatenate([np.zeros(1, np.uint8), data[:-2]]) if len(data) > 1 else left
        ok &= ~((left >= 0x80) & np.isin(before, (0xC2, 0x80, 0x81, 0x9A)))  # maybe a space of two or three bytes
        low = left | 0x20
        ok &= (right != 0x27) | (low >= 97) & (low <= 122) | (left >= 48) & (left <= 57)
        cut[1:] = ok
        return cut

    def encode_pretoken(self, piece: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in piece]
        return self._short(ids) if len(ids) < 100 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        merge, none = self.merge.get, (1 << 60, -1)
        found = [merge(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none or best[1] < 0:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merge(ids[i - 1] << 32 | ids[i], none)
            if i < len(found):
                found[i] = merge(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same in n log n, with a heap of pairs."""
        n, merge = len(ids), self.merge.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (m := merge(ids[i] << 32 | ids[j])):
                heap.append((m[0], i, ids[i], ids[j], m[1])) if start else heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        start = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        start = False
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def encode_fragment(self, piece: bytes) -> tuple[int, ...]:
        got = self.memory.get(piece)
        if got is None:
            if PLAIN.fullmatch(piece):
                got = tuple(self.encode_pretoken(piece))
            else:
                got = tuple(chain.from_iterable(self.encode_pretoken(p.encode()) for p in PRETOKEN.findall(piece.decode("utf-8", "replace"))))
            if len(piece) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[piece] = got
        return got

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and where each row begins (n + 1)."""
        data, raw = chunk.data, chunk.data.tobytes()
        if not raw:
            return np.zeros(0, np.int32), np.zeros(chunk.n + 1, np.int64)
        cut = self.cuts(data)
        cut[chunk.off[:-1][chunk.off[:-1] < len(data)]] = True
        marks = np.zeros(0, np.int64)
        if self.splitter and self.splitter.search(raw):
            at = [m.span() for i in range(chunk.n) for m in _within(self.splitter, raw, int(chunk.off[i]), int(chunk.off[i + 1]))]
            for a, b in at:
                cut[a + 1 : b] = False
                cut[a] = True
                if b < len(cut):
                    cut[b] = True
            marks = np.array([a for a, _ in at], dtype=np.int64)
        starts = np.flatnonzero(cut)
        bounds = starts.tolist()
        memory, encode = self.memory, self.encode_fragment
        pieces = [raw[a:b] for a, b in zip(bounds, [*bounds[1:], len(raw)])]
        if len(marks):
            special = set(np.searchsorted(starts, marks).tolist())
            got = [(self.special[p],) if i in special else encode(p) for i, p in enumerate(pieces)]
        else:
            known = memory.get
            got = [known(p) or encode(p) for p in pieces]
        count = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(count.sum()))
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, upto[np.searchsorted(starts, chunk.off)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Texts of the rows ids[first[i]:first[i + 1]]."""
        ok = (ids >= 0) & (ids < self.size)
        if not ok.all():
            upto = np.concatenate([[0], np.cumsum(ok)])
            ids, first = ids[ok], upto[first]
        size = self.length[ids]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(int(off[-1])) + np.repeat(self.start[ids] - off[:-1], size)
        data = self.pool[at].tobytes()
        bounds = off[first]
        try:
            data.decode("utf-8")
            if len(bounds) > 1 and len(data) and not ((np.frombuffer(data, np.uint8)[bounds[:-1][bounds[:-1] < len(data)]] & 0xC0) != 0x80).all():
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "a row begins inside a character")
            return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        except UnicodeDecodeError:
            b = bounds.tolist()
            return pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(b, b[1:])], pa.string())


def _within(pattern, raw: bytes, a: int, b: int):
    return pattern.finditer(raw, a, b)


@lru_cache(maxsize=2)
def _loaded(source: str) -> ByteBPE:
    return ByteBPE(source)


def tokenizer_source(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``carry`` columns (all by default) and ``ids`` of every row.  path: the tokenizer's file, read on the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))  # the vocabulary's size, whatever the data's

    def make():
        bpe = _loaded(sent.value)
        return lambda chunk: {"ids": _lists(*bpe.encode(chunk))}

    return map_text(docs, text_col, make, "ids array<int>", carry)


def round_trip(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``carry`` columns, ``ids`` and ``decoded``: the text encoded and its ids decoded again."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))

    def make():
        bpe = _loaded(sent.value)

        def apply(chunk: Chunk) -> dict:
            ids, first = bpe.encode(chunk)
            return {"ids": _lists(ids, first), "decoded": bpe.decode(ids, first)}

        return apply

    return map_text(docs, text_col, make, "ids array<int>, decoded string", carry)


def decode(rows: DataFrame, ids_col: str = "ids", carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``carry`` columns (all but the ids by default) and ``decoded``; null ids decode to the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    carry = [c for c in rows.columns if c != ids_col] if carry is None else carry
    inner = rows.select(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("__ids"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([*[f"__c{i} {inner.schema[f'__c{i}'].dataType.simpleString()}" for i in range(len(carry))], "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        for b in batches:
            v = b.column(0)
            first = np.asarray(v.offsets).astype(np.int64)
            flat = np.asarray(v.values.fill_null(-1))[first[0] : first[-1]] if len(v) else np.zeros(0, np.int32)
            text = bpe.decode(flat, first - first[0]) if len(v) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(i + 1) for i in range(len(carry))], text], names=[*[f"__c{i}" for i in range(len(carry))], "decoded"])

    made = inner.mapInArrow(run, schema)
    return made.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "decoded")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
