"""Sequences from text tables."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 12


_KEPT = np.zeros(256, np.uint8)
for _c in b"ACGT":
    _KEPT[[_c, _c + 32]] = _c
PART = 4_000_000  # bytes of text taken at once


def _letters(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, letters) of some PART bytes of text each: the letters A, C, G, T in either case, as capitals."""
    _, o, d = text.buffers()
    off = np.frombuffer(o, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PART, "right")) - 1)
        part = _KEPT[data[off[i] : off[j]]]
        at = np.flatnonzero(part)
        yield i, np.searchsorted(at, off[i : j + 1] - off[i]), part[at]
        i = j


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, carry: list[str] | None = None) -> DataFrame:
    """(seq_id, seq, carry...): the letters A, C, G, T of each whole text; texts with fewer than ``min_length`` are left out."""
    carry = carry or []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, off, letters in _letters(b.column(1).cast(pa.large_string())):
                n = len(off) - 1
                seq = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.string())
                keep = pa.array((np.diff(off) >= min_length) & np.asarray(b.column(1).slice(i, n).is_valid()))
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0).slice(i, n), seq, *[c.slice(i, n) for c in b.columns[2:]])], names=["seq_id", "seq", *carry])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"seq_id {kind}, seq string", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]])
    return docs.select(F.col(id_col), F.col(text_col), *carry).mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=carry)


def sites(seqs: DataFrame, seed: str, width: int, carry: list[str] | None = None) -> DataFrame:
    """(seq_id, i, site, carry...): every window of ``width`` bases that begins with ``seed``, over whole sequences; i from 1."""
    carry = carry or []
    letters = np.frombuffer(seed.encode(), np.uint8)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = b.column(1).cast(pa.large_string())
            _, o, d = text.buffers()
            off = np.frombuffer(o, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
            begins = np.ones(max(len(data) - width + 1, 0), bool)
            for k, c in enumerate(letters):
                begins &= data[k : k + len(begins)] == c
            at = np.flatnonzero(begins)
            row = np.searchsorted(off, at, "right") - 1
            inside = (at >= off[0]) & (at < off[-1])
            at, row = at[inside], row[inside]
            whole = at + width <= off[row + 1]
            at, row = at[whole], row[whole]
            windows = data[at[:, None] + np.arange(width)]
            cut = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32)), pa.py_buffer(windows.tobytes())])
            kept = [c.take(pa.array(row)) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array((at - off[row] + 1).astype(np.int32)), cut, *kept], names=["seq_id", "i", "site", *carry])

    kind = seqs.schema["seq_id"].dataType.simpleString()
    found = seqs.where((F.length("seq") >= width) & F.contains("seq", F.lit(seed))).select("seq_id", "seq", *carry)
    return found.mapInArrow(run, ", ".join([f"seq_id {kind}, i int, site string", *[f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in carry]]))
