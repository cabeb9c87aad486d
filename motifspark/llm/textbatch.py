"""Whole texts as numpy arrays: Arrow batches in, columns out, in chunks of bounded size.

``map_text`` runs a function over a DataFrame's text column inside Spark tasks.  The function sees a ``Chunk``:
the UTF-8 bytes of some documents and their offsets, without a Python object per document.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1_500_000

BYTES = np.arange(256)
IS_SPACE = np.isin(BYTES, [0x20, 9, 10, 11, 12, 13])
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
_RNG = np.random.Generator(np.random.Philox(20240607))
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, PRIME, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Chunk:
    """Texts of some rows: ``data`` holds their bytes, row i is ``data[off[i]:off[i + 1]]``; nulls are empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray, null: np.ndarray):
        self.data, self.off, self.null, self.n = data, off, null, len(off) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Chunk:
        return next(chunks(pa.array(texts, pa.string()), 1 << 60))

    def text(self, i: int) -> str:
        return self.data[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")

    @cached_property
    def lower(self) -> np.ndarray:
        return LOWER[self.data]

    @cached_property
    def space(self) -> np.ndarray:
        return IS_SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words between white space (0x20, 0x09-0x0D), and the first word of each row (n + 1)."""
        return self.runs(~self.space)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.data):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.off[:-1][self.off[:-1] < self.off[1:]]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        end = self.off[1:][self.off[:-1] < self.off[1:]] - 1
        last[end] = inside[end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def rows_of(self, first: np.ndarray) -> np.ndarray:
        """The row of each word, from the first word of each row."""
        return np.repeat(np.arange(self.n), np.diff(first))

    @cached_property
    def word_hash(self) -> np.ndarray:
        """64-bit hashes of the words, A-Z lower-cased."""
        starts, ends, _ = self.words
        return span_hash(self.lower, starts, ends)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; spans must not be empty or overlap, and must ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = within + np.repeat(starts, size)
    longest = int(size.max())
    power = _powers(1 << max(6, (longest - 1).bit_length()))
    with np.errstate(over="ignore"):
        parts = BYTE_HASH[data[at]] * power[within]
        return mix(np.add.reduceat(parts, np.cumsum(size) - size))


def add_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per row; row i holds values[first[i]:first[i + 1]], maybe none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def max_rows(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    """Largest of ``values`` per row."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, dtype=np.float64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(values, first[some])
    return out


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """``texts`` in runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        yield Chunk(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool))
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = np.asarray(texts.is_null())
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Chunk(raw[off[i] : off[j]], off[i : j + 1] - off[i], null[i:j])
        i = j


def quoted(name: str) -> str:
    """A column's name as Spark parses it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def new_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or with as many underscores as it takes not to be among ``taken``."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def released() -> None:
    """Give freed memory back to the system: Python workers live on, and the next stage's would come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_text(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[Chunk], dict[str, object]]],
    out: str,
    carry: list[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``df``'s ``carry`` columns and what the function made by ``make`` (once a task) returns for each row.

    out: the new columns, as DDL; empty for none.  A returned ``__keep`` (boolean array) drops rows.  Carried columns keep their
    order and names, even where a new column has the same name: the new ones come after them.
    """
    carry = df.columns if carry is None else carry
    new = T._parse_datatype_string(out) if out else T.StructType()
    inner = df.select(F.col(quoted(text_col)).alias("__text"), *[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([*[T.StructField(f"__c{i}", inner.schema[i + 1].dataType) for i in range(len(carry))], *[T.StructField(f"__n{i}", f.dataType) for i, f in enumerate(new)]])
    names, carried = [f.name for f in new], len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        apply = make()
        for batch in batches:
            at = 0
            for chunk in chunks(batch.column(0), chunk_bytes):
                if not chunk.n:
                    continue
                got = apply(chunk)
                part = batch.slice(at, chunk.n)
                at += chunk.n
                columns = [part.column(k + 1).cast(arrow.field(k).type) for k in range(carried)]
                for k, name in enumerate(names):
                    value = got[name]
                    columns.append(value if isinstance(value, pa.Array) else pa.array(value, arrow.field(carried + k).type))
                made = pa.RecordBatch.from_arrays(columns, schema=arrow)
                yield made.filter(pa.array(got["__keep"])) if "__keep" in got else made
        released()

    mapped = inner.mapInArrow(run, schema)
    return mapped.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], *[F.col(f"__n{i}").alias(c) for i, c in enumerate(names)])
