"""Random numbers by counting: the digits of md5 over (seed, key, place).  The same in Spark, numpy and SQL, on any number of tasks."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5  # the same digests as hashlib's in half the time
except ImportError:
    from hashlib import md5

DIGITS = 13  # hexadecimal: 52 bits, so that a double holds them


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1): the first digits of md5 of ``seed:key:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(1 << 4 * DIGITS)


def uniforms(keys: list[str], counts: np.ndarray) -> np.ndarray:
    """For each key its first ``count`` numbers, end to end: two a digest of ``key:block``."""
    blocks = (np.asarray(counts) + 1) // 2
    raw = b"".join([md5(f"{k}:{i}".encode()).digest() for k, n in zip(keys, blocks.tolist()) for i in range(n)])
    both = (np.frombuffer(raw, ">u8") >> np.uint64(64 - 4 * DIGITS)).astype(float) / float(1 << 4 * DIGITS)
    start = 2 * np.repeat(np.cumsum(blocks) - blocks, counts)
    return both[start + np.arange(int(np.sum(counts))) - np.repeat(np.cumsum(counts) - counts, counts)]
