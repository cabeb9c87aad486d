"""Language identification with interpolated Kneser-Ney character models.

Every letter of the basic plane is a 16-bit code of its own, in lower case; letters beyond it share the codes that no letter has;
runs of non-letters are one boundary code.  A 4-gram is thus a 64-bit key.  Counts of a bounded sample of
whole training texts per language are added up by Spark; the smoothed probabilities of all languages are stored in
sorted arrays of these keys.  A text goes to the language with the lowest cross-entropy per character.

Some of the sampled texts are not counted but kept for calibration: they give each language's usual cross-entropy, its
variance as a function of the text's length, the limit above which a text is marked as rejected (REJECTED of
the calibration texts are) and the sharpness of the score.

Defined results: texts that are null or have no letter are ``und`` with score 0; null languages are not learned; without
training rows every text is ``und``; ties go to the first language by name; rows repeated stay repeated; extra columns are
kept or ignored and never clash.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import remainder
from .textbatch import Chunk, map_text

ORDER, BITS = 4, 16
CODES = 1 << BITS
DOCS_PER_LANG, BYTES_PER_LANG = 720, 8_000_000  # training texts per language and about their bytes: the bound of the sample
HELD = 6  # one in so many sampled texts is for calibration
DISCOUNT = 0.75
REJECTED = 0.005
SPAN = 1 << 62
SHARPNESS = np.geomspace(1, 400, 25)  # of the score, per nat of difference in cross-entropy: the values to choose from
SPARE = np.arange(0xD800, 0xF900)  # surrogates and private use: no letter has these codes


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its code (0: no letter), and whether it is a letter."""
    points = np.arange(sys.maxunicode + 1)
    letter = np.array([chr(c).isalpha() for c in points])
    low = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in points])
    code = np.where(low < CODES, low, SPARE[low % len(SPARE)])
    return np.where(letter, code, 0).astype(np.uint16), letter


def _suffix(key: np.ndarray, k: int) -> np.ndarray:
    """The last k codes."""
    return key & np.uint64((1 << BITS * k) - 1)


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams (64-bit keys) of the texts, the first of each row, and whether the row has a letter."""
    code, letter = _tables()
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    off = lead[chunk.off]
    c = code[points]
    has = np.concatenate([[0], np.cumsum(letter[points])])[off]
    keep = c != 0
    keep[1:] |= c[:-1] != 0  # of a run of non-letters, the first
    starts = off[:-1][off[:-1] < off[1:]]
    keep[starts] = True
    first = np.concatenate([[0], np.cumsum(keep)])[off]
    c = c[keep].astype(np.uint64)
    key = c.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(c)
        before[k:] = c[:-k]
        for j in range(k):  # contexts do not reach into the text before
            at = first[:-1] + j
            before[at[at < first[1:]]] = 0
        key |= before << np.uint64(BITS * k)
    return key, first, np.diff(has) > 0


@dataclass
class Models:
    """langs, and by order k = 1..4 the sorted k-grams with the log-probability of each language (rows: grams)."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]  # by order: log weight of the lower order after this (k - 1)-gram, per language
    back_keys: list[np.ndarray]
    mean: np.ndarray  # cross-entropy of each language's calibration texts
    spread: tuple[float, float] = (1.0, 0.0)  # variance of the cross-entropy of n characters: a + b / n
    limit: float = np.inf  # in standard deviations
    sharpness: float = 40.0

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """(grams, languages)"""
        out = np.zeros((len(key), len(self.langs)), np.float32)
        todo = np.arange(len(key))
        for k in range(ORDER, 0, -1):
            part = _suffix(key[todo], k)
            at = np.minimum(np.searchsorted(self.keys[k - 1], part), len(self.keys[k - 1]) - 1)
            hit = self.keys[k - 1][at] == part
            if k == ORDER and hit.all():
                return self.logp[k - 1][at]
            out[todo[hit]] += self.logp[k - 1][at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                break
            if k == 1:
                out[todo] += self.back[0][0] + np.float32(np.log(1 / CODES))
            else:
                context = part >> np.uint64(BITS)
                at = np.minimum(np.searchsorted(self.back_keys[k - 1], context), len(self.back_keys[k - 1]) - 1)
                known = self.back_keys[k - 1][at] == context
                out[todo[known]] += self.back[k - 1][at[known]]
        return out

    def cross_entropy(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, languages) in nats a character, whether the row has a letter, and its characters."""
        key, first, letters = grams(chunk)
        n = np.diff(first)
        sums = np.zeros((chunk.n, len(self.langs)))
        some = np.flatnonzero(n)
        if len(some):
            distinct, of = np.unique(key, return_inverse=True)
            sums[some] = np.add.reduceat(self.log_probability(distinct)[of], first[:-1][some], axis=0, dtype=np.float64)
        return -sums / np.maximum(n, 1)[:, None], letters, n

    def excess(self, h: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many standard deviations the cross-entropy h of texts of n characters is above the language's mean."""
        a, b = self.spread
        return (h - self.mean[lang]) / np.sqrt(a + b / np.maximum(n, 1))


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """counts: by language, the distinct 4-grams and how often each occurs."""
    langs = sorted(counts)
    union = [np.unique(np.concatenate([_suffix(counts[x][0], k) for x in langs])) for k in range(1, ORDER + 1)]
    contexts = [np.unique(u >> np.uint64(BITS)) for u in union]
    logp = [np.zeros((len(u), len(langs)), np.float32) for u in union]
    back = [np.zeros((len(c), len(langs)), np.float32) for c in contexts]
    for i, x in enumerate(langs):
        grams_k, n_k = {ORDER: counts[x][0]}, {ORDER: counts[x][1].astype(float)}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
            grams_k[k], n_k[k] = np.unique(_suffix(grams_k[k + 1], k), return_counts=True)
            n_k[k] = n_k[k].astype(float)
        lower = np.full(len(union[0]), 1 / CODES)
        for k in range(1, ORDER + 1):
            own = np.zeros(len(union[k - 1]))
            own[np.searchsorted(union[k - 1], grams_k[k])] = n_k[k]
            at = np.searchsorted(contexts[k - 1], union[k - 1] >> np.uint64(BITS))
            total = np.bincount(at, own, len(contexts[k - 1]))
            kinds = np.bincount(at, own > 0, len(contexts[k - 1]))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(own - DISCOUNT, 0) / np.maximum(total, 1)[at] + weight[at] * lower
            logp[k - 1][:, i], back[k - 1][:, i] = np.log(p), np.log(weight)
            if k < ORDER:
                lower = p[np.searchsorted(union[k - 1], _suffix(union[k], k))]
    return Models(langs, union, logp, back, contexts, np.zeros(len(langs)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, gram, n)."""
    from .textbatch import chunks

    for b in batches:
        at = 0
        for chunk in chunks(b.column(1)):
            names = b.column(0).slice(at, chunk.n)
            at += chunk.n
            if not chunk.n:
                continue
            key, first, _ = grams(chunk)
            coded = names.dictionary_encode()
            rows = np.repeat(np.asarray(coded.indices), np.diff(first))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                gram, n = np.unique(key[rows == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _calibrate(models: Models, rows: list[tuple[int, int, float]], misses: np.ndarray) -> None:
    """rows: (language, characters, cross-entropy) of the calibration texts; misses: their log-loss for each sharpness."""
    if not rows:
        return
    lang, n, h = (np.array(x) for x in zip(*rows))
    for i in range(len(models.langs)):
        models.mean[i] = np.median(h[lang == i]) if (lang == i).any() else np.median(h)
    square = (h - models.mean[lang]) ** 2
    x = np.stack([np.ones(len(n)), 1 / np.maximum(n, 1)], axis=1) / np.maximum(square.mean(), 1e-9)
    a, b = np.linalg.lstsq(x, square / np.maximum(square.mean(), 1e-9), rcond=None)[0]
    models.spread = (max(float(a), 1e-4), max(float(b), 0.0))
    models.limit = float(np.quantile(models.excess(h, lang, n), 1 - REJECTED, method="higher"))
    models.sharpness = float(SHARPNESS[int(np.argmin(misses))])


def sample_share(n: int, size: int, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> int:
    """Of SPAN hashes, those that are sampled of a language with n texts of size bytes."""
    return int(min(1.0, docs_per_lang / n, bytes_per_lang / max(size, 1)) * SPAN)


def learn(docs: DataFrame, allowed: Column, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models | None:
    """Models of every language in the allowed rows, from about ``docs_per_lang`` whole texts of each, one at least, chosen by a hash of the id."""
    base = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    base = base.withColumn("__h", F.xxhash64(F.col("id").cast("string")))
    held = F.pmod(F.xxhash64(F.col("__h"), F.lit(1)), F.lit(HELD)) == 0
    place = F.pmod("__h", F.lit(SPAN))
    # with the first text of each language that is not held out: it is drawn however long the texts are
    sizes = base.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.min(F.when(~held, place)).alias("first"), F.min(place).alias("least")).collect()  # one row per language
    if not sizes:
        return None
    share = F.lit(0).cast("long")
    for r in sizes:
        first = r["least"] if r["first"] is None else r["first"]
        share = F.when(F.col("lang") == r["lang"], F.lit(max(sample_share(r["n"], r["size"], docs_per_lang, bytes_per_lang), first + 1))).otherwise(share)
    drawn = base.where(place < share)
    few = [r["lang"] for r in sizes if r["n"] < 5 * HELD or r["first"] is None]  # all of these are counted
    held = held & ~F.col("lang").isin(few)
    sample, calibration = drawn.where(~held).select("lang", "text"), drawn.where(held).select("lang", "text")
    rows = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = rows.column("lang").to_pylist(), np.asarray(rows.column("gram")).astype(np.int64).view(np.uint64), np.asarray(rows.column("n"))
    lang = np.array(lang, dtype=object)
    counts = {}
    for x in sorted(set(lang.tolist())):
        mine = lang == x
        order = np.argsort(gram[mine])
        counts[x] = (gram[mine][order], n[mine][order])
    if not counts:
        return None
    models = train(counts)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    index = {x: i for i, x in enumerate(models.langs)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textbatch import chunks

        loss = np.zeros(len(SHARPNESS))
        for b in batches:
            at = 0
            for chunk in chunks(b.column(1)):
                i = np.array([index.get(x, -1) for x in b.column(0).slice(at, chunk.n).to_pylist()], dtype=np.int64)
                at += chunk.n
                if not chunk.n:
                    continue
                h, letters, n = sent.value.cross_entropy(chunk)
                ok = letters & (i >= 0)
                h, i, n = h[ok], i[ok], n[ok]
                own = h[np.arange(len(i)), i]
                for k, s in enumerate(SHARPNESS):
                    loss[k] += np.log(np.exp(-s * (h - h.min(axis=1, keepdims=True))).sum(axis=1)).sum() + (s * (own - h.min(axis=1))).sum() if len(i) else 0.0
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[: len(i)].astype(np.int64)), pa.array(own)], names=["i", "n", "h"])
        k = np.arange(len(SHARPNESS))
        yield pa.RecordBatch.from_arrays([pa.array(-1 - k), pa.array(np.zeros(len(k), np.int64)), pa.array(loss)], names=["i", "n", "h"])

    # of the calibration texts, which are bounded, three numbers each; and the sums of the tasks
    judged = calibration.mapInArrow(judge, "i long, n long, h double")
    rows, sums = [], np.zeros(len(SHARPNESS))
    for r in judged.where("i >= 0").unionByName(judged.where("i < 0").groupBy("i").agg(F.max("n").alias("n"), F.sum("h").alias("h"))).collect():
        if r["i"] >= 0:
            rows.append((r["i"], r["n"], r["h"]))
        else:
            sums[-1 - r["i"]] = r["h"]
    _calibrate(models, sorted(rows), sums)
    return models


def identify(docs: DataFrame, models: Models | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default), lang_pred, score, cross_entropy and rejected of every row."""
    if models is None:
        kept = docs if carry is None else docs.select(*carry)
        return kept.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        m = sent.value
        names = np.array([*m.langs, "und"], dtype=object)

        def apply(chunk: Chunk) -> dict:
            h, letters, n = m.cross_entropy(chunk)
            best = np.where(letters & ~chunk.null, h.argmin(axis=1), len(m.langs))
            low = h.min(axis=1)
            known = best < len(m.langs)
            score = np.where(known, 1 / np.exp(-m.sharpness * (h - low[:, None])).sum(axis=1), 0.0)
            i = np.minimum(best, len(m.langs) - 1)
            reject = ~known | (m.excess(low, i, n) > m.limit)
            return {"lang_pred": names[best].tolist(), "score": score, "cross_entropy": pa.array(low, mask=~known), "rejected": reject}

        return apply

    return map_text(docs, text_col, make, "lang_pred string, score double, cross_entropy double, rejected boolean", carry)


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = remainder("doc_id", 4)
    out = identify(docs, learn(docs, rest != 2), carry=["doc_id"])
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
