"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every learnable document: each task adds its
documents into one dense vector per language, so at most languages x buckets
rows leave a task; labels beyond the `max_langs` most frequent are not learned.
The matrix of log probabilities (languages x buckets, a few
MB) is broadcast; scoring is a sparse gather and a segmented sum in numpy.

Cases: null text or a text without a letter gives `und` with score 0; an empty
table gives no rows; without any learnable label all are `und`; ties go to the
language that sorts first; repeated rows and repeated ids are separate rows;
long texts are cut into segments whose counts add up, never into prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, crc_remainder, strings, table

UND = "und"


@dataclass(frozen=True)
class LangIdConfig:
    bits: int = 16  # n-gram buckets: 2 ** bits
    sizes: tuple[int, ...] = (2, 3)
    alpha: float = 0.5
    segment: int = 1 << 20  # characters hashed at once
    max_langs: int = 1024  # documented bound: rows of the most frequent labels are learned from, ties by name

    @property
    def buckets(self) -> int:
        return 1 << self.bits


_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def segments(texts: list[str], limit: int, overlap: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (row, piece) of about `limit` characters; a longer text becomes pieces that overlap by `overlap`, so that each n-gram lies in exactly one piece."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text)), limit):
            piece = text[start : start + limit + overlap]
            if start and len(piece) <= overlap:
                break
            rows.append(row)
            parts.append(piece)
            size += len(piece) + 1
            if size >= limit:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), parts


def hashed(parts: list[str], size: int, codes: np.ndarray, bits: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and part of each n-gram of `size` characters that stays within a part and has a letter."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, owner.dtype)
    h = np.full(n, 0x9E3779B9 * size & 0xFFFFFFFF, np.uint32)
    inside = np.ones(n, bool)
    lettered = np.zeros(n, bool)
    for k in range(size):
        c = codes[k : k + n]
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside &= c != 0
        lettered |= c > 32
    keep = np.flatnonzero(inside & lettered)
    h = h[keep]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits), owner[keep]


def features(texts: list[str], cfg: LangIdConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays that together hold each n-gram of each text exactly once; rows ascend within one array."""
    letter = letter_table()
    for size in cfg.sizes:
        for rows, parts in segments(texts, cfg.segment, size - 1):
            joined = "\x00".join(parts)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            codes = np.where(letter[codes], codes, np.uint32(32))
            ends = np.cumsum(lens + 1)[:-1] - 1
            codes[ends] = 0
            owner = np.repeat(rows.astype(np.int32), lens + 1)[: len(codes)]
            yield hashed(parts, size, codes, cfg.bits, owner)


def lowered(col: pa.Array) -> list[str]:
    return [t.lower() for t in strings(col).to_pylist()]


@dataclass
class LangModel:
    """Sorted languages and log probabilities, [bucket, language]."""

    langs: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    cfg: LangIdConfig = field(default_factory=LangIdConfig)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        low = [(t or "").lower() for t in texts]
        total = np.zeros((len(low), max(1, len(self.langs))))
        seen = np.zeros(len(low), np.int64)
        for bucket, row in features(low, self.cfg):
            if not len(row):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            seen[row[starts]] += np.diff(np.r_[starts, len(row)])
            if self.langs:
                np.add.at(total, row[starts], np.add.reduceat(self.log_prob[bucket], starts, axis=0))
        # A lone letter has no n-gram; it still is a letter.
        has = [bool(seen[i]) or any(map(str.isalpha, t)) for i, t in enumerate(low)]
        if not self.langs:
            return [UND] * len(low), np.zeros(len(low))
        total += self.log_prior
        best = total.argmax(axis=1)
        peak = total.max(axis=1)
        score = 1.0 / np.exp(total - peak[:, None]).sum(axis=1)
        return [self.langs[b] if ok else UND for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", cfg: LangIdConfig = LangIdConfig()) -> LangModel:
    """Counts over all rows of docs with a label; null labels don't count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            names, index = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
            for name in names.tolist():
                if name not in sums:
                    sums[name], seen[name] = np.zeros(cfg.buckets, np.int64), 0
                seen[name] += labels.count(name)
            for bucket, row in features(lowered(batch.column(0)), cfg):
                which = index[row]
                for k, name in enumerate(names.tolist()):
                    sums[name] += np.bincount(bucket[which == k] if len(names) > 1 else bucket, minlength=cfg.buckets)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[seen[name], total[at]].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    often = [r[0] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.max_langs).select("lang").collect()]
    rows = rows.where(F.col("lang").isin(often))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column("lang").to_pylist()))
    where = {name: k for k, name in enumerate(langs)}
    k = np.array([where[x] for x in counted.column("lang").to_pylist()], np.int64)
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    counts, prior = np.zeros((cfg.buckets, len(langs))), np.zeros(len(langs))
    inside = bucket >= 0
    counts[bucket[inside], k[inside]] = n[inside]
    prior[k[~inside]] = n[~inside]
    log_prob = np.log(counts + cfg.alpha) - np.log(counts.sum(axis=0) + cfg.alpha * cfg.buckets)
    return LangModel(langs, np.log(prior / max(1, prior.sum())) if langs else prior, log_prob, cfg)


def predict(spark: SparkSession, docs: DataFrame, model: LangModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and its posterior probability. Columns of these names are replaced."""
    docs = docs.drop(*(c for c in (pred, score) if c != text))
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> list:
        langs, scores = shared.value.predict(batch.column(at).to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, make, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents outside the held-out quarter; a null id is neither held out nor learned."""
    return docs.where(crc_remainder(doc_id, 4) != 2)


def op10_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(learnable(docs))
    held = docs.select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return predict(spark, held, model).select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Keep documents in a language: not `und`, and with one language at least as probable as all others together."""
    model = fit(learnable(docs))
    names = docs.columns
    out = predict(spark, docs, model, pred="__lang_pred", score="__lang_score")
    return out.where((F.col("__lang_pred") != UND) & (F.col("__lang_score") >= min_score)).select(*names)
