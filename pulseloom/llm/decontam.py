"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive item words (a shorter item is one
window). The search runs over the word symbols (64-bit hashes) of a block of
documents: a shift table over blocks of two words tells how far a cursor may
skip, zero shifts lead to the bucket of windows that end in that block, and the
windows of a bucket are compared symbol by symbol and then byte by byte. Many
cursors advance in lockstep, so that each step is one numpy operation.

Windows are built on the driver in blocks of at most `max_windows`, each one a
broadcast of bounded size; a worker holds one block at a time, and all blocks
are searched in the same pass over the documents.

Cases: null or wordless texts have no words and are not contaminated; items
without words have no window; a null item_id counts as the string `null`;
repeated item rows count once by id; equal windows of several items credit each
of them; repeated documents are separate rows; texts are searched whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table, utf8_blocks

WINDOW = 13
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2**64
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BITS = 18  # shift and bucket tables: 2 ** 18 entries
_UNFOLD = 1 << 18  # candidate windows compared at once


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = _lower_table()
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n, mod 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_R, _RINV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = [tuple(out)]
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


@dataclass
class Words:
    """Words of consecutive texts: lower-cased bytes, word bounds, symbols and the text that each is in."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    symbol: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Words:
        data = _LOWER[raw]
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = _WORD[data]
        # A word never reaches over the end of its text.
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | first))
        end = np.flatnonzero(before & (~word | first))
        pw, inv = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
        symbol = (sums[end] - sums[start]) * inv[start]
        symbol ^= symbol >> np.uint64(29)
        doc = np.searchsorted(offsets, start, side="right") - 1
        return cls(data, start, end, symbol, doc)


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ b
    x = x * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


class Patterns:
    """Wu-Manber tables of windows that all have `length` words."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length = length
        self.words = list(windows)
        self.items = [sorted(windows[w]) for w in self.words]
        flat = [b" ".join(w) for w in self.words]
        joined = b" ".join(flat)
        raw = np.frombuffer(joined, np.uint8)
        found = Words.of(raw, np.array([0, len(raw)], np.int64))
        count = len(self.words)
        self.symbols = found.symbol.reshape(count, length)
        self.data = found.data
        self.starts = found.start.reshape(count, length)
        self.lens = (found.end - found.start).reshape(count, length)
        self.block = min(2, length)
        self.top = length - self.block + 1
        shift = np.full(1 << _BITS, self.top, np.int32)
        for j in range(length - self.block + 1):
            np.minimum.at(shift, self._slots(self.symbols, j + self.block - 1), length - self.block - j)
        self.shift = shift
        last = self._slots(self.symbols, length - 1)
        order = np.argsort(last, kind="stable")
        self.members = order
        self.bucket = np.searchsorted(last[order], np.arange((1 << _BITS) + 1))

    def _slots(self, symbols: np.ndarray, at) -> np.ndarray:
        """Table slots of the blocks that end at word `at` of each window, or of a text of symbols."""
        if symbols.ndim == 2:
            b = symbols[:, at]
            return _slot(symbols[:, at - 1] if self.block == 2 else np.zeros_like(b), b)
        b = symbols[at]
        return _slot(symbols[at - 1] if self.block == 2 else np.zeros_like(b), b)

    def search(self, text: Words, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of each confirmed occurrence."""
        n, m = len(text.symbol), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = np.linspace(m - 1, n, min(lanes, n - m + 1) + 1).astype(np.int64)
        at, stop = bounds[:-1].copy(), bounds[1:]
        hits = []
        while len(at):
            step = self.shift[self._slots(text.symbol, at)]
            zero = step == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.where(zero, 1, step)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        ends = ends[text.doc[ends] == text.doc[ends - m + 1]]
        if not len(ends):
            return ends, ends
        slots = self._slots(text.symbol, ends)
        size = self.bucket[slots + 1] - self.bucket[slots]
        total = np.cumsum(size)
        out, i = [], 0
        while i < len(ends):  # buckets are unfolded in pieces, so that many hits on one bucket need bounded memory
            j = max(i + 1, int(np.searchsorted(total, total[i] + _UNFOLD)))
            out.append(self._unfold(text, ends[i:j], slots[i:j], size[i:j]))
            i = j
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _unfold(self, text: Words, ends: np.ndarray, slots: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare each window of the bucket of each hit: by symbols, then directly."""
        f = np.repeat(ends - self.length + 1, size)
        inner = np.arange(len(f)) - np.repeat(np.cumsum(size) - size, size)
        w = self.members[np.repeat(self.bucket[slots], size) + inner]
        for j in range(self.length):
            same = text.symbol[f + j] == self.symbols[w, j]
            f, w = f[same], w[same]
        return self._confirm(text, f, w)

    def _confirm(self, text: Words, f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare the bytes of each word."""
        for j in range(self.length):
            if not len(f):
                break
            lens = self.lens[w, j]
            same = text.end[f + j] - text.start[f + j] == lens
            f, w, lens = f[same], w[same], lens[same]
            inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            differs = text.data[np.repeat(text.start[f + j], lens) + inner] != self.data[np.repeat(self.starts[w, j], lens) + inner]
            bad = np.zeros(len(f), bool)
            bad[np.repeat(np.arange(len(f)), lens)[differs]] = True
            f, w = f[~bad], w[~bad]
        return f, w


def item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    found = Words.of(raw, np.array([0, len(raw)], np.int64))
    data = found.data.tobytes()
    return [data[a:b] for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]


@dataclass
class Index:
    """Tables by window length, and the ids that windows point to."""

    tables: list[Patterns]
    ids: list[str]


def build_index(items: Iterator[tuple[str, str | None]], window: int = WINDOW, max_windows: int = 1 << 18) -> Iterator[Index]:
    """Indexes of at most `max_windows` windows (one item may exceed that alone), over all items."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    ids: dict[str, int] = {}
    size = 0
    for item, text in items:
        words = item_words(text)
        if not words:
            continue
        if size and size + len(words) > max_windows:
            yield Index([Patterns(m, w) for m, w in sorted(by_length.items())], list(ids))
            by_length.clear()
            ids, size = {}, 0
        k = ids.setdefault(item, len(ids))
        m = min(window, len(words))
        for a in range(len(words) - m + 1):
            by_length[m][tuple(words[a : a + m])].add(k)
        size += len(words) - m + 1
    if by_length:
        yield Index([Patterns(m, w) for m, w in sorted(by_length.items())], list(ids))


def scan(col: pa.Array, indexes: list) -> tuple[list[int], list[int], list[list[str]]]:
    """Words, hit words and items with an occurring window, for each text of an Arrow column. indexes: give an Index when called."""
    n_words, n_hit, items = [], [], []
    texts = [(Words.of(raw, offsets), len(offsets) - 1) for _, raw, offsets in utf8_blocks(col)]
    marks = [np.zeros(len(text.symbol) + 1, np.int64) for text, _ in texts]
    hits: list[list[set[str]]] = [[set() for _ in range(docs)] for _, docs in texts]
    for load in indexes:  # a block of windows is loaded once for all texts of a batch
        index = load()
        for (text, _), mark, found in zip(texts, marks, hits, strict=True):
            for t in index.tables:
                first, window = t.search(text)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + t.length, -1)
                pairs = np.unique(np.stack([text.doc[first], window], axis=1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
                for d, w in pairs.tolist():
                    found[d].update(index.ids[k] for k in t.items[w])
    for (text, docs), mark, found in zip(texts, marks, hits, strict=True):
        hit = np.cumsum(mark[:-1]) > 0
        n_words += np.bincount(text.doc, minlength=docs).tolist()
        n_hit += np.bincount(text.doc[hit], minlength=docs).tolist()
        items += [sorted(x) for x in found]
    return n_words, n_hit, items


FIELDS = [T.StructField("__words", T.LongType()), T.StructField("__hit", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType()))]


def find_overlap(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with __words, __hit (words inside an occurrence) and __items (ids, sorted as strings)."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).distinct().orderBy("i", "t")
    shared = [spark.sparkContext.broadcast(x) for x in build_index(((r[0], r[1]) for r in rows.toLocalIterator()), window)]
    at = docs.columns.index(text)

    def loader(bc, alone: bool):
        def load() -> Index:
            out = bc.value
            if not alone:
                bc._value = None  # the worker holds one block of windows at a time
                del bc._value
            return out

        return load

    def make(batch: pa.RecordBatch) -> list:
        n_words, n_hit, found = scan(batch.column(at), [loader(b, len(shared) == 1) for b in shared])
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string()))]

    return append_columns(docs, make, FIELDS)


def contaminated():
    return (F.col("__hit") > 0) & (F.lit(20) * F.col("__hit") >= F.col("__words"))


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlap(spark, docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Keep documents that are not contaminated; null and wordless texts are kept."""
    names = docs.columns
    return find_overlap(spark, docs, items).where(~contaminated()).select(*names)


_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_ASCII}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_SPLIT} as w from documents),
i as (select coalesce(cast(item_id as varchar), 'null') as item, {_SPLIT} as w from benchmark),
im as (select item, w, least({WINDOW}, len(w)) as m from i where len(w) > 0),
iw as (select distinct item, m, array_to_string(list_slice(w, k, k + m - 1), ' ') as win from (select item, w, m, unnest(range(1, len(w) - m + 2)) as k from im)),
dm as (select r, w, m from d, (select distinct m from iw) where len(w) >= m),
dw as (select r, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') as win from (select r, w, m, unnest(range(1, len(w) - m + 2)) as k from dm)),
hit as (select r, k, m, item from dw join iw using (m, win)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + m)) as p from hit) group by r),
it as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (r) left join it using (r)
"""
