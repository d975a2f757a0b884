"""Token counts without token ids: pieces are counted once per distinct
pre-token, joined to each document's pre-token frequencies, and summed.

1. A task cuts its documents into blocks and codes each block's pre-tokens, so a
   block is a table (pre-token, document, frequency). Pre-tokens that occur in
   `common` or more documents of the block are counted there, through a bounded
   memo: a very frequent pre-token would meet in one task otherwise.
2. All other pre-tokens are shuffled by value, with their postings packed in four
   bytes each. The task that gets a pre-token counts its pieces once, joins the
   count to the postings and sums by document before anything leaves it.
3. The sums return, packed, to their slice of a block, which adds them up by
   document.

Pre-tokens follow the vocabulary's own rules: texts are cut at special tokens
(one id each), normalised (NFC, lower case) and split by its pattern.

Cases: null and empty texts have no token; repeated rows are separate; special
strings in a text are special tokens, as is the library's default; long texts
are a block of their own; documents keep their order nowhere but within a block.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table


@dataclass(frozen=True)
class CountConfig:
    vocabulary: str = "word_bpe_49k.json"
    directory: str | None = None  # of vocabulary files; None: where the package of public tokenizers has them
    limit: int = 2048
    block_words: int = 3_000_000
    block_docs: int = 1 << 18  # documents of a block; postings hold 20 bits of document and 12 of frequency
    common: int = 6
    memo: int = 400_000
    flush: int = 2_000_000  # postings that a task sums at once
    slice_docs: int = 2048  # documents of a block whose sums travel as one row and meet in one group


def vocabulary_path(cfg: CountConfig) -> str:
    if cfg.directory:
        return f"{cfg.directory}/{cfg.vocabulary}"
    import public_tokenizers

    return public_tokenizers.path(cfg.vocabulary)


class PieceCounter:
    """Pieces of distinct pre-tokens, and the rules that make pre-tokens."""

    #: The vocabulary's split pattern.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.hint = special[0][:2] if special else "\x00"
        self.memo: dict[str, int] = {}
        self.limit = memo

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its special tokens."""
        if self.hint in text and (parts := self.special.split(text))[1:]:
            return [w for p in parts for w in self.PATTERN.findall(self.normal(p))], len(parts) - 1
        return self.PATTERN.findall(self.normal(text)), 0

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower case by character: no final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, words: list[str]) -> np.ndarray:
        """Pieces of each of some distinct pre-tokens."""
        memo = self.memo
        missing = [w for w in words if w not in memo]
        if len(memo) + len(missing) > self.limit:
            memo.clear()
            missing = words
        new = {}
        for at in range(0, len(missing), 8192):
            some = missing[at : at + 8192]
            new.update(zip(some, (len(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        if len(new) <= self.limit:
            memo.update(new)
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return np.fromiter((new[w] if w in new else memo[w] for w in words), np.int64, len(words))


_COUNTERS: dict[tuple, PieceCounter] = {}


def counter(cfg: CountConfig) -> PieceCounter:
    key = (vocabulary_path(cfg), cfg.memo)
    if key not in _COUNTERS:
        _COUNTERS[key] = PieceCounter(*key)
    return _COUNTERS[key]


def binary(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices of a 4-byte array as binary values; starts has one more entry than there are values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class Block:
    """Documents of a task whose pre-tokens are coded together."""

    def __init__(self):
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.parts: list[np.ndarray] = []
        self.lens: list[int] = []
        self.fixed: list[int] = []

    def add(self, words: list[str], special: int) -> None:
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.lens.append(len(words))
        self.fixed.append(special)

    def table(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens; code, document and frequency, by code and document."""
        docs = len(self.lens)
        key = np.concatenate(self.parts).astype(np.int64) * docs + np.repeat(np.arange(docs), self.lens)
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(key)])
        key = key[first]
        return list(self.codes), key // docs, key % docs, n



def spread_blocks(rows: DataFrame, cfg: CountConfig) -> DataFrame:
    """(slot, block, value, postings): a row for each rare pre-token of a block; and for each block's documents (null value) their sums so far."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(cfg)
        number = TaskContext.get().partitionId() << 32
        block, ids, size = Block(), [], []

        def close() -> Iterator[pa.RecordBatch]:
            words, code, doc, n = block.table()
            docs = len(block.lens)
            spread_ = np.bincount(code, minlength=len(words))
            often = spread_ >= cfg.common
            pieces = np.zeros(len(words), np.int64)
            at = np.flatnonzero(often)
            pieces[at] = count.pieces([words[i] for i in at])
            sums = np.array(block.fixed, np.int64)
            here = often[code]
            np.add.at(sums, doc[here], pieces[code[here]] * n[here])
            rare, rdoc, rn = code[~here], doc[~here], n[~here]
            # A frequency over 12 bits takes several postings.
            times = -(-rn // 4095)
            if len(times) and times.max() > 1:
                rare, rdoc, rn, times = (np.repeat(x, times) for x in (rare, rdoc, rn, times))
                turn = np.arange(len(rare)) - np.searchsorted(rare * docs + rdoc, rare * docs + rdoc)
                rn = np.minimum(4095, rn - 4095 * turn)
            packed = (rdoc << 12 | rn).astype("<u4")
            start = np.flatnonzero(np.r_[True, rare[1:] != rare[:-1]]) if len(rare) else np.zeros(0, np.int64)
            own = rare[start]
            bounds = np.r_[start, len(rare)]
            for a in range(0, len(own), 50_000):
                b = min(len(own), a + 50_000)
                part = bounds[a : b + 1]
                value = pa.array([words[i] for i in own[a:b].tolist()], pa.string())
                yield batch_of(np.full(b - a, number), value, binary(packed[part[0] : part[-1]], part - part[0]), None)
            who = pa.concat_arrays(ids)
            yield batch_of(np.full(docs, number), pa.nulls(docs, pa.string()), None, (who, np.concatenate(size), np.arange(docs), sums))

        def batch_of(numbers: np.ndarray, value: pa.Array, postings: pa.Array | None, docs: tuple | None) -> pa.RecordBatch:
            m = len(numbers)
            who, n_bytes, place, sums = docs or (pa.nulls(m, ids[0].type), None, None, None)
            cols = [pa.array(numbers, pa.int64()), value, pa.nulls(m, pa.binary()) if postings is None else postings, who]
            cols += [pa.nulls(m, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (n_bytes, place, sums)]
            return pa.RecordBatch.from_arrays(cols, names=["block", "value", "postings", "doc_id", "n_bytes", "place", "sums"])

        for batch in batches:
            texts = strings(batch.column(1))
            ids.append(batch.column(0))
            size.append(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            for t in texts.to_pylist():
                block.add(*count.pretokens(t))
            if sum(block.lens) >= cfg.block_words or len(block.lens) >= cfg.block_docs - 2000:
                yield from close()
                block, ids, size, number = Block(), [], [], number + 1
        if block.lens:
            yield from close()

    return rows.mapInArrow(run, f"block long, value string, postings binary, doc_id {id_type}, n_bytes long, place long, sums long")


def count_tokens(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cfg: CountConfig = CountConfig()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    spread_ = spread_blocks(rows, cfg)
    dealt = spread_.repartition(F.coalesce("value", F.concat(F.col("block").cast("string"), F.lit("\x00"), F.col("place").cast("string"))))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count each distinct pre-token of the task, join to its postings, sum by document."""
        count = counter(cfg)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """One row for each slice of a block, with the sums of its documents."""
            block, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, block))
            block, doc, n = block[order], doc[order], n[order]
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])])
            block, doc, total = block[first], doc[first], np.add.reduceat(n, first)
            part = doc // cfg.slice_docs
            cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
            pairs = np.stack([doc, total], axis=1).astype("<u4").ravel()
            m = len(cut)
            cols = [pa.array(block[cut]), pa.array(part[cut]), pa.nulls(m, kind), *(pa.nulls(m, pa.int64()) for _ in range(3)), binary(pairs, 2 * np.r_[cut, len(doc)])]
            yield pa.RecordBatch.from_arrays(cols, names=out_names)

        kind = None
        out_names = ["block", "slice", "doc_id", "n_bytes", "place", "sums", "packed"]
        for batch in batches:
            kind = batch.column(3).type
            value = batch.column(1)
            own = batch.filter(value.is_null())
            place = own.column(5)
            part = pa.array(place.to_numpy(zero_copy_only=False).astype(np.int64) // cfg.slice_docs)
            yield pa.RecordBatch.from_arrays([own.column(0), part, own.column(3), own.column(4), place, own.column(6), pa.nulls(own.num_rows, pa.binary())], names=out_names)
            some = batch.filter(value.is_valid())
            if not some.num_rows:
                continue
            coded = some.column(1).dictionary_encode()
            pieces = count.pieces(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            postings = some.column(2)
            flat = np.frombuffer(b"".join(postings.to_pylist()), "<u4").astype(np.int64)
            per = pc.binary_length(postings).to_numpy(zero_copy_only=False) // 4
            held.append((np.repeat(some.column(0).to_numpy(), per), flat >> 12, np.repeat(pieces, per) * (flat & 4095)))
            many += len(flat)
            if many >= cfg.flush:
                yield from flush()
                held, many = [], 0
        if held:
            yield from flush()

    def add_up(rows: pa.Table) -> pa.Table:
        """Documents of a slice, with all their sums."""
        here = rows.filter(pc.is_null(rows["packed"]))
        place = here["place"].to_numpy()
        pairs = np.frombuffer(b"".join(rows["packed"].drop_null().to_pylist()), "<u4").astype(np.int64).reshape(-1, 2)
        base = int(place.min())
        total = np.zeros(int(place.max()) - base + 1, np.int64)
        np.add.at(total, place - base, here["sums"].to_numpy())
        np.add.at(total, pairs[:, 0] - base, pairs[:, 1])
        return pa.table([here["doc_id"], here["n_bytes"], pa.array(total[place - base])], names=["doc_id", "n_bytes", "n_tokens"])

    sums = dealt.mapInArrow(join, f"block long, slice long, doc_id {id_type}, n_bytes long, place long, sums long, packed binary")
    return sums.groupBy("block", "slice").applyInArrow(add_up, f"doc_id {id_type}, n_bytes long, n_tokens long")


def op6_pretoken_counts(spark: SparkSession, sf_dir: str, cfg: CountConfig = CountConfig()) -> DataFrame:
    out = count_tokens(spark, table(spark, sf_dir, "documents"), cfg=cfg)
    return out.withColumn("over_limit", F.col("n_tokens") > cfg.limit)
