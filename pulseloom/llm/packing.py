"""Lexical retrieval packing: a sharded BM25 inverted index returns the neighbours
of a seed document, best first and unused so far, which fill the seed's window.

1. Each text is tokenised once; its ids are written to the shared folder, with
   the task's document frequencies. Document count, mean length and frequencies
   are those of all documents; they are bounded by the vocabulary.
2. Documents are routed so that lexical neighbours meet: a document's key is a
   sequence of consistent samples of its terms by BM25 weight (the term with the
   least -log(u) / weight, u a hash of the term), so that two documents have
   the same first key with the probability that grows with their overlap. All
   documents are sorted by their keys, and a shard is a run of this order of
   `shard_docs` documents or `shard_tokens` tokens. A hot key is several shards.
   Order and shards depend on the texts alone, not on files.
3. A shard's index scores all of its documents by all terms of the seed. The
   document that reaches over the end of a window is cut there, and its rest is
   the seed of the next one. Only the last window of a shard is padded.

Ids are those of the tokenizers library, computed from the same vocabulary's
ranks (a test holds both against each other, over all code points too).

Cases: null and empty texts are the end id alone; repeated rows and ids are
separate documents; a text longer than a window fills several; ties in score go
to the earlier document of the order; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, scratch, strings, table, trimmed


@dataclass(frozen=True)
class PackConfig:
    vocabulary: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
    directory: str | None = None  # of vocabulary files; None: where the package of public tokenizers has them
    window: int = 2048
    end_id: int = 1
    shard_docs: int = 4096
    shard_tokens: int = 4_000_000
    keys: int = 4  # of a document's route
    piece: int = 1024  # rows that are tokenised at a time
    id_type: str = "<u2"  # of ids in intermediate tables; a vocabulary that doesn't fit is refused
    seed: int = 42
    k1: float = 1.2
    b: float = 0.75


class TextEncoder:
    """Ids of whole texts: by the vocabulary's ranks, which is several times as fast, and by the library itself where a special token is in the text."""

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = self.tokenizer.get_vocab_size()
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def vocabulary_paths(cfg: PackConfig) -> tuple[str, str]:
    if cfg.directory:
        return f"{cfg.directory}/{cfg.vocabulary}", f"{cfg.directory}/{cfg.ranks}"
    import public_tokenizers

    return public_tokenizers.path(cfg.vocabulary), public_tokenizers.path(cfg.ranks)


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(cfg: PackConfig) -> TextEncoder:
    """One per worker process, kept between tasks."""
    key = vocabulary_paths(cfg)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


@dataclass(frozen=True)
class Statistics:
    """Of all documents: their number, mean length and, by term, -1 or the number of documents that have it."""

    n: int
    mean: float
    frequency: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.frequency + 0.5) / (self.frequency + 0.5))


def postings(docs: list[np.ndarray], stats: Statistics, idf: np.ndarray, cfg: PackConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, BM25 weight) of documents, by term and document."""
    n = max(1, len(docs))
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    kind = np.int32 if len(idf) * n < 1 << 31 else np.int64  # the smaller sorts twice as fast
    terms = np.concatenate(docs).astype(kind) if docs else np.zeros(0, kind)
    key, tf = np.unique(terms * kind(n) + np.repeat(np.arange(len(docs), dtype=kind), lens), return_counts=True)
    term, doc = np.divmod(key, kind(n))
    norm = cfg.k1 * (1 - cfg.b + cfg.b * lens / max(1.0, stats.mean))
    return term, doc, idf[term] * tf * (cfg.k1 + 1) / (tf + norm[doc])


class Bm25:
    """Inverted index of a shard. Terms that a sixteenth of the documents have are rows of a matrix, the others postings.

    `drop` leaves used documents out of the index; scores are of `alive` ones.
    """

    def __init__(self, docs: list[np.ndarray], stats: Statistics, cfg: PackConfig, idf: np.ndarray | None = None):
        n = len(docs)
        self.alive = np.arange(n)
        term, doc, weight = postings(docs, stats, stats.idf() if idf is None else idf, cfg)
        weight = weight.astype(np.float32)
        _, df = np.unique(term, return_counts=True)
        place = np.repeat(np.arange(len(df), dtype=np.int32), df)
        wide = df >= max(16, n / 16)
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.matrix = np.zeros((int(wide.sum()), n), np.float32)
        own = wide[place]
        self.matrix[self.row[place[own]], doc[own]] = weight[own]
        order = np.argsort(doc, kind="stable")
        self.place = place[order]  # the terms of each document
        self.begin = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
        self.posting = (place[~own], doc[~own], weight[~own])
        self._starts()

    def _starts(self) -> None:
        self.start = np.searchsorted(self.posting[0], np.arange(len(self.row) + 1))

    def drop(self, unused: np.ndarray) -> None:
        keep = unused[self.alive]
        to = np.cumsum(keep) - 1
        self.alive, self.matrix = self.alive[keep], np.ascontiguousarray(self.matrix[:, keep])
        place, doc, weight = self.posting
        own = keep[doc]
        self.posting = (place[own], to[doc[own]], weight[own])
        self._starts()

    def scores(self, seed: int) -> np.ndarray:
        q = self.place[self.begin[seed] : self.begin[seed + 1]]
        row = self.row[q]
        a = self.start[q[row < 0]]
        size = self.start[q[row < 0] + 1] - a
        at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
        return self.matrix[row[row >= 0]].sum(0) + np.bincount(self.posting[1][at], weights=self.posting[2][at], minlength=len(self.alive))


def route_table(vocabulary: int, cfg: PackConfig) -> np.ndarray:
    """-log(u) of each key and term."""
    return np.random.default_rng(cfg.seed).exponential(size=(cfg.keys, vocabulary))


def routes(docs: list[np.ndarray], stats: Statistics, idf: np.ndarray, draws: np.ndarray, cfg: PackConfig) -> np.ndarray:
    """(documents, keys): the sampled terms of each document, -1 where it has none."""
    term, doc, weight = postings(docs, stats, idf, cfg)
    order = np.argsort(doc, kind="stable")
    term, doc, weight = term[order], doc[order], np.maximum(weight[order], 1e-9)
    out = np.full((len(docs), cfg.keys), -1, np.int64)
    if not len(term):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    for k in range(cfg.keys):
        wait = draws[k, term] / weight
        least = np.minimum.reduceat(wait, first)
        hit = np.flatnonzero(wait == np.repeat(least, np.diff(np.r_[first, len(doc)])))
        out[doc[hit[::-1]], k] = term[hit[::-1]]  # the first of equals
    return out


def ranked(scores: np.ndarray, unused: np.ndarray, first: int = 64) -> Iterator[int]:
    """Unused documents that share a term with the seed, by score and then row."""
    scores = np.where(unused, scores, 0.0)
    best = np.argpartition(-scores, first)[: first + 1] if len(scores) > first + 1 else np.arange(len(scores))
    best = best[np.lexsort((best, -scores[best]))]
    # Within the partition, rows that tie with its last score may be missing: those come from the full order.
    sure = best[scores[best] > (scores[best[-1]] if len(best) < len(scores) else 0.0)]
    yield from sure.tolist()
    rest = np.flatnonzero(scores > 0)
    rest = rest[~np.isin(rest, sure)]
    yield from rest[np.lexsort((rest, -scores[rest]))].tolist()


def retrieval_order(docs: list[np.ndarray], stats: Statistics, cfg: PackConfig, idf: np.ndarray | None = None) -> list[int]:
    """The documents of a shard in the order in which windows take them."""
    index = Bm25(docs, stats, cfg, idf)
    unused = np.ones(len(docs), bool)
    order: list[int] = []
    fill = lowest = 0
    seed = -1  # the document that was cut at the end of the last window

    def take(d: int) -> None:
        nonlocal fill
        unused[d] = False
        order.append(d)
        fill += len(docs[d]) + 1

    while len(order) < len(docs):
        lowest += int(unused[lowest:].argmax())
        if seed < 0:
            seed = lowest
            take(seed)
        fill %= cfg.window
        if fill:
            if unused.sum() < 0.8 * len(index.alive):
                index.drop(unused)
            for d in ranked(index.scores(seed), unused[index.alive]):
                take(int(index.alive[d]))
                if fill >= cfg.window:
                    break
            while fill < cfg.window and len(order) < len(docs):  # no neighbour is left: the next documents by row
                lowest += int(unused[lowest:].argmax())
                take(lowest)
        seed = order[-1] if fill > cfg.window else -1
    return order


_TOKENS = "row long, tokens binary, term int, n long"


def tokenised(docs: DataFrame, text: str, doc_id: str, cfg: PackConfig, path: str = "") -> tuple[DataFrame, Statistics]:
    """(doc_id, row, tokens) of all documents, as a table in the shared folder, and their statistics."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(cfg)
        row = first = TaskContext.get().partitionId() << 40
        if enc.size - 1 > np.iinfo(cfg.id_type).max:
            raise ValueError(f"ids of this vocabulary don't fit {cfg.id_type}")
        frequency, last = np.zeros(enc.size, np.int64), np.zeros(enc.size, np.int64)
        total = 0
        id_type = None
        # A batch in pieces: its texts, as Python strings, take several times the memory of their ids.
        for batch in (whole.slice(k, cfg.piece) for whole in batches for k in range(0, whole.num_rows, cfg.piece)):
            id_type = batch.column(0).type
            held = [enc.encode(t) for t in strings(batch.column(1)).to_pylist()]
            for ids in held:
                at = np.arange(len(ids))
                last[ids] = at  # one place of each term
                frequency[ids[last[ids] == at]] += 1
                total += len(ids)
            n = len(held)
            tokens = pa.array([ids.astype(cfg.id_type).tobytes() for ids in held], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n)), tokens, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["doc_id", "row", "tokens", "term", "n"])
            row += n
        if id_type is not None:
            seen = np.flatnonzero(frequency)
            term, count = np.r_[-2, -1, seen].astype(np.int32), np.r_[row - first, total, frequency[seen]]
            m = len(term)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(term), pa.array(count)], names=["doc_id", "row", "tokens", "term", "n"])

    path = path or scratch(spark, "tokens")
    rows.mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, {_TOKENS}").write.parquet(path)
    table = spark.read.parquet(path)
    sums = {r["term"]: r["n"] for r in table.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = sums.pop(-2, 0)
    mean = sums.pop(-1, 0) / max(1, n)
    frequency = np.zeros(max(sums, default=0) + 1, np.int64)
    frequency[list(sums)] = list(sums.values())
    return table.where("tokens is not null").select("doc_id", "row", "tokens"), Statistics(n, mean, frequency)


def token_lists(col: pa.Array, cfg: PackConfig) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), cfg.id_type) for x in col]


def routed(tokens: DataFrame, stats: Statistics, cfg: PackConfig) -> DataFrame:
    """tokens in the order of their routes, in partitions of about two shards."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(stats)  # an integer for each term of the vocabulary
    keys = [f"k{i}" for i in range(cfg.keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, draws = shared.value.idf(), route_table(len(shared.value.frequency), cfg)
        for batch in batches:
            out = routes(token_lists(batch.column(2), cfg), shared.value, idf, draws, cfg)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, i].astype(np.int32)) for i in range(cfg.keys))], names=[*batch.schema.names, *keys])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    path = scratch(spark, "routes")
    # Written, as the limits of a range are sampled in a pass of its own; that reads the keys alone.
    tokens.mapInArrow(trimmed(run), f"doc_id {kind}, row long, tokens binary, " + ", ".join(f"{k} int" for k in keys)).withColumn("same", F.xxhash64("tokens")).write.parquet(path)
    keyed = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(stats.n * (stats.mean + 1) / cfg.shard_tokens / 2) + 1)
    order = [*keys, "same", "row"]  # copies stay together, and the order doesn't depend on files
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "tokens")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cfg: PackConfig = PackConfig(), ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and with `ids` the ids themselves)."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    tokens, stats = tokenised(docs, text, doc_id, cfg, path)
    rows = routed(tokens, stats, cfg)
    drop_path(spark, path)  # the routed table has them all
    shared = spark.sparkContext.broadcast(stats)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids

    def shard(names: list[pa.Array], docs: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        order = np.array(retrieval_order(docs, shared.value, cfg), np.int64)
        lens = np.array([len(docs[d]) + 1 for d in order], np.int64)
        ends = np.cumsum(lens)
        total, w = int(ends[-1]), cfg.window
        cuts = np.unique(np.r_[ends - lens, np.arange(0, total, w)])
        size = np.diff(np.r_[cuts, total])
        place = np.searchsorted(ends, cuts, side="right")
        start = cuts - (ends - lens)[place]
        crc, flat = [], []
        for p, s, n in zip(place.tolist(), start.tolist(), size.tolist(), strict=True):
            d = docs[order[p]]
            part = d[s : s + n]
            if s + n > len(d):
                part = np.append(part, np.array([cfg.end_id], part.dtype))
            crc.append(zlib.crc32(part.astype("<u4", copy=False).tobytes()))
            if ids:
                flat.append(part.astype(np.int32))
        who = pc.take(pa.concat_arrays(names), pa.array(order[place]))
        cols = [who, pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(lens[place]), pa.array(first + cuts // w), pa.array(cuts % w)]
        if ids:
            cols.append(pa.array(flat, pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]), first + -(-total // w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of sequences are unique over tasks, as each task has its own range.
        first = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for k, own in enumerate(token_lists(batch.column(1), cfg)):
                held.append(own.copy())
                names.append(batch.column(0).slice(k, 1))
                size += len(own) + 1
                if len(held) >= cfg.shard_docs or size >= cfg.shard_tokens:
                    out, first = shard(names, held, first)
                    yield out
                    names, held, size = [], [], 0
        if held:
            yield shard(names, held, first)[0]

    return rows.mapInArrow(trimmed(run), schema)


def op1_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The pieces of all documents: each of their ids lies in exactly one."""
    return pack(docs)
