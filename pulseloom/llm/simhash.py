"""SimHash near-duplicates, joined through a Gray-order hierarchical index.

1. Fingerprints: one pass in Arrow batches; nothing but (doc_id, 64 bits) leaves.
2. Distinct fingerprints are dealt by pigeonhole: of `max_bits` + 1 bit ranges
   at least one is equal in two fingerprints that link, so each fingerprint goes
   to the tasks of its ranges' values. A value that more than `hot` fingerprints
   share is dealt once more, by the ranges of the bits that are left; this loses
   no pair either. Nothing is dropped.
3. Each task sorts its fingerprints by Gray rank and builds a hierarchical index:
   a node holds the bits on which all its members agree (mask and pattern), bits
   that are already in an upper node are factored out of the lower one. A search
   walks the levels for many fingerprints at once, adds up the differences on
   the masked bits and prunes every group whose sum exceeds the limit.
4. A task emits a forest (each fingerprint with a root), never all pairs; the
   components are closed by alternating min-label rounds over DataFrames, with
   each round written to the shared folder.

Cases: null or wordless texts have fingerprint zero and link like any other;
texts of one or two words are one shingle; equal texts share a fingerprint; a
null doc_id is kept as a row, and a component of only null ids has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, drop_path, scratch, table, utf8_blocks

_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class SimHashConfig:
    words: int = 3
    max_bits: int = 2
    seed: int = 42
    fanout: int = 16
    hot: int = 256  # fingerprints of one pigeonhole value that are dealt no further
    rows_per_task: int = 500_000


def squeezed(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space between words; word starts and ends there, and words of each text."""
    data = _LOWER[raw]
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first))
    end = np.flatnonzero(before & (~word | first))
    per = np.bincount(np.searchsorted(offsets, start, side="right") - 1, minlength=len(offsets) - 1)
    lens = end - start
    at = np.cumsum(lens + 1) - (lens + 1)
    out = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(at, lens) + inner] = data[np.repeat(start, lens) + inner]
    return out.tobytes(), at, at + lens, per


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for c in range(0, len(h), 1 << 16):
        part = h[c : c + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(h)).astype(np.uint8)).view(">u8")[0]


def fingerprints(col: pa.Array, cfg: SimHashConfig = SimHashConfig()) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    result = np.zeros(len(col), np.uint64)
    digest, seed = xxhash.xxh64_intdigest, cfg.seed
    for row, raw, offsets in utf8_blocks(col):
        data, start, end, per = squeezed(raw, offsets)
        last = np.cumsum(per)
        for k in np.flatnonzero(per).tolist():
            a, b = int(last[k] - per[k]), int(last[k])
            m = min(cfg.words, b - a)
            froms, tos = start[a : b - m + 1].tolist(), end[a + m - 1 : b].tolist()
            h = np.fromiter((digest(data[i:j], seed) for i, j in zip(froms, tos, strict=True)), np.uint64, len(froms))
            result[row + k] = majority(h)
    return result


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 is the root."""

    def __init__(self, codes: np.ndarray, fanout: int):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.fanout = fanout
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        masks, patterns = [full], [self.codes]
        while len(masks[0]) > 1:
            cut = np.arange(0, len(masks[0]), fanout)
            lead = np.repeat(patterns[0][cut], np.diff(np.r_[cut, len(masks[0])]))
            agree = np.bitwise_and.reduceat(masks[0] & ~(patterns[0] ^ lead), cut)
            masks.insert(0, agree)
            patterns.insert(0, patterns[0][cut] & agree)
        # A node keeps the masked bits that its parent lacks: sums along a path count each bit once.
        self.levels = [(patterns[0], masks[0])]
        for k in range(1, len(masks)):
            up = masks[k - 1][np.arange(len(masks[k])) // fanout]
            self.levels.append((patterns[k], masks[k] & ~up))

    def search(self, queries: np.ndarray, equal: np.ndarray, limit: int, block: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, position) of codes within `limit` bits that agree on the bits of `equal` with their query."""
        for at in range(0, len(queries), block):
            q = np.arange(at, min(at + block, len(queries)))
            node = np.zeros(len(q), np.int64)
            acc = np.zeros(len(q), np.int64)
            stack = [(0, q, node, acc)]
            while stack:
                level, q, node, acc = stack.pop()
                if len(q) > 1 << 18:  # bounded memory: halves, one after the other
                    h = len(q) // 2
                    stack += [(level, q[:h], node[:h], acc[:h]), (level, q[h:], node[h:], acc[h:])]
                    continue
                pattern, mask = self.levels[level]
                diff = (queries[q] ^ pattern[node]) & mask[node]
                acc = acc + np.bitwise_count(diff)
                ok = (acc <= limit) & ((diff & equal[q]) == 0)
                q, node, acc = q[ok], node[ok], acc[ok]
                if not len(q):
                    continue
                if level == len(self.levels) - 1:
                    yield q, node
                    continue
                size = len(self.levels[level + 1][0])
                child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                q, acc = np.repeat(q, self.fanout), np.repeat(acc, self.fanout)
                inside = child < size
                stack.append((level + 1, q[inside], child[inside], acc[inside]))


def forest(size: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of `size` positions is linked to, over the given links."""
    root = np.arange(size)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low < high
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(root, high[open_], low[open_])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def bit_ranges(bits: list[int], parts: int) -> list[int]:
    """Masks of nearly equal parts of the given bit positions."""
    return [int(sum(1 << int(b) for b in part)) for part in np.array_split(np.array(bits), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal_fingerprints(fps: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(fp, equal, key): distinct fingerprints dealt so that any two within cfg.max_bits share a row's (equal, key)."""
    parts = cfg.max_bits + 1
    first = bit_ranges(list(range(63, -1, -1)), parts)
    pick = F.array(*(F.struct(F.lit(_signed(m)).alias("equal"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in first))
    dealt = fps.select("fp", F.explode(pick).alias("k")).select("fp", "k.equal", "k.key")
    sizes = dealt.groupBy("equal", "key").agg(F.count(F.lit(1)).alias("n"))
    busy = sizes.where(F.col("n") > cfg.hot).select("equal", "key")
    # Alone in its value: no partner there. Crowded: dealt again, on the bits that are left.
    pairs = dealt.join(sizes.where((F.col("n") > 1) & (F.col("n") <= cfg.hot)).select("equal", "key"), ["equal", "key"], "left_semi")
    crowd = dealt.join(busy, ["equal", "key"], "left_semi")
    again = []
    for m in first:
        left = [b for b in range(63, -1, -1) if not m >> b & 1]
        again += [(m, m | x) for x in bit_ranges(left, parts)]
    finer = F.array(*(F.struct(F.lit(_signed(a)).alias("of"), F.lit(_signed(b)).alias("equal"), F.col("fp").bitwiseAND(F.lit(_signed(b))).alias("key")) for a, b in again))
    crowd = crowd.select("fp", F.col("equal").alias("was"), F.explode(finer).alias("k")).where("was = k.of").select("fp", "k.equal", "k.key")
    return pairs.select("fp", "equal", "key").unionByName(crowd.select("fp", "equal", "key"))


def _local_links(cfg: SimHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, masks = [], []
        for batch in batches:
            fps.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            masks.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        if not fps:
            return
        fp, mask = np.concatenate(fps), np.concatenate(masks)
        for m in np.unique(mask):
            own = np.unique(fp[mask == m])
            if len(own) < 2:
                continue
            index = GrayIndex(own, cfg.fanout)
            codes = index.codes
            root = forest(len(codes), index.search(codes, np.full(len(codes), m), cfg.max_bits))
            at = np.flatnonzero(root != np.arange(len(codes)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(codes[root[at]].view(np.int64))], names=["a", "b"])

    return run


def components(spark: SparkSession, edges: DataFrame, what: str) -> DataFrame:
    """(node, root): the smallest node of each component, for each node of edges (a, b).

    Alternates large-star and small-star rounds until no edge changes; each round
    is a table in the shared folder, so a lost executor costs one round at most.
    """
    base = scratch(spark, what)
    held = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    step, before = 0, None
    while True:
        path = f"{base}/{step}"
        held.write.parquet(path)
        edges = spark.read.parquet(path)
        if step:
            drop_path(spark, f"{base}/{step - 1}")
        # Edges are stars at their minimum when a round leaves them as they are; 128 bits tell.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if before == now or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(mins, large["a"] == mins["k"])
        held = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        step += 1


def linked(spark: SparkSession, fps: DataFrame, what: str, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(node, root): the component of each of the distinct fingerprints fps (fp) that links to another, by the Gray-order index."""
    dealt = deal_fingerprints(fps, cfg)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fps.count() * (cfg.max_bits + 1) // cfg.rows_per_task)
    links = dealt.repartition(tasks, "equal", "key").select("fp", "equal").mapInArrow(_local_links(cfg), "a long, b long")
    return components(spark, links, what)


def grouped(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, fp long, component_id, root long): one row for each row of docs; root is a fingerprint that only one component has."""
    base = scratch(spark, "simhash")

    def make(batch: pa.RecordBatch) -> list:
        return [pa.array(fingerprints(batch.column(1), cfg).view(np.int64))]

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    append_columns(ids, make, [T.StructField("fp", T.LongType())]).select("doc_id", "fp").write.parquet(f"{base}/fp")
    marked = spark.read.parquet(f"{base}/fp")
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own.write.parquet(f"{base}/own")
    own = spark.read.parquet(f"{base}/own")
    roots = linked(spark, own.select("fp"), "simhash-links", cfg)
    grouped = own.join(roots, own["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = grouped.where("root <> fp").groupBy("root").agg(F.min("least").alias("low"))
    # Only groups of several fingerprints differ from the smallest id of their own fingerprint.
    named = grouped.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left")
    heads = own.select(F.col("fp").alias("head"), F.col("least").alias("head_least"))
    named = named.join(heads, F.col("root") == F.col("head"), "left").select(F.col("fp").alias("of"), F.least("low", "head_least").alias("component_id"), "root")
    return marked.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id", "root")


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of docs."""
    return grouped(spark, docs, text, doc_id, cfg).select("doc_id", "fp", "component_id")


def op8_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(spark, docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Keep one document of each group of near-duplicates: the smallest id.

    Rows with a null id all stay. Several rows with one id count as copies of
    each other where they fall into one group; one of them stays there.
    """
    base = scratch(spark, "simhash-stage")
    grouped(spark, docs, cfg=cfg).where(F.col("doc_id").isNotNull()).write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    verdict = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), F.min("component_id").alias("__c"))
    verdict = verdict.where("__n > 1 or doc_id <> __c").select(F.col("doc_id").alias("__id"), "__n")
    held = docs.join(verdict, docs["doc_id"] == verdict["__id"], "left")
    kept = held.where("__id is null").select(*docs.columns)
    if verdict.where("__n > 1").isEmpty():
        return kept
    several = held.where("__n > 1").select(*docs.columns)
    at = docs.columns.index("text")
    printed = append_columns(several, lambda batch: [pa.array(fingerprints(batch.column(at), cfg).view(np.int64))], [T.StructField("__fp", T.LongType())])
    winners = found.where("doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"), F.col("root").alias("__root")).distinct()
    won = printed.join(winners, (printed["doc_id"] == winners["__id"]) & (printed["__fp"] == winners["__of"]))
    return kept.unionByName(won.dropDuplicates(["__id", "__root"]).select(*docs.columns))
