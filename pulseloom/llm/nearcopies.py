"""Near copies by SimHash in Gray order and the similarity of word shingles, for the pipeline.

Two texts link when the Jaccard similarity of their sets of five-word shingles
is 0.8 or more. Fingerprints that the Gray-order index links propose the nearest
of them. 64 bits cannot search for the others: pairs at 0.8 differ by about 10
bits and up to 17, where ranges of bits and Gray order prune nothing; min-hashes
propose those.

1. One pass in Arrow batches: each text becomes the hash of its shingle set, the
   set's SimHash fingerprint and one key for each of `bands` groups of `rows`
   min-hashes. Equal sets are one from here on. A pair at 0.8 shares a key with
   probability 1 - 3e-5 at least.
2. Fingerprints are searched by the operator's Gray-order hierarchical index;
   the component of linked fingerprints is one more key of their sets.
3. Each set that shares keys is compared with one leader of each key, the set
   that shares keys with the most others, so that a crowd of copies costs as
   many comparisons as it has members. What is not yet in one component with the
   rest of its key is compared with all of the rest, block against block, by
   sketches of 2,048 one-bit min-hashes; a pair at 0.8 is lost there with
   probability 4e-6. Nothing is capped.
4. Comparisons are exact, over the whole shingle sets of the candidates alone.

Cases: null and wordless texts have the empty set and are copies of each other;
texts of fewer than `words` words are one shingle; rows with a null id all stay;
several rows with one id are reduced only where they fall into one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, release, scratch, scratch_count, sieve, trimmed, utf8_blocks
from .simhash import SimHashConfig, components, linked, majority, squeezed


@dataclass(frozen=True)
class CopyConfig:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    seed: int = 42
    bits: int = 2048  # of a sketch
    block: int = 512  # sets that one side of a comparison holds
    max_bits: int = 2  # in which fingerprints that link differ


def shingle_sets(col: pa.Array, cfg: CopyConfig = CopyConfig()) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, in blocks: first row, sets."""
    digest, seed = xxhash.xxh64_intdigest, cfg.seed
    for row, raw, offsets in utf8_blocks(col):
        data, start, end, per = squeezed(raw, offsets)
        last = np.cumsum(per)
        sets = []
        for a, b in zip((last - per).tolist(), last.tolist(), strict=True):
            m = min(cfg.words, b - a)
            froms, tos = (start[a : b - m + 1].tolist(), end[a + m - 1 : b].tolist()) if m else ([], [])
            sets.append(np.unique(np.fromiter((digest(data[i:j], seed) for i, j in zip(froms, tos, strict=True)), np.uint64, len(froms))))
        yield row, sets


def band_keys(sets: list[np.ndarray], cfg: CopyConfig) -> np.ndarray:
    """(sets, bands) keys of non-empty sets; equal where `rows` min-hashes are."""
    rng = np.random.default_rng(cfg.seed)
    flips = rng.integers(0, 1 << 63, (cfg.bands, cfg.rows), dtype=np.uint64)
    odds = rng.integers(0, 1 << 63, (cfg.bands, cfg.rows), dtype=np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), cfg.bands), np.uint64)
    for b in range(cfg.bands):
        for r in range(cfg.rows):
            x = (flat ^ flips[b, r]) * odds[b, r]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at)
            out[:, b] = (out[:, b] ^ low) * np.uint64(0x9E3779B97F4A7C15)
            out[:, b] ^= out[:, b] >> np.uint64(29)
    return out


def set_ids(sets: list[np.ndarray], cfg: CopyConfig) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), cfg.seed) for s in sets), np.uint64, len(sets)).view(np.int64)


def _sketches(cfg: CopyConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(2), cfg):
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = [None] * len(sets)
                prints = np.fromiter((majority(s) if len(s) else 0 for s in sets), np.uint64, len(sets)).view(np.int64)
                if full:
                    for k, own in zip(full, band_keys([sets[k] for k in full], cfg).view(np.int64), strict=True):
                        keys[k] = own
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), batch.column(1).slice(row, len(sets)), pa.array(set_ids(sets, cfg)), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "set", "fp", "keys"])

    return trimmed(run)


def _sets(cfg: CopyConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), cfg):
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets, cfg)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set", "hashes"])

    return trimmed(run)


def similar(x: np.ndarray, y: np.ndarray, cfg: CopyConfig) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= cfg.similarity * (len(x) + len(y) - both) - 1e-9


def _similar(cfg: CopyConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                near[k] = similar(*(np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3)), cfg)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return trimmed(run)


def _sketch(cfg: CopyConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(cfg.seed + 1)
        flips = rng.integers(0, 1 << 63, cfg.bits, dtype=np.uint64)[:, None]
        odds = rng.integers(0, 1 << 63, cfg.bits, dtype=np.uint64)[:, None] | np.uint64(1)
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64)
                low = np.zeros(cfg.bits, np.uint64)
                step = max(1, (1 << 18) // max(1, len(own)))
                for at in range(0, cfg.bits, step):
                    x = (own ^ flips[at : at + step]) * odds[at : at + step]
                    x ^= x >> np.uint64(32)
                    low[at : at + step] = x.min(1)
                out.append(np.packbits((low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)).astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["set", "hashes", "sketch"])

    return trimmed(run)


def _close(cfg: CopyConfig):
    """Links between two blocks of one key, of sets whose sketches may be those of similar ones and that are; as many as join their components."""
    # One bit of a min-hash differs with probability (1 - similarity) / 2; the limit is 4.5 standard deviations above.
    p = (1 - cfg.similarity) / 2
    limit = cfg.bits * p + 4.5 * (cfg.bits * p * (1 - p)) ** 0.5

    def run(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        name, root, block = (held.column(c).to_numpy() for c in ("set", "root", "block"))
        code = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(len(name), -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in held.column("hashes")]
        # Components of what is linked so far: a pair within one needs no comparison, and a link within one isn't written.
        names, own = np.unique(root, return_inverse=True)
        up = np.arange(len(names))
        a, b = [], []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        for at in range(0, len(left), 64):
            i = left[at : at + 64]
            near = np.bitwise_count(code[i][:, None, :] ^ code[right][None, :, :]).sum(2, dtype=np.int32) <= limit
            for x, y in zip(*(k.tolist() for k in np.nonzero(near & (root[i][:, None] != root[right]))), strict=True):
                p, q = int(i[x]), int(right[y])
                one, two = top(own[p]), top(own[q])
                if one != two and similar(sets[p], sets[q], cfg):
                    up[one] = two
                    a.append(name[p])
                    b.append(name[q])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def close_links(rest: DataFrame, sets: DataFrame, cfg: CopyConfig) -> DataFrame:
    """(a, b): links that join the sets of one key of `rest` (band, key, set, root) which aren't in one component yet.

    A key's sets are dealt to blocks of about `block` rows, and each two blocks
    meet in one task. Sketches rule pairs out there, and whole shingle sets decide;
    a task writes a forest of its links, fewer than it has rows, so that what a
    group writes doesn't grow with the square of its size.
    """
    wanted = rest.select("set").distinct()
    full = sets.where(sieve(wanted, "set")(F.col("set"))).join(wanted, "set").select("set", "hashes").mapInArrow(_sketch(cfg), "set long, hashes binary, sketch binary")
    size = rest.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / cfg.block).cast("int").alias("blocks"))
    dealt = rest.join(full, "set").join(size, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("set", F.lit(5)), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    return dealt.select("band", "key", "set", "root", "block", "sketch", "hashes", F.explode(meet).alias("m")).groupBy("band", "key", "m").applyInArrow(_close(cfg), "a long, b long")


def text_key(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def copy_groups(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cfg: CopyConfig = CopyConfig()) -> DataFrame:
    """(doc_id, text_key, root): the component of each row of docs."""
    base = scratch(spark, "near-copies")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    marked = kept(rows.mapInArrow(_sketches(cfg), f"doc_id {id_type}, text_key long, set long, fp long, keys array<long>"), "sketches")
    # Written, as three plans read it: each would shuffle all keys for it.
    own = kept(marked.where("keys is not null").select("set", "text_key", "fp", "keys").groupBy("set").agg(F.min(F.struct("text_key", "fp", "keys")).alias("one")), "own")
    # The Gray-order index links fingerprints; sets whose fingerprints are one or linked meet under band -1.
    prints = kept(own.select("set", F.col("one.fp").alias("fp")), "fingerprints")
    near = linked(spark, prints.select("fp").distinct(), "near-copies-gray", SimHashConfig(words=cfg.words, max_bits=cfg.max_bits, seed=cfg.seed))
    gray = prints.join(near, F.col("fp") == F.col("node"), "left").select("set", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("key"))
    dealt = own.select("set", F.posexplode("one.keys").alias("band", "key")).unionByName(gray)
    # One exchange of all keys gives the sizes and the rows: a sum by key would be shuffled once more.
    size = F.count(F.lit(1)).over(Window.partitionBy("band", "key"))
    shared = kept(dealt.withColumn("n", size).where("n > 1"), "shared")
    weight = shared.groupBy("set").agg(F.sum("n").alias("weight"))
    members = kept(shared.select("set", "band", "key").join(weight, "set"), "members")
    leaders = members.groupBy("band", "key").agg(F.max(F.struct("weight", "set")).alias("top")).select("band", "key", F.col("top.set").alias("leader"))

    # Texts aren't shuffled for their sets: the sieve lets few through that aren't asked for, and those go by their set.
    asked = kept(own.select("set", F.col("one.text_key").alias("tk")).join(members.select("set").distinct(), "set"), "asked")
    wanted = rows.where(sieve(asked, "tk")(F.col("text_key"))).select("text")
    held = wanted.mapInArrow(_sets(cfg), "set long, hashes binary").where(sieve(asked, "set")(F.col("set"))).dropDuplicates(["set"])
    sets = kept(held.join(asked.select("set"), "set", "left_semi"), "sets")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        held = pairs.distinct().join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a")
        held = held.join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
        return kept(held.mapInArrow(_similar(cfg), "a long, b long"), name)

    first = members.join(leaders, ["band", "key"]).where("set <> leader").select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b"))
    found = links(first, "links-1")
    roots = components(spark, found, "near-copies-1")
    placed = members.join(leaders, ["band", "key"]).join(roots, F.col("set") == F.col("node"), "left").select("band", "key", "set", "leader", F.coalesce("root", "set").alias("root"))
    # The leader has met all; the rest of its key is done once in one component.
    rest = placed.where("set <> leader")
    split = rest.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
    rest = rest.join(split, ["band", "key"], "left_semi")
    rest = kept(rest.select("band", "key", "set", "root"), "rest")
    second = kept(close_links(rest, sets, cfg), "links-2")
    roots = components(spark, found.unionByName(second), "near-copies-2")
    return marked.join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "set").alias("root"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, cfg: CopyConfig = CopyConfig()) -> DataFrame:
    """Keep one document of each component of near copies: the smallest id. Rows with a null id all stay."""
    since, base = scratch_count(), scratch(spark, "near-copy-stage")
    copy_groups(spark, docs, cfg=cfg).where("doc_id is not null").write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    heads = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.sum("n").alias("size")).where("size > 1")
    verdict = rows.join(heads, "root").where("n > 1 or doc_id <> head.doc_id or text_key <> head.text_key")
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("__head"))
    verdict.write.parquet(f"{base}/verdict")
    verdict = spark.read.parquet(f"{base}/verdict")
    # The result rests on the verdict alone.
    release(spark, since, keep=base)
    drop_path(spark, f"{base}/found")
    judged = sieve(verdict.select(F.xxhash64("__id", "__key").alias("h")), "h")
    marked = docs.withColumn("__text_key", text_key()).withColumn("__judged", judged(F.xxhash64("doc_id", "__text_key")))
    # Few rows but those of the verdict are shuffled for it; the others stay as they are.
    held = marked.where("__judged").join(verdict, (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    kept = marked.where("not __judged").select(*docs.columns).unionByName(held.where("__id is null").select(*docs.columns))
    if verdict.where("__head").isEmpty():
        return kept
    # Equal rows of a head's id and text: one of them stays.
    return kept.unionByName(held.where("__head").dropDuplicates(["__id", "__key"]).select(*docs.columns))
