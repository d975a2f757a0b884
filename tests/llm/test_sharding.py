import random
import zlib
from collections import Counter

import pytest

from pulseloom.llm import sharding

from . import edge


def check(docs, out, shards=16):
    rows = out.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    per = Counter(r.shard for r in rows)
    assert sum(per.values()) == len(rows) and max(per[k] for k in range(shards)) - min(per[k] for k in range(shards)) <= 1
    for k, n in per.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n)) and 0 <= k < shards


def test_query(spark):
    out = sharding.op7_hypergeometric_shards(spark, edge.SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(edge.sf_docs(spark), out)
    assert {r.law for r in out.collect()} == {"rows"}
    assert sorted(map(str, out.collect())) == sorted(map(str, sharding.op7_hypergeometric_shards(spark, edge.SF).collect()))


def test_edges(spark, tmp_path):
    for name, docs in (("a", edge.docs(spark)), ("b", edge.empty_docs(spark)), ("c", edge.docs(spark).where("doc_id is null or doc_id = 7"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        check(docs, sharding.op7_hypergeometric_shards(spark, f"{tmp_path}/{name}"))


def test_several_buckets(spark):
    docs = spark.range(3000)
    out = sharding.spread(spark, docs, sharding.ShuffleConfig(shards=2, rows_per_task=10)).collect()
    assert sorted((r["__shard"], r["__slot"]) for r in out) == [(k, s) for k in range(2) for s in range(1500)]
    assert sorted(r.id for r in out) == list(range(3000))


def test_copies_are_spread_like_other_rows(spark):
    """Of 5,000 rows that occur twice, a sixteenth share a shard, and few of these sit side by side."""
    docs = spark.range(10_000).selectExpr("id % 5000 as id", "'x' as __h").repartition(4)
    together = beside = 0
    for seed in range(4):
        places = {}
        for r in sharding.spread(spark, docs, sharding.ShuffleConfig(seed=seed)).collect():
            places.setdefault(r.id, []).append((r["__shard"], r["__slot"]))
        pairs = [sorted(x) for x in places.values()]
        assert all(len(x) == 2 for x in pairs)
        together += sum(a[0] == b[0] for a, b in pairs)
        beside += sum(a[0] == b[0] and b[1] - a[1] == 1 for a, b in pairs)
    mean = 4 * 5000 * 624 / 9999
    assert abs(together - mean) < 6 * mean**0.5 and beside <= 20


def test_one_row_many_times(spark):
    """No hash partition gets more than its share when all rows are equal."""
    docs = spark.range(40_000).selectExpr("7 as id")
    out = sharding.spread(spark, docs, sharding.ShuffleConfig(shards=4, min_partitions=16))
    assert sorted((r["__shard"], r["__slot"]) for r in out.collect()) == [(k, s) for k in range(4) for s in range(10_000)]


def test_log_chance_at_any_size():
    from fractions import Fraction
    from math import comb, log

    for good, bad, draws, k in ((7, 13, 6, 2), (500, 700, 300, 125), (50, 7000, 300, 0), (40, 60, 50, 40)):
        want = Fraction(comb(good, k) * comb(bad, draws - k), comb(good + bad, draws))
        assert abs(sharding.log_chance(k, good, bad, draws) - log(want)) < 1e-11
    # 10**11 rows: the mode's chance is that of the normal law, to the law's own error.
    good, bad, draws = 10**11, 15 * 10**11, 10**10
    mode = draws * good // (good + bad)
    spread = draws * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - draws) / (good + bad - 1))
    from math import pi

    assert abs(sharding.log_chance(mode, good, bad, draws) + 0.5 * log(2 * pi * spread)) < 1e-7


def test_hypergeometric_law():
    rng = random.Random(1)
    n = 20_000
    seen = Counter(sharding.hypergeometric(rng, 7, 13, 6) for _ in range(n))
    from math import comb

    for k in range(7):
        p = comb(7, k) * comb(13, 6 - k) / comb(20, 6)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    big = [sharding.hypergeometric(rng, 10**10, 15 * 10**10, 10**7) for _ in range(40)]
    assert all(abs(x - 625_000) < 8 * 765 for x in big)
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_matrix_sums():
    rng = random.Random(2)
    rows = [rng.randrange(0, 50) for _ in range(40)]
    cols = sharding.shard_sizes(sum(rows), 7)
    m = sharding.communication_matrix(rng, rows, cols)
    assert [sum(r) for r in m] == rows and [sum(r[k] for r in m) for k in range(7)] == cols
    with pytest.raises(AssertionError):
        sharding.communication_matrix(rng, [1], [2])


def test_positions_are_uniform(spark):
    """Over many seeds, one row is in each shard and half about equally often."""
    docs = spark.range(64)
    seen = Counter()
    for seed in range(40):
        cfg = sharding.ShuffleConfig(shards=2, seed=seed, min_partitions=4)
        seen.update((r["__shard"], r["__slot"] // 16) for r in sharding.spread(spark, docs, cfg).where("id < 16").collect())
    assert len(seen) == 4 and all(abs(n - 160) < 60 for n in seen.values())
