import random
import re

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulseloom.llm import common, nearcopies, simhash

from . import edge


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    """Component of each text, as a list of roots."""
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 3, 4, "z", "w") for i, t in rows], edge.DOCS).repartition(3)


def kept(spark, rows):
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), edge.SF).collect()), key=str)


def test_copies_from_08_to_097_are_caught(spark):
    rng = random.Random(4)
    rows, seen = [], []
    for k in range(60):
        words = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for c, changed in enumerate((1, 2, 3, 4, 8)):  # the last is below the limit
            other = list(words)
            for at in range(20, 20 + 20 * changed, 20):
                other[at] = f"n{rng.randrange(10_000)}"
            rows.append((10 * k + 1 + c, " ".join(other)))
            seen.append(similarity(shingles(rows[-1][1]), shingles(" ".join(words))))
    assert max(seen) > 0.94 and any(0.8 <= s < 0.83 for s in seen) and min(seen) < 0.8
    comp = brute([t for _, t in rows])
    assert sorted(i for i, _ in kept(spark, rows)) == sorted(rows[r][0] for r in set(comp))


def test_crowd_without_centre_and_sf(spark):
    """Copies of a text that is not there itself are under the limit with most others; chains count."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(70):
        other = list(words)
        for at in rng.sample(range(80), rng.choice((1, 2))):
            other[at] = f"n{rng.randrange(6)}"
        rows.append((k, " ".join(other)))
    comp = brute([t for _, t in rows])
    assert sorted(i for i, _ in kept(spark, rows)) == sorted({rows[r][0] for r in comp})
    docs = edge.sf_docs(spark).orderBy("doc_id").collect()
    comp = brute([r.text for r in docs])
    out = nearcopies.near_copy_stage(spark, edge.sf_docs(spark)).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs[r].doc_id for r in set(comp))


def test_rows_of_one_id_and_edges(spark):
    """Unrelated texts under one id are both kept; copies and null ids behave as told."""
    a, b = (" ".join(f"{p}{k}" for k in range(40)) for p in "ab")
    assert kept(spark, [(1, a), (1, b), (2, a), (3, b), (1, a)]) == [(1, a), (1, b)]
    assert kept(spark, [(5, None), (6, "  "), (None, ""), (7, "one two"), (8, "ONE  two")]) == sorted([(5, None), (None, ""), (7, "one two")], key=str)
    assert nearcopies.near_copy_stage(spark, edge.empty_docs(spark)).count() == 0
    assert nearcopies.near_copy_stage(spark, edge.docs(spark)).columns == edge.DOCS.names


def test_gray_order_index_proposes(spark, monkeypatch):
    """With min-hashes that never meet, copies within two bits are found by the Gray-order index alone, and verified."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10_000)}" for _ in range(4000)]
    other, far = [*words[:-1], "n"], [f"v{rng.randrange(10_000)}" for _ in range(4000)]
    rows = [(3, " ".join(words)), (4, " ".join(other)), (5, " ".join(far))]
    a, b = (simhash.majority(np.array([xxhash.xxh64_intdigest(" ".join(s), 42) for s in sorted(shingles(t))], np.uint64)) for _, t in rows[:2])
    assert bin(int(a) ^ int(b)).count("1") <= 2
    apart = lambda sets, cfg: np.array([[x.sum() + np.uint64(b) for b in range(cfg.bands)] for x in sets], np.uint64)
    monkeypatch.setattr(nearcopies, "band_keys", apart)
    rows = frame(spark, rows)
    assert sorted(r.doc_id for r in nearcopies.near_copy_stage(spark, rows).collect()) == [3, 5]


def test_links_of_a_group_do_not_grow_with_its_square(spark):
    """All pairs of a group are similar: its links are a forest, whatever the number of pairs."""
    rng = np.random.default_rng(3)
    base, n = rng.integers(0, 1 << 62, 60, dtype=np.uint64), 60
    sets = [np.unique(np.r_[base, np.uint64(k)]) for k in range(n)] + [rng.integers(0, 1 << 62, 61, dtype=np.uint64)]
    cfg = nearcopies.CopyConfig(block=16)
    held = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "set long, hashes binary")
    rest = spark.createDataFrame([(0, 9, k, k) for k in range(n + 1)], "band int, key long, set long, root long")
    got = [(r.a, r.b) for r in nearcopies.close_links(rest, held, cfg).collect()]
    assert all(a < b < n for a, b in got) and len(got) < 4 * n
    root = {r.node: r.root for r in simhash.components(spark, spark.createDataFrame(got, "a long, b long"), "test-links").collect()}
    assert len({root.get(k, k) for k in range(n)}) == 1


def test_texts_are_not_shuffled(spark):
    """What is shuffled are keys and the texts that have partners, not the corpus: neither for its sets nor for the result."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(3000)) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k] + " more") for k in range(8)] + [(1100, texts[9]), (None, texts[10]), (1, texts[1])]
    sc, size = spark.sparkContext._jsc.sc(), sum(map(len, texts))

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))

    docs = frame(spark, rows).persist()
    docs.count()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in nearcopies.near_copy_stage(spark, docs).collect())
        assert written() - before < 0.6 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        docs.unpersist()
    assert got == sorted([(False, k, t) for k, t in enumerate(texts)] + [(True, 0, texts[10])])


def test_sieve_holds_for_its_keys(spark):
    keys = spark.range(3000).selectExpr("id * 7919 as h")
    for words in (1 << 19, 8):  # too few words: more pass, none is lost
        holds = common.sieve(keys, "h", words)
        assert keys.where(~holds(F.col("h"))).isEmpty()
    others = spark.range(20_000).selectExpr("id * 7919 + 1 as h")
    assert others.where(common.sieve(keys, "h")(F.col("h"))).count() < 400
    assert others.where(common.sieve(keys.where("false"), "h")(F.col("h"))).isEmpty()
