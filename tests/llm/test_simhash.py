import re

import numpy as np
import xxhash

from pulseloom.llm import simhash

from . import edge


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def check(spark, docs, cfg=simhash.SimHashConfig()):
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    comp = brute_components([r.doc_id for r in rows], prints)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark, docs, cfg=cfg).collect()), key=key)
    assert got == sorted(((r.doc_id, p, c) for r, p, c in zip(rows, prints, comp, strict=True)), key=key)
    return comp


def test_sf_against_brute_force(spark):
    comp = check(spark, edge.sf_docs(spark))
    assert len(set(comp)) < len(comp)


def test_edges(spark):
    check(spark, edge.docs(spark))
    assert simhash.near_duplicates(spark, edge.empty_docs(spark)).count() == 0


def test_links_of_chains_and_crowds(spark):
    """Fingerprints a few bits apart: every link counts, also where one bit range is crowded."""
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = set()
    for s in seeds.tolist():
        x = s
        for _ in range(60):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            codes.add(x)
    codes = sorted(codes)
    fps = spark.createDataFrame([(int(np.array(c, np.uint64).view(np.int64)),) for c in codes], "fp long")
    want = brute_components(list(range(len(codes))), codes)
    for hot in (1, 8, 10_000):
        cfg = simhash.SimHashConfig(hot=hot)
        dealt = simhash.deal_fingerprints(fps, cfg).repartition(5, "equal", "key").select("fp", "equal")
        links = dealt.mapInArrow(simhash._local_links(cfg), "a long, b long")
        root = {r.node % (1 << 64): r.root for r in simhash.components(spark, links, "t").collect()}
        group = {}
        for c, w in zip(codes, want, strict=True):
            group.setdefault(root.get(c, int(np.array(c, np.uint64).view(np.int64))), set()).add(w)
        assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want))


def test_gray_index_is_exact():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64))
    index = simhash.GrayIndex(codes, 16)
    found = set()
    for q, pos in index.search(codes, np.zeros(len(codes), np.uint64), 2):
        found |= set(zip(codes[q].tolist(), index.codes[pos].tolist(), strict=True))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert found == {(int(codes[i]), int(codes[j])) for i, j in zip(*np.nonzero(near), strict=True)}


def test_stage_keeps_one_of_each_group(spark):
    docs = edge.sf_docs(spark)
    rows = docs.collect()
    comp = brute_components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    kept = simhash.simhash_stage(spark, docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp)) and kept.columns == docs.columns
    odd = simhash.simhash_stage(spark, edge.docs(spark)).collect()
    assert sum(r.doc_id == 7 for r in odd) == 0 and sum(r.doc_id == 6 for r in odd) == 1
    again = edge.docs(spark).where("doc_id = 7 or doc_id = 8 or doc_id is null")
    assert sorted(str(r.doc_id) for r in simhash.simhash_stage(spark, again).collect()) == ["7", "8", "None", "None"]
    assert simhash.simhash_stage(spark, edge.empty_docs(spark)).count() == 0


def test_stage_keeps_unrelated_texts_of_one_id(spark):
    a, b = (" ".join(f"{p}{k}" for k in range(40)) for p in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", 3, 4, "z", "w") for i, t in rows], edge.DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.simhash_stage(spark, docs).collect()) == [(1, a), (1, b)]
