import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from pulseloom.llm import packing

from . import edge


def check(docs, cfg, out):
    tok = Tokenizer.from_file(public_tokenizers.path(cfg.vocabulary))
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, cfg.end_id], "<u4"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, ids in want.items():
        assert sum(p.length for p in pieces[d]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids[0]))
                assert p.ids_crc32 == zlib.crc32(ids[0][at : at + p.length].tobytes())
                at += p.length
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= cfg.window
    return len(seqs), sum(len(i) for x in want.values() for i in x)


@pytest.mark.parametrize("cfg", [packing.PackConfig(), packing.PackConfig(window=64, shard_docs=50)])
def test_sf(spark, cfg):
    docs = edge.sf_docs(spark)
    n, total = check(docs, cfg, packing.pack(docs, cfg=cfg))
    assert n <= -(-total // cfg.window) + -(-docs.count() // cfg.shard_docs) + 8


def test_edges(spark):
    docs = edge.docs(spark)
    for window in (2048, 7):
        cfg = packing.PackConfig(window=window)
        check(docs, cfg, packing.pack(docs, cfg=cfg))
    with_ids = packing.pack(docs, ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)
    assert packing.pack(edge.empty_docs(spark)).count() == 0


def some_docs(seed, n=60):
    rng = np.random.default_rng(seed)
    return [(rng.random(rng.integers(0, 30)) ** 3 * 40).astype("<u4") for _ in range(n)]


def statistics(docs, size=40):
    return packing.Statistics(len(docs), float(np.mean([len(d) for d in docs])), np.array([sum(t in x for x in docs) for t in range(size)]))


def weight(stats, docs, t, d):
    df, tf = int(stats.frequency[t]), int((docs[d] == t).sum())
    return np.log1p((stats.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / stats.mean))


def test_bm25_scores_and_order():
    """All terms of the seed count, with the statistics of all documents, of which the shard has half."""
    every = some_docs(3, 120)
    docs, stats = every[:60], statistics(every)
    cfg = packing.PackConfig(window=50)
    index = packing.Bm25(docs, stats, cfg)
    assert 0 < len(index.matrix) < 40
    for q in range(0, 60, 7):
        assert np.allclose(index.scores(q), [sum(weight(stats, docs, t, d) for t in set(docs[q].tolist())) for d in range(60)], atol=1e-4)
    unused = np.random.default_rng(4).random(60) < 0.7
    full = index.scores(9)
    index.drop(unused)
    assert index.alive.tolist() == np.flatnonzero(unused).tolist() and np.allclose(index.scores(9), full[unused], atol=1e-5)
    unused = np.random.default_rng(5).random(60) < 0.7
    index = packing.Bm25(docs, stats, cfg)
    s = np.round(index.scores(3))  # many ties
    assert list(packing.ranked(s, unused, 10)) == sorted((d for d in range(60) if unused[d] and s[d] > 0), key=lambda d: (-s[d], d))
    assert sorted(packing.retrieval_order(docs, stats, cfg)) == list(range(60))


def test_routes_are_consistent_samples():
    docs = some_docs(5)
    stats, cfg = statistics(docs), packing.PackConfig()
    draws = packing.route_table(40, cfg)
    out = packing.routes(docs, stats, stats.idf(), draws, cfg)
    for d, own in enumerate(docs):
        for k in range(cfg.keys):
            want = min(set(own.tolist()), key=lambda t: (draws[k, t] / weight(stats, docs, t, d), t)) if len(own) else -1  # noqa: B023
            assert out[d, k] == want


def test_statistics_are_of_all_documents_and_order_is_of_texts(spark):
    docs = edge.sf_docs(spark)
    cfg = packing.PackConfig()
    enc = packing.encoder(cfg)
    own = [enc.encode(r.text or "") for r in docs.collect()]
    tokens, stats = packing.tokenised(docs.repartition(5), "text", "doc_id", cfg)
    want = statistics(own, len(stats.frequency))
    assert stats.n == want.n and abs(stats.mean - want.mean) < 1e-9 and (stats.frequency == want.frequency).all()
    ordered = [[r.doc_id for r in packing.routed(packing.tokenised(docs.repartition(k), "text", "doc_id", cfg)[0], stats, cfg).collect()] for k in (1, 4)]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [text[i] for i in ordered[0]] == [text[i] for i in ordered[1]]  # copies may change places


def test_neighbours_meet(spark):
    """Topics with words of their own are packed together, whatever file they come from."""
    rng = np.random.default_rng(6)
    letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))
    pool = sorted({"".join(rng.choice(letters, 3)) for _ in range(900)})
    words = [list(rng.choice(pool, 30, replace=False)) for t in range(20)]
    rows = [(t * 1000 + k, " ".join(rng.choice(words[t], 120))) for k in range(25) for t in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = packing.pack(docs, cfg=packing.PackConfig(shard_docs=100)).collect()
    topics = defaultdict(set)
    for r in out:
        topics[r.sequence_id].add(r.doc_id // 1000)
    # A window takes about ten documents.
    assert len(topics) < 80 and np.mean([len(x) for x in topics.values()]) < 3.5


def test_ranks_give_the_librarys_ids():
    enc = packing.encoder(packing.PackConfig())
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3000 or i % 61 == 0)]
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} 1{chr(i)} {chr(i)}\n {chr(i)}'s" for i in points]
    texts += ["x" * 20_000, " " * 20_000, "\n " * 9000, "1" * 9000, "a<|endoftext|> b", *(t or "" for _, t, _ in edge.TEXTS)]
    for text, want in zip(texts, enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert enc.encode(text).tolist() == want.ids, ascii(text[:40])
