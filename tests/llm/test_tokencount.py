import sys
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulseloom.llm import tokencount

from . import edge


def check(docs, out, cfg=tokencount.CountConfig()):
    tok = Tokenizer.from_file(public_tokenizers.path(cfg.vocabulary))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()) == want


SMALL = tokencount.CountConfig(block_words=500, common=2, memo=100, flush=50, slice_docs=3)


@pytest.mark.parametrize("cfg", [tokencount.CountConfig(), SMALL])
def test_sf(spark, cfg):
    docs = edge.sf_docs(spark)
    check(docs, tokencount.count_tokens(spark, docs, cfg=cfg))


def test_edges(spark):
    odd = ["ΟΔΟΣ ΣΑΣ İstanbul ǅ", "áé ẛ̣ ﬁ Å", "x" * 9000 + " y" * 9000, "<|endoftext|><|startoftext|>a<|endoftext|>'s <|x|>", "'S 'Ll don'T ''s 1²½Ⅷ", "\x00\x1c\x1d\x85\xa0 ​﻿", "👩‍👩‍👧 ก็ हिन्दी ١٢٣"]
    docs = edge.docs(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 0, "x", "y", 3, 4, "z", "w") for i, t in enumerate(odd)], edge.DOCS))
    check(docs, tokencount.count_tokens(spark, docs))
    check(docs, tokencount.count_tokens(spark, docs, cfg=SMALL), SMALL)
    assert tokencount.count_tokens(spark, edge.empty_docs(spark)).count() == 0


def test_pretokens_follow_the_library():
    """Every code point, between letters, gives as many pieces as the library gives."""
    cfg = tokencount.CountConfig()
    count = tokencount.PieceCounter(tokencount.vocabulary_path(cfg), 1 << 20)
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or i % 97 == 0 or 0xF900 <= i < 0x10000 or 0x1D400 <= i < 0x1D800)]
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} 1{chr(i)}" for i in points]
    for a in range(0, len(texts), 5000):
        part = texts[a : a + 5000]
        own = [count.pretokens(t)[0] for t in part]
        distinct = sorted({w for words in own for w in words})
        n = dict(zip(distinct, count.pieces(distinct).tolist(), strict=True))
        for t, words, e in zip(part, own, count.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert sum(n[w] for w in words) == len(e.ids), ascii(t)


def test_query(spark):
    out = tokencount.op6_pretoken_counts(spark, edge.SF)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out.collect())
