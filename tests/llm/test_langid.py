import zlib

import numpy as np
from pyspark.sql import functions as F

from pulseloom.llm import langid

from . import edge

CFG = langid.LangIdConfig(bits=10)


def ngrams(text, cfg):
    """Plain loop over characters: other characters than letters are one blank, a gram needs a letter."""
    chars = [c if c.isalpha() else " " for c in text.lower()]
    return [tuple(chars[i : i + n]) for n in cfg.sizes for i in range(len(chars) - n + 1) if any(c != " " for c in chars[i : i + n])]


def test_features_hold_each_ngram_once():
    texts = ["Hello, wörld", "", "12", "a", "日本 go", "abcdefghij" * 7]
    for segment in (1 << 20, 16):
        cfg = langid.LangIdConfig(bits=16, segment=segment)
        got = np.zeros(len(texts), int)
        for _, row in langid.features([t.lower() for t in texts], cfg):
            got += np.bincount(row, minlength=len(texts))
        assert got.tolist() == [len(ngrams(t, cfg)) for t in texts]


def test_counts_and_scores_against_brute_force(spark):
    docs = edge.sf_docs(spark)
    rows = docs.select("doc_id", "text", "lang").collect()
    learn = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(langid.learnable(docs), cfg=CFG)
    assert model.langs == sorted({r.lang for r in learn})
    count = np.zeros((CFG.buckets, len(model.langs)))
    for r in learn:
        for bucket, _ in langid.features([r.text.lower()], CFG):
            np.add.at(count[:, model.langs.index(r.lang)], bucket, 1)
    log_prob = np.log((count + CFG.alpha) / (count.sum(0) + CFG.alpha * CFG.buckets))
    assert np.allclose(model.log_prob, log_prob)
    got = {r.doc_id: r for r in langid.predict(spark, docs, model).collect()}
    for r in rows[:50]:
        total = model.log_prior + sum(log_prob[b].sum(0) for b, _ in langid.features([r.text.lower()], CFG))
        p = np.exp(total - total.max())
        assert got[r.doc_id].lang_pred == model.langs[int(total.argmax())]
        assert abs(got[r.doc_id].score - p.max() / p.sum()) < 1e-9


def test_held_out_accuracy(spark):
    out = langid.op10_naive_bayes_language(spark, "/root/testdata/sf0.01").alias("p")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = out.where("held_out").join(docs, "doc_id")
    right, n = held.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n


def test_edges(spark):
    docs = edge.docs(spark)
    model = langid.fit(langid.learnable(edge.sf_docs(spark)), cfg=CFG)
    got = langid.predict(spark, docs, model)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(edge.TEXTS)
    for key in ((1, ""), (2, None), (3, "   \n\t "), (4, "12 34 !!"), (None, None)):
        assert (rows[key].lang_pred, rows[key].score) == ("und", 0.0)
    assert rows[(5, "one")].lang_pred in model.langs and rows[(8, edge.LONG)].lang_pred in model.langs
    assert langid.predict(spark, edge.empty_docs(spark), model).count() == 0
    nothing = langid.fit(edge.empty_docs(spark))
    assert {r.lang_pred for r in langid.predict(spark, docs, nothing).collect()} == {"und"}
    kept = langid.language_stage(spark, docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    assert langid.language_stage(spark, edge.empty_docs(spark)).count() == 0


def test_labels_beyond_the_bound_are_not_learned(spark):
    rows = [(k, f"some words of text {k % 3}", ("aa", "bb", f"dirt{k}")[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, cfg=langid.LangIdConfig(max_langs=2)).langs == ["aa", "bb"]
    assert len(langid.fit(docs).langs) == 102


def test_stage_keeps_what_has_a_language(spark):
    docs = edge.docs(spark)
    out = langid.language_stage(docs.sparkSession, docs)
    assert out.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    gone = {(r.doc_id, r.text) for r in docs.collect()} - kept
    assert {(1, ""), (2, None), (3, "   \n\t "), (4, "12 34 !!"), (None, None)} <= gone
    assert all(any(map(str.isalpha, t or "")) for _, t in kept)
