import hashlib
import re

import pytest

from pulseloom.llm import decontam

from . import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        p = words(text)
        m = min(13, len(p))
        windows = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for a in range(len(w) - m + 1):
            if m and tuple(w[a : a + m]) in windows:
                hit.update(range(a, a + m))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def rows_of(spark, docs, items):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), r["__words"], r["__hit"], r["__items"]) for r in decontam.find_overlap(spark, docs, items).collect())


def expected(docs, items):
    pairs = [(r.item_id, r.text) for r in items.collect()]
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), *brute(r.text, pairs)) for r in docs.collect())


def test_sf_against_brute_force(spark):
    docs = edge.sf_docs(spark).select("doc_id", "text")
    items = spark.read.parquet(f"{edge.SF}/benchmark.parquet")
    got = rows_of(spark, docs, items)
    assert got == expected(docs, items)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("max_windows", [1 << 18, 3])
def test_edges(spark, monkeypatch, max_windows):
    monkeypatch.setattr(decontam, "_UNFOLD", 5)
    build = decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda rows, window: build(rows, window, max_windows))
    docs = edge.docs(spark).select("doc_id", "text")
    items = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "ONE"), (None, "lazy DOG and"), (3, None), (4, "!!"), (5, "brown fox jumps over the lazy dog and runs on the quick brown fox jumps"), (6, "naïve café quotes"), (7, "日本語")], "item_id long, text string")
    assert rows_of(spark, docs, items) == expected(docs, items)
    none = items.where("false")
    assert rows_of(spark, docs, none) == expected(docs, none)
    assert decontam.find_overlap(spark, edge.empty_docs(spark), items).count() == 0


def test_query_and_stage(spark):
    got = {r.doc_id: r for r in decontam.op2_wu_manber_decontamination(spark, edge.SF).collect()}
    pairs = [(r.item_id, r.text) for r in spark.read.parquet(f"{edge.SF}/benchmark.parquet").collect()]
    bad = set()
    for r in edge.sf_docs(spark).collect():
        n, hit, ids = brute(r.text, pairs)
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items) == (n, hit, len(ids))
        assert x.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert x.contaminated == (hit > 0 and 20 * hit >= n)
        bad |= {r.doc_id} if x.contaminated else set()
    docs = edge.sf_docs(spark)
    kept = decontam.decontamination_stage(spark, docs, spark.read.parquet(f"{edge.SF}/benchmark.parquet"))
    assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    assert kept.columns == docs.columns


def test_sql_twin(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{edge.SF}/{t}.parquet'")
    got = [tuple(r) for r in decontam.op2_wu_manber_decontamination(spark, edge.SF).collect()]
    assert sorted(con.sql(decontam.ORACLE).fetchall()) == sorted(got)


def test_stage_on_awkward_rows(spark):
    docs = edge.docs(spark)
    items = spark.createDataFrame([(1, " ".join(edge.LONG.split()[:20])), (None, "naïve café"), (3, None), (4, "")], "item_id long, text string")
    out = decontam.decontamination_stage(spark, docs, items)
    assert out.columns == docs.columns
    texts = [t for _, t, _ in edge.TEXTS]
    hit = [bool(h) and 20 * h >= n for n, h, _ in (brute(t, [(r.item_id, r.text) for r in items.collect()]) for t in texts)]
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(t) for t, h in zip(texts, hit, strict=True) if not h)
    assert sum(hit) == 2 and decontam.decontamination_stage(spark, edge.empty_docs(spark), items).count() == 0
