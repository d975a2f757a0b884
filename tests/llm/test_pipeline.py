import corpus_pipeline

from pulseloom.llm import common

from . import edge
from .test_decontam import brute as overlap
from .test_nearcopies import brute as copies
from .test_pii import brute as personal


def test_stages_take_effect(spark, tmp_path):
    docs = edge.sf_docs(spark)
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{edge.SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, edge.SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        after = docs.collect()
        if name == "language_id":
            assert len(after) == len(before)  # every document here is in a language
        if name == "near_duplicates":
            # The stage's own contract: five-word shingles, similarity of 0.8 or more, the smallest id of a component.
            before.sort(key=lambda r: r.doc_id)
            heads = {before[k].doc_id for k in set(copies([r.text for r in before]))}
            assert {r.doc_id for r in after} == heads and len(after) == len(heads) < len(before)
        if name == "decontamination":
            gone = {r.doc_id for r in before for n, hit, _ in [overlap(r.text, items)] if hit and 20 * hit >= n}
            assert gone and {r.doc_id for r in after} == {r.doc_id for r in before} - gone
        if name == "personal_data":
            assert len(after) == len(before) and any(any(personal(r.text).values()) for r in before)
            assert not any(any(personal(r.text).values()) for r in after)
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, edge.SF).count() > 0
    docs = edge.empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edge.SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge.SF).count() == 0


def test_decontamination_hands_memory_back(spark, monkeypatch):
    """Idle workers stay through the later stages: what a stage freed must not stay with them."""
    seen = []
    monkeypatch.setattr(common, "trimmed", lambda run: seen.append(run) or run)
    assert corpus_pipeline.drop_contaminated(spark, edge.docs(spark), edge.SF).count() > 0
    assert seen
