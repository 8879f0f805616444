import corpus_pipeline
from pyspark.sql import functions as F

from loopwright.llm.near_dedup import find_groups
from loopwright.llm.packing import pack_documents
from loopwright.llm.pii import Field, redacted, spans_of, trained
from loopwright.llm.quality_rules import judge
from loopwright.llm.decontamination import words_of


def test_stages_keep_the_columns_and_decide(llm, sf_dir):
    """Each stage against plain Python over what the stage before it kept."""
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "personal_data", "packing",
    ]
    stages = dict(corpus_pipeline.STAGES)

    judged, stats = judge(docs)
    good = {r["doc_id"] for r in judged.filter(F.col(stats).kept).select("doc_id").collect()}
    docs = stages["quality_rules"](llm, docs, sf_dir).cache()
    assert {r["doc_id"] for r in docs.collect()} == good and len(docs.columns) == 5

    names = {r["component_id"] for r in find_groups(docs).collect()}
    docs = stages["near_dedup"](llm, docs, sf_dir).cache()
    assert {r["doc_id"] for r in docs.collect()} == names and len(docs.columns) == 5

    items = [words_of(r["text"]) for r in llm.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {
        r["doc_id"] for r in docs.collect()
        if not any(f" {' '.join(i)} " in f" {' '.join(words_of(r['text']))} " for i in items)
    }
    docs = stages["decontamination"](llm, docs, sf_dir).cache()
    assert {r["doc_id"] for r in docs.collect()} == clean and len(docs.columns) == 5

    rows = docs.collect()
    expected = {
        r["doc_id"]: redacted(r["text"], spans)
        for r, (_, spans) in zip(rows, spans_of([r["text"] for r in rows], Field(*trained())))
    }
    docs = stages["personal_data"](llm, docs, sf_dir).cache()
    found = docs.collect()
    assert {r["doc_id"]: r["text"] for r in found} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(docs.columns) == 5

    packed = stages["packing"](llm, docs, sf_dir)
    assert packed.columns == pack_documents(docs).columns
    assert {r["doc_id"] for r in packed.collect()} == clean


def test_stages_take_odd_rows(llm, odd, none, sf_dir):
    """NULLs, blank texts, repeated rows, a long text and clashing names, stage by stage."""
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    given = odd.collect()
    left = {
        "quality_rules": [5, 5, 6, 7, 8, None],
        "near_dedup": [1, 2, 3, 4, 5, 7, 8, None],
        "decontamination": [r["doc_id"] for r in given],
        "personal_data": [r["doc_id"] for r in given],
    }
    for name, expected in left.items():
        found = stages[name](llm, odd, sf_dir)
        assert found.columns == odd.columns and ids(found) == sorted(expected, key=str), name
        assert found.exceptAll(odd).count() == 0
        assert stages[name](llm, none, sf_dir).collect() == []
    packed = stages["packing"](llm, odd, sf_dir).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == sorted({str(r["doc_id"]) for r in given})
    assert sum(r["length"] for r in packed if r["doc_id"] in (1, 2, 3)) == 3
    assert stages["packing"](llm, none, sf_dir).collect() == []


def test_stages_follow_each_other_on_odd_rows(llm, odd, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(llm, docs, sf_dir)
    assert {r["doc_id"] for r in docs.collect()} == {5, 7, 8}


def test_run_ends_in_pieces(llm, sf_dir):
    assert corpus_pipeline.run(llm, sf_dir).count() > 0
