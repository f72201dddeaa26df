"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
from pyspark.sql import functions as F

from labeltab.llm import stages, toxicity
from labeltab.llm.shared import stage, table
from tests.conftest import SF_SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_its_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF_SMALL), name)
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    names = list(kept)
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets"]
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:])) and kept["secrets"] == kept["decontamination"]
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id for r in out} == kept["secrets"] and all(r.decoded_ok for r in out)


def test_stages_decide_row_by_row(spark, make_docs):
    plain = "an ordinary row number {} of the corpus with words of its own, kept as it is and was"
    copy = "the same long passage stands in several rows here, with and without an id, and only one of them stays in the end"
    rows = [(None, copy), (5, copy), (None, copy), (4, copy), (7, plain.format("seven")), (7, plain.format("seven")), (7, "other words under this id, clean as well"),
            (8, ""), (8, ""), (9, "")]
    got = [(r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, make_docs(rows), SF_SMALL).collect()]
    assert sorted(got) == [(4, copy), (7, plain.format("seven")), (7, rows[6][1]), (8, ""), (9, "")]
    item = table(spark, SF_SMALL, "benchmark").where("length(text) > 100").first().text
    got = [(r.doc_id, r.text) for r in stages.drop_leaks(spark, make_docs([(None, "x. " + item), (3, "clean"), (3, item), (None, "clean"), (3, "clean")]), SF_SMALL).collect()]
    assert sorted(got, key=str) == [(3, "clean"), (3, "clean"), (None, "clean")]
    labels = table(spark, SF_SMALL, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, SF_SMALL, "documents")
    weights = toxicity.train(docs, labels)
    bad = toxicity.score(docs, weights).where("predicted = 1").join(docs, "doc_id").first().text
    got = [(r.doc_id, r.text) for r in toxicity.clean(make_docs([(None, bad), (3, bad), (3, "clean"), (None, "clean")]), weights).collect()]
    assert sorted(got, key=str) == [(3, "clean"), (None, "clean")]


def test_stages_take_awkward_documents(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, SF_SMALL)
        assert got.columns == docs.columns
        assert {r.doc_id for r in got.collect()} >= {None, 1, 2, 3, 4, 5, 6}  # clean documents stay
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, SF_SMALL).collect()} == {None, 1, 2, 3, 4, 5, 6, 7}  # 8 repeats 5
    none = docs.where("doc_id = 0")
    assert all(step(spark, none, SF_SMALL).count() == 0 for _, step in corpus_pipeline.STAGES)
