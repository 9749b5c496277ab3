"""The pipeline's stages, one after the other, on hard cases and against plain code."""

import corpus_pipeline
from siftwell.llm.runtime import materialize
from tests.llm.cases import base_text, docs, empty, words
from tests.llm.test_search_and_mix import check_pieces


def test_stage_order_and_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixing", "packing"]


def test_stages(spark, tmp_path):
    passage = base_text(60, 40)
    texts = [(i, base_text(60 + i, i)) for i in range(1, 13)] + [(20, base_text(61, 1)), (21, base_text(70, 50) + "\n" + passage), (22, passage + "\n" + base_text(70, 51)), (30, None), (31, ""), (None, base_text(80, 60))]
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(spark, texts)
    kept = [d]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], str(tmp_path))
        if name != "packing":
            assert out.columns == d.columns
        kept.append(materialize(out, f"test-{name}"))
    ids = [sorted(str(r["doc_id"]) for r in k.select("doc_id").collect()) for k in kept]
    assert "20" in ids[1] and "20" not in ids[2] and "None" in ids[2]
    text = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert text[21].endswith(passage) and passage not in text[22]
    mixed = kept[4].collect()
    assert {r["doc_id"] for r in mixed} <= set(text) and all(r["text"] == text[r["doc_id"]] for r in mixed)
    check_pieces([r for r in kept[5].collect()], [(r["doc_id"], r["text"]) for r in mixed], 1024)
    assert words(passage)


def test_run_on_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
