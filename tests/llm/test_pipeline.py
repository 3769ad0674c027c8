"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == columns
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before and len(set(after)) == len(after)
        if name == "exact dedup":
            texts = {}
            for r in docs.select("doc_id", "text").collect():
                texts[r.text or ""] = max(r.doc_id, texts.get(r.text or "", r.doc_id))
            assert set(after) == set(texts.values())
        assert len(after) > len(before) / 2
        docs = out
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(after)
    assert cp.run(spark, SF).count() == pieces.count()
