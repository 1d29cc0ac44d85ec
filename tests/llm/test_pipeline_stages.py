"""The pipeline's stages on nulls, empty texts, repeated ids, extra columns and an empty table."""

import corpus_pipeline
from kgframe.llm.common import table


def test_stages_on_hard_rows(spark, sf_dir):
    some = table(spark, sf_dir, "documents").select(corpus_pipeline.COLUMNS).limit(40)
    hard = [(10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (10_003, "x", "en", None, 1), (10_003, "x", "en", None, 1), (None, "call 555-012-3456", "en", "src0", 17)]
    docs = some.unionByName(spark.createDataFrame(hard, some.schema)).selectExpr("*", "'h' AS hits", "1 AS copies", "'s' AS stats")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS or k == len(corpus_pipeline.STAGES) - 1
        rows = out.collect()
        if name == "PII":
            assert len(rows) == 45 and not any("555-012-3456" in (r["text"] or "") for r in rows)
        if name == "n-gram Jaccard join":
            assert {10_001, 10_002, None} <= {r["doc_id"] for r in rows}
        if name == "BPE encoding and decoding":
            assert len(rows) == 45 and {r["n_tokens"] for r in rows if r["doc_id"] in (10_001, 10_002)} == {0}
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
