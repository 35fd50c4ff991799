"""Near-duplicate stage: documents without an id, or that share one, are told apart by their texts."""

import corpus_pipeline


def test_null_and_shared_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (3, text(3)), (4, text(4)), (4, text(5)), (4, text(4)), (6, text(5))]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted((r["doc_id"] or 0, r["text"].split("x")[0]) for r in out.collect())
    assert got[:3] == [(0, "w1"), (0, "w2"), (3, "w3")] and len(got) == 5 and out.columns == ["doc_id", "text"]
    assert sorted(t for _, t in got[3:]) == ["w4", "w5"]
