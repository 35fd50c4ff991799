"""Whole texts and all evidence count."""

import numpy as np

from halocline.llm import textmodel


def test_repetition_after_the_opening_counts():
    opening = " ".join(f"w{i}" for i in range(200))
    varied = opening + " " + " ".join(f"v{i}" for i in range(2000))
    junk = opening + " " + " ".join(f"j{i % 5}" for i in range(2000))
    assert textmodel.families(varied)[1][1] == 0 and textmodel.families(junk)[1][1] > 5
    again = " ".join(f"a{i % 150}" for i in range(200))
    assert np.isclose(textmodel.families(again)[1][1], textmodel.families(" ".join([again] * 20))[1][1])


def test_model_is_fitted_on_the_executors(spark):
    good = [(i, f"alpha beta gamma delta item {i}", 1) for i in range(60)]
    bad = [(100 + i, f"zeta zeta zeta junk spam {i}", 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    one, two = textmodel.train(docs, docs.select("doc_id", "quality")), textmodel.train(docs.repartition(7), docs.select("doc_id", "quality"))
    assert len(one.weights) == 4 * textmodel.SIZE + textmodel.DENSE + 1
    assert np.array_equal(one.weights, two.weights) and (one.slope, one.offset) == (two.slope, two.offset)
    raw = textmodel.logits(docs.toPandas()["text"], one.weights)
    assert raw[:60].min() > raw[60:].max()
