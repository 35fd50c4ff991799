"""Observations on model levels: each level once, of the first segment that holds it; no row a level is dealt."""

import random

import pytest

import __spark_entry__ as entry
from halocline.operators import profiles


def test_levels_are_of_the_first_segment_that_holds_them(spark):
    rng = random.Random(3)
    nodes = [(k, 10.0 * (k + 1)) for k in range(8)]
    given = {"a": [(10.0, 1.0), (20.0, 5.0), (20.0, 4.0), (45.0, 9.0), (80.0, 2.0)], "b": [(None, 3.0), (30.0, 1.0), (50.0, 2.0), (None, 7.0)], "c": [(20.0, 1.0)], "d": [(20.0, None), (30.0, 1.0), (60.0, None), (70.0, 3.0)]}
    given |= {f"r{n}": [(rng.choice((5.0, 10.0, 15.0, 20.0, 30.0, 62.0, 80.0, 95.0)), rng.choice((None, rng.random()))) for _ in range(rng.randint(1, 7))] for n in range(40)}
    want = {}
    for key, levels in given.items():
        least = {}
        for depth, temp in levels:
            if depth is not None and temp is not None:
                least[depth] = min(temp, least.get(depth, temp))
        seg = sorted(least.items())
        for k, node in nodes:
            held = [(a, b) for a, b in zip(seg, seg[1:]) if a[0] <= node <= b[0]]
            if held:
                (d0, v0), (d1, v1) = held[0]
                want[key, k] = v0 + (node - d0) / (d1 - d0) * (v1 - v0)
    rows = [(key, depth, temp) for key, levels in given.items() for depth, temp in levels]
    observed = spark.createDataFrame(rows, "profile_id string, depth double, temp double").repartition(3)
    got = profiles.on_levels(observed, spark.createDataFrame(nodes, "k_idx int, node double")).collect()
    assert len(got) == len(want) and {(r["profile_id"], r["k_idx"]): r["observed"] for r in got} == want


@pytest.mark.parametrize("name", ["j6_nearest_column", "j7_observed_on_levels", "w11_residual_series"])
def test_no_row_a_level_is_dealt(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line.split("Exchange hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not [by for by in dealt if "k_idx" in by]
    # what meets the model's columns is a row a segment or profile: their levels are listed after the last shuffle
    assert "inline" not in plan or plan.index("Generate inline") < plan.index("Exchange hashpartitioning(")
