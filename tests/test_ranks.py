"""Order statistics, places, last rows per key, as-of joins and tiles against plain code; no step gathers all rows in one task."""

import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import asof, axes, colocate as co, ranks
from halocline.sources import casts as ca


def values(kind, n=5000):
    rng = np.random.default_rng(7)
    return {
        "even": rng.random(n) * 40, "skew": np.exp(rng.normal(0, 12, n)), "ties": np.append(np.full(n, 3.5), rng.integers(0, 9, 50)), "one": np.array([2.0]), "two": np.array([-1.0, 4.0]),
        "wide": np.append(rng.random(n), [-1e300, 1e300]), "near": 1 + rng.integers(0, 5000, n) * 2.0**-50,
    }[kind]


@pytest.mark.parametrize("kind", ["even", "skew", "ties", "one", "two", "wide", "near"])
def test_percentiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "FEW", 40)
    monkeypatch.setattr(ranks, "BINS", 64)
    v = values(kind)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(4)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    n, got = ranks.order_statistics(df, "x", [(p, how) for p in shares for how in ("floor", "ceil")])
    order = np.sort(v)
    assert n == len(v) and got == [order[int(getattr(np, how)((n - 1) * p))] for p in shares for how in ("floor", "ceil")]
    assert np.allclose(ranks.percentiles(df, "x", shares), np.quantile(v, shares), rtol=1e-12)


def test_no_values(spark):
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert ranks.percentiles(none, "x", [0.5]) == [None] and ranks.percentiles(none.where("false"), "x", [0.5]) == [None]


def test_places_in_a_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 9 else None, rng.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(5)
    out = ranks.placed(df, [F.col("g").desc_nulls_last(), F.col("x").asc(), F.col("id").desc()], "place", 6)
    want = sorted(rows, key=lambda r: (r[0] is None, -ord(r[0] or "a"), r[1], -r[2]))
    got = sorted(out.collect(), key=lambda r: r["place"])
    assert [(r["g"], r["x"], r["id"]) for r in got] == want and [r["place"] for r in got] == list(range(3000))
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert all("__part" in below for line, below in zip(plan, plan[1:]) if "SinglePartition" in line)  # counts of ranges, no rows
    assert ranks.placed(df.where("false"), [F.col("id")], "place").count() == 0


def test_last_rows_of_a_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), x) for x in rng.sample(range(10**6), 2000)] + [("few", 5), ("few", None)]
    df = spark.createDataFrame(rows, "s string, seq long")
    for k, width in ((3, 50_000), (40, 1000), (5000, 10)):
        got = sorted(((r["s"] or "", -1 if r["seq"] is None else r["seq"]) for r in ranks.last(df, ["s"], "seq", k, width).collect()))
        want = []
        for s in {r[0] for r in rows}:
            mine = sorted((-1 if x is None else x for t, x in rows if t == s), reverse=True)[:k]
            want += [(s or "", x) for x in mine]
        assert got == sorted(want)


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of_joins(spark, parts):
    rng = random.Random(parts)
    left = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.randrange(0, 500) / 2 if k % 40 else None, k) for k in range(1500)]
    right = [(rng.choice(["hot"] * 6 + ["b", None, "only"]), float(rng.randrange(0, 250)), f"r{k}") for k in range(400)] + [("hot", None, "none")]
    a, b = spark.createDataFrame(left, "key string, at double, id int"), spark.createDataFrame(right, "key string, node double, name string")
    nodes = {}
    for key, node, name in sorted(right, key=lambda r: (r[0] or "", r[1] or 0, r[2])):
        if node is not None:
            nodes.setdefault(key, {}).setdefault(node, name)
    got = {r["id"]: r for r in asof.neighbours(a, b, F.col("at"), F.col("node"), ["key"], parts).collect()}
    near = {r["id"]: r for r in asof.nearest(a, b, F.col("at"), F.col("node"), ["key"], 3.0, parts).collect()}
    assert len(got) == len(near) == len(left)
    for key, at, k in left:
        line = sorted(nodes.get(key, {})) if at is not None else []
        n = bisect.bisect_right(line, at) if line else 0
        before, after = (line[n - 1] if n else None), (line[n] if n < len(line) else None)
        for side, node in (("before", before), ("after", after)):
            assert (got[k][side] and (got[k][side]["at"], got[k][side]["name"])) == (None if node is None else (node, nodes[key][node])), (k, side)
        best = min((abs(x - at), x) for x in line) if line else (None, None)
        assert (near[k]["near"] and near[k]["near"]["at"]) == (best[1] if line and best[0] <= 3 else None)


def test_a_large_axis_is_met_by_range(spark, monkeypatch):
    rng = random.Random(3)
    ax = axes.axis(spark.createDataFrame([(rng.random() * 100,) for _ in range(300)], "x double"), "x")
    df = spark.createDataFrame([(rng.random() * 120 - 10, k) for k in range(800)] + [(None, 800)], "v double, id int")
    want = sorted(axes.nearest(df, F.col("v"), ax, "n_").collect(), key=lambda r: r["id"])
    monkeypatch.setattr(axes, "MAX_BROADCAST", 100)
    assert sorted(axes.nearest(df, F.col("v"), ax, "n_").collect(), key=lambda r: r["id"]) == want


def test_days_nearest_to_steps(spark):
    rng = random.Random(4)
    t0 = datetime(2020, 1, 1)
    days = sorted({(rng.choice("abc"), t0 + timedelta(days=rng.randrange(0, 300))) for _ in range(120)})
    steps = [t0 + timedelta(days=10 * k, hours=12 * (k % 3)) for k in range(-2, 40)]
    rows = spark.createDataFrame([(s, t, 1.0) for s, t in days for _ in range(2)], "station string, time timestamp, temp double")
    got = sorted({(r["station"], r["time"]) for r in ca.nearest_days(rows, spark.createDataFrame([(k, t) for k, t in enumerate(steps)], "idx int, node timestamp")).collect()})
    want = sorted({min(((abs(t - step), t) for q, t in days if q == s))[1] and (s, min((abs(t - step), t) for q, t in days if q == s)[1]) for s in "abc" for step in steps})
    assert got == want


@pytest.mark.parametrize("side", [1, 3, 8])
def test_tiles_hold_every_stencil(spark, side):
    rng = random.Random(side)
    field = [(0, k, float(k), j, i, None if rng.random() < 0.05 else rng.random()) for j in range(11) for i in range(7) if (j, i) != (4, 4) for k in range(3)]
    cells = {(j, i, k): v for _, k, _, j, i, v in field}
    f = spark.createDataFrame(field, "t_idx int, k_idx int, depth double, j int, i int, temp double")
    at = [(n, 0, rng.choice([0.0, rng.random() * 10]), rng.choice([3.0, rng.random() * 6])) for n in range(60)]
    rows = []
    for n, t, y, x in at:
        j1, i1 = int(np.ceil(y)), int(np.ceil(x))
        j0, i0 = max(j1 - 1, 0), max(i1 - 1, 0)
        rows.append((n, t, j0, j1, y - j0 if j1 else 0.0, i0, i1, x - i0 if i1 else 0.0, None))
    p = spark.createDataFrame(rows, "profile_id int, t_idx int, j0 int, j1 int, jf double, i0 int, i1 int, if double, p_reason string")
    got = {(r["profile_id"], r["k"]): r["v"] for r in co.stencils(p, co.tiles(f, "temp", side), side).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select("profile_id", "k", co.at_level(F.col("k")).alias("v")).collect()}
    for n, _, j0, j1, fy, i0, i1, fx, _ in rows:
        for k in range(3):
            four = [((1 - fy) * (1 - fx), j0, i0), ((1 - fy) * fx, j0, i1), (fy * (1 - fx), j1, i0), (fy * fx, j1, i1)]
            part = [(w, cells.get((j, i, k))) for w, j, i in four if w]
            want = None if any(v is None for _, v in part) else sum(w * v for w, v in part)
            assert got[n, k] == pytest.approx(want), (n, k)
