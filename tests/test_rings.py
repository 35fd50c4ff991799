"""Simplified rings against a plain walk, and the rounds that it takes."""

import math
import random

from halocline.operators import alerts


def walked(points, tolerance):
    """Places that stay, by a stack of segments; the first of the farthest counts."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        worst, at = 0.0, a
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        for i in range(a + 1, b):
            px, py = points[i][0] - ax, points[i][1] - ay
            long2 = dx * dx + dy * dy
            t = max(0.0, min(1.0, (px * dx + py * dy) / long2)) if long2 > 0 else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > worst:
                worst, at = d, i
        if worst > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return keep


def shapes():
    rng = random.Random(11)
    wave = [(i * 0.02, 0.1 * math.sin(i / 9.0)) for i in range(3000)]
    turn = [(math.cos(math.tau * i / 1500), math.sin(math.tau * i / 1500)) for i in range(1501)]
    walk = [(0.0, 0.0)]
    while len(walk) < 1200:
        walk.append((walk[-1][0] + rng.uniform(-0.01, 0.011), walk[-1][1] + rng.uniform(-0.01, 0.01)))
    # whole numbers: many points stand at the same distance, several at the same place
    steps = [(float(rng.randint(0, 8)), float(rng.randint(0, 8))) for _ in range(700)]
    comb = [(float(i // 4), float((i // 2) % 2)) for i in range(900)]
    column = [(5.0, float(i % 7)) for i in range(300)]
    line = [(0.001 * i, 0.0) for i in range(500)]
    return {"wave": wave, "turn": turn, "walk": walk, "steps": steps, "comb": comb, "column": column, "line": line, "short": wave[:50]}


def test_rings_over_many_blocks_keep_the_points_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(alerts, "BLOCK", 150)
    given = shapes()
    # numbers of points may have gaps
    rows = [(ring, 10 + i * 3, x, y) for ring, points in given.items() for i, (x, y) in enumerate(points)]
    p = spark.createDataFrame(rows, "ring string, idx int, lon double, lat double").repartition(5)
    got = alerts.simplified(p)
    assert got.dtypes == p.dtypes
    kept = {}
    for r in got.collect():
        kept.setdefault(r["ring"], []).append((r["idx"] - 10) // 3)
    for ring, points in given.items():
        want = range(len(points)) if ring == "short" else sorted(walked(points, alerts.TOLERANCE))
        assert sorted(kept[ring]) == list(want), ring


def test_rounds_do_not_grow_with_the_depth_of_splitting(spark, monkeypatch):
    """A long wave is cut crest by crest, from one end to the other."""
    made = []
    written = alerts.written
    monkeypatch.setattr(alerts, "written", lambda df, label: made.append(label) or written(df, label))
    wave = shapes()["wave"]
    p = spark.createDataFrame([("wave", i, x, y) for i, (x, y) in enumerate(wave)], "ring string, idx int, lon double, lat double")
    n = alerts.simplified(p).count()
    assert n == len(walked(wave, alerts.TOLERANCE)) > 100
    assert len(made) < 10


def test_only_short_rings(spark):
    p = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(5)], "ring string, idx int, lon double, lat double")
    assert alerts.simplified(p).count() == 5
