"""Closed forms, conservation and published check values."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from halocline.functions import ocean
from halocline.operators import alerts, colocate, columns, derived, fields, mesh, vectors
from halocline.sources import casts, gridded
from halocline.streaming import readings, stateful


def plane(lat, lon, z):
    """A field without curvature, which interpolation gives back exactly."""
    return 31.0 - 0.3 * lat + 0.125 * lon - 0.02 * z


def sloping_field(spark, nodes=5, depths=(4.0, 12.0, 30.0, 60.0, 130.0, 400.0, 900.0), hole=None):
    rows = [
        (0, datetime(2025, 3, 4), k, z, j, -3.0 + j, i, 60.0 + i, None if hole == (k, j, i) else plane(-3.0 + j, 60.0 + i, z))
        for k, z in enumerate(depths) for j in range(nodes) for i in range(nodes)
    ]
    return spark.createDataFrame(rows, "t_idx int, time timestamp, k_idx int, depth double, j int, lat double, i int, lon double, temp double")


def level(spark, rows):
    return spark.createDataFrame(rows, "profile_id string, wmo string, time timestamp, lat double, lon double, depth double, temp double, temp_qc int")


def test_plane_is_reproduced(spark):
    at = datetime(2025, 3, 5)
    lv = level(spark, [("a", "1", at, -1.7, 62.6, z, plane(-1.7, 62.6, z), 1) for z in (4.0, 9.0, 77.0, 900.0)])
    rows = colocate.colocate(sloping_field(spark), lv).collect()
    assert all(r["reason"] is None and abs(r["residual"]) < 1e-9 for r in rows)


def test_reasons_and_conservation(spark):
    at, late = datetime(2025, 3, 4), datetime(2025, 3, 25)
    lv = level(spark, [
        ("late", "1", late, -2.0, 61.0, 12.0, 1.0, 1), ("out", "1", at, 40.0, 61.0, 12.0, 1.0, 1), ("ok", "1", at, -2.0, 61.0, 12.0, 1.0, 1), ("ok", "1", at, -2.0, 61.0, 20.0, None, 1),
        ("ok", "1", at, -2.0, 61.0, 31.0, 1.0, None), ("ok", "1", at, -2.0, 61.0, 45.0, 1.0, 4), ("ok", "1", at, -2.0, 61.0, 5000.0, 1.0, 1), ("gap", "1", at, -1.5, 61.5, 20.0, 1.0, 2),
    ])
    pairs = colocate.colocate(sloping_field(spark, hole=(2, 1, 1)), lv)
    got = {r["reason"]: r["n"] for r in colocate.refusals(pairs).collect()}
    assert got == {"matched": 1, "no_model_time": 1, "outside_grid": 1, "no_observation": 1, "no_qc_flag": 1, "rejected_qc": 1, "outside_depth_range": 1, "missing_stencil": 1}
    assert sum(got.values()) == lv.count()


def test_empty_levels_give_empty_card(spark):
    card = colocate.scorecard(colocate.colocate(sloping_field(spark), level(spark, [])))
    assert card.count() == 8 and card.agg(F.sum("n")).first()[0] == 0


def test_isotherm_and_mesh_agree(spark):
    rows = [(0, datetime(2026, 1, 1), k, 10.0 * k, j, float(j), i, float(i), 30.0 - k * (1 + 0.1 * j) - 0.05 * i) for k in range(10) for j in range(3) for i in range(3)]
    f = spark.createDataFrame(rows, "t_idx int, time timestamp, k_idx int, depth double, j int, lat double, i int, lon double, temp double")
    iso = {(r["j"], r["i"]): r["depth"] for r in columns.isotherm_depth(f).collect()}
    cross = {(r["j"], r["i"]): r["depth"] for r in mesh.crossings(f, "temp", 26.0).where("axis = 0").collect()}
    assert iso == cross


def solid(spark, value, n=10):
    """A field on n x n x n nodes between -1 and 1, value(x, y, z) at each."""
    g = [2 * k / (n - 1) - 1 for k in range(n)]
    rows = [(0, k, g[k], j, g[j], i, g[i], float(value(g[i], g[j], g[k]))) for k in range(n) for j in range(n) for i in range(n)]
    return spark.createDataFrame(rows, "t_idx int, k_idx int, depth double, j int, lat double, i int, lon double, v double")


def shape_of(field):
    """Euler characteristic, components, boundary edges, directed edges used twice, signed volume of the surface at 0."""
    vertices, tri = mesh.triangles(field, "v", 0.0)
    tri = tri.checkpoint()
    used = tri.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct().count()
    both = tri.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")), F.struct(F.col("c").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    edges = both.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()
    at = {r["id"]: (r["lon"], r["lat"], r["depth"]) for r in vertices.collect()}
    volume = 0.0
    for r in tri.collect():
        (a, b, c), (d, e, f), (g, h, i) = at[r["a"]], at[r["b"]], at[r["c"]]
        volume += (a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)) / 6
    return used - edges + tri.count(), mesh.mesh_components(tri).select("label").distinct().count(), mesh.boundary_edges(tri).count(), both.groupBy("a", "b").count().where("count > 1").count(), volume


def test_sphere_torus_and_two_balls(spark):
    euler, parts, rim, clashes, ball = shape_of(solid(spark, lambda x, y, z: 0.7 - math.hypot(x, y, z), 12))
    assert (euler, parts, rim, clashes) == (2, 1, 0, 0) and abs(abs(ball) - 4 / 3 * math.pi * 0.7**3) < 0.1
    torus = shape_of(solid(spark, lambda x, y, z: 0.25 - math.hypot(math.hypot(x, y) - 0.6, z), 22))
    assert torus[:4] == (0, 1, 0, 0) and torus[4] * ball > 0
    balls = shape_of(solid(spark, lambda x, y, z: 0.3 - min(math.hypot(x + 0.45, y, z), math.hypot(x - 0.45, y, z)), 18))
    assert balls[:4] == (4, 2, 0, 0) and balls[4] * ball > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_noise_makes_closed_surfaces(spark, seed):
    import random

    rnd = random.Random(seed)
    inner = lambda *p: max(map(abs, p)) < 0.99
    euler, parts, rim, clashes, _ = shape_of(solid(spark, lambda x, y, z: rnd.gauss(0, 1) if inner(x, y, z) else -1.0, 8))
    assert rim == 0 and clashes == 0 and euler % 2 == 0 and euler <= 2 * parts


def test_mesh_counts(spark):
    field = solid(spark, lambda x, y, z: 0.0 if (x, y, z) == (0, 0, 0) else 0.5 if z > 0.9 else -1.0, 5)
    counts = mesh.mesh_counts(field, "v", 0.0).first()
    vertices, tri = mesh.fans(field, "v", 0.0)
    assert counts["n_vertices"] == vertices.count() and counts["n_triangles"] + counts["n_culled"] == tri.count() and counts["n_culled"] > 0
    own = vertices.agg(F.round(F.min("depth"), 4), F.round(F.max("depth"), 4)).first()
    assert (counts["depth_min"], counts["depth_max"]) == tuple(own) and counts["max_bracket"] == 0.5


def test_ties_count_in_whole_cells_only(spark):
    rows = [(0, k, float(k), j, float(j), i, float(i), None if (k, j, i) == (0, 0, 0) else 1.0 if k else 0.0) for k in range(2) for j in range(2) for i in range(3)]
    field = spark.createDataFrame(rows, "t_idx int, k_idx int, depth double, j int, lat double, i int, lon double, v double")
    got = mesh.accounting(mesh.cells(field, "v", 0.0)).first()
    assert (got["n_cells"], got["n_skipped"], got["n_tied"]) == (2, 1, 1)
    saddle = spark.createDataFrame([(0, k, float(k), j, float(j), i, float(i), 1.0 if (j + i) % 2 else -1.0) for k in range(2) for j in range(2) for i in range(2)], field.schema)
    assert mesh.accounting(mesh.cells(saddle, "v", 0.0)).first()["n_ambiguous"] == 1


def test_case_table_covers_all_masks():
    for mask in range(1, 255):
        for bits in (0, 63):
            crossed = {e for e, (c, axis) in enumerate(mesh.EDGES) if (mask >> c & 1) != (mask >> (c + (4, 2, 1)[axis]) & 1)}
            assert {e for chain in mesh.loops(mask, bits) for e in chain} == crossed


#: Published check values of the sea-water standard (fixed values).
SA, CT, P = (34.7118, 34.8915, 35.0256, 34.8472, 34.7366, 34.7324), (28.8099, 28.4392, 22.7862, 10.2262, 6.8272, 4.3236), (10.0, 50.0, 125.0, 250.0, 600.0, 1000.0)
SIGMA0 = (21.797901, 22.052215, 23.892985, 26.667609, 27.107380, 27.409749)
SOUND = (1542.478379, 1542.572504, 1530.740258, 1494.430078, 1487.391369, 1483.937418)


def test_density_and_sound_speed_give_the_published_values(spark):
    df = spark.createDataFrame(list(zip(SA, CT, P, SIGMA0, SOUND)), "sa double, ct double, p double, s double, c double")
    for r in df.select("s", "c", ocean.sigma0(F.col("sa"), F.col("ct")).alias("s1"), ocean.sound_speed(F.col("sa"), F.col("ct"), F.col("p")).alias("c1")).collect():
        assert abs(r["s"] - r["s1"]) < 1e-6 and abs(r["c"] - r["c1"]) < 1e-6


def test_a_fall_does_not_trip(spark):
    rows = [("a", i, 20.0 + 0.01 * (i % 5)) for i in range(40)]
    for last, trips in ((30.0, [40]), (10.0, []), (21.4, [])):
        df = spark.createDataFrame([*rows, ("a", 40, last)], "station_id string, seq long, temp_c double")
        assert [r["seq"] for r in readings.threshold_alerts(df).where("tripped").collect()] == trips


def test_windows_of_a_station_in_stretches(spark, monkeypatch):
    import random

    monkeypatch.setattr(readings, "SEQ_CELL", 40)
    rnd = random.Random(2)
    rows = [("a", 3 * i, rnd.gauss(20, 3)) for i in range(300)] + [("b", i, 5.0) for i in range(90)]
    got = {(r["station_id"], r["seq"]): r for r in readings.history(spark.createDataFrame(rows, "station_id string, seq long, temp_c double"), 25).collect()}
    assert len(got) == len(rows)
    for s, n in (("a", 300), ("b", 90)):
        mine = sorted(r for r in rows if r[0] == s)
        for k, (_, seq, _) in enumerate(mine):
            before = [v for *_, v in mine[max(0, k - 25) : k]]
            r = got[s, seq]
            assert r["n_before"] == len(before)
            if before:
                mean = sum(before) / len(before)
                assert abs(r["mean_before"] - mean) < 1e-9 and abs(r["std_before"] - (sum((v - mean) ** 2 for v in before) / len(before)) ** 0.5) < 1e-7


@pytest.mark.parametrize("have,want,value", [
    ("degs", "degC", 5.0), ("Deg_C", "degC", 5.0), ("degree_Celsius", "degC", 5.0), ("PSS-78", "1", 5.0), ("decibar", "dbar", 5.0), ("METRES", "m", 5.0), ("cm/s", "m s-1", 0.05), ("cm/sec", "m s-1", 0.05), ("m s-1", "cm s-1", 500.0),
    ("degK", "degC", -268.15), ("degC", "degK", 278.15), ("mg m-3", "kg m-3", 5e-6), ("km", "m", None), ("kelvin", "degC", None),
])
def test_units(spark, have, want, value):
    df = spark.createDataFrame([(5.0,)], "v double")
    if value is None:
        with pytest.raises(ValueError):
            gridded.in_unit(df, "v", have, want)
    else:
        assert abs(gridded.in_unit(df, "v", have, want).first()["v"] - value) < 1e-12


def test_readers_and_level_slices(spark):
    derived.register_reader("sloping", lambda s, spec: sloping_field(s, spec["nodes"]))
    assert derived.opened(spark, "sloping", {"nodes": 3}).count() == 7 * 9
    for bad in (lambda: derived.opened(spark, "none", {}), lambda: derived.register_reader("sloping", print), lambda: derived.register_reader("", print)):
        with pytest.raises(ValueError):
            bad()
    f = sloping_field(spark).withColumn("sal", F.lit(35.0))
    units = {"temp": "degC", "sal": "1"}
    level = derived.shaped(derived.run(f, "sigma0", units), "sigma0", 20.0)
    assert {(r["k_idx"], r["depth"]) for r in level.select("k_idx", "depth").distinct().collect()} == {(1, 12.0)} and level.count() == 25
    assert derived.shaped(derived.run(f, "d26", units), "d26").where("depth is not null").count() == 0
    with pytest.raises(ValueError):
        derived.shaped(derived.run(f, "sigma0", units), "sigma0", 5000.0)


def test_instrument_classes_must_agree(spark):
    files = spark.createDataFrame([("a", "s", "glider"), ("b", "s", "float"), ("c", "s", ""), ("d", "t", "float")], "file string, source_id string, detected string")
    got = casts.class_mismatches(files, spark.createDataFrame([("s", "glider"), ("t", None)], "source_id string, instrument_class string")).collect()
    assert [(r["file"], r["declared"], r["detected"]) for r in got] == [("b", "glider", "float")]


def test_depth_and_pressure(spark):
    r = spark.range(1).select(ocean.depth_of(F.lit(1000.0), F.lit(5.0)).alias("z"), ocean.pressure_of(F.lit(2000.0), F.lit(15.5)).alias("p")).first()
    assert abs(1000 - r["z"] - 7.92) < 0.01
    assert abs(r["p"] - 2021.5243) < 1e-3


@pytest.mark.parametrize("stride,budget,ny,nx", [(9, 600, 241, 181), (1, 600, 21, 16)])
def test_stride(stride, budget, ny, nx):
    assert vectors.stride_for(ny, nx, budget) == stride


def test_blocks_add_up(spark):
    rows = [(0, 0, j, float(j), i, float(i), None if (i + j) % 3 == 0 else 1.0, None if j == 0 else 2.0) for j in range(7) for i in range(5)]
    f = spark.createDataFrame(rows, "t_idx int, k_idx int, j int, lat double, i int, lon double, uo double, vo double")
    b = vectors.block_means(f, 3).collect()
    assert sum(r["cells"] for r in b) == 35
    assert all((r["u"], r["v"]) == (1.0, 2.0) for r in b if r["reason"] is None)


def test_box_refuses_nonsense():
    with pytest.raises(ValueError):
        fields.valid_box(10, 0, 5, 1)


def test_cancel_after_the_fact(spark):
    rows = [("1", "Alert", []), ("2", "Alert", []), ("3", "Cancel", ["1"]), ("4", "Update", ["2"])]
    a = spark.createDataFrame([(i, k, "Actual", r, datetime(2026, 1, 1), None) for i, k, r in rows], "identifier string, msg_type string, status string, references array<string>, effective timestamp, expires timestamp")
    got = {r["identifier"]: r["reason"] for r in alerts.resolved(a, datetime(2026, 1, 2)).collect()}
    assert got == {"1": "cancelled", "2": "superseded", "3": "not_a_warning", "4": None}


def test_simplify_keeps_short_rings_and_ends(spark):
    long = [("long", i, i * 0.001, 0.0) for i in range(300)]
    short = [("short", i, float(i), float(i % 2)) for i in range(5)]
    p = spark.createDataFrame(long + short, "ring string, idx int, lon double, lat double")
    got = {r["ring"]: r["n"] for r in alerts.simplified(p).groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"long": 2, "short": 5}


def test_stream_trips_as_batch_does(spark, tmp_path):
    values = [20.0 + 0.01 * (i % 5) for i in range(40)] + [30.0] + [20.0] * 5
    rows = [("a", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_id string, seq long, temp_c double")
    batch = {(r["station_id"], r["seq"]) for r in readings.threshold_alerts(df).where("tripped").collect()}
    for part in range(2):
        df.where(f"seq >= {part * 23} and seq < {(part + 1) * 23}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
    with stateful.key_value_store(spark):
        q = stateful.trip_stream(stream).writeStream.format("memory").queryName("trips").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = {(r["station_id"], r["seq"]) for r in spark.sql("select * from trips").collect()}
    assert got == batch and batch


def test_ingest_stream_restarts_without_repeats(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 20.0, 1.0, 1.0, 1), ("", None, 20.0, 1.0, 1.0, 2), ("b", None, 500.0, 1.0, 1.0, 3)], readings.READING)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        readings.to_sinks(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    assert {r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"no_station", "temp_c_out_of_range"}


def test_products_refuse_units_and_names(spark):
    with pytest.raises(ValueError):
        derived.run(sloping_field(spark), "d26", {"temp": "K"})
    with pytest.raises(ValueError):
        derived.register(derived.PRODUCTS["d26"])
