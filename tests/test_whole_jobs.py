"""Registered queries take all of their input."""

import pytest
from pyspark.sql import functions as F

from halocline.plans import core, inputs, more

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["x3_sigma0", "x4_sound_speed"])
def test_products_cover_every_step(spark, name):
    assert more.QUERIES[name](spark, SF).count() == inputs.grid(spark, SF).count()


def test_meshes_cover_every_step(spark, monkeypatch):
    some = inputs.grid(spark, SF).where("t_idx < 4 and k_idx < 30").checkpoint()
    monkeypatch.setattr(core, "grid", lambda *a: some.where(a[2]) if len(a) > 2 else some)
    alone = {t: core.ms.triangles(some.where(f"t_idx = {t}"), "rough", 20.0)[1].count() for t in range(4)}
    got = core.QUERIES["g3_triangles"](spark, SF)
    step = F.regexp_extract("b", r"^(\d+):", 1).cast("int")
    assert {r["t"]: r["count"] for r in got.groupBy(step.alias("t")).count().collect()} == {t: n for t, n in alone.items() if n}
    labels = core.QUERIES["g4_mesh_components"](spark, SF)
    assert labels.select(F.regexp_extract("label", r"^m?:?(\d+):", 1)).distinct().count() == 4


def test_a_box_reads_the_folders_it_touches(spark, tmp_path):
    from halocline.sources import gridded as gr

    cells = [(t, k, j, i) for t in range(12) for k in range(9) for j in range(10) for i in range(6)]
    df = spark.createDataFrame(cells, "t_idx int, k_idx int, j int, i int").withColumns({"temp": F.col("t_idx") + F.col("k_idx") / 10, "source_id": F.lit("a")})
    keys = [r["z"] for r in df.select(gr.curve_key().alias("z")).collect()]
    assert keys == [sum(((v >> b) & 1) << (4 * b + n) for n, v in enumerate(c) for b in range(15)) for c in cells]
    top = spark.createDataFrame([(32767, 32767, 32767, 32767)], "t_idx int, k_idx int, j int, i int")
    assert top.select(gr.curve_key().alias("z")).first()["z"] == 2**60 - 1
    gr.store_tiled(df, f"{tmp_path}/f", fold=2)
    files = df.sparkSession.read.parquet(f"{tmp_path}/f").inputFiles()
    box = {"t_idx": (4, 7), "k_idx": (0, 3), "j": (8, 9)}
    got = gr.load_box(spark, f"{tmp_path}/f", "a", {"a"}, box, fold=2)
    assert sorted((r["t_idx"], r["k_idx"], r["j"], r["i"]) for r in got.collect()) == [c for c in cells if all(lo <= c[gr.CURVE.index(a)] <= hi for a, (lo, hi) in box.items())]
    read = {r["f"] for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 3 * 3 * 3 * 2 and len(read) == 2
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in scan and "cell" in scan.split("PartitionFilters")[1].split("]")[0]


def test_a_ledger_is_counted_as_rows_are_stored(spark, tmp_path):
    from halocline import ledger

    rows = spark.range(100).withColumn("reason", F.when(F.col("id") % 3 == 0, "third").when(F.col("id") % 5 == 0, "fifth"))
    got = {r["reason"]: r["n"] for r in ledger.stored(rows, f"{tmp_path}/a", ["third", "fifth", "never"]).collect()}
    assert got == {r["reason"]: r["n"] for r in ledger.ledger(rows, ["third", "fifth", "never"]).collect()} == {"accepted": 53, "third": 34, "fifth": 13, "never": 0}
    back = spark.read.parquet(f"{tmp_path}/a")
    assert back.count() == 53 and back.columns == ["id"]
    with pytest.raises(ValueError, match="declared reason"):
        ledger.stored(rows, f"{tmp_path}/b", ["third"])


def test_a_kind_has_one_reader_and_the_library_has_its_own(spark, tmp_path):
    from halocline.operators import derived as de
    from halocline.sources import readers, text_casts as tx

    assert {"field", "profiles", "text_casts", "alerts"} <= set(de.READERS)
    with pytest.raises(ValueError, match="of its own"):
        de.register_reader("alerts", readers.alerts)
    (tmp_path / "a.csv").write_text("# latitude = 10\n# longitude = 86\n# time = 2024-01-02\nDepth;Temperature\n5;20\n")
    fmt = tx.Format({"lat": ("latitude",), "lon": ("longitude",), "time": (), "depth": (), "temp": ("temperature",)})
    assert [(r["wmo"], r["depth"], r["temp"]) for r in de.opened(spark, "text_casts", {"path": str(tmp_path), "format": fmt}).collect()] == [("a", 5.0, 20.0)]
    assert de.opened(spark, "profiles", {"path": f"{tmp_path}/none"}).count() == 0


@pytest.mark.parametrize("name", ["o2_profile_order", "s9_cast_levels", "s9_cast_counters", "s12_cast_profiles", "u2_pooled_counters"])
def test_tasks_that_sort_levels_grow_in_number_with_them(spark, monkeypatch, name):
    """Every exchange of levels by profile has as many parts as they ask for, and no levels are dealt by file."""
    monkeypatch.setattr(inputs, "TASK_LEVELS", 500)
    n = -(-inputs.table(spark, SF, "lineitem").count() // 500)
    q = (core.QUERIES | more.QUERIES)[name](spark, SF)
    plan = q._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in x]
    assert sorts and all(f", {n})" in x or f", {n}, " in x or f", {n})," in x for x in sorts)
    assert "SortMergeJoin [file" not in plan
    assert "Exchange hashpartitioning(profile_id" not in plan and "Exchange hashpartitioning(file#" not in plan.split("Window")[-1]


def test_rows_of_a_file_are_spread_where_they_meet_its_facts(spark):
    from halocline.session import per_file

    rows = spark.range(1000).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 990, "b").alias("file"), "id")
    facts = rows.groupBy("file").agg(F.count("*").alias("n"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = per_file(rows, facts)
        assert {(r["file"], r["n"], r["c"]) for r in out.groupBy("file", "n").agg(F.count("*").alias("c")).collect()} == {("a", 900, 900), ("b", 90, 90), (None, 10, 10)}
        dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]
        assert any("__part" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
