"""Registered queries over fields, profiles and their colocation, each with its DuckDB SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ocean
from ..operators import alerts as al, axes, claims as cl, colocate as co, columns as cc, fields as fl, mesh as ms, profiles as pf, raster as ra, vectors as ve
from ..session import written
from .inputs import ALERTS, GRID, LEVELS, PAIRS, alerts, grid, levels, steps, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = (0.0, 2.0, 3.0, 12.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def paired(spark, sf) -> DataFrame:
    return co.colocate(grid(spark, sf), levels(spark, sf))


# ---- colocation and scores -------------------------------------------------------------------------------------------


@query(PAIRS + "SELECT profile_id, depth, t_idx, round(t_gap, 1) AS t_gap, round(modelled, 4) AS modelled, round(residual, 4) AS residual FROM pairs WHERE reason IS NULL")
def j5_colocate(spark, sf):
    return paired(spark, sf).where("reason is null").select("profile_id", "depth", "t_idx", F.round("t_gap", 1).alias("t_gap"), F.round("modelled", 4).alias("modelled"), F.round("residual", 4).alias("residual"))


@query(PAIRS + """, names AS (SELECT unnest(['matched','no_model_time','outside_grid','no_observation','no_qc_flag','rejected_qc','outside_depth_range','missing_stencil']) AS reason)
SELECT n.reason, count(p.profile_id) AS n FROM names n LEFT JOIN pairs p ON coalesce(p.reason, 'matched') = n.reason GROUP BY 1""")  # fmt: skip
def a6_refusal_ledger(spark, sf):
    return co.refusals(paired(spark, sf))


BANDS_SQL = "bands AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 10, 50), (2, 50, 100), (3, 100, 200), (4, 200, 500), (5, 500, 1000), (6, 1000, 2000), (-1, NULL, NULL)) b(band, lo, hi))"
BAND_OF = "CASE " + " ".join(f"WHEN depth >= {a} AND depth < {b} THEN {i}" for i, (a, b) in enumerate(zip(co.BANDS, co.BANDS[1:]))) + " END"
CARD_SQL = PAIRS + f""", {BANDS_SQL}, good AS (SELECT depth, residual FROM pairs WHERE reason IS NULL),
each AS (SELECT {BAND_OF} AS band, residual FROM good UNION ALL SELECT -1 AS band, residual FROM good),
stat AS (SELECT band, count(residual) AS n, round(avg(residual), 4) AS bias, round(sqrt(avg(residual*residual)), 4) AS rmse, round(avg(abs(residual)), 4) AS mae, round(stddev_pop(residual), 4) AS std FROM each WHERE band IS NOT NULL GROUP BY band),
card AS (SELECT band, lo, hi, coalesce(n, 0) AS n, bias, rmse, mae, std FROM bands LEFT JOIN stat USING (band))
"""


@query(CARD_SQL + "SELECT * FROM card")
def a4_scorecard(spark, sf):
    return co.scorecard(paired(spark, sf))


@query(CARD_SQL + "SELECT n, bias, rmse, mae, std FROM card WHERE band = -1")
def a3_residual_stats(spark, sf):
    return paired(spark, sf).where("reason is null").agg(*co.stats())


@query(PAIRS + """SELECT count(*) AS n_pairs, count(DISTINCT profile_id) AS n_profiles, count(DISTINCT nullif(wmo, '')) AS n_platforms,
round(quantile_cont(t_gap / 3600, 0.5), 2) AS median_hours, round(max(t_gap / 3600), 2) AS max_hours FROM pairs WHERE reason IS NULL""")  # fmt: skip
def a5_scorecard_head(spark, sf):
    return co.head(paired(spark, sf))


@query(PAIRS + "SELECT DISTINCT wmo FROM pairs WHERE reason IS NULL AND wmo <> ''")
def a5_platforms(spark, sf):
    return co.platforms(paired(spark, sf))


@query(CARD_SQL + "SELECT * FROM card WHERE band >= 0 AND n >= 20 ORDER BY rmse DESC, band LIMIT 1")
def a7_worst_band(spark, sf):
    return co.worst_band(co.scorecard(paired(spark, sf)))


NEAR_SQL = f"""WITH {GRID}, d AS (SELECT DISTINCT o_orderdate AS time FROM orders),
n AS (SELECT d.time, s.t_idx, abs(epoch_us(d.time) - epoch_us(s.time)) / 1e6::DOUBLE AS gap, row_number() OVER (PARTITION BY d.time ORDER BY abs(epoch_us(d.time) - epoch_us(s.time)), s.t_idx) AS r FROM d, steps s)
SELECT time, t_idx, gap, gap > 432000 AS refused FROM n WHERE r = 1"""


@query(NEAR_SQL)
def j1_nearest_step(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").alias("time")).distinct()
    ax = steps(spark, sf).select(F.col("t_idx").alias("idx"), F.col("time").alias("node"))
    near = axes.nearest(days, axes.seconds(F.col("time")), ax, "n_")
    return near.select("time", F.col("n_idx").alias("t_idx"), F.col("n_gap").alias("gap"), (F.col("n_gap") > co.MAX_DAYS * 86400).alias("refused"))


@query(f"""WITH {LEVELS} SELECT profile_id, n, lat, CASE WHEN lat < 0 OR lat > 24 THEN NULL ELSE greatest(CAST(ceil(lat) AS INTEGER) - 1, 0) END AS j0, CASE WHEN lat < 0 OR lat > 24 THEN NULL ELSE CAST(ceil(lat) AS INTEGER) END AS j1,
round(CASE WHEN lat < 0 OR lat > 24 THEN NULL WHEN ceil(lat) = 0 THEN 0 ELSE lat - greatest(CAST(ceil(lat) AS INTEGER) - 1, 0) END, 6) AS share FROM levels""")  # fmt: skip
def j2_bracket(spark, sf):
    ax = axes.axis(table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("lat")), "lat")
    rows = axes.bracketed(levels(spark, sf), F.col("lat"), ax, "j")
    return rows.select("profile_id", "n", "lat", "j0", "j1", F.round("jf", 6).alias("share"))


#: The model's columns as lists, by level.
LISTS = "cols AS (SELECT t_idx, j, i, list(temp ORDER BY k_idx) AS v FROM grid GROUP BY ALL)"
CORNERS_SQL = ", ".join(f"c{x}.v AS v{x}" for x in ("00", "01", "10", "11")), " ".join(f"LEFT JOIN cols c{x} ON c{x}.t_idx = p.t_idx AND c{x}.j = p.j{x[0]} AND c{x}.i = p.i{x[1]}" for x in ("00", "01", "10", "11"))


@query(PAIRS + f""", {LISTS}, w AS (SELECT p.profile_id, CASE WHEN j1 = 0 THEN 0.0::DOUBLE ELSE p_lat - j0 END AS fy, CASE WHEN i1 = 0 THEN 0.0::DOUBLE ELSE p_lon - i0 END AS fx, {CORNERS_SQL[0]} FROM pos p {CORNERS_SQL[1]} WHERE NOT late AND NOT outside),
l AS (SELECT profile_id, fy, fx, k - 1 AS k_idx, v00[k] AS a, v01[k] AS b, v10[k] AS c, v11[k] AS d FROM w, range(1, 51) r(k))
SELECT profile_id, k_idx, round((1-fy)*(1-fx)*coalesce(a,0) + (1-fy)*fx*coalesce(b,0) + fy*(1-fx)*coalesce(c,0) + fy*fx*coalesce(d,0), 4) AS at_level FROM l
WHERE NOT (((1-fy)*(1-fx) <> 0 AND a IS NULL) OR ((1-fy)*fx <> 0 AND b IS NULL) OR (fy*(1-fx) <> 0 AND c IS NULL) OR (fy*fx <> 0 AND d IS NULL))""")  # fmt: skip
def j3_bilinear(spark, sf):
    """Every profile's place at every level."""
    g, lv = grid(spark, sf), levels(spark, sf)
    pos = co.placed(co.heads(lv), axes.axes_of(g, "time", "lat", "lon"))
    st = co.stencils(pos, co.tiles(g, "temp"))
    levels_ = F.explode(F.sequence(F.lit(0), F.greatest(*[F.size(f"v{n}") for n in range(4)]) - 1))
    rows = st.where("coalesce(v0, v1, v2, v3) is not null").withColumn("k_idx", levels_)
    return rows.select("profile_id", F.col("k_idx").cast("long").alias("k_idx"), F.round(co.at_level(F.col("k_idx")), 4).alias("at_level")).where("at_level is not null")


@query(f"""WITH {GRID}, {LEVELS}, {LISTS}, q AS (SELECT DISTINCT depth FROM levels WHERE depth >= 40 AND depth <= 2000),
b AS (SELECT depth, greatest(CAST(ceil(depth / 40.0::DOUBLE) AS INTEGER) - 2, 0) AS k0, CAST(ceil(depth / 40.0::DOUBLE) AS INTEGER) - 1 AS k1 FROM q)
SELECT t_idx, j, i, depth, round(v[k0 + 1] + CASE WHEN k1 = 0 THEN 0 ELSE (depth - 40.0::DOUBLE*(k0 + 1)) / 40.0::DOUBLE END * (v[k1 + 1] - v[k0 + 1]), 8) AS value FROM cols, b""")  # fmt: skip
def j4_depth_interp(spark, sf):
    """All model columns at every depth that was measured: depths meet the pairs of levels that bracket them."""
    g = grid(spark, sf)
    q = axes.bracketed(levels(spark, sf).select("depth").distinct(), F.col("depth"), axes.axis(g, "depth"), "k").where("k1 is not null")
    cols = co.columns_of(g, "temp")
    pair = F.transform(F.sequence(F.lit(0), F.size("vals") - 1), lambda k: F.struct(F.greatest(k - 1, F.lit(0)).alias("k0"), k.alias("k1"), F.get("vals", F.greatest(k - 1, F.lit(0))).alias("lo"), F.get("vals", k).alias("hi")))
    pairs = cols.select("t_idx", "j", "i", F.explode(pair).alias("p")).select("t_idx", "j", "i", "p.*")
    rows = pairs.join(q.select("depth", F.col("k1").alias("q1"), "kf"), F.col("k1") == F.col("q1"))
    return rows.select("t_idx", "j", "i", "depth", F.round(F.col("lo") + F.col("kf") * (F.col("hi") - F.col("lo")), 8).alias("value"))


COLUMN_SQL = f"""WITH {GRID}, {LEVELS}, h AS (SELECT DISTINCT profile_id, time, lat, lon FROM levels),
n AS (SELECT h.*, s.t_idx, row_number() OVER (PARTITION BY profile_id ORDER BY abs(epoch_us(h.time) - epoch_us(s.time)), s.t_idx) AS r FROM h, steps s),
a AS (SELECT profile_id, t_idx, least(greatest(CAST(ceil(lat - 0.5::DOUBLE) AS INTEGER), 0), 24) AS j, least(greatest(CAST(ceil(lon - 0.5::DOUBLE) AS INTEGER), 0), 4) AS i FROM n WHERE r = 1),
m AS (SELECT profile_id, g.k_idx, g.depth, g.temp AS modelled FROM a JOIN grid g USING (t_idx, j, i)),
o AS (SELECT profile_id, depth, min(temp) AS temp FROM levels WHERE temp IS NOT NULL GROUP BY ALL),
s AS (SELECT profile_id, depth AS d0, lead(depth) OVER w AS d1, temp AS v0, lead(temp) OVER w AS v1 FROM o WINDOW w AS (PARTITION BY profile_id ORDER BY depth)),
x AS (SELECT m.*, s.*EXCLUDE (profile_id), row_number() OVER (PARTITION BY m.profile_id, m.k_idx ORDER BY s.d0) AS r FROM m JOIN s ON s.profile_id = m.profile_id AND m.depth BETWEEN s.d0 AND s.d1),
y AS (SELECT profile_id, k_idx, v0 + (depth - d0) / (d1 - d0) * (v1 - v0) AS observed FROM x WHERE r = 1)
"""


def nearest_cells(g: DataFrame, lv: DataFrame) -> DataFrame:
    """(profile_id, t_idx, j, i): every profile's nearest step and column."""
    h = co.heads(lv)
    ax = axes.axes_of(g, "time", "lat", "lon")
    for name, value, dim in (("t", axes.seconds(F.col("p_time")), "time"), ("jn", F.col("p_lat"), "lat"), ("in", F.col("p_lon"), "lon")):
        h = axes.nearest(h, value, ax[dim], f"{name}_")
    return h.select("profile_id", "t_idx", F.col("jn_idx").alias("j"), F.col("in_idx").alias("i"))


def with_columns(rows: DataFrame, g: DataFrame) -> DataFrame:
    """rows(t_idx, j, i) with `cells`, the column's (k_idx, depth, modelled) by level, which is written, so that Spark knows whether it's small."""
    cells = F.sort_array(F.collect_list(F.struct("k_idx", "depth", F.col("temp").alias("modelled"))))
    return rows.join(written(g.groupBy("t_idx", "j", "i").agg(cells.alias("cells")), "columns"), ["t_idx", "j", "i"])


def model_columns(spark, sf, lv: DataFrame) -> DataFrame:
    """Nearest-cell model column of every profile, for display: (profile_id, k_idx, depth, modelled)."""
    g = grid(spark, sf)
    return with_columns(nearest_cells(g, lv), g).select("profile_id", F.inline("cells"))


@query(COLUMN_SQL + "SELECT profile_id, k_idx, depth, round(modelled, 4) AS modelled FROM m")
def j6_nearest_column(spark, sf):
    return model_columns(spark, sf, levels(spark, sf)).withColumn("modelled", F.round("modelled", 4))


@query(COLUMN_SQL + "SELECT m.profile_id, m.k_idx, round(modelled, 4) AS modelled, round(observed, 7) AS observed FROM m JOIN y USING (profile_id, k_idx)")
def j7_observed_on_levels(spark, sf):
    return j7_joined(spark, sf).select("profile_id", "k_idx", F.round("modelled", 4).alias("modelled"), F.round("observed", 7).alias("observed"))


@query(COLUMN_SQL + f""", {BANDS_SQL} SELECT profile_id, k_idx, round(observed - modelled, 4) AS residual, band FROM (
SELECT m.profile_id, m.k_idx, observed, modelled, band, row_number() OVER (PARTITION BY m.profile_id, m.k_idx ORDER BY band) AS r FROM m JOIN y USING (profile_id, k_idx) LEFT JOIN (SELECT * FROM bands WHERE band >= 0) b ON m.depth BETWEEN lo AND hi) WHERE r = 1""")  # fmt: skip
def w11_residual_series(spark, sf):
    """Bands are closed at both ends here and the first that fits is taken."""
    rows = j7_joined(spark, sf)
    band = F.lit(None).cast("int")
    for n, (a, b) in reversed(list(enumerate(zip(co.BANDS, co.BANDS[1:])))):
        band = F.when(F.col("depth").between(a, b), F.lit(n)).otherwise(band)
    return rows.select("profile_id", "k_idx", F.round(F.col("observed") - F.col("modelled"), 4).alias("residual"), band.alias("band"))


def j7_joined(spark, sf):
    """(profile_id, k_idx, depth, modelled, observed).  A profile's segments get their model column, and only then their levels: no row a level is dealt."""
    g, lv = grid(spark, sf), levels(spark, sf)
    nodes = axes.axis(grid(spark, sf, "t_idx = 0"), "depth").select(F.col("idx").alias("k_idx"), "node")
    rows = pf.at_nodes(with_columns(pf.segments(lv).join(nearest_cells(g, lv), "profile_id"), g), nodes)
    return rows.withColumn("cell", F.get("cells", F.col("k_idx"))).select("profile_id", "k_idx", "cell.depth", "cell.modelled", "observed")


# ---- subsetting and summaries ----------------------------------------------------------------------------------------

BOX_SQL = "lat BETWEEN 2 AND 12 AND lon BETWEEN 0 AND 3"
AT = datetime(1998, 5, 20)


@query(f"WITH {LEVELS} SELECT profile_id, n, lat, lon, depth FROM levels WHERE {BOX_SQL}")
def f2_box(spark, sf):
    return fl.in_box(levels(spark, sf), BOX).select("profile_id", "n", "lat", "lon", "depth")


@query(f"""WITH {GRID}, s AS (SELECT * FROM steps ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '1998-05-20')), t_idx LIMIT 1) SELECT t_idx, time AS served_time, abs(epoch_us(time) - epoch_us(TIMESTAMP '1998-05-20')) / 1e6::DOUBLE AS gap FROM s""")
def f3_snap_time(spark, sf):
    ax = steps(spark, sf).select(F.col("t_idx").alias("idx"), F.col("time").alias("node"))
    one = table(spark, sf, "orders").agg(F.lit(AT).alias("want"))
    near = axes.nearest(one, axes.seconds(F.col("want")), ax, "n_")
    return near.select(F.col("n_idx").alias("t_idx"), F.col("n_node").alias("served_time"), F.col("n_gap").alias("gap"))


@query(f"""WITH {LEVELS}, q AS (SELECT DISTINCT depth FROM levels) SELECT depth, least(greatest(CAST(ceil(depth / 40.0::DOUBLE - 0.5::DOUBLE) AS INTEGER), 1), 50) - 1 AS k_idx, depth < 40 - 1e-6::DOUBLE OR depth > 2000 + 1e-6::DOUBLE AS refused FROM q""")
def f4_snap_depth(spark, sf):
    ax = axes.axis(table(spark, sf, "part").select((F.col("p_size") * F.lit(40.0)).alias("depth")), "depth")
    ends = ax.agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    near = axes.nearest(levels(spark, sf).select("depth").distinct(), F.col("depth"), ax, "k_").join(F.broadcast(ends))
    return near.select("depth", "k_idx", ((F.col("depth") < F.col("lo") - axes.DEPTH_SLACK) | (F.col("depth") > F.col("hi") + axes.DEPTH_SLACK)).alias("refused"))


SLAB_SQL = f"""WITH {GRID}, s AS (SELECT * FROM steps ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '1998-05-20')), t_idx LIMIT 1), g AS (SELECT grid.* FROM grid JOIN s USING (t_idx))
"""


@query(SLAB_SQL + f"SELECT time AS served_time, k_idx, depth, j, lat, i, lon, round(temp, 4) AS value FROM g WHERE {BOX_SQL} AND k_idx = 11")
def f5_slab(spark, sf):
    return fl.slab(grid(spark, sf), "temp", BOX, AT, 490.0)


@query(SLAB_SQL + f"SELECT row_number() OVER (ORDER BY k_idx, j, i) - 1 AS place, round(temp, 4) AS value FROM g WHERE {BOX_SQL}")
def f6_row_major(spark, sf):
    return fl.row_major(fl.slab(grid(spark, sf), "temp", BOX, AT), "k_idx", "j", "i").select("place", "value")


DAY = date(1996, 1, 2)


@query(f"WITH {LEVELS} SELECT profile_id, n, depth, round(temp, 4) AS temp FROM levels WHERE CAST(time AS DATE) = DATE '1996-01-02'")
def f7_day(spark, sf):
    return pf.on_day(levels(spark, sf), DAY).select("profile_id", "n", "depth", F.round("temp", 4).alias("temp"))


@query(f"WITH {LEVELS} SELECT profile_id, n, depth, round(temp, 4) AS temp FROM levels WHERE wmo = '17'")
def f8_by_platform(spark, sf):
    """No profile has this id, so the platform's profiles are served."""
    lv = levels(spark, sf).withColumn("profile_id", F.concat(F.lit("p"), F.col("profile_id").cast("string")))
    rows = pf.one(lv, "17")
    return rows.select(F.substring("profile_id", 2, 20).cast("long").alias("profile_id"), "n", "depth", F.round("temp", 4).alias("temp"))


SERVED = "count(temp) AS n_temp, count(psal) AS n_psal, concat_ws(',', CASE WHEN count(temp) > 0 THEN 'temp' END, CASE WHEN count(psal) > 0 THEN 'psal' END) AS served"


@query(f"WITH {LEVELS} SELECT profile_id, {SERVED} FROM levels GROUP BY 1")
def f9_served_parameters(spark, sf):
    return pf.served(levels(spark, sf), "profile_id")


@query(f"WITH {LEVELS} SELECT source_id, {SERVED} FROM levels GROUP BY 1")
def a2_parameter_counts(spark, sf):
    return pf.served(levels(spark, sf), "source_id")


@query(f"""WITH {GRID}, {LEVELS}, st AS (SELECT quantile_cont(d, 0.5) AS step FROM (SELECT (epoch_us(lead(time) OVER (ORDER BY time)) - epoch_us(time)) / 1e6::DOUBLE AS d FROM steps WHERE t_idx BETWEEN 3 AND 30)),
r AS (SELECT epoch_us(min(time)) / 1e6::DOUBLE AS lo, epoch_us(max(time)) / 1e6::DOUBLE AS hi FROM steps WHERE t_idx BETWEEN 3 AND 30),
k AS (SELECT l.*, epoch_us(time) / 1e6::DOUBLE BETWEEN lo - step / 2 AND hi + step / 2 OR source_id = 'bgc' AS kept FROM levels l, st, r)
SELECT source_id, count(DISTINCT profile_id) AS n_before, count(DISTINCT CASE WHEN kept THEN profile_id END) AS n_after FROM k GROUP BY 1""")  # fmt: skip
def f10_contemporary(spark, sf):
    s = steps(spark, sf).where("t_idx between 3 and 30")
    ends = s.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    step = axes.median_step(s.select(F.col("t_idx").alias("idx"), F.col("time").alias("node"))).first()["median_step"]
    return pf.window_ledger(pf.contemporary(levels(spark, sf), ends["lo"], ends["hi"], step, ["bgc"]))


@query(f"""WITH {LEVELS} SELECT profile_id, f.wmo, f.time, f.lat, f.lon, n_levels, max_depth FROM (
SELECT profile_id, min({{'depth': depth, 'wmo': wmo, 'time': time, 'lat': lat, 'lon': lon}}) AS f, count(*) AS n_levels, max(depth) AS max_depth FROM levels GROUP BY 1)""")  # fmt: skip
def a1_profile_summary(spark, sf):
    return pf.summaries(levels(spark, sf))


@query(SLAB_SQL + "SELECT k_idx, round(min(temp), 4) AS lo, round(max(temp), 4) AS hi, round(avg(temp), 4) AS mean, count(temp) AS n_valid, count(*) - count(temp) AS n_missing FROM g GROUP BY 1")
def a8_field_summary(spark, sf):
    g = grid(spark, sf)
    return fl.summary(g.where(F.col("t_idx") == fl.snap_time(g, AT)[0]), "temp", "k_idx")


@query(f"WITH {GRID} SELECT t_idx, k_idx, round(avg(rough), 6) AS mean FROM grid GROUP BY 1, 2")
def a9_level_mean(spark, sf):
    return grid(spark, sf).groupBy("t_idx", "k_idx").agg(F.round(F.avg("rough"), 6).alias("mean"))


@query(f"WITH {GRID} SELECT round(quantile_cont(rough, 0.02), 4) AS lo, round(quantile_cont(rough, 0.98), 4) AS hi FROM grid")
def a10_robust_range(spark, sf):
    return fl.robust_range(grid(spark, sf), "rough").select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(f"""WITH {GRID}, v AS (SELECT rough AS v, row_number() OVER (ORDER BY rough) - 1 AS r, count(*) OVER () AS n FROM grid WHERE rough IS NOT NULL)
SELECT round(max(v) FILTER (r = floor((n - 1) * 0.02::DOUBLE)), 4) AS lo, round(max(v) FILTER (r = floor((n - 1) * 0.98::DOUBLE)), 4) AS hi FROM v""")  # fmt: skip
def a11_floor_range(spark, sf):
    return fl.floor_range(grid(spark, sf), "rough").select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(f"WITH {LEVELS} SELECT source_id, count(DISTINCT profile_id) AS n_profiles, count(DISTINCT wmo) AS n_platforms FROM levels GROUP BY 1")
def a12_instrument_census(spark, sf):
    return pf.census(levels(spark, sf), "source_id")


@query(f"WITH {LEVELS}, c AS (SELECT source_id, count(DISTINCT profile_id) AS n_profiles FROM levels GROUP BY 1) SELECT source_id, n_profiles, row_number() OVER (ORDER BY n_profiles DESC, source_id) AS place FROM c")
def o5_classes_by_count(spark, sf):
    c = pf.census(levels(spark, sf), "source_id")
    return c.select("source_id", "n_profiles", F.row_number().over(W.orderBy(F.desc("n_profiles"), "source_id")).cast("long").alias("place"))


@query(f"WITH {LEVELS} SELECT wmo, max(profile_id) AS profile_id FROM levels GROUP BY 1")
def o3_latest_profile(spark, sf):
    return pf.latest(levels(spark, sf))


@query(f"WITH {LEVELS} SELECT source_id, count(DISTINCT profile_id) AS n_profiles, count(*) AS n_levels, count(DISTINCT wmo) AS n_platforms, count(temp) AS n_temp, count(psal) AS n_psal FROM levels GROUP BY 1")
def a15_ingest_counts(spark, sf):
    return levels(spark, sf).groupBy("source_id").agg(F.countDistinct("profile_id").alias("n_profiles"), F.count(F.lit(1)).alias("n_levels"), F.countDistinct("wmo").alias("n_platforms"), F.count("temp").alias("n_temp"), F.count("psal").alias("n_psal"))


@query(f"""WITH {GRID} SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, min(depth) AS top, max(depth) AS bottom, count(DISTINCT time) AS n_times, 'temp,sal,uo,vo' AS variables FROM grid""")
def a22_catalog(spark, sf):
    return fl.catalog(grid(spark, sf), ["temp", "sal", "uo", "vo"])


@query(f"WITH {GRID} SELECT min(lat) - 0.5::DOUBLE AS south, max(lat) + 0.5::DOUBLE AS north, min(lon) - 0.5::DOUBLE AS west, max(lon) + 0.5::DOUBLE AS east FROM grid")
def a23_extents(spark, sf):
    return fl.extents(grid(spark, sf)).select("south", "north", "west", "east")


@query(f"WITH {GRID} SELECT t_idx AS idx, (epoch_us(lead(time) OVER (ORDER BY t_idx)) - epoch_us(time)) / 1e6::DOUBLE AS step FROM steps")
def w9_axis_steps(spark, sf):
    return axes.steps(steps(spark, sf).select(F.col("t_idx").alias("idx"), F.col("time").alias("node"))).select("idx", "step")


@query(f"WITH {LEVELS} SELECT DISTINCT CAST(time AS DATE) AS day, abs(date_diff('day', DATE '1996-01-02', CAST(time AS DATE))) AS gap FROM levels")
def w12_day_gaps(spark, sf):
    return pf.day_gaps(levels(spark, sf), DAY).select("day", F.col("gap").cast("long").alias("gap"))


@query(f"WITH {GRID} SELECT time, depth, lat, lon, round(temp, 4) AS temp, round(sal, 4) AS sal FROM grid WHERE {BOX_SQL} AND depth BETWEEN 100 AND 400 AND time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-01'")
def s24_range_subset(spark, sf):
    rows = fl.subset(grid(spark, sf), ["temp", "sal"], BOX, (100.0, 400.0), (datetime(1996, 1, 1), datetime(1996, 6, 1)))
    return rows.withColumns({"temp": F.round("temp", 4), "sal": F.round("sal", 4)})


@query(f"""WITH {LEVELS}, c AS (SELECT *, 'P' || CAST(profile_id % 4 AS VARCHAR) || CASE WHEN profile_id % 3 = 0 THEN '' ELSE 'x' END AS platform, CASE WHEN n % 5 = 0 THEN NULL ELSE source_id END AS rec FROM levels)
SELECT coalesce(rec, CASE WHEN NOT regexp_matches(platform, '^[0-9]+$') THEN CASE WHEN platform LIKE 'P1%' THEN 'mooring' WHEN platform LIKE 'P2%' THEN 'glider' END END, 'core') AS source, count(*) AS n FROM c GROUP BY 1""")  # fmt: skip
def j8_provenance(spark, sf):
    lv = levels(spark, sf)
    platform = F.concat(F.lit("P"), (F.col("profile_id") % 4).cast("string"), F.when(F.col("profile_id") % 3 == 0, "").otherwise("x"))
    src = pf.source_of(F.when(F.col("n") % 5 != 0, F.col("source_id")), platform, {"P1": "mooring", "P2": "glider"}, "core")
    return lv.select(src.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEVELS}, k(source_id, kind, instrument_class, archive) AS (VALUES ('core', 'float', NULL, false), ('bgc', 'float', 'biofloat', true))
SELECT l.profile_id, l.n, coalesce(instrument_class, kind) AS class, archive FROM levels l LEFT JOIN k USING (source_id)""")  # fmt: skip
def j11_class_attach(spark, sf):
    k = spark.createDataFrame([("core", "float", None, False), ("bgc", "float", "biofloat", True)], "source_id string, kind string, instrument_class string, archive boolean")
    return levels(spark, sf).join(F.broadcast(k), "source_id", "left").select("profile_id", "n", F.coalesce("instrument_class", "kind").alias("class"), "archive")


@query(f"WITH {LEVELS} SELECT CAST(time AS DATE) AS day, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS citations FROM levels GROUP BY 1")
def j15_citations(spark, sf):
    return levels(spark, sf).groupBy(F.to_date("time").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("citations"))


@query(f"WITH {LEVELS} SELECT DISTINCT wmo, source_id FROM levels")
def u3_distinct_stations(spark, sf):
    return levels(spark, sf).select("wmo", "source_id").dropDuplicates()


@query(f"""WITH {LEVELS} SELECT profile_id, n, depth, temp_qc, NULL::DOUBLE AS doxy, 'a' AS part FROM levels WHERE source_id = 'core'
UNION ALL SELECT profile_id, n, depth, NULL, round(depth / 10.0::DOUBLE, 4), 'b' FROM levels WHERE source_id = 'bgc'""")  # fmt: skip
def u1_union_by_name(spark, sf):
    lv = levels(spark, sf)
    a = lv.where("source_id = 'core'").select("profile_id", "n", "depth", "temp_qc", F.lit("a").alias("part"))
    b = lv.where("source_id = 'bgc'").select("profile_id", "n", "depth", F.round(F.col("depth") / 10.0, 4).alias("doxy"), F.lit("b").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {LEVELS} SELECT profile_id, n, depth, row_number() OVER (PARTITION BY profile_id ORDER BY depth, n, source_id, temp_qc, temp, psal_qc, psal) AS place FROM levels")
def o2_profile_order(spark, sf):
    w = W.partitionBy("profile_id").orderBy("depth", "n", "source_id", F.col("temp_qc").asc_nulls_last(), F.col("temp").asc_nulls_last(), "psal_qc", F.col("psal").asc_nulls_last())
    return levels(spark, sf).select("profile_id", "n", "depth", F.row_number().over(w).cast("long").alias("place"))


# ---- columns, vectors, raster, mesh ----------------------------------------------------------------------------------

D26_SQL = f"""WITH {GRID}, p AS (SELECT *, lead(temp) OVER w AS v2, lead(depth) OVER w AS z2 FROM grid WINDOW w AS (PARTITION BY t_idx, j, i ORDER BY k_idx)),
x AS (SELECT t_idx, j, i, count(temp) AS n_wet, count(*) FILTER (temp >= 26 AND v2 < 26) AS n_crossings, arg_min(depth + (temp - 26) / (temp - v2) * (z2 - depth), k_idx) FILTER (temp >= 26 AND v2 < 26) AS depth FROM p GROUP BY ALL)
"""


@query(D26_SQL + "SELECT t_idx, j, i, round(depth, 4) AS depth, n_crossings FROM x")
def w1_isotherm_depth(spark, sf):
    return cc.isotherm_depth(grid(spark, sf)).select("t_idx", "j", "i", F.round("depth", 4).alias("depth"), "n_crossings")


@query(D26_SQL + "SELECT count(*) AS n_columns, count(*) FILTER (n_wet > 0) AS n_wet, count(*) FILTER (n_crossings > 0) AS n_crossing, count(*) FILTER (n_crossings > 1) AS n_multiple FROM x")
def a16_crossing_census(spark, sf):
    return cc.crossing_census(grid(spark, sf))


INV_SQL = f"""WITH {GRID}, p AS (SELECT t_idx, j, i, k_idx, depth AS z, rough AS v, lead(rough) OVER w AS v2, lead(depth) OVER w AS z2 FROM grid WINDOW w AS (PARTITION BY t_idx, j, i ORDER BY k_idx)),
d AS (SELECT *, v - v2 AS deficit FROM p WHERE v IS NOT NULL AND v2 IS NOT NULL),
u AS (SELECT t_idx, j, i, max(CAST(deficit > 0 AS INTEGER)) AS u, max(CAST(deficit > 0 AND z >= 50 AS INTEGER)) AS deep, max(deficit) FILTER (deficit > 0) AS most, min(z) FILTER (deficit > 0) AS top, max(z2) FILTER (deficit > 0) AS bottom FROM d GROUP BY ALL),
wet AS (SELECT DISTINCT t_idx, j, i FROM grid WHERE rough IS NOT NULL)
"""


@query(INV_SQL + "SELECT t_idx, j, i, k_idx, round(deficit, 4) AS deficit FROM d WHERE deficit > 0")
def w2_inversions(spark, sf):
    return cc.inversions(grid(spark, sf), "rough").where("deficit > 0").select("t_idx", "j", "i", "k_idx", F.round("deficit", 4).alias("deficit"))


@query(INV_SQL + "SELECT count(*) AS n_wet, sum(u) AS n_unstable, sum(deep) AS n_unstable_deep, round(max(most), 4) AS max_inversion, min(top) AS top, max(bottom) AS bottom FROM wet LEFT JOIN u USING (t_idx, j, i)")
def a17_stability_census(spark, sf):
    return cc.stability_census(grid(spark, sf), "rough")


CHANNEL_SQL = f"""WITH {GRID}, m AS (SELECT t_idx, j, i, min({{'v': rough, 'k': k_idx, 'z': depth}}) AS m, min(k_idx) AS k0, max(k_idx) AS k1, count(*) AS n, max(rough) AS most FROM grid WHERE rough IS NOT NULL GROUP BY ALL),
c AS (SELECT t_idx, j, i, m.k AS k_axis, m.z AS z_axis, m.v AS v_axis, most, n, m.k > k0 AND m.k < k1 AND n >= 3 AS is_channel FROM m)
"""


@query(CHANNEL_SQL + "SELECT t_idx, j, i, k_axis, z_axis, round(v_axis, 4) AS v_axis, is_channel FROM c")
def w3_channel_axis(spark, sf):
    return cc.channel_axis(grid(spark, sf), "rough").select("t_idx", "j", "i", "k_axis", "z_axis", F.round("v_axis", 4).alias("v_axis"), "is_channel")


@query(CHANNEL_SQL + """SELECT count(*) AS n_wet, count(*) FILTER (is_channel) AS n_channel, round(quantile_cont(z_axis, 0.5) FILTER (is_channel), 4) AS median_axis, min(z_axis) FILTER (is_channel) AS min_axis,
max(z_axis) FILTER (is_channel) AS max_axis, round(min(v_axis) FILTER (is_channel), 4) AS min_axis_value, round(min(v_axis), 4) AS lo, round(max(most), 4) AS hi FROM c WHERE n >= 3""")  # fmt: skip
def a18_channel_census(spark, sf):
    return cc.channel_census(grid(spark, sf), "rough")


BLOCK_SQL = f"""WITH {GRID}, b AS (SELECT t_idx, k_idx, j // 3 AS bj, i // 3 AS bi, avg(lat) AS lat, avg(lon) AS lon, avg(uo) FILTER (uo IS NOT NULL AND vo IS NOT NULL) AS u, avg(vo) FILTER (uo IS NOT NULL AND vo IS NOT NULL) AS v,
count(*) FILTER (uo IS NOT NULL AND vo IS NOT NULL) AS n, count(*) AS cells FROM grid GROUP BY ALL), r AS (SELECT *, CASE WHEN n = 0 OR n < 0.5::DOUBLE * cells THEN 'mostly_dry' END AS reason FROM b)
"""


@query(BLOCK_SQL + """SELECT t_idx, k_idx, bj, bi, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN reason IS NULL THEN round(u, 4) END AS u, CASE WHEN reason IS NULL THEN round(v, 4) END AS v,
CASE WHEN reason IS NULL THEN round(sqrt(u*u + v*v), 4) END AS speed, n, cells, reason FROM r""")  # fmt: skip
def a13_block_mean(spark, sf):
    return ve.block_means(grid(spark, sf), ve.stride_for(25, 5, 14))


@query(BLOCK_SQL + "SELECT coalesce(reason, 'served') AS reason, count(*) AS n, sum(cells) AS cells FROM r GROUP BY 1")
def a13_block_ledger(spark, sf):
    return ve.block_means(grid(spark, sf), 3).groupBy(F.coalesce("reason", F.lit("served")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("cells").alias("cells"))


@query(f"WITH {GRID} SELECT t_idx, k_idx, j, i, round(sqrt(uo*uo + vo*vo), 4) AS speed FROM grid")
def x6_speed(spark, sf):
    return grid(spark, sf).select("t_idx", "k_idx", "j", "i", ocean.speed(F.col("uo"), F.col("vo")).alias("speed"))


SAMPLE_SQL = f"""WITH {GRID}, px AS (SELECT r AS row, c AS col, 14.0::DOUBLE - (r + 0.5::DOUBLE) * (16.0::DOUBLE / 64) AS lat, -1.0::DOUBLE + (c + 0.5::DOUBLE) * (6.0::DOUBLE / 48) AS lon FROM range(64) a(r), range(48) b(c)),
sl AS (SELECT * FROM grid WHERE t_idx = 2 AND k_idx = 4), s AS (SELECT row, col, sl.temp AS value FROM px LEFT JOIN sl ON px.lat >= sl.lat - 0.5::DOUBLE AND px.lat < sl.lat + 0.5::DOUBLE AND px.lon >= sl.lon - 0.5::DOUBLE AND px.lon < sl.lon + 0.5::DOUBLE)
"""
WINDOW = (-1.0, -2.0, 5.0, 14.0)


@query(SAMPLE_SQL + "SELECT row, col, round(value, 4) AS value FROM s")
def j14_raster_sample(spark, sf):
    cells = grid(spark, sf, "t_idx = 2").where("k_idx = 4")
    return ra.sampled(cells, "temp", WINDOW, 48, 64).withColumn("value", F.round("value", 4))


@query(SAMPLE_SQL + """, q AS (SELECT quantile_cont(temp, 0.02) AS lo, quantile_cont(temp, 0.98) AS hi FROM sl), t AS (SELECT row, col, value, CASE WHEN value IS NOT NULL THEN greatest(0, least(1, (value - lo) / (hi - lo))) END AS t FROM s, q)
SELECT row, col, round(value, 4) AS value, coalesce(CAST(round_even(t * 255, 0) AS INTEGER), -1) AS idx FROM t""")  # fmt: skip
def x11_colour_index(spark, sf):
    cells = grid(spark, sf, "t_idx = 2").where("k_idx = 4")
    px = ra.sampled(cells, "temp", WINDOW, 48, 64).join(F.broadcast(fl.robust_range(cells, "temp")))
    idx = F.when(F.col("value").isNotNull(), ra.colour_index(ra.position(F.col("value"), F.col("lo"), F.col("hi"))))
    return px.select("row", "col", F.round("value", 4).alias("value"), F.coalesce(idx, F.lit(-1)).alias("idx"))


@query(SAMPLE_SQL + """, q AS (SELECT quantile_cont(temp, 0.02) AS lo, quantile_cont(temp, 0.98) AS hi FROM sl), t AS (SELECT row, col, value, CASE WHEN value IS NOT NULL THEN round_even(greatest(0, least(1, (value - lo) / (hi - lo))) * 255, 0) END AS g FROM s, q)
SELECT row, col, round(value, 4) AS value, CAST(coalesce(g, 0) AS INTEGER) AS r, CAST(coalesce(g, 0) AS INTEGER) AS g, CAST(coalesce(g, 0) AS INTEGER) AS b, CASE WHEN g IS NULL THEN 0 ELSE 255 END AS a FROM t""")  # fmt: skip
def g6_tile(spark, sf):
    return ra.tile(grid(spark, sf, "t_idx = 2").where("k_idx = 4"), "temp", WINDOW, 48, 64, "grey")


@query(f"WITH {GRID} SELECT t_idx, k_idx, j, i, round(greatest(0, least(1, (log10(CASE WHEN rough > 0 THEN rough ELSE 0.5::DOUBLE END) - log10(0.5::DOUBLE)) / (log10(40.0::DOUBLE) - log10(0.5::DOUBLE)))), 4) AS place FROM grid WHERE rough IS NOT NULL")
def x10_log_position(spark, sf):
    g = grid(spark, sf).where("rough is not null")
    return g.select("t_idx", "k_idx", "j", "i", F.round(ra.position(F.col("rough"), F.lit(0.5), F.lit(40.0), log=True), 4).alias("place"))


CELL_SQL = f"""WITH {GRID}, g AS (SELECT t_idx, k_idx, j, i, rough AS v FROM grid),
n AS (SELECT t_idx, k_idx - dk AS k_idx, j - dj AS j, i - di AS i, 4*dk + 2*dj + di AS c, v FROM g, range(2) a(dk), range(2) b(dj), range(2) d(di)),
c AS (SELECT t_idx, k_idx, j, i, count(v) AS valid, coalesce(sum(CASE WHEN v >= 20 THEN 1 << c ELSE 0 END), 0) AS mask, count(*) FILTER (v >= 20) AS n_in, count(*) FILTER (v < 20) AS n_out, count(*) FILTER (v = 20) AS ties FROM n GROUP BY ALL HAVING count(*) = 8)
"""


@query(CELL_SQL + "SELECT t_idx, k_idx, j, i, valid, CAST(mask AS INTEGER) AS mask, ties, valid = 8 AND n_in > 0 AND n_out > 0 AS active FROM c")
def g1_cells(spark, sf):
    return ms.cells(grid(spark, sf), "rough", 20.0, ("t_idx",)).select("t_idx", "k_idx", "j", "i", "valid", "mask", "ties", "active")


FACES_SQL = ", ".join(f"({n}, {r})" for n, r in enumerate(([0, 1, 3, 2], [4, 5, 7, 6], [0, 1, 5, 4], [2, 3, 7, 6], [0, 2, 6, 4], [1, 3, 7, 5])))


@query(CELL_SQL + f""", act AS (SELECT t_idx, k_idx, j, i, CAST(mask AS INTEGER) AS mask FROM c WHERE valid = 8 AND n_in > 0 AND n_out > 0), faces(f, r) AS (VALUES {FACES_SQL}),
amb AS (SELECT t_idx, count(*) AS n FROM (SELECT DISTINCT t_idx, k_idx, j, i FROM act, faces WHERE (mask >> r[1]) & 1 = (mask >> r[3]) & 1 AND (mask >> r[2]) & 1 = (mask >> r[4]) & 1 AND (mask >> r[1]) & 1 <> (mask >> r[2]) & 1) GROUP BY 1)
SELECT t_idx, count(*) AS n_cells, count(*) FILTER (valid = 8 AND n_in > 0 AND n_out > 0) AS n_active, count(*) FILTER (valid < 8) AS n_skipped,
count(*) FILTER (valid < 8 AND n_in > 0 AND n_out > 0) AS n_masked_straddle, count(*) FILTER (valid = 8 AND ties > 0) AS n_tied, count(*) FILTER (valid = 8 AND NOT (n_in > 0 AND n_out > 0)) AS n_uncrossed,
coalesce(any_value(amb.n), 0) AS n_ambiguous FROM c LEFT JOIN amb USING (t_idx) GROUP BY t_idx""")  # fmt: skip
def a20_cell_accounting(spark, sf):
    return ms.accounting(ms.cells(grid(spark, sf), "rough", 20.0, ("t_idx",)), ("t_idx",))


@query()
def a20_mesh_counts(spark, sf):
    """Per step what the mesh holds beside its cells: vertices, triangles, culled ones, depth range, thickest bracket."""
    return ms.mesh_counts(grid(spark, sf), "rough", 20.0, ("t_idx",))


@query(f"""WITH {GRID}, g AS (SELECT * FROM grid), e AS (
SELECT t_idx, k_idx, j, i, 0 AS axis, rough AS v, lead(rough) OVER (PARTITION BY t_idx, j, i ORDER BY k_idx) AS v2, depth AS base, 40.0::DOUBLE AS step FROM g UNION ALL
SELECT t_idx, k_idx, j, i, 1, rough, lead(rough) OVER (PARTITION BY t_idx, k_idx, i ORDER BY j), lat, 1.0 FROM g UNION ALL
SELECT t_idx, k_idx, j, i, 2, rough, lead(rough) OVER (PARTITION BY t_idx, k_idx, j ORDER BY i), lon, 1.0 FROM g)
SELECT t_idx, k_idx, j, i, axis, round(base + (20 - v) / (v2 - v) * step, 4) AS place FROM e WHERE (v >= 20 AND v2 < 20) OR (v < 20 AND v2 >= 20)""")  # fmt: skip
def g2_crossings(spark, sf):
    """All crossed edges; with lat, lon or depth where the surface passes."""
    one = ms.crossings(grid(spark, sf), "rough", 20.0, by=("t_idx",))
    place = F.when(F.col("axis") == 0, F.col("depth")).when(F.col("axis") == 1, F.col("lat")).otherwise(F.col("lon"))
    return one.select("t_idx", "k_idx", "j", "i", "axis", F.round(place, 4).alias("place"))


@query(CELL_SQL + """, own AS (SELECT t_idx, k_idx + ok AS k_idx, j + oj AS j, i + oi AS i, axis FROM c, (SELECT a.k AS ok, b.j AS oj, d.i AS oi, axis FROM range(2) a(k), range(2) b(j), range(2) d(i), range(3) x(axis) WHERE (axis = 0 AND a.k = 0) OR (axis = 1 AND b.j = 0) OR (axis = 2 AND d.i = 0)) WHERE valid = 8 AND n_in > 0 AND n_out > 0),
n2 AS (SELECT t_idx, k_idx, j, i, v, lead(v) OVER (PARTITION BY t_idx, j, i ORDER BY k_idx) AS a0, lead(v) OVER (PARTITION BY t_idx, k_idx, i ORDER BY j) AS a1, lead(v) OVER (PARTITION BY t_idx, k_idx, j ORDER BY i) AS a2 FROM g),
e AS (SELECT t_idx, k_idx, j, i, axis FROM (SELECT *, CASE axis WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS v2 FROM n2, range(3) x(axis)) WHERE (v >= 20 AND v2 < 20) OR (v < 20 AND v2 >= 20))
SELECT t_idx, count(*) AS n_vertices FROM (SELECT DISTINCT t_idx, k_idx, j, i, axis FROM own JOIN e USING (t_idx, k_idx, j, i, axis)) GROUP BY 1""")  # fmt: skip
def g2_active_vertices(spark, sf):
    """Crossed edges of at least one active cell, once each however many cells share them."""
    g = grid(spark, sf)
    active = ms.cells(g, "rough", 20.0, ("t_idx",)).where("active")
    return ms.crossings(g, "rough", 20.0, active, ("t_idx",)).groupBy("t_idx").agg(F.count(F.lit(1)).alias("n_vertices"))


@query()
def g3_triangles(spark, sf):
    return ms.triangles(grid(spark, sf), "rough", 20.0, ("t_idx",))[1]


@query()
def a26_boundary_edges(spark, sf):
    return ms.boundary_edges(ms.triangles(grid(spark, sf), "rough", 20.0, ("t_idx",))[1])


@query()
def g4_mesh_components(spark, sf):
    labels = ms.mesh_components(ms.triangles(grid(spark, sf), "temp", 15.0, ("t_idx",))[1])
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_vertices"))
