"""Gridded fields as long tables: subsetting, snapping, summaries, extents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from .axes import axis, edges, median_step, seconds
from .ranks import order_statistics, percentiles, placed

#: Cap on exported values, seconds of slack for a one-step time axis.
EXPORT_CAP = 20_000_000
ONE_STEP_SLACK = 10 * 86400


def valid_box(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("box must satisfy -180 <= west < east <= 180 and -90 <= south < north <= 90")
    return west, south, east, north


def in_box(df: DataFrame, box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside the box, all sides closed."""
    w, s, e, n = valid_box(*box)
    return df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def snap_time(field: DataFrame, at: datetime) -> tuple[int, datetime]:
    """(t_idx, time) of the nearest step, the earlier on a tie; refused beyond one median step outside the range."""
    ax = axis(field, "time")
    want = F.lit(at)
    gap = F.abs(seconds(F.col("node")) - seconds(want))
    near = ax.agg(F.min(F.struct(gap.alias("gap"), "idx", "node")).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).first()
    step = median_step(ax).first()["median_step"] or ONE_STEP_SLACK
    if near["n"] is None or (at - near["hi"]).total_seconds() > step or (near["lo"] - at).total_seconds() > step:
        raise ValueError(f"{at} is outside the field's time range")
    return near["n"]["idx"], near["n"]["node"]


def snap_depth(field: DataFrame, depth: float) -> tuple[int, float]:
    """(k_idx, depth) of the nearest level, the shallower on a tie; refused outside the range."""
    near = axis(field, "depth").agg(F.min(F.struct(F.abs(F.col("node") - depth).alias("gap"), "idx", "node")).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).first()
    if near["n"] is None or not near["lo"] - 1e-6 <= depth <= near["hi"] + 1e-6:
        raise ValueError(f"depth {depth} is outside the field's range")
    return near["n"]["idx"], near["n"]["node"]


def slab(field: DataFrame, var: str, box, at: datetime, depth: float | None = None) -> DataFrame:
    """Cells of one step, one level or all: served_time, k_idx, depth, j, lat, i, lon, value rounded to 4 (null if missing)."""
    t, served = snap_time(field, at)
    rows = in_box(field.where(F.col("t_idx") == t), box)
    if depth is not None:
        rows = rows.where(F.col("k_idx") == snap_depth(field, depth)[0])
    if rows.limit(1).count() == 0:
        raise ValueError("the box holds no cell of the field")
    return rows.select(F.lit(served).alias("served_time"), "k_idx", "depth", "j", "lat", "i", "lon", F.round(var, 4).alias("value"))


def row_major(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, from 0, in the order of a flat array over these axes."""
    return placed(rows, [F.col(c) for c in order], "place")


def subset(field: DataFrame, variables: list[str], box, depths: tuple[float, float], times: tuple[datetime, datetime], cap: int = EXPORT_CAP) -> DataFrame:
    """Native cells of a box, depth and time range; refused when an axis is empty or above cap values."""
    rows = in_box(field, box).where(F.col("depth").between(*depths) & F.col("time").between(*times))
    size = rows.count() * len(variables)
    if size == 0:
        raise ValueError("the range holds no cell")
    if size > cap:
        raise ValueError(f"{size} values exceed the cap of {cap}")
    return rows.select("time", "depth", "lat", "lon", *variables)


def summary(rows: DataFrame, var: str, *keys: str) -> DataFrame:
    """min, max, mean, valid and missing counts of a variable, over all rows or per key."""
    v = F.col(var)
    return rows.groupBy(*keys).agg(F.round(F.min(v), 4).alias("lo"), F.round(F.max(v), 4).alias("hi"), F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_missing"))


def robust_range(rows: DataFrame, var: str, pct: float = 2.0) -> DataFrame:
    """(lo, hi): percentiles pct and 100 - pct; equal ones one apart; (0, 1) without values."""
    lo, hi = percentiles(rows, var, [pct / 100, 1 - pct / 100])
    if lo is None or hi is None:
        lo, hi = 0.0, 1.0
    return rows.sparkSession.createDataFrame([(lo, hi if hi != lo else lo + 1)], "lo double, hi double")


def floor_range(rows: DataFrame, var: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Range by the values at places floor((n - 1) * p) of the sorted values; null without values."""
    _, values = order_statistics(rows, var, [(lo, "floor"), (hi, "floor")])
    return rows.sparkSession.createDataFrame([tuple(values)], "lo double, hi double")


def catalog(field: DataFrame, variables: list[str], *keys: str) -> DataFrame:
    """One row per dataset: box, depth range, steps, and the variables that hold any value."""
    present = F.array_compact(F.array(*[F.when(F.count(v) > 0, F.lit(v)) for v in variables]))
    return field.groupBy(*keys).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("depth").alias("top"), F.max("depth").alias("bottom"),
        F.countDistinct("time").alias("n_times"), F.array_join(present, ",").alias("variables"),
    )


def extents(field: DataFrame) -> DataFrame:
    """West, south, east and north of the cells' edges."""
    lat, lon = edges(axis(field, "lat")), edges(axis(field, "lon"))
    a = lat.agg(F.min("lo_edge").alias("south"), F.max("hi_edge").alias("north"))
    b = lon.agg(F.min("lo_edge").alias("west"), F.max("hi_edge").alias("east"))
    return a.join(F.broadcast(b))  # one row each
