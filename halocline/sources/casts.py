"""Glider, ship and mooring casts to level rows, with disclosure counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ocean import depth_of, unmasked
from ..operators import asof
from ..session import written

ACCEPT = (1, 2)
#: Foreign flag vocabulary of the moorings (fixed values); anything else is missing.
MOORING_FLAGS = {0: 9, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
MOORING_FILL = 1.0e35


def descending(rows: DataFrame) -> DataFrame:
    """Of each file the descending leg if any row is of one; else all rows.  Files with such a leg are found by aggregation.

    Their list is written, so its size is known before rows meet it: a short one is sent to the rows, which stay dealt by cast and aren't
    gathered by file.
    """
    has = written(rows.where("direction = 'D'").select(F.col("file").alias("__file")).distinct().withColumn("__has", F.lit(True)), "descending")
    both = rows.join(has, F.col("file").eqNullSafe(F.col("__file")), "left")
    return both.where(F.col("__has").isNull() | (F.col("direction") == "D")).drop("__has", "__file")


def cast_levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(file, cast, pos, lat, lon, time, direction, pres, pres_qc, temp, temp_qc, psal, psal_qc): (levels, counters per file).

    A bad pressure flag spoils every parameter (flag 4); a missing flag is 9; of repeated depths the first stays.
    """
    d = descending(rows)
    own = W.partitionBy("file", "cast")
    d = d.withColumn("depth", depth_of(F.col("pres"), F.col("lat")))
    real = d.where("pres is not null")
    order = own.orderBy("pos")
    marked = real.withColumn("__back", F.coalesce(F.col("depth") <= F.lag("depth").over(order), F.lit(False)))
    marked = marked.withColumn("__nth", F.row_number().over(W.partitionBy("file", "cast", "depth").orderBy("pos")))
    bad = F.coalesce(~F.col("pres_qc").isin(*ACCEPT), F.lit(False))
    flags = {f"{p}_qc": F.when(bad, 4).otherwise(F.coalesce(F.col(f"{p}_qc"), F.lit(9))).cast("short") for p in ("temp", "psal")}
    levels = marked.where("__nth = 1").withColumns(flags)
    per = marked.groupBy("file", "cast").agg(F.max("__back").alias("back"), F.count_if(F.col("__nth") > 1).alias("dup"), (F.max("pos") - F.min("pos") + 1 - F.count(F.lit(1))).alias("gap"), F.count_if(bad).alias("spoilt"), F.count(F.lit(1)).alias("n"))
    counters = per.groupBy("file").agg(F.count(F.lit(1)).alias("n_casts"), F.sum("gap").alias("n_gaps"), F.count_if("back").alias("n_resorted"), F.sum("dup").alias("n_repeated"), F.sum("spoilt").alias("n_bad_pressure"), F.sum("n").alias("n_rows"))
    return levels.drop("__back", "__nth"), counters


def class_mismatches(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Files(file, source_id, detected) whose own instrument class isn't the one declared(source_id, instrument_class) for their
    source, with both; a class that either side leaves open disagrees with none.  A source has one declared row."""
    both = files.join(declared, "source_id")
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return both.where(named("detected") & named("instrument_class") & (F.col("detected") != F.col("instrument_class"))).select("file", "source_id", F.col("instrument_class").alias("declared"), "detected")


def profile_rows(levels: DataFrame, accept: tuple[int, ...] = ACCEPT) -> DataFrame:
    """Rows with a depth and an accepted temperature; salinity is masked by its own flag."""
    good = levels.where(F.col("depth").isNotNull() & F.col("temp").isNotNull() & F.col("temp_qc").isin(*accept))
    return good.withColumn("psal", F.when(F.col("psal_qc").isin(*accept), F.col("psal")))


def pooled(counters: DataFrame) -> DataFrame:
    """Counters of all files of a source added up."""
    return counters.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in counters.columns if c.startswith("n_")])


def mooring_levels(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(file, station, code, time, depth, lat, lon, temp, qc): (levels, refused files).

    Fills are masked in value and depth, flags translated, rows without depth dropped; a file whose position moves is refused.
    """
    flag = F.create_map(*[F.lit(x) for kv in MOORING_FLAGS.items() for x in kv])
    r = rows.withColumns({"temp": unmasked(F.col("temp"), (MOORING_FILL,)), "depth": unmasked(F.col("depth"), (MOORING_FILL,)), "temp_qc": F.coalesce(F.try_element_at(flag, F.col("qc").cast("int")), F.lit(9)).cast("short"), "wmo": F.col("code").cast("long").cast("string")})
    moving = rows.groupBy("file").agg(F.countDistinct(F.round("lat", 4), F.round("lon", 4)).alias("n_positions")).where("n_positions > 1")
    return r.where("depth is not null").join(moving.select("file"), "file", "left_anti").drop("qc", "code"), moving


def nearest_days(rows: DataFrame, step_axis: DataFrame) -> DataFrame:
    """Per station and model step the reported day nearest to it (the earlier on a tie), each day once; pressure stays null.

    A day is the nearest for the times from halfway to the station's day before (not included) to halfway to the next, so it stays if the
    last step up to there lies in between: one as-of join of days with steps, whatever the number of either.
    """
    at = F.unix_seconds(F.col("time").cast("timestamp")).cast("double")
    order = W.partitionBy("station").orderBy("time")
    days = rows.select("station", "time").distinct().withColumns({"low": (at + F.lag(at).over(order)) / 2, "high": F.coalesce((at + F.lead(at).over(order)) / 2, F.lit(1e300))})
    steps = step_axis.select(F.unix_seconds(F.col("node").cast("timestamp")).alias("step"))
    met = asof.neighbours(days, steps, F.col("high"), F.col("step"))
    picked = met.where("before is not null and (low is null or before.at > low)").select("station", "time")
    return rows.join(picked, ["station", "time"], "left_semi").withColumn("pres", F.lit(None).cast("double"))
