"""Nested float profiles to level rows: adjusted values, own flags, units, quality masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ocean import depth_of, profile_name, qc_code
from ..session import per_file

ACCEPT = (1, 2)
MISSING = 9
#: Spellings that mean the same: of practical salinity, and of no dimension (fixed values, lower case without blanks, dashes and underscores).
SAME_UNITS = ({"psu", "1", "pss78", "practicalsalinityunits"}, {"dimensionless", "1", ""})


def adjusted(files: DataFrame, params: list[str]) -> DataFrame:
    """files(file, profiles...) one row per profile with arrays p, p_qc, p_adjusted, p_adjusted_qc: the array to use.

    A parameter's adjusted array is used for a whole file unless all of it is missing; a missing flag array counts as good.
    """
    params = ["pres", *params]
    raw = [p for p in params if f"{p}_adjusted" not in files.columns]
    files = files.withColumns({f"{p}_adjusted{x}": F.lit(None).cast(k) for p in raw for x, k in (("", "array<double>"), ("_qc", "array<string>"))})
    any_adjusted = [F.max(F.exists(F.coalesce(f"{p}_adjusted", F.array().cast("array<double>")), lambda v: v.isNotNull()).cast("int")).alias(f"use_{p}") for p in params]
    use = files.groupBy("file").agg(*any_adjusted)
    rows = per_file(files, use)
    for p in params:
        better = F.col(f"use_{p}") == 1
        vals = F.when(better, F.col(f"{p}_adjusted")).otherwise(F.col(p))
        flags = F.when(better, F.col(f"{p}_adjusted_qc")).otherwise(F.col(f"{p}_qc"))
        rows = rows.withColumns({f"v_{p}": vals, f"f_{p}": F.coalesce(flags, F.transform(vals, lambda _: F.lit("1")))})
    return rows.drop(*[f"use_{p}" for p in params])


def levels(profiles: DataFrame, params: list[str], accept: tuple[int, ...] = ACCEPT) -> DataFrame:
    """Level rows of adjusted() profiles (with platform, time, lat, lon, v_pres, f_pres and v_/f_ per parameter).

    Each parameter is masked by its own flag; a masked value is null and keeps its flag; a level stays if its pressure's
    flag is accepted and any value survives.
    """
    names = ["pres", *params]
    zipped = F.arrays_zip(*[F.col(f"{k}_{n}") for n in names for k in ("v", "f")])
    rows = profiles.select("file", "platform", "time", "lat", "lon", F.posexplode(zipped).alias("n", "z"))
    rows = rows.withColumns({x: F.col(f"z.{x}") for n in names for x in (f"v_{n}", f"f_{n}")}).drop("z")
    rows = rows.withColumns({f"f_{n}": qc_code(F.col(f"f_{n}")) for n in names})
    kept = rows.where(F.col("f_pres").isin(*accept) & F.col("v_pres").isNotNull())
    out = {}
    for p in params:
        good = F.col(f"f_{p}").isin(*accept)
        out |= {p: F.when(good, F.col(f"v_{p}")), f"{p}_qc": F.when(F.col(f"v_{p}").isNull() & good, MISSING).otherwise(F.col(f"f_{p}")).cast("short")}
    kept = kept.withColumns(out).where(F.coalesce(*params).isNotNull())
    return kept.select(profile_name(F.col("platform"), F.col("time")).alias("profile_id"), F.col("platform").alias("wmo"), "time", "lat", "lon", F.col("v_pres").alias("pres"), depth_of(F.col("v_pres"), F.col("lat")).alias("depth"), *out)


def juld(days: Column) -> Column:
    """Timestamp of days since 1950-01-01, to the second."""
    return F.timestamp_seconds(F.round(days * 86400).cast("long") - 631152000)


def squashed(unit: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), "[ _-]", "")


def unit_mismatches(declared: DataFrame, found: DataFrame) -> DataFrame:
    """declared(param, unit) against found(file, param, unit): rows that disagree beyond spelling."""
    a, b = squashed(F.col("want")), squashed(F.col("have"))
    same = a == b
    for group in SAME_UNITS:
        same = same | (a.isin(*sorted(group)) & b.isin(*sorted(group)))
    both = found.withColumnRenamed("unit", "have").join(F.broadcast(declared.withColumnRenamed("unit", "want")), "param")
    return both.where(~same).select("file", "param", "want", "have")


def platforms(index: DataFrame, box: tuple[float, float, float, float], centres: dict[str, str]) -> DataFrame:
    """index(wmo, kind, lat, lon, centre, seq) of files: biogeochemical platforms inside the box, last entry wins, centre mapped to its directory."""
    w, s, e, n = box
    hit = index.where(F.contains("kind", F.lit("BGC")) & F.col("lat").between(s, n) & F.col("lon").between(w, e))
    last = hit.groupBy("wmo").agg(F.max_by("centre", "seq").alias("centre"))
    known = last.sparkSession.createDataFrame(sorted(centres.items()), "centre string, directory string")
    return last.join(F.broadcast(known), "centre").select("wmo", "directory")
