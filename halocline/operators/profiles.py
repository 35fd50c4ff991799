"""Profiles of measured levels: selection, summaries, provenance."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .axes import seconds, small

#: Days between the wanted day and the nearest observed one beyond which a day filter is refused.
DAY_SLACK = 10
NOT_MEASURED = ("depth", "pres")


def on_day(levels: DataFrame, day: date, slack: int = DAY_SLACK) -> DataFrame:
    """Levels of one whole day; refused when the nearest observed day is farther than the slack."""
    gap = day_gaps(levels, day).agg(F.min(F.struct("gap", "day")).alias("m")).first()["m"]
    if gap is None or gap["gap"] > slack:
        raise ValueError(f"no profile within {slack} days of {day}" + (f"; the nearest day is {gap['day']}" if gap else ""))
    return levels.where(F.to_date("time") == F.lit(day))


def day_gaps(levels: DataFrame, day: date) -> DataFrame:
    """(day, gap in days) of the distinct observed days."""
    d = levels.select(F.to_date("time").alias("day")).distinct()
    return d.withColumn("gap", F.abs(F.datediff(F.col("day"), F.lit(day))))


def one(levels: DataFrame, wanted: str) -> DataFrame:
    """Levels of the profile with that id, else of the platform, by depth."""
    by_id = levels.where(F.col("profile_id").cast("string") == wanted)
    rows = by_id if by_id.limit(1).count() else levels.where(F.col("wmo") == wanted)
    return rows.orderBy("depth", "profile_id")


def measured(levels: DataFrame) -> list[str]:
    """Parameters: columns with a _qc sibling, but for the vertical ones."""
    return [c for c in levels.columns if f"{c}_qc" in levels.columns and c not in NOT_MEASURED]


def served(levels: DataFrame, *keys: str) -> DataFrame:
    """Per key the count of values of every parameter, and the names of those with any."""
    names = measured(levels)
    counts = [F.count(c).alias(f"n_{c}") for c in names]
    have = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in names])), ",")
    return levels.groupBy(*keys).agg(*counts).withColumn("served", have)


def summaries(levels: DataFrame) -> DataFrame:
    """Per profile: platform, time and position of its shallowest level, number of levels, greatest depth."""
    first = F.min(F.struct("depth", "wmo", "time", "lat", "lon"))
    return levels.groupBy("profile_id").agg(first.alias("f"), F.count(F.lit(1)).alias("n_levels"), F.max("depth").alias("max_depth")).select("profile_id", "f.wmo", "f.time", "f.lat", "f.lon", "n_levels", "max_depth")


def contemporary(levels: DataFrame, lo: datetime, hi: datetime, step_seconds: float | None, archives: list[str]) -> DataFrame:
    """Levels within half a step of the model's range (5 days for one step); archive sources are exempt."""
    half = (step_seconds / 2) if step_seconds else 5 * 86400
    t = seconds(F.col("time"))
    return levels.withColumn("kept", t.between(seconds(F.lit(lo)) - half, seconds(F.lit(hi)) + half) | F.col("source_id").isin(*archives))


def window_ledger(rows: DataFrame) -> DataFrame:
    """Distinct profiles before and after the window, per source."""
    return rows.groupBy("source_id").agg(F.countDistinct("profile_id").alias("n_before"), F.countDistinct(F.when(F.col("kept"), F.col("profile_id"))).alias("n_after"))


def source_of(recorded: Column, platform: Column, prefixes: dict[str, str], default: str) -> Column:
    """The recorded source; else by prefix of a platform that isn't all digits; else the default."""
    by_prefix = F.lit(None).cast("string")
    for prefix, source in sorted(prefixes.items()):
        by_prefix = F.when(~platform.rlike(r"^\d+$") & platform.startswith(prefix), F.lit(source)).otherwise(by_prefix)
    return F.coalesce(recorded, by_prefix, F.lit(default))


def census(levels: DataFrame, kind: str) -> DataFrame:
    """Profiles and platforms per instrument class, most profiles first."""
    return levels.groupBy(kind).agg(F.countDistinct("profile_id").alias("n_profiles"), F.countDistinct("wmo").alias("n_platforms")).orderBy(F.desc("n_profiles"), kind)


def latest(levels: DataFrame) -> DataFrame:
    return levels.groupBy("wmo").agg(F.max("profile_id").alias("profile_id"))


def segments(observed: DataFrame, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """(keys, d0, d1, v0, v1, first): neighbouring depths with a value each, and whether none of the profile lies above."""
    order = W.partitionBy(*keys).orderBy("depth")
    seg = observed.where("temp is not null").groupBy(*keys, "depth").agg(F.min("temp").alias("temp"))
    return seg.select(
        *keys, F.col("depth").alias("d0"), F.lead("depth").over(order).alias("d1"), F.col("temp").alias("v0"), F.lead("temp").over(order).alias("v1"),
        F.lag("depth").over(order).isNull().alias("first"),
    ).where("d0 is not null and d1 is not null")


def at_nodes(seg: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of segments() with the model levels nodes(k_idx, node) they hold, and `observed` there; no extrapolation.

    A level on a shared end is of the segment above, so each stands once a profile without any being compared.
    """
    d0, d1, node = F.col("d0"), F.col("d1"), F.col("node")
    hit = seg.join(small(nodes), (node >= d0) & (node <= d1) & (F.col("first") | (node > d0)))
    value = F.col("v0") + (node - d0) / (d1 - d0) * (F.col("v1") - F.col("v0"))
    return hit.withColumn("observed", value).drop("d0", "d1", "v0", "v1", "first")


def on_levels(observed: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Observations interpolated onto model levels nodes(k_idx, node): the first segment that holds the level, no extrapolation."""
    return at_nodes(segments(observed, keys), nodes).select(*keys, "k_idx", "node", "observed")
