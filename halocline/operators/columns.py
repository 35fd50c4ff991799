"""Diagnostics of water columns, and censuses of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

COLUMN = ("t_idx", "j", "i")
#: Isotherm in degC, depth that parts surface from interior, least levels of a channel.
ISOTHERM, SURFACE, CHANNEL_LEVELS = 26.0, 50.0, 3


def pairs(field: DataFrame, var: str) -> DataFrame:
    """Vertically adjacent levels: v, z and the next level's v2, z2 (null unless it's the very next)."""
    order = W.partitionBy(*COLUMN).orderBy("k_idx")
    nxt = lambda c: F.when(F.lead("k_idx").over(order) == F.col("k_idx") + 1, F.lead(c).over(order))
    return field.select(*COLUMN, "lat", "lon", "k_idx", F.col("depth").alias("z"), F.col(var).alias("v"), nxt("depth").alias("z2"), nxt(var).alias("v2"))


def isotherm_depth(field: DataFrame, var: str = "temp", threshold: float = ISOTHERM) -> DataFrame:
    """Per column the shallowest depth where the value falls below the threshold; null where it doesn't; n_crossings."""
    crossing = (F.col("v") >= threshold) & (F.col("v2") < threshold)
    z = F.col("z") + (F.col("v") - threshold) / (F.col("v") - F.col("v2")) * (F.col("z2") - F.col("z"))
    at = F.min(F.when(crossing, F.struct("k_idx", z.alias("depth"))))
    return pairs(field, var).groupBy(*COLUMN, "lat", "lon").agg(at["depth"].alias("depth"), F.count_if(crossing).alias("n_crossings"), F.count("v").alias("n_wet"))


def crossing_census(field: DataFrame, var: str = "temp", threshold: float = ISOTHERM) -> DataFrame:
    c = isotherm_depth(field, var, threshold)
    return c.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("n_wet") > 0).alias("n_wet"), F.count_if(F.col("n_crossings") > 0).alias("n_crossing"), F.count_if(F.col("n_crossings") > 1).alias("n_multiple"))


def inversions(field: DataFrame, var: str) -> DataFrame:
    """Adjacent present levels whose upper value exceeds the lower: (column, z, z2, deficit)."""
    return pairs(field, var).where(F.col("v").isNotNull() & F.col("v2").isNotNull()).withColumn("deficit", F.col("v") - F.col("v2"))


def stability_census(field: DataFrame, var: str, surface: float = SURFACE) -> DataFrame:
    """Wet columns, unstable ones, those unstable below the surface layer, the largest inversion and its depth range."""
    unstable = F.col("deficit") > 0
    per = inversions(field, var).groupBy(*COLUMN).agg(F.max(unstable.cast("int")).alias("u"), F.max((unstable & (F.col("z") >= surface)).cast("int")).alias("deep"), F.max(F.when(unstable, F.col("deficit"))).alias("most"), F.min(F.when(unstable, F.col("z"))).alias("top"), F.max(F.when(unstable, F.col("z2"))).alias("bottom"))
    wet = field.where(F.col(var).isNotNull()).select(*COLUMN).distinct()
    both = wet.join(per, list(COLUMN), "left")
    return both.agg(F.count(F.lit(1)).alias("n_wet"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_unstable"), F.coalesce(F.sum("deep"), F.lit(0)).alias("n_unstable_deep"), F.round(F.max("most"), 4).alias("max_inversion"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def channel_axis(field: DataFrame, var: str) -> DataFrame:
    """Per column the level of least value (first on a tie); a channel only strictly between the first and last present level."""
    v = field.where(F.col(var).isNotNull())
    per = v.groupBy(*COLUMN).agg(F.min(F.struct(F.col(var).alias("v"), "k_idx", "depth")).alias("m"), F.min("k_idx").alias("k_first"), F.max("k_idx").alias("k_last"), F.count(F.lit(1)).alias("n"), F.max(var).alias("most"))
    k = F.col("m.k_idx")
    return per.select(*COLUMN, k.alias("k_axis"), F.col("m.depth").alias("z_axis"), F.col("m.v").alias("v_axis"), "most", "n", ((k > F.col("k_first")) & (k < F.col("k_last")) & (F.col("n") >= CHANNEL_LEVELS)).alias("is_channel"))


def channel_census(field: DataFrame, var: str) -> DataFrame:
    c = channel_axis(field, var).where(F.col("n") >= CHANNEL_LEVELS)
    z = F.when(F.col("is_channel"), F.col("z_axis"))
    return c.agg(
        F.count(F.lit(1)).alias("n_wet"), F.count_if("is_channel").alias("n_channel"), F.round(F.percentile(z, 0.5), 4).alias("median_axis"), F.min(z).alias("min_axis"), F.max(z).alias("max_axis"),
        F.round(F.min(F.when(F.col("is_channel"), F.col("v_axis"))), 4).alias("min_axis_value"), F.round(F.min("v_axis"), 4).alias("lo"), F.round(F.max("most"), 4).alias("hi"),
    )
