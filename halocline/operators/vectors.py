"""Thinning of vector fields by block means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Most blocks on a screen, least share of wet cells in a block.
BUDGET, MIN_WET = 600, 0.5


def stride_for(ny: int, nx: int, budget: int = BUDGET) -> int:
    """The smallest stride whose whole blocks fit the budget."""
    if min(ny, nx, budget) <= 0:
        return 1
    return next((s for s in range(1, max(ny, nx) + 1) if (ny // s) * (nx // s) <= budget), max(ny, nx) + 1)


def block_means(field: DataFrame, stride: int, u: str = "uo", v: str = "vo", keys: tuple[str, ...] = ("t_idx", "k_idx"), min_wet: float = MIN_WET) -> DataFrame:
    """Per block of stride x stride cells: centre, mean components, speed, n wet cells and reason (null if served).

    A cell is wet only with both components.  The centre is the mean of the block's axis nodes, so dry cells count.
    """
    wet = F.col(u).isNotNull() & F.col(v).isNotNull()
    b = field.groupBy(*keys, F.floor(F.col("j") / stride).alias("bj"), F.floor(F.col("i") / stride).alias("bi")).agg(
        F.sum("lat").alias("sl"), F.sum("lon").alias("so"),
        F.avg(F.when(wet, F.col(u))).alias("u"), F.avg(F.when(wet, F.col(v))).alias("v"), F.count_if(wet).alias("n"), F.count(F.lit(1)).alias("cells"),
    )
    reason = F.when((F.col("n") == 0) | (F.col("n") < min_wet * F.col("cells")), F.lit("mostly_dry"))
    served = reason.isNull()
    return b.select(
        *keys, "bj", "bi", F.round(F.col("sl") / F.col("cells"), 4).alias("lat"), F.round(F.col("so") / F.col("cells"), 4).alias("lon"), F.when(served, F.round("u", 4)).alias("u"),
        F.when(served, F.round("v", 4)).alias("v"), F.when(served, F.round(F.hypot("u", "v"), 4)).alias("speed"), "n", "cells", reason.alias("reason"),
    )
