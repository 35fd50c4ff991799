"""Raster tiles as tables: a pixel takes the value of the native cell that holds its centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .axes import axis, edges, small
from .fields import robust_range, valid_box

#: Most pixels a side, entries of a palette.
MAX_SIDE, LUT = 2048, 256
#: Anchor colours of the palettes that tiles are offered in, from low to high; entries between are interpolated.
ANCHORS = {"ice": ((8, 16, 48), (70, 130, 190), (240, 250, 255)), "ember": ((10, 5, 20), (190, 60, 30), (255, 240, 170)), "grey": ((0, 0, 0), (255, 255, 255))}


def palette(spark: SparkSession, name: str) -> DataFrame:
    """(idx, r, g, b): LUT rows by linear interpolation between the palette's anchors."""
    stops = ANCHORS[name]
    rows = []
    for i in range(LUT):
        x = i / (LUT - 1) * (len(stops) - 1)
        a = min(int(x), len(stops) - 2)
        rows.append((i, *[round(p + (q - p) * (x - a)) for p, q in zip(stops[a], stops[a + 1])]))
    return spark.createDataFrame(rows, "idx int, r int, g int, b int")


def position(value: Column, lo: Column, hi: Column, log: bool = False) -> Column:
    """Place of a value in [0, 1]; on a log scale non-positive values stand at the low end."""
    if log:
        safe = F.when(value > 0, value).otherwise(lo)
        t = (F.log10(safe) - F.log10(lo)) / (F.log10(hi) - F.log10(lo))
    else:
        t = (value - lo) / (hi - lo)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def colour_index(t: Column, reverse: bool = False) -> Column:
    """Half-even rounding of t * 255; null for a missing value."""
    return F.bround((1 - t if reverse else t) * (LUT - 1)).cast("int")


def pixels(spark: SparkSession, box, width: int, height: int) -> DataFrame:
    """(row, col, lat, lon) of every pixel's centre, rows from the north."""
    w, s, e, n = valid_box(*box)
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"a side has 1 to {MAX_SIDE} pixels")
    p = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return p.select("row", "col", (F.lit(n) - (F.col("row") + 0.5) * ((n - s) / height)).alias("lat"), (F.lit(w) + (F.col("col") + 0.5) * ((e - w) / width)).alias("lon"))


def sampled(cells: DataFrame, var: str, box, width: int, height: int) -> DataFrame:
    """(row, col, value) of one slice's cells (j, lat, i, lon, var); outside every cell null."""
    p = pixels(cells.sparkSession, box, width, height)
    for dim, name in (("lat", "j"), ("lon", "i")):
        e = edges(axis(cells, dim)).select(F.col("idx").alias(name), F.col("lo_edge").alias("lo"), F.col("hi_edge").alias("hi"))
        p = p.join(small(e), (F.col(dim) >= F.col("lo")) & (F.col(dim) < F.col("hi")), "left").drop("lo", "hi")
    return p.join(cells.select("j", "i", F.col(var).alias("value")), ["j", "i"], "left").select("row", "col", "value")


def tile(cells: DataFrame, var: str, box, width: int, height: int, name: str = "ice", log: bool = False, reverse: bool = False) -> DataFrame:
    """(row, col, value, r, g, b, a); the colour range comes from the whole slice, not from the window."""
    span = robust_range(cells, var)
    px = sampled(cells, var, box, width, height).join(F.broadcast(span))  # one row
    px = px.withColumn("idx", colour_index(position(F.col("value"), F.col("lo"), F.col("hi"), log), reverse))
    out = px.join(F.broadcast(palette(cells.sparkSession, name)), "idx", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("row", "col", F.round("value", 4).alias("value"), zero("r"), zero("g"), zero("b"), F.when(F.col("idx").isNull(), 0).otherwise(255).alias("a"))
