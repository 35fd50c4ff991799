"""Coordinate axes as small tables: steps, nearest node, bracketing nodes.

An axis table has (idx, node), one row per distinct coordinate: a few hundred rows whatever the number of cells, since
a grid's size is the product of its axes.  Joins with the spans of an axis go by even cells and broadcast them below
MAX_BROADCAST nodes; nearest nodes of a larger axis are found by an as-of join, its brackets by Spark's own choice of join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written
from . import asof

MAX_BROADCAST = 100_000
#: Tolerance beyond the first and last node within which a depth still snaps.
DEPTH_SLACK = 1e-6


def small(ax: DataFrame) -> DataFrame:
    """The axis marked for broadcast if it's within the bound."""
    return F.broadcast(ax) if ax.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else ax


def axis(df: DataFrame, col: str) -> DataFrame:
    """(idx, node) of the distinct values of a column in rising order."""
    nodes = df.select(F.col(col).alias("node")).where("node is not null").distinct()
    return nodes.select((F.row_number().over(W.orderBy("node")) - 1).cast("int").alias("idx"), "node")


def axes_of(df: DataFrame, *cols: str) -> dict[str, DataFrame]:
    """axis() of several columns from one pass over the rows; what is kept is one row that holds the axes."""
    one = written(df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]), "axes")
    return {c: one.select(F.posexplode(c).alias("idx", "node")) for c in cols}


def seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def steps(ax: DataFrame) -> DataFrame:
    """(idx, node, step): distance to the next node in the axis's unit (seconds for time); null for the last."""
    at = seconds(F.col("node")) if dict(ax.dtypes)["node"].startswith("timestamp") else F.col("node")
    return ax.withColumn("step", F.lead(at).over(W.orderBy("idx")) - at)


def median_step(ax: DataFrame) -> DataFrame:
    return steps(ax).agg(F.percentile("step", 0.5).alias("median_step"), F.count(F.lit(1)).alias("n_nodes"))


def cells(ax: DataFrame) -> DataFrame:
    """Nearest-node cells (idx, node, lo, hi]: a value halfway goes to the lower node."""
    at = seconds(F.col("node")) if dict(ax.dtypes)["node"].startswith("timestamp") else F.col("node").cast("double")
    order = W.orderBy("idx")
    rows = ax.withColumn("at", at)
    return rows.select("idx", "node", "at", ((F.lag("at").over(order) + F.col("at")) / 2).alias("lo"), ((F.lead("at").over(order) + F.col("at")) / 2).alias("hi"))


def met(df: DataFrame, value: Column, spans: DataFrame, low: Column, high: Column, inside: Column, beyond: Callable[[], DataFrame] | None = None) -> DataFrame:
    """df left-joined with the spans for which `inside` holds; a null low or high reaches to the end of the axis.

    The axis is cut into even cells, four a span; a span is listed under the cells it reaches, so a value looks at the few
    spans of its cell by an equi-join, not at all of them.  `beyond` serves axes of more nodes than may be broadcast.
    """
    ends = spans.agg(F.min(F.coalesce(low, high)).alias("a"), F.max(F.coalesce(high, low)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if ends["a"] is None or not ends["b"] > ends["a"]:
        return df.join(small(spans), inside, "left")
    if beyond and ends["n"] > MAX_BROADCAST:
        return beyond()
    m = 4 * ends["n"]
    cell = lambda v: F.least(F.greatest(F.floor((v - ends["a"]) / ((ends["b"] - ends["a"]) / m)), F.lit(-1)), F.lit(m)).cast("long")
    reach = F.sequence(F.coalesce(cell(low), F.lit(-1).cast("long")), F.coalesce(cell(high), F.lit(m).cast("long")))
    listed = spans.withColumn("__at", F.explode(reach))
    listed = F.broadcast(listed) if ends["n"] <= MAX_BROADCAST else listed
    return df.withColumn("__cell", cell(value)).join(listed, (F.col("__cell") == F.col("__at")) & inside, "left").drop("__cell", "__at")


def nearest(df: DataFrame, value: Column, ax: DataFrame, prefix: str) -> DataFrame:
    """df with {prefix}idx, {prefix}node and {prefix}gap (distance) of the node nearest to value; first node on a tie.

    A large axis is met by an as-of join, dealt by range.
    """
    c = cells(ax).select(*[F.col(x).alias(f"{prefix}{x}") for x in ("idx", "node", "at", "lo", "hi")])
    lo, hi = F.col(f"{prefix}lo"), F.col(f"{prefix}hi")
    inside = (lo.isNull() | (value > lo)) & (hi.isNull() | (value <= hi)) & value.isNotNull()

    def dealt() -> DataFrame:
        near = asof.nearest(df, c.select(f"{prefix}idx", f"{prefix}node", f"{prefix}at"), value, F.col(f"{prefix}at"))
        return near.select(*df.columns, *[F.col(f"near.{prefix}{x}").alias(f"{prefix}{x}") for x in ("idx", "node", "at")])

    joined = met(df, value, c, lo, hi, inside, dealt)
    return joined.withColumn(f"{prefix}gap", F.abs(value - F.col(f"{prefix}at"))).drop(f"{prefix}at", f"{prefix}lo", f"{prefix}hi")


def brackets(ax: DataFrame) -> DataFrame:
    """Intervals (k0, k1, x0, x1): below the first node only the node itself; values are never clamped."""
    order = W.orderBy("idx")
    rows = ax.select(F.col("idx").alias("k1"), F.col("node").cast("double").alias("x1"), F.lag("idx").over(order).alias("k0"), F.lag(F.col("node").cast("double")).over(order).alias("x0"))
    return rows.select(F.coalesce("k0", "k1").alias("k0"), "k1", "x0", "x1")


def bracketed(df: DataFrame, value: Column, ax: DataFrame, prefix: str) -> DataFrame:
    """df with {prefix}0, {prefix}1 (bracketing indexes) and {prefix}f (share of the way); null outside the axis.

    A value on node m > 0 gives (m - 1, m, 1); on the first node (0, 0, 0).
    """
    b = brackets(ax).select(*[F.col(a).alias(prefix + z) for a, z in (("k0", "0"), ("k1", "1"), ("x0", "x0"), ("x1", "x1"))])
    x0, x1 = F.col(f"{prefix}x0"), F.col(f"{prefix}x1")
    inside = x0.isNull() & (value == x1) | (value > x0) & (value <= x1)
    share = F.when(x0.isNull(), F.lit(0.0)).otherwise((value - x0) / (x1 - x0))
    joined = met(df, value, b, F.coalesce(x0, x1), x1, inside)
    return joined.withColumn(f"{prefix}f", F.when(F.col(f"{prefix}1").isNotNull(), share)).drop(f"{prefix}x0", f"{prefix}x1")


def edges(ax: DataFrame) -> DataFrame:
    """(idx, node, lo_edge, hi_edge): midpoints, the end cells as wide outside as inside."""
    order = W.orderBy("idx")
    node = F.col("node").cast("double")
    before, after = F.lag(node).over(order), F.lead(node).over(order)
    lo = F.coalesce((before + node) / 2, node - (after - node) / 2, node)
    hi = F.coalesce((after + node) / 2, node + (node - before) / 2, node)
    return ax.select("idx", "node", lo.alias("lo_edge"), hi.alias("hi_edge"))
