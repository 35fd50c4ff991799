"""As-of joins: for each row of one side the last row of the other at or before it, the first behind it, or the nearer of both.

Both sides are dealt together by range of (key, time), so that a key with any share of the rows spreads over many tasks.  Within a range the
last and next row are carried along; across ranges they're carried over a table that has a row for each key and range it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written


def neighbours(left: DataFrame, right: DataFrame, at: Column, node: Column, keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """left with `before` and `after`: structs of the right row at or before `at`, and of the first one behind it; null if there is none.

    at and node are numbers of the same unit; left rows with a null one meet nothing.  Keys stand in both sides; null keys meet.  Of
    right rows with the same key and node one is taken, the least in the order of their columns.
    """
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in right.columns if c not in keys]
    payload = F.struct(node.cast("double").alias("at"), *own)
    one = right.withColumn("__p", payload).where("__p.at is not null").groupBy(*keys, F.col("__p.at").alias("__at")).agg(F.min("__p").alias("__p"))
    kept = F.struct(*left.columns)
    a = left.select(*keys, at.cast("double").alias("__at"), F.lit(1).alias("__side"), kept.alias("__l")).withColumn("__p", F.lit(None).cast(one.schema["__p"].dataType))
    b = one.select(*keys, "__at", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), "__p")
    order = [*[F.col(c).asc_nulls_first() for c in keys], F.col("__at").asc_nulls_last(), F.col("__side").asc()]
    dealt = a.unionByName(b).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("__id", F.monotonically_increasing_id()), "asof").withColumn("__part", F.shiftright("__id", 33))
    # within a range
    inner = W.partitionBy("__part", *keys).orderBy("__id")
    rows = dealt.withColumns({
        "before": F.last("__p", True).over(inner.rowsBetween(W.unboundedPreceding, 0)), "after": F.first("__p", True).over(inner.rowsBetween(1, W.unboundedFollowing)),
    })
    # across ranges: a row a key and range
    ends = dealt.where("__p is not null").groupBy(*keys, "__part").agg(F.max(F.struct("__id", "__p")).alias("z"), F.min(F.struct("__id", "__p")).alias("a"))
    touched = _left(dealt.select(*keys, "__part").distinct(), ends, [*keys, "__part"])
    outer = W.partitionBy(*keys).orderBy("__part")
    edge = touched.select(
        *keys, "__part", F.last(F.col("z.__p"), True).over(outer.rowsBetween(W.unboundedPreceding, -1)).alias("__before"),
        F.first(F.col("a.__p"), True).over(outer.rowsBetween(1, W.unboundedFollowing)).alias("__after"),
    )
    both = _left(rows.where("__side = 1"), edge, [*keys, "__part"])
    met = F.col("__at").isNotNull()
    return both.select("__l.*", F.when(met, F.coalesce("before", "__before")).alias("before"), F.when(met, F.coalesce("after", "__after")).alias("after"))


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which nulls meet; the keys come once."""
    named = right.select(*[F.col(c).alias(f"__r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys]
    return left.join(named, on, "left").drop(*[f"__r_{c}" for c in keys])


def nearest(left: DataFrame, right: DataFrame, at: Column, node: Column, keys: Sequence[str] = (), tolerance: float | None = None, partitions: int | None = None) -> DataFrame:
    """left with `near`: the struct of the nearest right row, the earlier on a tie, null beyond the tolerance; and `gap`."""
    rows = neighbours(left.withColumn("__want", at.cast("double")), right, F.col("__want"), node, keys, partitions)
    down, up = F.col("__want") - F.col("before.at"), F.col("after.at") - F.col("__want")
    near = F.when(down.isNull() | (up < down), F.col("after")).otherwise(F.col("before"))
    rows = rows.withColumn("near", near).withColumn("gap", F.abs(F.col("__want") - F.col("near.at"))).drop("before", "after", "__want")
    if tolerance is None:
        return rows
    return rows.withColumns({"near": F.when(F.col("gap") <= tolerance, F.col("near")), "gap": F.when(F.col("gap") <= tolerance, F.col("gap"))})
