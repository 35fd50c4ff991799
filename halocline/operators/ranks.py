"""Places in a total order: exact order statistics, row numbers and last rows per key, without all rows meeting in one task.

Order statistics narrow an interval by counts of a fixed number of bins until what is asked for is one value or lies among a few.
Row numbers come from a range partition: counts of partitions give each its first number.  The last rows of a key are sought in
the last cells that hold enough of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import unwritten, written

#: Bins an interval is cut into, and distinct values of a last interval that are looked at one by one.
BINS, FEW = 2048, 2000


def order_statistics(rows: DataFrame, value: str, places: Sequence[tuple[float, str]]) -> tuple[int, list[float | None]]:
    """(n, values): how many finite values there are, and those at the places asked for, in rising order.

    A place is (share p, how): of (n - 1) * p the `floor` or the `ceil`; all places are null without values.  Each pass over the values
    counts bins for all places at once; what comes to the driver is BINS rows a place at most.
    """
    v = F.col(value).cast("double")
    own = written(rows.select(v.alias("v")).where(v.isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))), "values")
    ends = own.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    if not ends["n"]:
        unwritten(own)
        return 0, [None] * len(places)
    n = ends["n"]
    ranks = [getattr(math, how)((n - 1) * p) for p, how in places]
    # of each place's interval: the ends, how many values lie before it and in it
    spans = {r: (ends["a"], ends["b"], 0, n) for r in set(ranks)}
    found: dict[int, float] = {}
    while True:
        found |= {r: a for r, (a, b, _, _) in spans.items() if a == b}
        asked = sorted({(a, b) for r, (a, b, _, _) in spans.items() if r not in found})
        if not asked:
            break
        few = {s: next(m for a, b, _, m in spans.values() if (a, b) == s) <= FEW for s in asked}
        # a span of few values is counted value by value, others by even bins; rounding may move values between bins, but not past others
        part = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("s"), (F.col("v") if few[a, b] else F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS).cast("double")).alias("bin"), F.col("v").alias("x"))) for k, (a, b) in enumerate(asked)]
        each = own.select(F.explode(F.array_compact(F.array(*part))).alias("c")).select("c.*")
        bins = each.groupBy("s", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for r, (a, b, before, _) in list(spans.items()):
            if r in found:
                continue
            for c in sorted((c for c in bins if asked[c["s"]] == (a, b)), key=lambda c: c["bin"]):
                if r < before + c["n"]:
                    spans[r] = (c["a"], c["b"], before, c["n"])
                    break
                before += c["n"]
    unwritten(own)
    return n, [found[r] for r in ranks]


def percentiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Percentiles with linear interpolation between neighbours, null without values."""
    n, got = order_statistics(rows, value, [(p, how) for p in shares for how in ("floor", "ceil")])
    out: list[float | None] = []
    for k, p in enumerate(shares):
        lo, hi = got[2 * k], got[2 * k + 1]
        if lo is None or hi is None:
            out.append(None)
            continue
        at = (n - 1) * p
        out.append(lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    return out


def placed(rows: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None) -> DataFrame:
    """rows with `out`: their place from 0 in a total order, in which ties stand in any order.

    Rows are dealt by range of the order and numbered within their range; the counts of ranges, one row each, give every range
    its first place.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of this number count partitions, the lower ones rows within
    dealt = written(dealt.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__id", 33)
    counts = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    start = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(counts.select("__part", start.alias("__start")))  # a row a partition
    both = dealt.withColumn("__part", part).join(first, "__part")
    return both.withColumn(out, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__id")


def last(rows: DataFrame, keys: Sequence[str], by: str, k: int, width: int) -> DataFrame:
    """The k rows of each key with the greatest `by` (a whole number; nulls last), in which ties stand in any order.

    A key is cut into cells of `width` numbers.  Counts of cells, added up from the last one, tell which cells hold
    the last k rows; only rows of these are sorted.
    """
    cell = F.coalesce(F.floor(F.col(by) / width), F.lit(-(2**62))).cast("long")
    counts = rows.groupBy(*keys, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    behind = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy(F.desc("__cell")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("__behind", behind).where(F.col("__behind") < k).select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__cell").alias("__at"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    near = rows.withColumn("__cell", cell).join(cells, [F.col("__cell") == F.col("__at"), *same], "left_semi").drop("__cell")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last()))
    return near.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")
