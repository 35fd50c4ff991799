"""Mixing sources to target weights (operator 6) by systematic sampling.

Within a source every document is due the same expected number of copies, target words over source words.  The
prefix sum of these, plus one random offset of the source, passes an integer boundary once per copy.  Documents stand
in order of size, so that the words taken come as near the target as the largest documents allow.

Defined results: null text has size 0; a null source is a source, the last; sources without words get target 0 and
no copies; an empty table gives no rows; repeated rows are sampled as separate documents.  mixed() puts rows of the same id,
source and text out as one of them, as often as they are taken together; rows that share an id only are told apart by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, ranked, same, written

WEIGHTS = (1, 2, 3)
CAP = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of sizes(source, size): one row per source.

    Weighted water filling: a source is full if its cap over its weight is below the common level; the level is what
    is left over the weights that are left.  The windows run over one row per source, never over documents.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = own.withColumn("w", w).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    by_ratio = W.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    left = F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumns({"level": (F.col("total") - full).cast("double") / left, "nth": F.row_number().over(by_ratio)})
    holds = F.col("level") <= F.col("source_size") * cap / F.col("w")
    level = F.min(F.when(holds, F.struct("nth", "level"))).over(W.partitionBy())["level"]
    target = F.least((F.col("source_size") * cap).cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("w"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def mix(rows: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and copies; th, if there, orders rows that share an id.

    The offset of a source is the md5 of seed and source, so reruns agree.
    """
    sources = targets(rows.select("source", "size"), weights, cap)
    placed = ranked(rows, ["source"], ["size"], "doc_id", "__rank", ties=tuple(c for c in ("th",) if c in rows.columns))
    joined = same(placed, sources, ["source"])
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank.cast("double") * each + offset)
    return joined.withColumn("copies", (upto(F.col("__rank") + 1) - upto(F.col("__rank"))).cast("long")).drop("__rank")


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    out = mix(slim, seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Ranks are made of narrow rows; the texts meet only the table of copies, once.
    """
    keys = ["doc_id", "source", "th"]
    slim = written(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), n_words(F.col("text")).alias("size")), "sizes")
    taken = mix(slim, seed).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = written(taken.where("copies > 0"), "taken")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "source", F.xxhash64("text").alias("th"))
    out = same(whole, taken.where("rows = 1"), keys)
    repeated = taken.where("rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(same(whole, repeated, keys).dropDuplicates(keys))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
