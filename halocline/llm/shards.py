"""Sharding (operator 5) by a minimax contiguous partition; DataFrame operations only.

Equal texts form an atomic group; groups stand in order of their key, the text's md5.  The smallest capacity for which
a greedy fill needs no more than the given shards is found by search: each round tests `WIDTH` capacities at once, and
a greedy step is one aggregation over the groups' prefix sums.  The groups where a shard ends then cut the order,
so a document finds its shard by comparing its key with at most n - 1 cuts: no join, and copies of a hot text need no
shuffle of their own.

Defined results: null text is a group of its own with size 1 per row and null text_crc32; fewer groups than shards
leave shards empty; an empty table gives no rows; repeated rows are placed and numbered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ranked, written

SHARDS = 8
#: Capacities tested in one round of the search.
WIDTH = 64


def group_key(text: Column) -> Column:
    """Sort key of a group of equal texts; null text has the empty key, the first."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefix_sums(groups: DataFrame) -> DataFrame:
    """groups(key, bytes) with `upto`, the bytes of all groups up to this one in key order.

    Keys are spread evenly, so their first three digits make 4096 cells (and one for the empty key): sums of cells are
    added up over these few rows, groups within their cell.
    """
    cell = F.substring("key", 1, 3)
    groups = groups.withColumn("cell", cell)
    cells = groups.groupBy("cell").agg(F.sum("bytes").alias("b"))
    start = F.coalesce(F.sum("b").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("cell", start.alias("start"))
    inside = F.sum("bytes").over(W.partitionBy("cell").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    # 4097 rows at most
    return groups.join(F.broadcast(starts), "cell").select("key", "bytes", (F.col("start") + inside).cast("long").alias("upto"))


def smallest_capacity(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity under which a greedy fill takes at most `shards` shards, and where its shards end."""
    total, largest = sums.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return 0, []
    low = max(largest, -(-total // shards))
    high = -(-total // shards) + largest
    ends: list[int] = []
    while True:
        step = max(1, -(-(high - low + 1) // WIDTH))
        tried = list(range(low, high + 1, step))
        if tried[-1] != high:
            tried.append(high)
        filled = greedy(sums, tried, shards, total, largest)
        fits = next(i for i, x in enumerate(filled) if x[-1] == total)
        if step == 1:
            return tried[fits], filled[fits]
        low, high = (tried[fits - 1] + 1 if fits else tried[fits]), tried[fits]
        ends = filled[fits]
        if low == high:
            return high, ends


def greedy(sums: DataFrame, capacities: list[int], shards: int, total: int, largest: int) -> list[list[int]]:
    """For each capacity, the prefix sums at which its first `shards` shards end."""
    at = [[0] for _ in capacities]
    for _ in range(shards - 1):
        bound = [ends[-1] + c for ends, c in zip(at, capacities)]
        open_ = [i for i, b in enumerate(bound) if b < total]
        found = {}
        if open_:
            order = sorted(open_, key=lambda i: bound[i])
            lo, hi = bound[order[0]] - largest, bound[order[-1]]
            near = sums.where((F.col("upto") >= lo) & (F.col("upto") <= hi))
            passed = F.size(F.filter(F.lit([bound[i] for i in order]).cast("array<long>"), lambda b: b < F.col("upto")))
            best = {r[0]: r[1] for r in near.groupBy(passed.alias("at")).agg(F.max("upto")).collect()}  # WIDTH rows at most
            top = 0
            for k, i in enumerate(order):
                top = found[i] = max(top, best.get(k, 0))
        for i, ends in enumerate(at):
            ends.append(found.get(i, total))
    for ends, c in zip(at, capacities):  # the last shard takes what is left if it can
        ends.append(total if total - ends[-1] <= c else ends[-1])
    return [ends[1:] for ends in at]


def cuts(docs: DataFrame, shards: int = SHARDS) -> list[str]:
    """The last group key of every shard but the last that is used."""
    rows = docs.select(group_key(F.col("text")).alias("key"), text_size(F.col("text")).alias("size"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    sums = written(prefix_sums(groups), "sums")
    _, ends = smallest_capacity(sums, shards)
    inner = sorted(set(ends[:-1]) - set(ends[-1:]))
    if not inner:
        return []
    return sorted(r["key"] for r in sums.where(F.col("upto").isin(inner)).select("key").collect())


def shard_of(key: Column, ends: list[str]) -> Column:
    """Number of cuts below the key."""
    out = F.lit(0)
    for x in ends:
        out = out + (key > F.lit(x)).cast("int")
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (from 0 without gaps in its shard), grown_shard (null)."""
    slim = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), group_key(F.col("text")).alias("key"))
    slim = written(slim, "keys")
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes"))
    sums = written(prefix_sums(groups), "sums")
    _, ends = smallest_capacity(sums, shards)
    inner = sorted(set(ends[:-1]) - set(ends[-1:]))
    last = sorted(r["key"] for r in sums.where(F.col("upto").isin(inner)).select("key").collect()) if inner else []
    rows = slim.withColumn("shard", shard_of(F.col("key"), last)).drop("key")
    out = ranked(rows, ["shard"], [], "doc_id", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their shard: one pass for the cuts, then comparisons only."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    return docs.select(*own, shard_of(group_key(F.col("text")), cuts(docs, shards)).alias("shard"))
