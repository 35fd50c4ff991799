"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Characters that separate words: U+0020 and U+0009 to U+000D (fixed value).
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only in local mode, as in tests, a folder of our own may stand for it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(*tables: DataFrame) -> None:
    """Delete the tables made by written() that these read; to be called when nothing needs them any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark).split(":", 1)[-1].rstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in folder and re.search("-[0-9a-f]{32}$", folder):
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sub_key(id_col: Column, digits: int = 3) -> Column:
    """An even spread of ids over 16**digits cells, by md5 of the id's decimal form (null: cell 'nul')."""
    return F.coalesce(F.substring(F.md5(id_col.cast("string").cast("binary")), 1, digits), F.lit("nul"))


def ranked(df: DataFrame, group: list[str], coarse: list[str], id_col: str, out: str, digits: int = 3, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `out`: the row's place (from 0) among the rows of its group, ordered by coarse, cell of the id, id, ties.

    A group may hold any share of the rows.  Only cell counts are windowed over a whole group; rows are
    numbered within (group, coarse, cell), which md5 keeps small.
    """
    cell = "__cell"
    df = df.withColumn(cell, sub_key(F.col(id_col), digits))
    keys = [*group, *coarse]
    counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__n"))
    inner = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    start = counts.withColumn("__start", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
    if coarse:
        outer = W.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in coarse]).rowsBetween(W.unboundedPreceding, -1)
        level = counts.groupBy(*keys).agg(F.sum("__n").alias("__m")).withColumn("__base", F.coalesce(F.sum("__m").over(outer), F.lit(0)))
        start = same(start, level.drop("__m"), keys).withColumn("__start", F.col("__start") + F.col("__base")).drop("__base")
    place = F.row_number().over(W.partitionBy(*keys, cell).orderBy(F.col(id_col).asc_nulls_first(), *ties))
    rows = df.withColumn("__row", place - 1)
    joined = same(rows, start.drop("__n"), [*keys, cell])
    return joined.withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__start", "__row", cell)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which null keys meet; the keys come once, from the left."""
    named = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(named, cond).drop(*[f"__r_{k}" for k in keys])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component being the smallest node reachable.

    Union-find in two steps.  Each task first joins its own edges with a union-find forest and passes on one
    edge per joined node; then large-star and small-star rounds link what tasks hold apart, every round
    an aggregation and a join, until a round changes no edge.
    """
    e = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where("u < v")
    e = e.mapInPandas(_forest, "u long, v long").distinct()
    e = written(e, "edges")
    seen = None
    while True:
        # large star: every neighbour above u goes to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: u and its lower neighbours go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("m"), "u", "v")
        e = small.select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()
        last, e = e, written(e, "edges")
        unwritten(last)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
        seen = tuple(state)


def _forest(batches):
    import pandas as pd

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def drain():
        rows = [(root(x), x) for x in list(parent)]
        parent.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"]).astype("int64")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:  # bounds the forest's memory; later rounds join the pieces
            yield drain()
    if parent:
        yield drain()
