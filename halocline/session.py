"""Session settings that the engine relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the master comes from spark-submit."""
    b = SparkSession.builder.appName("halocline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


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
    """df written to the shared folder and read back: cuts lineage, survives lost executors, and its size is known as measured."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unwritten(*tables: DataFrame) -> None:
    """Delete the tables made by written() that these read; to be called when nothing needs them any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark).split(":", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in folder and re.search("-[0-9a-f]{32}$", folder):
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def per_file(rows: DataFrame, facts: DataFrame, key: str = "file") -> DataFrame:
    """rows with the facts, one row a key, of their key (nulls meet); no task gathers the rows of a key.

    The key's rows are dealt over as many parts as there are shuffle partitions, by all their columns, and the facts stand in each part.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*plain), F.lit(n)).cast("int"))
    spread = facts.withColumnRenamed(key, "__key").withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.join(spread, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at"))).drop("__key", "__part", "__at")
