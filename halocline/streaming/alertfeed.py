"""Alert feed over time: messages arrive in any order, a Cancel or Update before or after what it names.

The feed's table holds one row an identifier: the message, if it has come, and whether a Cancel or an Update names it.  Every batch
turns into claims about identifiers, and claims merge by a maximum a column, so order and repeats of arrival don't matter.  What is in
force is asked of the table at any instant.

A table is a folder of batches and snapshots.  Batch n holds the merged claims of batch n alone, which costs no more than the batch, and
is overwritten when n runs again, so a restart repeats nothing.  Every COMPACT batches a snapshot merges the one before and what came
since; readers merge the newest complete one with the batches behind it.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alerts as al

#: Batches between snapshots.
COMPACT = 20
MESSAGE = "sent timestamp, seq long, status string, msg_type string, effective timestamp, expires timestamp, severity string, urgency string"
MESSAGES = f"identifier string, {MESSAGE}, references array<string>"
FIELDS = [x.split()[0] for x in MESSAGE.split(", ")]
_STRUCT = "struct<" + ",".join(x.replace(" ", ":") for x in MESSAGE.split(", ")) + ">"
ROW = f"identifier string, message {_STRUCT}, cancelled boolean, superseded boolean"


def claims(messages: DataFrame) -> DataFrame:
    """What messages say: (identifier, message, cancelled, superseded), one row for a message itself and for each that it names."""
    claim = lambda name, message, cancels, updates: F.struct(name.alias("identifier"), message.cast(_STRUCT).alias("message"), cancels.alias("cancelled"), updates.alias("superseded"))
    own = claim(F.col("identifier"), F.struct(*FIELDS), F.lit(False), F.lit(False))
    cancels, updates = (F.coalesce(F.col("msg_type") == kind, F.lit(False)) for kind in ("Cancel", "Update"))
    named = F.when(cancels | updates, F.array_distinct("references"))
    every = F.concat(F.array(own), F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda r: claim(r, F.lit(None), cancels, updates)))
    return messages.select(F.explode(every).alias("c")).select("c.*").where("identifier is not null")


def merged(rows: DataFrame) -> DataFrame:
    """One row an identifier: of repeated messages the one sent last counts."""
    return rows.groupBy("identifier").agg(F.max("message").alias("message"), F.bool_or("cancelled").alias("cancelled"), F.bool_or("superseded").alias("superseded"))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete batches or snapshots of a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found = [int(m[1]) for f in fs.listStatus(hadoop) if (m := re.fullmatch(r"n=(\d+)", f.getPath().getName()))]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/n={n}/_SUCCESS"))
    return sorted(n for n in found if done(n))


def _parts(spark: SparkSession, path: str, before: int | None) -> DataFrame | None:
    """Rows of the newest snapshot and of the batches behind it; with `before`, as of that batch."""
    snapshots = [n for n in _numbers(spark, path, "snapshot") if before is None or n < before]
    since = max(snapshots, default=-1)
    places = [f"{path}/snapshot/n={since}"] * bool(snapshots) + [f"{path}/batch/n={n}" for n in _numbers(spark, path, "batch") if n > since and (before is None or n < before)]
    return spark.read.schema(ROW).parquet(*places) if places else None


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table: (identifier, message, cancelled, superseded)."""
    rows = _parts(spark, path, before)
    return merged(rows) if rows is not None else spark.createDataFrame([], ROW)


def upsert(messages: DataFrame, number: int, path: str) -> None:
    """Add batch `number` of the feed to the table at path."""
    merged(claims(messages)).write.mode("overwrite").parquet(f"{path}/batch/n={number}")
    if number % COMPACT == COMPACT - 1:
        latest(messages.sparkSession, path, number + 1).write.mode("overwrite").parquet(f"{path}/snapshot/n={number}")


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Start the upsert of a stream of messages (MESSAGES) into the table at path."""
    return stream.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def at_instant(table: DataFrame, at: datetime, exercises: bool = False) -> DataFrame:
    """The messages of a table with reason: null where in force at the instant; identifiers that are only named have no message yet and no row."""
    rows = table.where("message is not null").select("identifier", "message.*", F.col("cancelled").alias("c"), F.col("superseded").alias("u"))
    return rows.withColumn("reason", al.reason_at(at, exercises)).drop("c", "u")
