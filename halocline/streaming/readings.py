"""Sensor readings: validation, receipt stamps, look-back figures and threshold alerts of a whole log, logs and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..ledger import first_reason
from ..operators import ranks

READING = "station_id string, ts timestamp, temp_c double, tds_ppm double, turbidity_ntu double, seq long"
#: Closed limits of the sensors (fixed values).
LIMITS = {"temp_c": (-5.0, 100.0), "tds_ppm": (0.0, 60000.0), "turbidity_ntu": (0.0, 4000.0)}
#: Trip rule: least readings with the current one, deviations, degrees, readings looked back (fixed values).
MIN_READINGS, SIGMAS, DEGREES, LOOK_BACK = 13, 6.0, 1.5, 500
LAST_LINES = 500
#: Readings of a file of a replayed log, about; a batch of the stream is one file.
REPLAY_ROWS = 500_000
#: Readings of a station that are numbered, and looked back over, in one task.
SEQ_CELL = 100_000


def reason(limits: dict[str, tuple[float, float]] = LIMITS) -> Column:
    """First failing test of a reading, null if it's accepted."""
    tests = [("no_station", F.col("station_id").isNull() | (F.trim("station_id") == ""))]
    for name, (lo, hi) in limits.items():
        v = F.col(name)
        tests += [(f"no_{name}", v.isNull()), (f"{name}_not_finite", F.isnan(v) | (F.abs(v) == float("inf"))), (f"{name}_out_of_range", ~v.between(lo, hi))]
    return first_reason(*tests)


def stamped(readings: DataFrame, received: Column | None = None) -> DataFrame:
    """received_at, and ts with its source: the device's, or the receipt's where the device gave none."""
    got = received if received is not None else F.current_timestamp()
    out = readings.withColumn("received_at", got)
    return out.withColumns({"ts_source": F.when(F.col("ts").isNull(), "server").otherwise("device"), "ts": F.coalesce("ts", "received_at")})


def lines(spark: SparkSession, path: str, last: int = LAST_LINES) -> DataFrame:
    """The last lines of a JSON-lines log, oldest first; corrupt ones are dropped after the cut.

    The log is read in splits and may have many files, which follow one another by name; only the last lines are sorted.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    text = spark.read.text(path).select(place.alias("pos"), F.col("value").alias("line")).where("trim(line) <> ''")
    kept = text.orderBy(F.desc("pos")).limit(last)
    parsed = kept.select("pos", F.from_json("line", READING + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r is not null and r._corrupt is null").select("pos", "r.*").drop("_corrupt").orderBy("pos").drop("pos")


def last_readings(readings: DataFrame, k: int = LAST_LINES) -> DataFrame:
    """The last k readings of each station, by arrival."""
    return ranks.last(readings, ["station_id"], "seq", k, SEQ_CELL)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Start the append of readings to a JSON-lines log, one line a reading."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def numbered(readings: DataFrame) -> DataFrame:
    """readings with rn, their place from 0 within the station, by seq.

    Rows are numbered within a station's SEQ_CELL numbers; only the counts of these cells are added up over a station.
    """
    rows = readings.withColumn("cell", F.coalesce(F.floor(F.col("seq") / SEQ_CELL), F.lit(-1)).cast("long"))
    counts = rows.groupBy("station_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("station_id").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("own", F.row_number().over(W.partitionBy("station_id", "cell").orderBy("seq")))
    both = placed.join(counts.select("station_id", "cell", start.alias("start")), ["station_id", "cell"])
    return both.withColumn("rn", F.col("start") + F.col("own") - 1).drop("cell", "own", "start")


def history(readings: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """n, mean and population deviation of the up to look_back readings of the station before each one, by arrival.

    A station is cut into stretches of SEQ_CELL readings, each with the look_back before it, so its log is no one task's work;
    and the figures are differences of running sums about the stretch's mean, which cost the same however far one looks back.
    """
    rows = numbered(readings).withColumn("part", F.floor(F.col("rn") / SEQ_CELL))
    tail = rows.where(F.col("rn") % SEQ_CELL >= SEQ_CELL - look_back).withColumns({"part": F.col("part") + 1, "own": F.lit(False)})
    rows = rows.withColumn("own", F.lit(True)).unionByName(tail)
    stretch = W.partitionBy("station_id", "part")
    x = F.col("temp_c") - F.col("mid")
    upto, back = stretch.orderBy("rn").rowsBetween(W.unboundedPreceding, -1), stretch.orderBy("rn")
    rows = rows.withColumn("mid", F.avg("temp_c").over(stretch))
    rows = rows.withColumns({"c0": F.count("temp_c").over(upto), "c1": F.coalesce(F.sum(x).over(upto), F.lit(0.0)), "c2": F.coalesce(F.sum(x * x).over(upto), F.lit(0.0))})
    before = {f"w{k}": F.col(f"c{k}") - F.coalesce(F.lag(f"c{k}", look_back).over(back), F.lit(0)) for k in range(3)}
    rows = rows.withColumns(before).where("own")
    mean = F.col("w1") / F.col("w0")
    spread = F.sqrt(F.greatest(F.col("w2") / F.col("w0") - mean * mean, F.lit(0.0)))
    some = F.col("w0") > 0
    rows = rows.withColumns({"n_before": F.col("w0"), "mean_before": F.when(some, F.col("mid") + mean), "std_before": F.when(some, spread)})
    return rows.drop("rn", "part", "own", "mid", *[f"{a}{k}" for a in "cw" for k in range(3)])


def tripped() -> Column:
    """A reading trips when it's warmer than what came before it, by degrees and by deviations; a fall doesn't."""
    delta = F.col("temp_c") - F.col("mean_before")
    return (F.col("n_before") + 1 >= MIN_READINGS) & (delta >= DEGREES) & ((F.col("std_before") == 0) | (delta >= SIGMAS * F.col("std_before")))


def threshold_alerts(readings: DataFrame) -> DataFrame:
    """Accepted readings with delta and whether they trip; an alert clears itself as the window moves on."""
    return history(readings).withColumns({"delta": F.col("temp_c") - F.col("mean_before"), "tripped": tripped(), "status": F.lit("Exercise")})


def replay_log(readings: DataFrame, path: str, rows: int = REPLAY_ROWS, by: tuple[str, ...] = ("seq",)) -> None:
    """Write readings as files of ranges of `by`, by many tasks, with times in that order: a file stream takes the oldest first."""
    spark = readings.sparkSession
    n = max(1, -(-readings.count() // rows))
    readings.repartitionByRange(n, *by).sortWithinPartitions(*by).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    last = max(fs.getFileStatus(p).getModificationTime() for p in files)
    for k, p in enumerate(files):
        fs.setTimes(p, last - 1000 * (len(files) - k), -1)


def to_sinks(stream: DataFrame, accepted_path: str, refused_path: str, checkpoint: str):
    """Start the ingest: accepted readings appended to one table, refused ones with their reason to another.

    A batch writes under its own number and overwrites it on replay, so a restart repeats no reading.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = stamped(batch).withColumn("reason", reason())
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{refused_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(readings: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition to the arrival-ordered rules: event-time summaries per station; a stream drops what comes behind its watermark.

    `stateful.hour_stream` tells late readings apart instead of dropping them.
    """
    rows = readings.withWatermark("ts", late) if readings.isStreaming else readings
    return rows.groupBy(F.window("ts", width).alias("w"), "station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("temp_c"), 6).alias("mean")).select(F.col("w.start").alias("start"), "station_id", "n", "mean")


def span(readings: DataFrame) -> DataFrame:
    """Per station low and high for a trend (0.2 apart at least) and whole seconds from first to last reading."""
    r = readings.groupBy("station_id").agg(F.min("temp_c").alias("a"), F.max("temp_c").alias("b"), F.min(F.struct("seq", "ts")).alias("f"), F.max(F.struct("seq", "ts")).alias("l"))
    mid, half = (F.col("a") + F.col("b")) / 2, F.greatest((F.col("b") - F.col("a")) / 2, F.lit(0.1))
    return r.select("station_id", F.round(mid - half, 4).alias("lo"), F.round(mid + half, 4).alias("hi"), (F.unix_seconds("l.ts") - F.unix_seconds("f.ts")).alias("elapsed"))
