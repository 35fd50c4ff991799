"""Ocean-shaped inputs derived from the star-schema tables, in Spark and as DuckDB common table expressions.

Both sides use the same plain arithmetic, so results can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t_idx, time): the months of the orders."""
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("time")).distinct()
    return months.select((F.row_number().over(W.orderBy("time")) - 1).cast("int").alias("t_idx"), "time")


#: Nodes of the analysis grid: levels 40 m apart, rows and columns a degree apart.
LEVEL_NODES, LAT_NODES, LON_NODES = 50, 25, 5


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, k, j, i, d, n): all line items, binned to the grid's cells; d is the sum of their discounts in hundredths."""
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("month"))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("int").alias("k"), (F.col("l_suppkey") % LAT_NODES).cast("int").alias("j"), (F.col("l_partkey") % LON_NODES).cast("int").alias("i"),
        F.round(F.lit(100.0) * F.col("l_discount")).cast("int").alias("c"),
    )
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("month", "k", "j", "i").agg(F.sum("c").alias("d"), F.count(F.lit(1)).alias("n"))


def grid(spark: SparkSession, sf_dir: str, times: str | None = None) -> DataFrame:
    """Cells (t_idx, time, k_idx, depth, j, lat, i, lon, temp, sal, uo, vo, rough) of an analysis by months.

    A cell's values are those of a plain background, moved by the mean discount of the line items that fall into it; cells
    that no item falls into keep the background, land and missing cells hold nulls.
    """
    t = steps(spark, sf_dir)
    if times:
        t = t.where(times)
    upto = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    cells = t.repartition(spark.sparkContext.defaultParallelism, "t_idx").withColumn("j", upto(0, LAT_NODES - 1)).withColumn("i", upto(0, LON_NODES - 1)).withColumn("k", upto(1, LEVEL_NODES))
    cells = cells.join(binned(spark, sf_dir).withColumnRenamed("month", "time"), ["time", "k", "j", "i"], "left")
    lat, lon, depth = F.col("j").cast("double"), F.col("i").cast("double"), F.col("k") * F.lit(40.0)
    moved = F.when(F.col("n") > 0, (F.col("d").cast("double") / F.col("n") - 5) / F.lit(53.0)).otherwise(F.lit(0.0))
    land = (5 * F.col("j") + 3 * F.col("i")) % 17 == 0
    hole = (7 * F.col("j") + 11 * F.col("i") + 3 * F.col("k")) % 29 == 0
    sea = lambda v: F.when(~land & ~hole, v)
    return cells.select(
        "t_idx", "time", (F.col("k") - 1).alias("k_idx"), depth.alias("depth"), "j", lat.alias("lat"), "i", lon.alias("lon"),
        sea(F.lit(30.0) + F.lit(0.05) * lat - F.lit(0.1) * lon - F.lit(0.013) * depth + moved).alias("temp"), sea(F.lit(33.0) + F.lit(0.001) * depth + moved / F.lit(10.0)).alias("sal"),
        F.when(~land, ((13 * F.col("i") + 7 * F.col("j") + F.col("k")) % 17 - 8) / F.lit(9.7) + moved).alias("uo"),
        F.when(~hole, ((3 * F.col("j") + 5 * F.col("i") + 2 * F.col("k")) % 19 - 9) / F.lit(9.7) - moved).alias("vo"),
        # a rougher field with inversions and interior extremes, for column diagnostics
        sea(((F.col("k") * F.col("k") + 3 * F.col("j") + 5 * F.col("i") + F.col("t_idx")) % 23) / F.lit(10.0) + F.lit(0.02) * depth + moved).alias("rough"),
    )


GRID = f"""
steps AS (SELECT time, CAST(row_number() OVER (ORDER BY time) - 1 AS INTEGER) AS t_idx
          FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time FROM orders)),
binned AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time, CAST(l_quantity AS INTEGER) AS k, CAST(l_suppkey % {LAT_NODES} AS INTEGER) AS j, CAST(l_partkey % {LON_NODES} AS INTEGER) AS i,
                  sum(CAST(round(100.0::DOUBLE*l_discount) AS INTEGER)) AS d, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
cells AS (SELECT t_idx, time, k, j, i, (5*j + 3*i) % 17 = 0 AS land, (7*j + 11*i + 3*k) % 29 = 0 AS hole, CASE WHEN n > 0 THEN (CAST(d AS DOUBLE) / n - 5) / 53.0::DOUBLE ELSE 0.0::DOUBLE END AS moved
          FROM (SELECT t_idx, time, CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i FROM steps, range(1, {LEVEL_NODES + 1}) a(k), range({LAT_NODES}) b(j), range({LON_NODES}) c(i)) LEFT JOIN binned USING (time, k, j, i)),
grid AS (SELECT t_idx, time, k - 1 AS k_idx, k * 40.0::DOUBLE AS depth, j, CAST(j AS DOUBLE) AS lat, i, CAST(i AS DOUBLE) AS lon,
                CASE WHEN NOT land AND NOT hole THEN 30.0::DOUBLE + 0.05::DOUBLE*j - 0.1::DOUBLE*i - 0.013::DOUBLE*(k*40.0::DOUBLE) + moved END AS temp,
                CASE WHEN NOT land AND NOT hole THEN 33.0::DOUBLE + 0.001::DOUBLE*(k*40.0::DOUBLE) + moved / 10.0::DOUBLE END AS sal,
                CASE WHEN NOT land THEN ((13*i + 7*j + k) % 17 - 8) / 9.7::DOUBLE + moved END AS uo,
                CASE WHEN NOT hole THEN ((3*j + 5*i + 2*k) % 19 - 9) / 9.7::DOUBLE - moved END AS vo,
                CASE WHEN NOT land AND NOT hole THEN ((k*k + 3*j + 5*i + t_idx) % 23) / 10.0::DOUBLE + 0.02::DOUBLE*(k*40.0::DOUBLE) + moved END AS rough
         FROM cells)
"""


#: Most levels that a task sorts on average.
TASK_LEVELS = 500_000


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured levels (profile_id, wmo, time, lat, lon, depth, temp, temp_qc, psal, psal_qc, source_id).

    They're dealt by profile over as many tasks as their number asks for, if that's more than the session's, so a task's memory doesn't grow.
    """
    li, od = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = -(-li.count() // TASK_LEVELS)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li, od = li.repartition(n, "l_orderkey"), od.repartition(n, "o_orderkey")
    both = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    lat = (37 * F.col("l_orderkey") % 260) / F.lit(10.0) - F.lit(0.5)
    lon = (53 * F.col("l_orderkey") % 45) / F.lit(10.0) - F.lit(0.2)
    depth = F.lit(41.0) * F.col("l_quantity")
    tax = F.round(F.lit(100.0) * F.col("l_tax")).cast("int")
    field = F.lit(30.0) + F.lit(0.05) * lat - F.lit(0.1) * lon - F.lit(0.013) * depth + (F.col("l_discount") - F.lit(0.05))
    qc = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4)
    return both.select(
        F.col("l_orderkey").alias("profile_id"), (F.col("o_custkey") % 200).cast("string").alias("wmo"), F.col("o_orderdate").alias("time"), lat.alias("lat"), lon.alias("lon"),
        depth.alias("depth"), F.when(tax != 8, field).alias("temp"), F.when(tax != 7, qc).cast("int").alias("temp_qc"),
        F.when(tax != 3, F.lit(34.0) + F.lit(0.001) * depth).alias("psal"), F.when(F.col("l_linestatus") == "O", 1).otherwise(3).cast("int").alias("psal_qc"),
        F.when(F.col("l_linestatus") == "O", "core").otherwise("bgc").alias("source_id"), F.col("l_linenumber").alias("n"),
    )


LEVELS = """
levels AS (SELECT l_orderkey AS profile_id, CAST(o_custkey % 200 AS VARCHAR) AS wmo, o_orderdate AS time, plat AS lat, plon AS lon, pdepth AS depth,
                  CASE WHEN tax <> 8 THEN 30.0::DOUBLE + 0.05::DOUBLE*plat - 0.1::DOUBLE*plon - 0.013::DOUBLE*pdepth + (l_discount - 0.05::DOUBLE) END AS temp,
                  CASE WHEN tax <> 7 THEN CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 4 END END AS temp_qc,
                  CASE WHEN tax <> 3 THEN 34.0::DOUBLE + 0.001::DOUBLE*pdepth END AS psal, CASE l_linestatus WHEN 'O' THEN 1 ELSE 3 END AS psal_qc,
                  CASE l_linestatus WHEN 'O' THEN 'core' ELSE 'bgc' END AS source_id, l_linenumber AS n
           FROM (SELECT *, (37*l_orderkey % 260) / 10.0::DOUBLE - 0.5::DOUBLE AS plat, (53*l_orderkey % 45) / 10.0::DOUBLE - 0.2::DOUBLE AS plon,
                        41.0::DOUBLE*l_quantity AS pdepth, CAST(round(100.0::DOUBLE*l_tax) AS INTEGER) AS tax
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey))
"""

#: Expressions shared by the colocation queries: brackets of the grid's axes and the seven refusal reasons in order.
PAIRS = f"""
WITH {GRID}, {LEVELS},
heads AS (SELECT DISTINCT profile_id, time, lat, lon FROM levels),
near AS (SELECT h.*, s.t_idx, abs(epoch_us(h.time) - epoch_us(s.time)) / 1e6::DOUBLE AS t_gap,
                row_number() OVER (PARTITION BY profile_id ORDER BY abs(epoch_us(h.time) - epoch_us(s.time)), s.t_idx) AS r
         FROM heads h, steps s),
pos AS (SELECT profile_id, t_idx, t_gap, lat AS p_lat, lon AS p_lon, t_gap > 5*86400 AS late, lat < 0 OR lat > 24 OR lon < 0 OR lon > 4 AS outside,
               greatest(CAST(ceil(lat) AS INTEGER) - 1, 0) AS j0, CAST(ceil(lat) AS INTEGER) AS j1, greatest(CAST(ceil(lon) AS INTEGER) - 1, 0) AS i0, CAST(ceil(lon) AS INTEGER) AS i1
        FROM near WHERE r = 1),
lv AS (SELECT l.*, p.* EXCLUDE (profile_id), CASE WHEN l.depth < 40 OR l.depth > 2000 THEN NULL ELSE greatest(CAST(ceil(l.depth / 40.0::DOUBLE) AS INTEGER) - 2, 0) END AS k0,
              CASE WHEN l.depth < 40 OR l.depth > 2000 THEN NULL ELSE CAST(ceil(l.depth / 40.0::DOUBLE) AS INTEGER) - 1 END AS k1,
              CASE WHEN j1 = 0 THEN 0.0::DOUBLE ELSE p_lat - j0 END AS fy, CASE WHEN i1 = 0 THEN 0.0::DOUBLE ELSE p_lon - i0 END AS fx
       FROM levels l JOIN pos p USING (profile_id)),
val AS (SELECT lv.*, CASE WHEN lv.k1 = 0 THEN 0.0::DOUBLE ELSE (lv.depth - 40.0::DOUBLE*(lv.k0 + 1)) / 40.0::DOUBLE END AS fz,
               {{corner}}
        FROM lv {{joins}}),
both_ AS (SELECT *, CASE WHEN (w00 <> 0 AND (a00 IS NULL OR b00 IS NULL)) OR (w01 <> 0 AND (a01 IS NULL OR b01 IS NULL)) OR (w10 <> 0 AND (a10 IS NULL OR b10 IS NULL)) OR (w11 <> 0 AND (a11 IS NULL OR b11 IS NULL)) THEN NULL
                    ELSE w00*coalesce(a00, 0) + w01*coalesce(a01, 0) + w10*coalesce(a10, 0) + w11*coalesce(a11, 0) END AS lo,
                  w00*coalesce(b00, 0) + w01*coalesce(b01, 0) + w10*coalesce(b10, 0) + w11*coalesce(b11, 0) AS hi
          FROM (SELECT *, (1-fy)*(1-fx) AS w00, (1-fy)*fx AS w01, fy*(1-fx) AS w10, fy*fx AS w11 FROM val)),
pairs AS (SELECT profile_id, wmo, time, lat, lon, depth, temp, temp_qc, t_idx, t_gap, lo + fz*(hi - lo) AS modelled,
                 CASE WHEN late THEN 'no_model_time' WHEN outside THEN 'outside_grid' WHEN temp IS NULL THEN 'no_observation' WHEN temp_qc IS NULL THEN 'no_qc_flag'
                      WHEN temp_qc NOT IN (1, 2) THEN 'rejected_qc' WHEN k1 IS NULL THEN 'outside_depth_range' WHEN lo IS NULL THEN 'missing_stencil' END AS reason,
                 lo + fz*(hi - lo) - temp AS residual
          FROM both_)
""".format(  # noqa: UP032
    corner=", ".join(f"{p}{c}.temp AS {p}{c}" for p in "ab" for c in ("00", "01", "10", "11")),
    joins=" ".join(f"LEFT JOIN grid {p}{c} ON {p}{c}.t_idx = lv.t_idx AND {p}{c}.j = lv.j{c[0]} AND {p}{c}.i = lv.i{c[1]} AND {p}{c}.k_idx = lv.k{k}" for p, k in (("a", 0), ("b", 1)) for c in ("00", "01", "10", "11")),
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings (station_id, seq, ts, temp_c, tds_ppm, turbidity_ntu, received_at), with some sudden rises and falls."""
    e = table(spark, sf_dir, "events")
    temp = F.when(F.col("event_id") % 37 == 0, 150.0).when(F.col("event_id") % 41 == 0, -40.0).when(F.col("event_id") % 997 == 500, 95.0).when(F.col("event_id") % 997 == 250, -4.9).when(F.col("event_type") == "error", None).otherwise(F.col("value") / F.lit(10.0))
    return e.select(
        F.concat(F.lit("st"), (F.col("user_id") % 10).cast("string")).alias("station_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"),
        temp.alias("temp_c"), (F.col("event_id") % 700 * F.lit(100.0)).alias("tds_ppm"), (F.col("user_id") % 45 * F.lit(100.0)).alias("turbidity_ntu"), F.col("ts").alias("received_at"),
    )


READINGS = """
readings AS (SELECT 'st' || CAST(user_id % 10 AS VARCHAR) AS station_id, event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts,
                    CASE WHEN event_id % 37 = 0 THEN 150.0::DOUBLE WHEN event_id % 41 = 0 THEN -40.0::DOUBLE WHEN event_id % 997 = 500 THEN 95.0::DOUBLE WHEN event_id % 997 = 250 THEN -4.9::DOUBLE WHEN event_type = 'error' THEN NULL ELSE value / 10.0::DOUBLE END AS temp_c,
                    event_id % 700 * 100.0::DOUBLE AS tds_ppm, user_id % 45 * 100.0::DOUBLE AS turbidity_ntu, ts AS received_at FROM events)
"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazard alerts with one info block in two languages and a ring of four points."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    kind = F.when(F.col("event_type").isin("click", "view"), "Alert").when(F.col("event_type") == "signup", "Update").when(F.col("event_type") == "purchase", "Cancel").otherwise("Ack")
    status = F.when(F.col("k") % 10 == 0, "Exercise").when(F.col("k") % 10 == 1, "Test").otherwise("Actual")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.col("k") % len(v) + 1)
    x, y = (F.col("user_id") % 60) * F.lit(1.0) + 60, (F.col("user_id") % 30) * F.lit(1.0)
    ring = F.array(*[F.struct((x + a).alias("lon"), (y + b).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))])
    return e.select(
        F.col("event_id").cast("string").alias("identifier"), F.col("event_id").alias("seq"), F.col("ts").alias("sent"), status.alias("status"), kind.alias("msg_type"),
        F.array((F.col("event_id") - 1 - F.col("k") % 5).cast("string")).alias("references"), F.col("ts").alias("effective"),
        F.when(F.col("k") % 7 != 3, F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("k") + 1) * 3600)).alias("expires"),
        pick("Extreme", "Severe", "Moderate", "Minor", "odd").alias("severity"), pick("Immediate", "Expected", "Future").alias("urgency"), ring.alias("ring"),
        (F.col("k") * F.lit(3.0)).alias("radius_km"), (x + 0.5).alias("c_lon"), (y + 0.5).alias("c_lat"), F.col("k"),
    )


ALERTS = """
ev AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
alerts AS (SELECT CAST(event_id AS VARCHAR) AS identifier, event_id AS seq, ts AS sent, CASE k % 10 WHEN 0 THEN 'Exercise' WHEN 1 THEN 'Test' ELSE 'Actual' END AS status,
                  CASE WHEN event_type IN ('click', 'view') THEN 'Alert' WHEN event_type = 'signup' THEN 'Update' WHEN event_type = 'purchase' THEN 'Cancel' ELSE 'Ack' END AS msg_type,
                  CAST(event_id - 1 - k % 5 AS VARCHAR) AS ref, ts AS effective,
                  CASE WHEN k % 7 <> 3 THEN date_trunc('second', ts) + (k + 1) * INTERVAL 1 HOUR END AS expires,
                  list_value('Extreme', 'Severe', 'Moderate', 'Minor', 'odd')[k % 5 + 1] AS severity, list_value('Immediate', 'Expected', 'Future')[k % 3 + 1] AS urgency,
                  (user_id % 60) * 1.0::DOUBLE + 60 AS x, (user_id % 30) * 1.0::DOUBLE AS y, k * 3.0::DOUBLE AS radius_km, k FROM ev)
"""
