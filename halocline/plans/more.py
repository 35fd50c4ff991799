"""Registered queries over alerts, sensors, claims, derived products and ingest, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import ocean
from ..ledger import ledger, stored
from ..operators import alerts as al, claims as cl, columns as cc, derived as de, fields as fl
from ..operators.ranks import placed
from ..session import shared_dir
from ..sources import bulletins as bu, casts as ca, floats as fo, gridded as gr, readers, text_casts as tx
from ..streaming import alertfeed as af, readings as st, stateful as sm
from .inputs import ALERTS, GRID, LEVELS, READINGS, alerts, grid, levels, readings, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AT = datetime(2024, 1, 16)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- alerts ----------------------------------------------------------------------------------------------------------

RESOLVED = f"""WITH {ALERTS}, x AS (SELECT a.*, EXISTS (SELECT 1 FROM alerts b WHERE b.msg_type = 'Cancel' AND b.ref = a.identifier) AS c, EXISTS (SELECT 1 FROM alerts b WHERE b.msg_type = 'Update' AND b.ref = a.identifier) AS u FROM alerts a),
r AS (SELECT *, CASE WHEN c THEN 'cancelled' WHEN u THEN 'superseded' WHEN msg_type NOT IN ('Alert', 'Update') THEN 'not_a_warning' WHEN status <> 'Actual' THEN 'not_actual'
WHEN effective > TIMESTAMP '2024-01-16' THEN 'not_yet_effective' WHEN expires <= TIMESTAMP '2024-01-16' THEN 'expired' END AS reason FROM x)
"""
RANK = "CASE severity WHEN 'Extreme' THEN 4 WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END"
URG = "CASE urgency WHEN 'Immediate' THEN 0 WHEN 'Expected' THEN 1 WHEN 'Future' THEN 2 WHEN 'Past' THEN 3 ELSE 4 END"


@query(RESOLVED + "SELECT identifier, reason FROM r")
def j9_resolve_alerts(spark, sf):
    return al.resolved(alerts(spark, sf), AT).select("identifier", "reason")


@query(RESOLVED + """, n AS (SELECT unnest(['live','cancelled','superseded','not_a_warning','not_actual','not_yet_effective','expired']) AS reason)
SELECT n.reason, count(r.identifier) AS n FROM n LEFT JOIN r ON coalesce(r.reason, 'live') = n.reason GROUP BY 1""")  # fmt: skip
def f11_alert_ledger(spark, sf):
    return al.refusals(al.resolved(alerts(spark, sf), AT))


@query(RESOLVED.replace("status <> 'Actual'", "status NOT IN ('Actual', 'Exercise')") + "SELECT status, count(*) AS n FROM r WHERE reason IS NULL GROUP BY 1")
def f13_drill_gate(spark, sf):
    return al.resolved(alerts(spark, sf), AT, exercises=True).where("reason is null").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(RESOLVED + f"SELECT identifier, row_number() OVER (ORDER BY {RANK} DESC, {URG}, expires ASC NULLS LAST, seq) AS place FROM r WHERE reason IS NULL")
def o1_alert_order(spark, sf):
    live = al.resolved(alerts(spark, sf), AT).where("reason is null")
    return al.ordered(live).select("identifier", F.col("place").cast("long").alias("place"))


@query(f"WITH {ALERTS} SELECT identifier FROM alerts WHERE (x BETWEEN 70 AND 80 OR x + 1 BETWEEN 70 AND 80) AND (y BETWEEN 5 AND 15 OR y + 1 BETWEEN 5 AND 15) AND ((x BETWEEN 70 AND 80 AND y BETWEEN 5 AND 15) OR (x + 1 BETWEEN 70 AND 80 AND y BETWEEN 5 AND 15) OR (x + 1 BETWEEN 70 AND 80 AND y + 1 BETWEEN 5 AND 15)) OR (x + 0.5::DOUBLE BETWEEN 70 - radius_km / 111.0::DOUBLE AND 80 + radius_km / 111.0::DOUBLE AND y + 0.5::DOUBLE BETWEEN 5 - radius_km / 111.0::DOUBLE AND 15 + radius_km / 111.0::DOUBLE)")
def f12_alert_box(spark, sf):
    hit = al.touches((70.0, 5.0, 80.0, 15.0), F.col("ring"), F.col("c_lon"), F.col("c_lat"), F.col("radius_km"))
    return alerts(spark, sf).where(hit).select("identifier")


@query(RESOLVED + "SELECT count(*) AS n, count(*) FILTER (status = 'Exercise') AS n_exercise, count(*) FILTER (x > 90) AS n_outside, 4 * count(*) AS n_vertices FROM r WHERE reason IS NULL")
def a21_layer_totals(spark, sf):
    live = al.resolved(alerts(spark, sf), AT).where("reason is null")
    return live.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Exercise").alias("n_exercise"), F.count_if(F.get("ring", F.lit(0))["lon"] > 90).alias("n_outside"), F.sum(F.size("ring")).alias("n_vertices"))


@query(f"WITH {ALERTS} SELECT severity, {RANK} AS rank, CASE WHEN severity = 'odd' THEN 'Unknown' ELSE severity END AS folded, {URG} AS urgency_index, count(*) AS n FROM alerts GROUP BY ALL")
def x7_severity_rank(spark, sf):
    rows = alerts(spark, sf).select("severity", al.severity_rank(F.col("severity")).alias("rank"), al.folded(F.col("severity"), al.SEVERITY).alias("folded"), al.urgency_index(F.col("urgency")).alias("urgency_index"))
    return rows.groupBy("severity", "rank", "folded", "urgency_index").agg(F.count(F.lit(1)).alias("n"))


STAMP = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'soon' END"


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def x9_alert_time(spark, sf):
    e = table(spark, sf, "events")
    plain = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(plain, F.lit("+05:30"))).when(F.col("event_id") % 4 == 1, F.concat(plain, F.lit("Z"))).when(F.col("event_id") % 4 == 2, plain).otherwise("soon")
    return e.select("event_id", al.parsed_time(text).alias("at"))


def xml_docs(spark, sf) -> DataFrame:
    """Alert documents written from the events, with some that can't be read."""
    a = alerts(spark, sf)
    iso = F.date_format(F.col("sent").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ring = F.array_join(F.transform("ring", lambda p: F.concat_ws(",", p["lat"].cast("string"), p["lon"].cast("string"))), " ")
    info = lambda lang: F.format_string("<cap:info><cap:language>" + lang + "</cap:language><cap:event>Surge</cap:event><cap:urgency>%s</cap:urgency><cap:severity>%s</cap:severity><cap:certainty>Likely</cap:certainty><cap:effective>%s</cap:effective><cap:area><cap:areaDesc>coast</cap:areaDesc><cap:polygon>%s</cap:polygon><cap:circle>%s,%s %s</cap:circle></cap:area></cap:info>", "urgency", "severity", iso, ring, "c_lat", "c_lon", "radius_km")
    body = F.format_string("<cap:alert xmlns:cap=\"urn:oasis:names:tc:emergency:cap:1.2\"><cap:identifier>%s</cap:identifier><cap:sender>node</cap:sender><cap:sent>%s</cap:sent><cap:status>%s</cap:status><cap:msgType>%s</cap:msgType><cap:scope>Public</cap:scope><cap:references>node,%s,%s</cap:references>%s%s</cap:alert>", "identifier", iso, "status", "msg_type", F.get("references", F.lit(0)), iso, F.when(F.col("seq") % 50 != 1, info("en-IN")).otherwise(""), F.when(F.col("seq") % 50 != 1, info("hi-IN")).otherwise(""))
    return a.select(F.col("identifier").alias("file"), F.when(F.col("seq") % 97 == 0, "<other><thing/></other>").otherwise(body).alias("xml"))


@query(f"""WITH {ALERTS} SELECT identifier, status, msg_type, ref AS reference, CASE WHEN severity = 'odd' THEN 'Unknown' ELSE severity END AS severity, date_trunc('second', sent) AS sent, 2 AS n_infos, 4 AS n_vertices, CASE WHEN radius_km > 0 THEN 1 ELSE 0 END AS n_circles FROM alerts WHERE seq % 97 <> 0 AND seq % 50 <> 1""")
def s13_alert_ingest(spark, sf):
    a, _ = bu.alerts(xml_docs(spark, sf))
    first = F.get(F.get("infos", F.lit(0))["areas"], F.lit(0))
    return a.select("identifier", "status", "msg_type", F.get("references", F.lit(0)).alias("reference"), F.get("infos", F.lit(0))["severity"].alias("severity"), "sent", F.size("infos").alias("n_infos"), F.size(F.get(first["polygons"], F.lit(0))).alias("n_vertices"), F.size(first["circles"]).alias("n_circles"))


@query(f"WITH {ALERTS} SELECT CASE WHEN seq % 97 = 0 THEN 'not_an_alert' ELSE 'no_info' END AS reason, count(*) AS n FROM alerts WHERE seq % 97 = 0 OR seq % 50 = 1 GROUP BY 1")
def s13_unreadable_ledger(spark, sf):
    return bu.alerts(xml_docs(spark, sf))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ALERTS}, a AS (SELECT * FROM alerts WHERE seq % 97 <> 0 AND seq % 50 <> 1) SELECT count(*) AS n_alerts, count(*) FILTER (status = 'Exercise') AS n_exercises, 8 * count(*) AS n_vertices FROM a")
def s23_alert_totals(spark, sf):
    return bu.totals(bu.alerts(xml_docs(spark, sf))[0])


@query(f"WITH {ALERTS} SELECT identifier, CASE WHEN seq % 3 = 0 THEN 'hi-IN' ELSE 'en-IN' END AS picked FROM alerts WHERE seq % 97 <> 0 AND seq % 50 <> 1")
def j12_language_block(spark, sf):
    a, _ = bu.alerts(xml_docs(spark, sf))
    picked = F.when(F.col("identifier").cast("long") % 3 == 0, al.block_for(F.col("infos"), "hi")["language"]).when(F.col("identifier").cast("long") % 3 == 1, al.block_for(F.col("infos"), "en-IN")["language"]).otherwise(al.block_for(F.col("infos"), "fr")["language"])
    return a.select("identifier", picked.alias("picked"))


RING_TEXT = "CASE event_id % 5 WHEN 0 THEN '10,80 11,81 12,80' WHEN 1 THEN '10,80 11,81 12,80 10,80' WHEN 2 THEN '10,80 x,81 12,80' WHEN 3 THEN '95,80 11,81 12,80' ELSE '10,80 11,81' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 4 END AS n_points, CASE WHEN event_id % 3 = 0 THEN CAST(user_id + 1 AS DOUBLE) END AS radius FROM events")
def s14_rings_and_circles(spark, sf):
    e = table(spark, sf, "events")
    pick = F.element_at(F.array(*[F.lit(x) for x in ("10,80 11,81 12,80", "10,80 11,81 12,80 10,80", "10,80 x,81 12,80", "95,80 11,81 12,80", "10,80 11,81")]), (F.col("event_id") % 5 + 1).cast("int"))
    circle = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.5,80.25 "), (F.col("user_id") + 1).cast("string"))).when(F.col("event_id") % 3 == 1, F.lit("10.5,80.25 -4")).otherwise(F.lit("10.5,80.25 wide"))
    return e.select("event_id", F.size(al.ring_of(pick)).alias("n_points"), al.circle_of(circle)["radius_km"].alias("radius"))


@query(f"WITH {ALERTS} SELECT identifier, CASE WHEN seq % 2 = 0 THEN 1 WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS n_rings FROM alerts")
def s16_sidecar_geometry(spark, sf):
    """Every third alert has a sidecar, with its ring twice; every second has rings of its own."""
    a = alerts(spark, sf)
    rows = a.select("identifier", F.when(F.col("seq") % 2 == 0, F.array("ring")).otherwise(F.array().cast("array<array<struct<lon:double,lat:double>>>")).alias("rings"))
    side = a.where("seq % 3 = 0").select("identifier", F.array("ring", "ring").alias("rings"))
    return bu.with_sidecars(rows, side).select("identifier", F.coalesce(F.size("rings"), F.lit(0)).alias("n_rings"))


@query("SELECT event_id AS guid FROM events ORDER BY event_id DESC LIMIT 25")
def o4_newest(spark, sf):
    """A top-k report: the newest 25."""
    return table(spark, sf, "events").select(F.col("event_id").alias("guid")).orderBy(F.desc("guid")).limit(25)


@query()
def g5_simplify_rings(spark, sf):
    """Rings of the orders of each customer's nation, one vertex per order day: some are longer than the threshold."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.select(F.col("c_nationkey").alias("ring"), F.col("o_orderdate").alias("d"), "o_orderkey")
    p = placed(p, [F.col("ring"), F.col("d"), F.col("o_orderkey")], "place")
    first = p.groupBy("ring").agg(F.min("place").alias("first"))
    p = p.join(first, "ring").withColumn("idx", F.col("place") - F.col("first") + 1).withColumns({"lon": F.col("idx") * 0.002, "lat": F.sin(F.col("idx") / 90.0) * 0.1})
    p = p.select("ring", "idx", "lon", "lat")
    before = p.groupBy("ring").agg(F.count(F.lit(1)).alias("n_before"))
    return before.join(al.simplified(p).groupBy("ring").agg(F.count(F.lit(1)).alias("n_after")), "ring")


# ---- sensors ---------------------------------------------------------------------------------------------------------

REASON_SQL = f"""WITH {READINGS}, r AS (SELECT *, CASE WHEN temp_c IS NULL THEN 'no_temp_c' WHEN temp_c < -5 OR temp_c > 100 THEN 'temp_c_out_of_range' WHEN tds_ppm > 60000 THEN 'tds_ppm_out_of_range' WHEN turbidity_ntu > 4000 THEN 'turbidity_ntu_out_of_range' END AS reason FROM readings)
"""


@query(REASON_SQL + "SELECT seq, reason FROM r")
def r1_validate(spark, sf):
    return readings(spark, sf).select("seq", st.reason().alias("reason"))


@query(f"WITH {READINGS} SELECT seq, CASE WHEN ts IS NULL THEN 'server' ELSE 'device' END AS ts_source, coalesce(ts, received_at) AS ts FROM readings")
def r2_stamp(spark, sf):
    return st.stamped(readings(spark, sf), F.col("received_at")).select("seq", "ts_source", "ts")


TRIP_SQL = REASON_SQL + """, ok AS (SELECT * FROM r WHERE reason IS NULL), h AS (SELECT *, count(temp_c) OVER w AS n_before, avg(temp_c) OVER w AS mean_before, stddev_pop(temp_c) OVER w AS std_before FROM ok WINDOW w AS (PARTITION BY station_id ORDER BY seq ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING))
"""


@query(TRIP_SQL + "SELECT seq, n_before, round(mean_before, 6) AS mean_before, round(std_before, 6) AS std_before FROM h")
def w7_trailing_stats(spark, sf):
    ok = readings(spark, sf).withColumn("reason", st.reason()).where("reason is null")
    return st.history(ok).select("seq", "n_before", F.round("mean_before", 6).alias("mean_before"), F.round("std_before", 6).alias("std_before"))


TRIPPED = "n_before + 1 >= 13 AND temp_c - mean_before >= 1.5 AND (std_before = 0 OR temp_c - mean_before >= 6 * std_before)"


@query(TRIP_SQL + f"SELECT seq, station_id, round(temp_c - mean_before, 3) AS delta FROM h WHERE {TRIPPED}")
def r3_threshold_alert(spark, sf):
    ok = readings(spark, sf).withColumn("reason", st.reason()).where("reason is null")
    return st.threshold_alerts(ok).where("tripped").select("seq", "station_id", F.round("delta", 3).alias("delta"))


@query(f"WITH {READINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY seq DESC) AS p FROM readings) SELECT station_id, seq, temp_c FROM n WHERE p <= 500")
def w8_last_readings(spark, sf):
    return st.last_readings(readings(spark, sf)).select("station_id", "seq", "temp_c")


@query(REASON_SQL + """, s AS (SELECT station_id, min(temp_c) AS a, max(temp_c) AS b, min({'seq': seq, 'ts': received_at}) AS f, max({'seq': seq, 'ts': received_at}) AS l FROM r WHERE reason IS NULL GROUP BY 1)
SELECT station_id, round((a + b) / 2 - greatest((b - a) / 2, 0.1::DOUBLE), 4) AS lo, round((a + b) / 2 + greatest((b - a) / 2, 0.1::DOUBLE), 4) AS hi, CAST(floor(epoch(l.ts)) AS BIGINT) - CAST(floor(epoch(f.ts)) AS BIGINT) AS elapsed FROM s""")  # fmt: skip
def a24_trend_span(spark, sf):
    ok = readings(spark, sf).withColumn("reason", st.reason()).where("reason is null").withColumn("ts", F.col("received_at").cast("timestamp"))
    return st.span(ok)


@query(f"WITH {READINGS} SELECT time_bucket(INTERVAL 1 HOUR, received_at) AS start, station_id, count(*) AS n, round(avg(temp_c), 6) AS mean FROM readings GROUP BY 1, 2")
def r5_hourly_summary(spark, sf):
    return st.tumbling(readings(spark, sf).withColumn("ts", F.col("received_at").cast("timestamp")))


@query(RESOLVED.replace("2024-01-16", "2024-01-08") + "SELECT coalesce(reason, 'live') AS reason, count(*) AS n FROM r GROUP BY 1")
def r4_alerts_at_instant(spark, sf):
    r = al.resolved(alerts(spark, sf), datetime(2024, 1, 8))
    return r.groupBy(F.coalesce("reason", F.lit("live")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- claims ----------------------------------------------------------------------------------------------------------

NUMS = "[replace(x, ',', '') for x in regexp_extract_all({}, '\\d[\\d,]*(?:\\.\\d+)?')]"


@query(f"SELECT page_id AS id, array_to_string(list_sort([y for y in list_distinct({NUMS.format('html')}) if NOT list_contains({NUMS.format('url')}, y)]), ',') AS unbacked, len([y for y in list_distinct({NUMS.format('html')}) if NOT list_contains({NUMS.format('url')}, y)]) AS n_unbacked FROM pages")
def f18_unbacked_numerals(spark, sf):
    p = table(spark, sf, "pages")
    return cl.unbacked(p.select(F.col("page_id").alias("id"), F.col("html").alias("text")), p.select(F.col("page_id").alias("id"), F.col("url").alias("text")))


@query(f"SELECT page_id AS id, array_to_string(list_sort([y for y in list_distinct({NUMS.format('html')}) if NOT contains(replace(url, ',', ''), y)]), ',') AS unbacked, len([y for y in list_distinct({NUMS.format('html')}) if NOT contains(replace(url, ',', ''), y)]) AS n_unbacked FROM pages")
def f19_unbacked_substring(spark, sf):
    p = table(spark, sf, "pages")
    return cl.unbacked_substring(p.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.col("url").alias("hay")))


@query(f"SELECT doc_id, array_to_string({NUMS.format('text')}, '|') AS numerals FROM documents")
def x17_numerals(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(cl.numerals(F.col("text")), "|").alias("numerals"))


# ---- derived products ------------------------------------------------------------------------------------------------

UNITS = {"temp": "degC", "sal": "1"}


@query(f"""WITH {GRID}, wet AS (SELECT t_idx, j, i, count(temp) AS w FROM grid GROUP BY ALL), p AS (SELECT *, lead(temp) OVER (PARTITION BY t_idx, j, i ORDER BY k_idx) AS v2 FROM grid)
SELECT (SELECT count(*) FROM wet) AS n_cells, count(DISTINCT (t_idx, j, i)) FILTER (temp >= 26 AND v2 < 26) AS n_valid, 0 AS n_infinite, 0 AS n_on_dry, 0 AS n_surplus, 0 AS n_absent FROM p""")  # fmt: skip
def e5_contract_check(spark, sf):
    g = grid(spark, sf)
    return de.violations(g, de.run(g, "d26", UNITS), "d26")


@query(f"WITH {GRID} SELECT count(*) AS n_cells, count(temp) AS n_valid FROM grid")
def a19_valid_cells(spark, sf):
    g = grid(spark, sf)
    return de.run(g, "sigma0", UNITS).agg(F.count(F.lit(1)).alias("n_cells"), F.count("sigma0").alias("n_valid"))


@query()
def x3_sigma0(spark, sf):
    return de.run(grid(spark, sf), "sigma0", UNITS).select("t_idx", "k_idx", "j", "i", F.round("sigma0", 4).alias("sigma0"))


@query()
def x4_sound_speed(spark, sf):
    return de.run(grid(spark, sf), "sound", UNITS).select("t_idx", "k_idx", "j", "i", F.round("sound", 4).alias("sound"))


@query(f"WITH {GRID} SELECT unnest(['d26', 'sigma0', 'sound']) AS product, max(t_idx) * 0 AS shadowed FROM grid")
def e3_offered(spark, sf):
    g = grid(spark, sf)
    names = spark.createDataFrame([(n,) for n in de.offered(g)], "product string")
    return names.join(F.broadcast(g.agg((F.max("t_idx") * 0).alias("shadowed"))))


@query(f"WITH {GRID}, p AS (SELECT *, lead(temp) OVER w AS v2, lead(depth) OVER w AS z2 FROM grid WINDOW w AS (PARTITION BY t_idx, j, i ORDER BY k_idx)) SELECT t_idx, j, i, round(arg_min(depth + (temp - 26) / (temp - v2) * (z2 - depth), k_idx) FILTER (temp >= 26 AND v2 < 26), 4) AS d26 FROM p GROUP BY ALL")
def e4_run_product(spark, sf):
    return de.run(grid(spark, sf), "d26", UNITS).select("t_idx", "j", "i", F.round("d26", 4).alias("d26"))


@query(f"WITH {GRID} SELECT t_idx, k_idx, j, i, round(temp, 4) AS temp, round(sal, 4) AS sal FROM grid")
def j13_input_assembly(spark, sf):
    """Stored variables of a product come from separate tables on the same cells."""
    g = grid(spark, sf)
    keys = ["t_idx", "k_idx", "j", "i"]
    return g.select(*keys, F.round("temp", 4).alias("temp")).join(g.select(*keys, F.round("sal", 4).alias("sal")), keys)


DEPTH_SQL = "(2 * c / (b + sqrt(b*b - 4*(-0.5::DOUBLE*2.26e-7::DOUBLE*b)*c)))"


@query(f"""WITH {LEVELS}, q AS (SELECT profile_id, n, depth AS pres, lat, pow(sin(radians(lat)), 2) AS s, depth * 1e-4::DOUBLE AS q FROM levels), b AS (SELECT *, 9.780327::DOUBLE*(1 + (5.2792e-3::DOUBLE + 2.32e-5::DOUBLE*s)*s) AS b,
1e8::DOUBLE*q*(9.726613854843870e-4::DOUBLE+q*(-2.252956605630465e-5::DOUBLE+q*(2.376909655387404e-6::DOUBLE+q*(-1.664294869986011e-7::DOUBLE+q*(-5.988108894465758e-9::DOUBLE+q*(-2.1078768810e-9::DOUBLE+2.8019291329e-10::DOUBLE*q)))))) AS c FROM q)
SELECT profile_id, n, round({DEPTH_SQL}, 3) AS depth FROM b""")  # fmt: skip
def x1_pressure_to_depth(spark, sf):
    return levels(spark, sf).select("profile_id", "n", F.round(ocean.depth_of(F.col("depth"), F.col("lat")), 3).alias("depth"))


@query(f"WITH {LEVELS} SELECT profile_id, n, round(depth, 3) AS depth FROM levels")
def x2_depth_to_pressure(spark, sf):
    """A round trip: the depth of the pressure of a depth."""
    p = ocean.pressure_of(F.col("depth"), F.col("lat"))
    return levels(spark, sf).withColumn("p", p).select("profile_id", "n", F.round(ocean.depth_of(F.col("p"), F.col("lat")), 3).alias("depth"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 THEN NULL ELSE round(l_quantity * 0.01::DOUBLE + 15, 4) END AS v FROM lineitem")
def n1_fill_and_unpack(spark, sf):
    """One line in four holds the packed fill and one a large sentinel; the rest is unpacked once."""
    raw = F.when(F.col("l_linenumber") % 4 == 0, F.lit(-32768.0)).when(F.col("l_linenumber") % 4 == 1, F.lit(9.9999999e34)).otherwise(F.col("l_quantity"))
    v = ocean.unpacked(ocean.unmasked(raw, (1.0e35, -9999.0)), 0.01, 15.0, -32768.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 4).alias("v"))


@query("SELECT p_partkey, p_size * 10.0::DOUBLE AS depth, round(p_retailprice - 273.15::DOUBLE, 4) AS temp FROM part")
def n3_normalise(spark, sf):
    """Depths declared up become positive down, kelvins degrees, metres by another spelling stay."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * -10.0).alias("ZAX"), F.col("p_retailprice").alias("T"))
    out = gr.normalised(p, {"ZAX": "depth", "T": "temp"}, {}, (-9999.0,), {"temp": ("K", "degC"), "depth": ("METERS", "m")}, "up")
    return out.select("p_partkey", "depth", F.round("temp", 4).alias("temp"))


@query("WITH a AS (SELECT DISTINCT p_partkey % 60 AS level, CAST(CASE WHEN p_partkey % 60 = 30 THEN NULL WHEN p_partkey % 60 = 41 THEN 40 ELSE p_partkey % 60 END AS DOUBLE) AS depth FROM part), f AS (SELECT level, depth, CASE WHEN depth IS NULL THEN 'not_finite' WHEN depth <= lag(depth) OVER (ORDER BY level) THEN 'not_increasing' END AS fault FROM a) SELECT * FROM f WHERE fault IS NOT NULL")
def n6_depth_faults(spark, sf):
    lev = F.col("p_partkey") % 60
    p = table(spark, sf, "part").select(lev.alias("level"), F.when(lev == 41, 40.0).when(lev != 30, lev.cast("double")).alias("depth"))
    return gr.depth_faults(p)


# ---- profile ingest --------------------------------------------------------------------------------------------------

FLOATS = f"{LEVELS}, per AS (SELECT profile_id, CAST(profile_id % 7 AS INTEGER) AS file, min(wmo) AS platform, min(time) AS time, min(lat) AS lat, min(lon) AS lon FROM levels GROUP BY profile_id)"


def float_files(spark, sf) -> DataFrame:
    """Nested profiles: one row per profile with arrays in level order; files 0 to 2 have adjusted temperatures."""
    lv = levels(spark, sf)
    item = F.struct("depth", "n", F.coalesce("temp", F.lit(-1e9)).alias("o"), "temp", "temp_qc", "psal", "psal_qc")
    per = lv.groupBy("profile_id").agg(F.sort_array(F.collect_list(item)).alias("z"), F.min("wmo").alias("platform"), F.min("time").alias("time"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    text = lambda x: x.cast("string")
    file = (F.col("profile_id") % 7).cast("int")
    return per.select(
        file.alias("file"), F.concat_ws("-", "platform", F.col("profile_id").cast("string")).alias("platform"), "time", "lat", "lon", F.transform("z", lambda x: x["depth"]).alias("pres"), F.transform("z", lambda x: F.when(x["n"] % 6 == 0, "4").otherwise("1")).alias("pres_qc"),
        F.transform("z", lambda x: x["temp"]).alias("temp"), F.transform("z", lambda x: text(x["temp_qc"])).alias("temp_qc"),
        F.transform("z", lambda x: F.when(file < 3, x["temp"] + 1)).alias("temp_adjusted"), F.transform("z", lambda x: text(x["temp_qc"])).alias("temp_adjusted_qc"),
        F.transform("z", lambda x: x["psal"]).alias("psal"), F.transform("z", lambda x: text(x["psal_qc"])).alias("psal_qc"), F.lit(None).cast("array<double>").alias("psal_adjusted"), F.lit(None).cast("array<string>").alias("psal_adjusted_qc"),
    )


@query(f"""WITH {FLOATS}, f AS (SELECT CAST(l.profile_id % 7 AS INTEGER) AS file, l.depth AS pres, l.n, CASE WHEN l.profile_id % 7 < 3 THEN temp + 1 ELSE temp END AS t, coalesce(temp_qc, 9) AS tq, psal AS s, psal_qc AS sq, l.profile_id FROM levels l WHERE n % 6 <> 0),
m AS (SELECT *, CASE WHEN tq IN (1, 2) THEN t END AS temp, CASE WHEN tq IN (1, 2) AND t IS NULL THEN 9 ELSE tq END AS temp_qc, CASE WHEN sq IN (1, 2) THEN s END AS psal, CASE WHEN sq IN (1, 2) AND s IS NULL THEN 9 ELSE sq END AS psal_qc FROM f)
SELECT pres, round(temp, 4) AS temp, temp_qc, round(psal, 4) AS psal, psal_qc FROM m WHERE temp IS NOT NULL OR psal IS NOT NULL""")  # fmt: skip
def s3_float_ingest(spark, sf):
    out = fo.levels(fo.adjusted(float_files(spark, sf), ["temp", "psal"]), ["temp", "psal"])
    return out.select("pres", F.round("temp", 4).alias("temp"), F.col("temp_qc").cast("int").alias("temp_qc"), F.round("psal", 4).alias("psal"), F.col("psal_qc").cast("int").alias("psal_qc"))


@query("""SELECT p_partkey AS file, 'temp' AS param, 'degC' AS want, CASE p_partkey % 4 WHEN 0 THEN 'degree_Celsius' WHEN 2 THEN 'kelvin' ELSE 'K' END AS have FROM part WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, 'psal', '1', 'g/kg' FROM part WHERE p_partkey % 4 = 3""")
def s5_unit_mismatch(spark, sf):
    """Of the temperatures only another case of the letters agrees; of the salinities all spellings of no unit do."""
    at = (F.col("p_partkey") % 4 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), at)
    p = table(spark, sf, "part")
    found = p.select(F.col("p_partkey").alias("file"), F.lit("temp").alias("param"), pick("degree_Celsius", "DegC", "kelvin", "K").alias("unit"))
    found = found.unionByName(p.select(F.col("p_partkey").alias("file"), F.lit("psal").alias("param"), pick("psu", "Practical Salinity_Units", "", "g/kg").alias("unit")))
    return fo.unit_mismatches(spark.createDataFrame([("temp", "degC"), ("psal", "1")], "param string, unit string"), found)


@query("SELECT s_suppkey AS wmo, CASE s_nationkey % 3 WHEN 0 THEN 'alpha' ELSE 'beta' END AS directory FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 3 < 2")
def s28_platform_discovery(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("wmo"), F.when(F.col("s_suppkey") % 2 == 0, "float BGC").otherwise("float").alias("kind"), (F.col("s_nationkey") * 1.0).alias("lat"), (F.col("s_nationkey") * 1.0).alias("lon"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("centre"), F.lit(1).alias("seq"))
    return fo.platforms(s, (0.0, 0.0, 30.0, 30.0), {"A": "alpha", "B": "beta"})


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'A' THEN 9 ELSE 4 END AS qc FROM lineitem")
def x14_qc_decode(spark, sf):
    c = F.when(F.col("l_returnflag") == "N", " 1").when(F.col("l_returnflag") == "A", "").otherwise("4 ")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ocean.qc_code(c).alias("qc"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') AS profile_id FROM orders")
def x15_profile_name(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ocean.profile_name(F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("timestamp")).alias("profile_id"))


CAST_SQL = f"""{LEVELS}, raw AS (SELECT CAST(profile_id % 11 AS INTEGER) AS file, profile_id AS cst, row_number() OVER (PARTITION BY profile_id ORDER BY n, depth, temp_qc, temp, source_id, psal) AS pos, depth AS z, temp, temp_qc, source_id FROM levels),
leg AS (SELECT * FROM (SELECT *, max(CASE WHEN file < 6 AND pos % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file) AS has FROM raw) WHERE has = 0 OR pos % 2 = 1),
ok AS (SELECT *, lag(z) OVER (PARTITION BY file, cst ORDER BY pos) AS before, row_number() OVER (PARTITION BY file, cst, z ORDER BY pos) AS nth FROM leg WHERE pos % 5 <> 0)
"""


def cast_rows(spark, sf) -> DataFrame:
    lv = levels(spark, sf)
    pos = F.row_number().over(W.partitionBy("profile_id").orderBy("n", "depth", F.col("temp_qc").asc_nulls_last(), F.col("temp").asc_nulls_last(), "source_id", F.col("psal").asc_nulls_last()))
    r = lv.withColumns({"file": (F.col("profile_id") % 11).cast("int"), "cast": F.col("profile_id"), "pos": pos})
    return r.select(
        "file", "cast", "pos", "lat", "lon", "time", F.when((F.col("file") < 6) & (F.col("pos") % 2 == 1), "D").otherwise("A").alias("direction"), F.when(F.col("pos") % 5 != 0, F.col("depth")).alias("pres"),
        F.when(F.col("pos") % 7 == 0, 4).otherwise(1).alias("pres_qc"), "temp", "temp_qc", "psal", "psal_qc", "source_id",
    )


@query(f"""WITH {CAST_SQL}, c AS (SELECT file, cst, max(CASE WHEN z <= before THEN 1 ELSE 0 END) AS back, count(*) FILTER (nth > 1) AS dup, max(pos) - min(pos) + 1 - count(*) AS gap, count(*) FILTER (pos % 7 = 0) AS bad, count(*) AS n FROM ok GROUP BY ALL)
SELECT file, count(*) AS n_casts, sum(gap) AS n_gaps, count(*) FILTER (back = 1) AS n_resorted, sum(dup) AS n_repeated, sum(bad) AS n_bad_pressure, sum(n) AS n_rows FROM c GROUP BY 1""")  # fmt: skip
def s9_cast_counters(spark, sf):
    return ca.cast_levels(cast_rows(spark, sf))[1]


@query(f"WITH {CAST_SQL} SELECT file, cst AS cast, pos, CASE WHEN pos % 7 = 0 THEN 4 ELSE coalesce(temp_qc, 9) END AS temp_qc FROM ok WHERE nth = 1")
def s9_cast_levels(spark, sf):
    return ca.cast_levels(cast_rows(spark, sf))[0].select("file", "cast", "pos", F.col("temp_qc").cast("int").alias("temp_qc"))


@query(f"WITH {CAST_SQL} SELECT file, count(*) AS n, count(temp) AS n_temp FROM ok WHERE nth = 1 AND temp IS NOT NULL AND pos % 7 <> 0 AND temp_qc IN (1, 2) GROUP BY 1")
def s12_cast_profiles(spark, sf):
    rows = ca.profile_rows(ca.cast_levels(cast_rows(spark, sf))[0])
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count("temp").alias("n_temp"))


MOOR = f"""{LEVELS}, mo AS (SELECT CAST(profile_id % 13 AS INTEGER) AS file, wmo AS station, time, depth, CASE WHEN profile_id % 13 = 5 THEN lat ELSE 1.0 END AS la, temp, n FROM levels)"""


def mooring_rows(spark, sf) -> DataFrame:
    f = F.col("profile_id") % 13
    lv = levels(spark, sf)
    return lv.select(
        f.cast("int").alias("file"), F.col("wmo").alias("station"), F.col("wmo").cast("double").alias("code"), "time", F.when(F.col("n") % 6 == 0, ca.MOORING_FILL).otherwise(F.col("depth")).alias("depth"),
        F.when(f == 5, F.col("lat")).otherwise(1.0).alias("lat"), F.lit(90.0).alias("lon"), F.when(F.col("n") % 4 == 0, ca.MOORING_FILL).otherwise(F.col("temp")).alias("temp"), (F.col("n") - 1).alias("qc"),
    )


@query(f"WITH {MOOR} SELECT file, station AS wmo, depth, round(CASE WHEN n % 4 = 0 THEN NULL ELSE temp END, 4) AS temp, CASE n - 1 WHEN 0 THEN 9 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 9 END AS temp_qc FROM mo WHERE n % 6 <> 0 AND file <> 5")
def s7_mooring_ingest(spark, sf):
    rows, _ = ca.mooring_levels(mooring_rows(spark, sf))
    return rows.select("file", "wmo", "depth", F.round("temp", 4).alias("temp"), F.col("temp_qc").cast("int").alias("temp_qc"))


@query(f"""WITH {GRID}, {MOOR}, d AS (SELECT DISTINCT station, time FROM mo WHERE n % 6 <> 0 AND file <> 5), x AS (SELECT station, s.t_idx, d.time, row_number() OVER (PARTITION BY station, s.t_idx ORDER BY abs(CAST(epoch(d.time) AS BIGINT) - CAST(epoch(s.time) AS BIGINT)), d.time) AS r FROM d, steps s)
SELECT DISTINCT station, time FROM x WHERE r = 1""")  # fmt: skip
def s8_mooring_subsample(spark, sf):
    from .inputs import steps

    rows, _ = ca.mooring_levels(mooring_rows(spark, sf))
    ax = steps(spark, sf).select(F.col("t_idx").alias("idx"), F.col("time").alias("node"))
    return ca.nearest_days(rows, ax).select("station", "time").distinct()


@query(f"WITH {CAST_SQL}, c AS (SELECT file, cst, count(*) FILTER (nth > 1) AS dup, count(*) AS n FROM ok GROUP BY ALL) SELECT CASE WHEN file % 2 = 0 THEN 'even' ELSE 'odd' END AS source_id, sum(dup) AS n_repeated, sum(n) AS n_rows FROM c GROUP BY 1")
def u2_pooled_counters(spark, sf):
    c = ca.cast_levels(cast_rows(spark, sf))[1].withColumn("source_id", F.when(F.col("file") % 2 == 0, "even").otherwise("odd"))
    return ca.pooled(c).select("source_id", "n_repeated", "n_rows")


# ---- text casts ------------------------------------------------------------------------------------------------------

FORMAT = tx.Format({"platform": ("station",), "time": ("date time",), "lat": ("latitude",), "lon": ("longitude",), "depth": (), "pres": ("pressure",), "temp": ("t90", "temperature"), "psal": ("salinity",), "flag": ("qf",)}, flags={"good": 1, "bad": 4})
TEXT_SQL = f"""{LEVELS}, tl AS (SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY depth, n, temp_qc, temp, source_id, psal) AS p, depth, temp, coalesce(temp_qc, 9) AS q, lat, lon, time, wmo, count(*) OVER (PARTITION BY profile_id) AS np FROM levels)
"""


def text_files(spark, sf) -> DataFrame:
    """One text per profile, in four delimiters; some without a position, some with a ragged line, some with a footer."""
    lv = levels(spark, sf)
    p = F.row_number().over(W.partitionBy("profile_id").orderBy("depth", "n", F.col("temp_qc").asc_nulls_last(), F.col("temp").asc_nulls_last(), "source_id", F.col("psal").asc_nulls_last()))
    k = F.col("profile_id")
    sep = F.element_at(F.array(F.lit("\t"), F.lit(";"), F.lit("|"), F.lit(",")), (k % 4 + 1).cast("int"))
    num = lambda c, d: F.format_string(f"%.{d}f", c)
    first = F.col("p") == 1
    lv = lv.withColumn("p", p)
    line = F.concat_ws(
        "\x01", F.when(first, F.concat(F.lit("ST"), "wmo")).otherwise(""), F.when(first, F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).otherwise(""),
        F.when(first & (k % 10 != 3), num(F.col("lat"), 4)).otherwise(""), F.when(first, num(F.col("lon"), 4)).otherwise(""), num(F.col("depth"), 1), F.when(F.col("temp").isNull(), "-999").otherwise(num(F.col("temp"), 4)),
        F.when(F.col("temp_qc").isNull(), "").when(F.col("temp_qc") == 1, "good").otherwise(F.col("temp_qc").cast("string")),
    )
    line = F.when((k % 10 == 7) & first, F.concat(line, F.lit("\x01extra"))).otherwise(line)
    per = lv.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("p", line.alias("l")))).alias("z"), F.count(F.lit(1)).alias("np"))
    sep = F.element_at(F.array(F.lit("\t"), F.lit(";"), F.lit("|"), F.lit(",")), (k % 4 + 1).cast("int"))
    head = F.lit("\x01".join(("Station", "Date Time", "Latitude", "Longitude", "Depth [m]", "T90", "QF")))
    foot = F.when(k % 10 == 5, F.lit("\nEnd of cast")).otherwise("")
    body = F.concat(F.lit("# ship = none\n"), head, F.lit("\n"), F.array_join(F.transform("z", lambda s: s["l"]), "\n"), foot)
    return per.select(F.concat(F.col("profile_id").cast("string"), F.lit(".txt")).alias("file"), F.replace(body, F.lit("\x01"), sep).alias("text"))


@query(TEXT_SQL and f"""WITH {TEXT_SQL} SELECT CAST(profile_id AS VARCHAR) || '.txt' AS file, round(depth, 1) AS depth, round(CASE WHEN q IN (1, 2) THEN temp END, 3) AS temp, CASE WHEN temp IS NULL AND q IN (1, 2) THEN 9 ELSE q END AS temp_qc
FROM tl WHERE np >= 1 AND profile_id % 10 NOT IN (3, 7) AND q IN (1, 2) AND temp IS NOT NULL""")  # fmt: skip
def s6_text_casts(spark, sf):
    lv, _, _ = tx.parse(text_files(spark, sf), FORMAT)
    return lv.select("file", F.round("depth", 1).alias("depth"), F.round("temp", 3).alias("temp"), F.col("temp_qc").cast("int").alias("temp_qc"))


@query(f"""WITH {TEXT_SQL}, f AS (SELECT DISTINCT profile_id, np FROM tl) SELECT CASE WHEN profile_id % 10 = 3 THEN 'station_without_position' ELSE 'ragged_lines' END AS reason, count(*) AS n FROM f WHERE profile_id % 10 = 3 OR (profile_id % 10 = 7 AND np > 1) GROUP BY 1""")
def t16_text_refusals(spark, sf):
    return tx.parse(text_files(spark, sf), FORMAT)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TEXT_SQL}, f AS (SELECT profile_id, any_value(np) AS np FROM tl GROUP BY 1) SELECT CASE profile_id % 4 WHEN 0 THEN 'tab' WHEN 1 THEN 'semicolon' WHEN 2 THEN 'pipe' ELSE 'comma' END AS delimiter, count(*) AS n_files, sum(np) AS n_data, sum(CASE WHEN profile_id % 10 = 5 THEN 1 ELSE 0 END) AS n_footer, sum(np - 1) AS inherited_time
FROM f WHERE profile_id % 10 NOT IN (3, 7) GROUP BY 1""")  # fmt: skip
def t21_text_record(spark, sf):
    r = tx.parse(text_files(spark, sf), FORMAT)[2]
    return r.groupBy("delimiter").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_data").alias("n_data"), F.sum("n_footer").alias("n_footer"), F.sum("inherited_time").alias("inherited_time"))


CRUISE = tx.Format({"platform": ("station",), "cast": (), "time": ("date time",), "lat": ("latitude",), "lon": ("longitude",), "depth": (), "temp": ("t90",), "flag": ("qf",), "qc": ("quality",)})
CRUISE_SQL = f"""WITH {TEXT_SQL}, st AS (SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY depth, n, temp_qc, temp, source_id, psal) AS p, n FROM levels),
f AS (SELECT profile_id // 8 AS f, count(DISTINCT profile_id) AS ns FROM levels GROUP BY 1)
"""


def cruise_files(spark, sf) -> DataFrame:
    """Texts of up to eight stations, by number: continuation rows that repeat the station but not the cast (1), a last station without
    latitude (2), a first one without name (3) or time (4), a sign-off with a number (5).  Every fifth level's depth is flagged bad."""
    lv = levels(spark, sf)
    f = F.floor(F.col("profile_id") / 8).cast("long")
    order = W.partitionBy("profile_id").orderBy("depth", "n", F.col("temp_qc").asc_nulls_last(), F.col("temp").asc_nulls_last(), "source_id", F.col("psal").asc_nulls_last())
    ends = lv.groupBy(f.alias("f")).agg(F.min("profile_id").alias("a"), F.max("profile_id").alias("b"))
    lv = lv.withColumns({"f": f, "p": F.row_number().over(order)}).join(ends, "f")
    first, kind, k = F.col("p") == 1, F.col("f") % 6, F.col("profile_id")
    num = lambda c, d: F.format_string(f"%.{d}f", c)
    line = F.concat_ws(
        ";", F.when(F.when(kind == 3, first & (k != F.col("a"))).otherwise(first | (kind == 1)), F.concat(F.lit("ST"), k.cast("string"))).otherwise(""), F.when(first, (k % 3 + 1).cast("string")).otherwise(""),
        F.when(first & ~((kind == 4) & (k == F.col("a"))), F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).otherwise(""),
        F.when(first & ~((kind == 2) & (k == F.col("b"))), num(F.col("lat"), 4)).otherwise(""), F.when(first, num(F.col("lon"), 4)).otherwise(""),
        num(F.col("depth"), 1), F.when(F.col("n") % 5 == 0, "4").otherwise("1"), F.when(F.col("temp").isNull(), "-999").otherwise(num(F.col("temp"), 4)), F.coalesce(F.col("temp_qc").cast("string"), F.lit("")),
    )
    per = lv.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("profile_id", "p", line.alias("l")))).alias("z"))
    body = F.concat(F.lit("# ship = none\nStation;Cast;Date Time;Latitude;Longitude;Depth [m];QF;T90;Quality\n"), F.array_join(F.transform("z", lambda s: s["l"]), "\n"), F.when(F.col("f") % 6 == 5, "\nlogger 3 off").otherwise(""))
    return per.select(F.concat(F.col("f").cast("string"), F.lit(".txt")).alias("file"), body.alias("text"))


@query(CRUISE_SQL + """SELECT CAST(f AS VARCHAR) || '.txt' AS file, CASE WHEN f % 6 = 3 THEN CAST(f AS VARCHAR) ELSE 'ST' || CAST(profile_id AS VARCHAR) END AS wmo, round(depth, 1) AS depth, round(temp, 3) AS temp, q AS temp_qc
FROM tl JOIN st USING (profile_id, p) JOIN f ON profile_id // 8 = f WHERE f % 6 NOT IN (2, 4) AND (f % 6 <> 3 OR ns = 1) AND n % 5 <> 0 AND temp IS NOT NULL AND q IN (1, 2)""")  # fmt: skip
def t20_cruise_levels(spark, sf):
    """Levels of files with several stations: each placed by its own station, with an accepted flag of depth and of the level."""
    lv, _, _ = tx.parse(cruise_files(spark, sf), CRUISE)
    return lv.select("file", "wmo", F.round("depth", 1).alias("depth"), F.round("temp", 3).alias("temp"), F.col("temp_qc").cast("int").alias("temp_qc"))


@query(CRUISE_SQL + "SELECT CASE f % 6 WHEN 2 THEN 'station_without_position' WHEN 3 THEN 'station_without_platform' ELSE 'station_without_time' END AS reason, count(*) AS n FROM f WHERE f % 6 IN (2, 4) OR (f % 6 = 3 AND ns > 1) GROUP BY 1")
def t16_cruise_refusals(spark, sf):
    return tx.parse(cruise_files(spark, sf), CRUISE)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- stores and streams ----------------------------------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {GRID} SELECT t_idx, k_idx, count(*) AS n_cells, count(temp) AS n_valid FROM grid GROUP BY 1, 2")
def s20_store_round_trip(spark, sf):
    path = scratch(spark, "store")
    gr.store(grid(spark, sf).withColumn("source_id", F.lit("analysis")), path)
    back = gr.load(spark, path, "analysis", {"analysis"})
    return back.groupBy("t_idx", "k_idx").agg(F.count(F.lit(1)).alias("n_cells"), F.count("temp").alias("n_valid"))


@query(f"WITH {GRID} SELECT source_id, k_idx, count(*) AS n_cells, round(avg(temp), 6) AS mean FROM (SELECT *, CASE WHEN t_idx % 2 = 0 THEN 'even' ELSE 'odd' END AS source_id FROM grid) WHERE source_id = 'odd' GROUP BY 1, 2")
def e2_registered_reader(spark, sf):
    """One of two stored sources, opened through the reader that its kind has."""
    assert readers.field is de.READERS["field"]
    path = scratch(spark, "sources")
    gr.store(grid(spark, sf).withColumn("source_id", F.when(F.col("t_idx") % 2 == 0, "even").otherwise("odd")), path)
    odd = de.opened(spark, "field", {"path": path, "source": "odd"})
    return odd.groupBy("source_id", "k_idx").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("temp"), 6).alias("mean"))


@query(REASON_SQL + """, n AS (SELECT unnest(['accepted', 'no_temp_c', 'temp_c_out_of_range', 'tds_ppm_out_of_range', 'turbidity_ntu_out_of_range']) AS reason), w AS (SELECT station_id, count(*) AS k FROM r WHERE reason IS NULL GROUP BY 1)
SELECT n.reason, count(r.seq) AS n, (SELECT sum(k) FROM w) AS n_stored FROM n LEFT JOIN r ON coalesce(r.reason, 'accepted') = n.reason GROUP BY 1""")  # fmt: skip
def r1_stored_ledger(spark, sf):
    """Accepted readings stored by station; the ledger of all readings is counted in the same pass, and stands beside what the table holds."""
    path = scratch(spark, "accepted")
    rows = readings(spark, sf).withColumn("reason", st.reason())
    counts = stored(rows, path, ["no_temp_c", "temp_c_out_of_range", "tds_ppm_out_of_range", "turbidity_ntu_out_of_range"], by=("station_id",))
    held = spark.read.schema("seq long, station_id string").parquet(path).agg(F.count(F.lit(1)).alias("n_stored"))
    return counts.join(F.broadcast(held))  # one row


@query(f"WITH {GRID} SELECT t_idx, k_idx, j, i, round(temp, 4) AS temp FROM grid WHERE t_idx BETWEEN 10 AND 30 AND k_idx BETWEEN 5 AND 20 AND j BETWEEN 2 AND 12 AND i BETWEEN 0 AND 3")
def s20_tiled_box(spark, sf):
    """A box of steps, levels, rows and columns, read from a field laid out along a space-filling curve."""
    path = scratch(spark, "tiles")
    gr.store_tiled(grid(spark, sf).select("t_idx", "k_idx", "j", "i", "temp").withColumn("source_id", F.lit("analysis")), path)
    box = gr.load_box(spark, path, "analysis", {"analysis"}, {"t_idx": (10, 30), "k_idx": (5, 20), "j": (2, 12), "i": (0, 3)})
    return box.select("t_idx", "k_idx", "j", "i", F.round("temp", 4).alias("temp"))


PROFILE_SQL = f"{LEVELS}, box AS (SELECT *, CASE WHEN source_id = 'core' THEN temp END AS t, CASE WHEN source_id = 'bgc' THEN psal END AS s FROM levels WHERE lat BETWEEN 2 AND 12 AND lon BETWEEN 0 AND 3 AND (source_id = 'bgc' OR time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'))"


@query(f"WITH {PROFILE_SQL} SELECT source_id, count(DISTINCT profile_id) AS n_profiles, count(*) AS n_levels, count(DISTINCT wmo) AS n_platforms, count(t) AS n_temp, count(s) AS n_psal FROM box GROUP BY 1")
def s21_profile_table(spark, sf):
    """Frames of two instrument classes, united by name, clipped to box and window (the archive is exempt), stored; its provenance."""
    lv = levels(spark, sf)
    both = lv.where("source_id = 'core'").drop("psal", "psal_qc").unionByName(lv.where("source_id = 'bgc'").drop("temp", "temp_qc"), allowMissingColumns=True)
    keep = (F.col("source_id") == "bgc") | F.col("time").between(F.lit(datetime(1996, 1, 1)), F.lit(datetime(1999, 1, 1)))
    path = scratch(spark, "profiles")
    fl.in_box(both, (0.0, 2.0, 3.0, 12.0)).where(keep).write.parquet(path)
    gr.write_provenance(gr.profiles(spark, path), f"{path}-provenance")
    return spark.read.schema("source_id string, n_profiles long, n_levels long, n_platforms long, n_temp long, n_psal long").json(f"{path}-provenance")


@query(TRIP_SQL + f"SELECT station_id, seq, round(temp_c - mean_before, 3) AS delta FROM h WHERE {TRIPPED}")
def r3_threshold_stream(spark, sf):
    """The stateful stream over a replay of the accepted readings, state kept per station; results land in a table."""
    path = scratch(spark, "readings")
    ok = readings(spark, sf).withColumn("reason", st.reason()).where("reason is null").select("station_id", "seq", "temp_c")
    st.replay_log(ok, f"{path}/in")
    stream = spark.readStream.schema(ok.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with sm.key_value_store(spark):
        q = sm.trip_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(sm.TRIPS).parquet(f"{path}/out").withColumn("delta", F.round("delta", 3))


LATE_SQL = REASON_SQL + """, a AS (SELECT station_id, seq, temp_c, epoch_us(received_at) AS us, epoch_us(received_at) + (seq * 37 % 180) * 60000000 AS arrival FROM r WHERE reason IS NULL),
s AS (SELECT *, us - us % 3600000000 AS start, max(us) OVER (PARTITION BY station_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told, max(us) OVER (PARTITION BY station_id) AS last FROM a),
k AS (SELECT *, CASE WHEN start + 4200000000 <= told THEN 'late' WHEN start + 4200000000 <= last THEN 'closed' ELSE 'open' END AS kind FROM s)
"""


@query(LATE_SQL + "SELECT station_id, kind, start, count(*) AS n, round(sum(temp_c), 4) AS total FROM k GROUP BY ALL")
def r5_late_readings(spark, sf):
    """Hours by event time of accepted readings that arrive up to three hours late: those closed, late readings, and the hours still open."""
    path = scratch(spark, "late")
    us = F.unix_micros(F.col("received_at").cast("timestamp"))
    ok = readings(spark, sf).withColumn("reason", st.reason()).where("reason is null").select("station_id", "seq", us.alias("us"), (us + F.col("seq") * 37 % 180 * 60_000_000).alias("arrival"), "temp_c")
    st.replay_log(ok, f"{path}/in", by=("arrival", "seq"))
    stream = spark.readStream.schema(ok.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with sm.key_value_store(spark):
        q = sm.hour_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(sm.HOURS).parquet(f"{path}/out").unionByName(sm.open_hours(spark, f"{path}/state"))
    return rows.groupBy("station_id", "kind", "start").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


INSTANTS = (datetime(2024, 1, 4), datetime(2024, 1, 8), datetime(2024, 1, 16))


@query(" UNION ALL ".join("(" + RESOLVED.replace("2024-01-16", f"{at:%Y-%m-%d}") + f"SELECT TIMESTAMP '{at:%Y-%m-%d}' AS at, coalesce(reason, 'live') AS reason, count(*) AS n FROM r GROUP BY ALL)" for at in INSTANTS))
def r4_alert_feed(spark, sf):
    """The feed as a stream, in files by a hash of the message, so that Cancels and Updates come before and after what they name; asked at three instants."""
    path = scratch(spark, "feed")
    rows = alerts(spark, sf).select("identifier", *[F.col(c).cast("timestamp").alias(c) if c in ("sent", "effective", "expires") else c for c in af.FIELDS], "references")
    rows.repartition(6, F.xxhash64("seq")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    af.follow(stream, f"{path}/table", f"{path}/state").awaitTermination()
    table_ = af.latest(spark, f"{path}/table")
    asked = [af.at_instant(table_, at).select(F.lit(at).alias("at"), F.coalesce("reason", F.lit("live")).alias("reason")) for at in INSTANTS]
    every = asked[0].unionByName(asked[1]).unionByName(asked[2])
    return every.groupBy("at", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(REASON_SQL + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1")
def r6_incremental_ingest(spark, sf):
    """New files in a folder go through the same batch functions; accepted and refused readings go to two tables."""
    path = scratch(spark, "ingest")
    r = readings(spark, sf).select("station_id", F.col("ts").cast("timestamp").alias("ts"), "temp_c", "tds_ppm", "turbidity_ntu", "seq")
    r.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    st.to_sinks(stream, f"{path}/ok", f"{path}/bad", f"{path}/state").awaitTermination()
    ok, bad = spark.read.parquet(f"{path}/ok"), spark.read.parquet(f"{path}/bad")
    return ok.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {READINGS} SELECT station_id, seq, temp_c FROM (SELECT * FROM readings ORDER BY seq DESC LIMIT 500) WHERE seq % 29 <> 0")
def s18_last_lines(spark, sf):
    """The log's last 500 lines, the feature's own limit; every 29th line is corrupt and goes after the cut."""
    path = scratch(spark, "log")
    line = F.when(F.col("seq") % 29 == 0, "{ cut off").otherwise(F.to_json(F.struct("station_id", "seq", "temp_c")))
    readings(spark, sf).orderBy("seq").select(line.alias("line")).write.text(path)
    return st.lines(spark, path).select("station_id", "seq", "temp_c")


@query(f"WITH {READINGS} SELECT station_id, count(*) AS n, count(temp_c) AS n_temp, max(seq) AS last_seq FROM readings GROUP BY 1")
def s19_append_log(spark, sf):
    """Readings of a stream appended to a log of JSON lines, and what the log then holds."""
    path = scratch(spark, "sink")
    r = readings(spark, sf).select("station_id", "temp_c", "seq")
    r.write.parquet(f"{path}/in")
    st.append_log(spark.readStream.schema(r.schema).parquet(f"{path}/in"), f"{path}/log", f"{path}/state").awaitTermination()
    log = spark.read.schema(st.READING).json(f"{path}/log")
    return log.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.count("temp_c").alias("n_temp"), F.max("seq").alias("last_seq"))


@query("SELECT CAST(event_id AS VARCHAR) AS guid, 'alerts/' || CAST(event_id AS VARCHAR) || '.xml' AS link FROM events ORDER BY event_id DESC LIMIT 25")
def s17_feed_index(spark, sf):
    """The 25 items that stand first in a feed of all events, newest first."""
    path = scratch(spark, "feed")
    guid = F.col("event_id").cast("string")
    items = table(spark, sf, "events").orderBy(F.desc("event_id")).select(guid.alias("guid"), F.concat(F.lit("alerts/"), guid, F.lit(".xml")).alias("link"), F.lit("event").alias("title"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return bu.feed(spark, path, 25)


@query(f"WITH {LEVELS} SELECT source_id, 'temp: no unit' AS breach, count(*) AS n_levels FROM levels GROUP BY 1")
def n8_reader_contract(spark, sf):
    """Per source the breaches of the reader contract: the temperature is declared without a unit."""
    lv = levels(spark, sf)
    found = gr.contract(lv, {"temp": "", "psal": "1"})
    return lv.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_levels")).withColumn("breach", F.explode(F.array(*[F.lit(x) for x in found])))
