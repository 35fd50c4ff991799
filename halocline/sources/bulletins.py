"""Alert documents (CAP 1.2 XML) to nested rows, with a ledger of the unreadable ones; feeds; geometry sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.alerts import SEVERITY, URGENCY, circle_of, folded, parsed_time, ring_of

AREA = "areaDesc string, polygon array<string>, circle array<string>, geocode array<struct<valueName:string,value:string>>"
INFO = f"language string, category string, event string, urgency string, severity string, certainty string, effective string, onset string, expires string, headline string, description string, instruction string, web string, parameter array<struct<valueName:string,value:string>>, area array<struct<{','.join(x.replace(' ', ':', 1) for x in AREA.split(', '))}>>"
SCHEMA = f"identifier string, sender string, sent string, status string, msgType string, scope string, references string, source string, note array<string>, info array<struct<{','.join(x.replace(' ', ':', 1) for x in INFO.split(', '))}>>"
STATUS = ("Actual", "Exercise", "System", "Test", "Draft")
KINDS = ("Alert", "Update", "Cancel", "Ack", "Error")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml) of whole documents."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))


def alerts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(file, xml): (alerts, unreadable).  Unknown words become Unknown with a note; references keep their identifiers."""
    parsed = docs.withColumn("a", F.from_xml("xml", F.lit(SCHEMA), {"ignoreNamespace": "true", "mode": "PERMISSIVE"}))
    reason = F.when(F.col("a").isNull() | F.col("a.identifier").isNull(), "not_an_alert").when(F.coalesce(F.size("a.info"), F.lit(0)) < 1, "no_info")
    rows = parsed.withColumn("reason", reason)
    a = rows.where("reason is null").select("file", "a.*")
    refs = F.transform(F.filter(F.split(F.coalesce("references", F.lit("")), r"\s+"), lambda x: x != ""), lambda x: F.coalesce(F.get(F.split(x, ","), F.lit(1)), x))
    info = F.transform("info", lambda i: F.struct(
        i["language"].alias("language"), i["category"].alias("category"), i["event"].alias("event"), folded(i["urgency"], URGENCY).alias("urgency"), folded(i["severity"], SEVERITY).alias("severity"),
        i["certainty"].alias("certainty"), parsed_time(i["effective"]).alias("effective"), parsed_time(i["onset"]).alias("onset"), parsed_time(i["expires"]).alias("expires"), i["headline"].alias("headline"),
        i["description"].alias("description"), i["instruction"].alias("instruction"), F.map_from_entries(F.coalesce(i["parameter"], F.array().cast("array<struct<valueName:string,value:string>>"))).alias("parameters"),
        F.transform(F.coalesce(i["area"], F.array().cast(f"array<struct<{','.join(x.replace(' ', ':', 1) for x in AREA.split(', '))}>>")), lambda r: F.struct(
            r["areaDesc"].alias("desc"), F.array_compact(F.transform(F.coalesce(r["polygon"], F.array().cast("array<string>")), ring_of)).alias("polygons"),
            F.array_compact(F.transform(F.coalesce(r["circle"], F.array().cast("array<string>")), circle_of)).alias("circles"),
        )).alias("areas"),
    ))
    strange = F.concat_ws("; ", *[F.when(~F.col(c).isin(*words), F.concat(F.lit(f"{c} "), F.col(c))) for c, words in (("status", STATUS), ("msgType", KINDS))])
    out = a.select(
        "file", "identifier", "sender", parsed_time(F.col("sent")).alias("sent"), F.when(F.col("status").isin(*STATUS), F.col("status")).otherwise("Unknown").alias("status"),
        F.when(F.col("msgType").isin(*KINDS), F.col("msgType")).otherwise("Unknown").alias("msg_type"), "scope", refs.alias("references"), "source", strange.alias("notes"), info.alias("infos"),
    )
    return out, rows.where("reason is not null").select("file", "reason")


def with_sidecars(rows: DataFrame, sidecars: DataFrame) -> DataFrame:
    """rows(identifier, rings) and sidecars(identifier, rings): a sidecar's distinct rings serve an alert that has none."""
    side = sidecars.groupBy("identifier").agg(F.array_distinct(F.flatten(F.collect_list("rings"))).alias("side"))
    both = rows.join(side, "identifier", "left")
    own = F.coalesce(F.size("rings"), F.lit(0)) > 0
    return both.withColumn("rings", F.when(own, F.col("rings")).otherwise(F.coalesce("side", "rings"))).drop("side")


def totals(rows: DataFrame) -> DataFrame:
    """Alerts, exercises and vertices of all rings."""
    vertices = F.aggregate(F.flatten(F.transform("infos", lambda i: F.flatten(F.transform(i["areas"], lambda a: a["polygons"])))), F.lit(0), lambda n, r: n + F.size(r))
    return rows.agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(F.col("status") == "Exercise").alias("n_exercises"), F.coalesce(F.sum(vertices), F.lit(0)).alias("n_vertices"))


def feed(spark: SparkSession, path: str, newest: int) -> DataFrame:
    """(guid, link) of a feed's first items; feeds list the newest first, and parts of one follow one another by name."""
    items = spark.read.format("xml").option("rowTag", "item").schema("guid string, link string, title string").load(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    return items.select("guid", "link", place.alias("place")).orderBy("place").limit(newest).select("guid", "link")
