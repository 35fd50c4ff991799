"""The library's own readers, registered by kind like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import derived
from . import bulletins, gridded, text_casts


def field(spark: SparkSession, spec: dict) -> DataFrame:
    """A stored field: path, source, and index ranges of a box where it's laid out in tiles."""
    if "box" in spec:
        return gridded.load_box(spark, spec["path"], spec["source"], {spec["source"]}, spec["box"])
    return gridded.load(spark, spec["path"], spec["source"], {spec["source"]})


def profiles(spark: SparkSession, spec: dict) -> DataFrame:
    """The profile table at path."""
    return gridded.profiles(spark, spec["path"])


def casts(spark: SparkSession, spec: dict) -> DataFrame:
    """Levels of the delimited texts below path, by a declared format."""
    return text_casts.parse(text_casts.read(spark, spec["path"]), spec["format"])[0]


def alerts(spark: SparkSession, spec: dict) -> DataFrame:
    """Alerts of the documents below path."""
    return bulletins.alerts(bulletins.documents(spark, spec["path"]))[0]


for _kind, _read in (("field", field), ("profiles", profiles), ("text_casts", casts), ("alerts", alerts)):
    derived.register_reader(_kind, _read)
