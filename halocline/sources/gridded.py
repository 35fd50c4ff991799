"""Gridded tables: normalisation before they are stored, and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.ocean import unmasked, unpacked

#: Spellings of the canonical unit, and conversions (from, to) -> (factor, offset); fixed values.
RELABEL = {
    "degs": "degC", "deg_c": "degC", "degree_celsius": "degC", "degrees_celsius": "degC", "celsius": "degC",
    "psu": "1", "pss-78": "1", "meters": "m", "metres": "m", "decibar": "dbar",
}
CONVERT = {
    ("cm s-1", "m s-1"): (0.01, 0.0), ("cm/s", "m s-1"): (0.01, 0.0), ("cm/sec", "m s-1"): (0.01, 0.0), ("m s-1", "cm s-1"): (100.0, 0.0),
    ("degK", "degC"): (1.0, -273.15), ("K", "degC"): (1.0, -273.15), ("degC", "degK"): (1.0, 273.15), ("mg m-3", "kg m-3"): (1e-6, 0.0),
}


def in_unit(df: DataFrame, var: str, have: str, want: str) -> DataFrame:
    """The variable in the wanted unit: spelling is relabelled, a known pair converted, any other refused."""
    have = RELABEL.get(have.strip().lower(), have.strip())
    if have == want:
        return df
    if (have, want) not in CONVERT:
        raise ValueError(f"{var}: no conversion from {have} to {want}")
    a, b = CONVERT[have, want]
    return df.withColumn(var, F.col(var) * a + b)


def depth_down(df: DataFrame, positive: str | None) -> DataFrame:
    """Depth positive down: declared up is negated; undeclared with negatives becomes absolute."""
    if positive == "up":
        return df.withColumn("depth", -F.col("depth"))
    low = df.agg(F.min("depth")).first()[0] if positive is None else None
    return df.withColumn("depth", F.abs("depth")) if low is not None and low < 0 else df


def depth_faults(df: DataFrame) -> DataFrame:
    """Levels of the depth axis that break its rules: not finite, or not above the level before (level numbers in file order)."""
    ax = df.select("level", "depth").distinct()
    order = W.orderBy("level")
    fault = F.when(F.col("depth").isNull() | F.isnan("depth"), "not_finite").when(F.col("depth") <= F.lag("depth").over(order), "not_increasing")
    return ax.withColumn("fault", fault).where("fault is not null")


def normalised(df: DataFrame, rename: dict[str, str], packing: dict[str, tuple[float, float, float | None]], fills: tuple[float, ...], units: dict[str, tuple[str, str]], positive: str | None) -> DataFrame:
    """In this order: unpack, mask fills, canonical names and order, depth direction, units."""
    for v, (scale, offset, fill) in packing.items():
        df = df.withColumn(v, unpacked(F.col(v), scale, offset, fill))
    for v in [c for c in rename if rename[c] not in ("time", "depth", "lat", "lon", "level")]:
        df = df.withColumn(v, unmasked(F.col(v).cast("double"), fills))
    df = df.withColumnsRenamed(rename)
    df = depth_down(df, positive)
    for v, (have, want) in units.items():
        df = in_unit(df, v, have, want)
    return df


def contract(df: DataFrame, variables: dict[str, str]) -> list[str]:
    """Breaches of the reader contract: variables with units, canonical axes, rising depth not below zero, floating values."""
    out = [] if variables else ["no variables"]
    out += [f"{c}: axis missing" for c in ("time", "depth", "lat", "lon") if c not in df.columns]
    kinds = dict(df.dtypes)
    out += [f"{v}: not floating" for v in variables if kinds.get(v) not in ("double", "float")]
    out += [f"{v}: no unit" for v, u in variables.items() if not u]
    if "depth" in df.columns and df.where("depth < 0").limit(1).count():
        out.append("depth: below zero")
    return out


def store(df: DataFrame, path: str) -> None:
    """One folder per source and step, whole columns in order within a file."""
    df.repartition("source_id", "time").sortWithinPartitions("k_idx", "j", "i").write.mode("overwrite").partitionBy("source_id", "time").parquet(path)


def load(spark: SparkSession, path: str, source: str, enabled: set[str]) -> DataFrame:
    """A stored source: only if it's enabled and present."""
    if source not in enabled:
        raise ValueError(f"{source} isn't enabled")
    df = spark.read.parquet(path).where(F.col("source_id") == source)
    if df.limit(1).count() == 0:
        raise ValueError(f"{source} isn't stored")
    return df


#: Axes of the curve's key in order, and bits of an index that count; cells of a folder are 2**FOLD wide along each axis.
CURVE, CURVE_BITS, FOLD = ("t_idx", "k_idx", "j", "i"), 15, 3


def spread_bits(x: Column) -> Column:
    """The low 15 bits of a whole number, three zero bits between each."""
    for shift, mask in ((0, 0x7FFF), (24, 0x0000007F000000FF), (12, 0x0007000F000F000F), (6, 0x0303030303030303), (3, 0x1111111111111111)):
        x = (x.bitwiseOR(F.shiftleft(x, shift)) if shift else x).bitwiseAND(F.lit(mask))
    return x


def curve_key(fold: int = 0) -> Column:
    """Place on a Z-order curve over step, level, row and column, so that neighbours along every axis lie close; fold: of cells 2**fold wide."""
    out = F.lit(0).cast("long")
    for n, c in enumerate(CURVE):
        out = out.bitwiseOR(F.shiftleft(spread_bits(F.shiftright(F.col(c).cast("long"), fold)), n))
    return out


def store_tiled(df: DataFrame, path: str, fold: int = FOLD) -> None:
    """A field laid out along the curve: one folder per source and cell of 2**fold steps, levels, rows and columns, in the curve's order within.

    A box reads the folders of the cells it touches, and of their files the row groups whose bounds it meets.
    """
    rows = df.withColumns({"cell": curve_key(fold), "__key": curve_key()})
    rows = rows.repartitionByRange(F.col("source_id"), F.col("cell")).sortWithinPartitions("source_id", "cell", "__key").drop("__key")
    rows.write.mode("overwrite").partitionBy("source_id", "cell").parquet(path)


def load_box(spark: SparkSession, path: str, source: str, enabled: set[str], box: dict[str, tuple[int, int]], fold: int = FOLD) -> DataFrame:
    """Cells of a source stored by store_tiled() within closed ranges of indexes, {axis: (first, last)}; axes left out are read whole."""
    rows = load(spark, path, source, enabled)
    bits = {c: (CURVE.index(c), lo >> fold, hi >> fold) for c, (lo, hi) in box.items()}
    for n, lo, hi in bits.values():
        # an axis's index of the folder, of every fourth bit of its number: a filter on folders alone
        index = F.lit(0).cast("long")
        for b in range(CURVE_BITS - fold):
            index = index.bitwiseOR(F.shiftleft(F.shiftright(F.col("cell").cast("long"), 4 * b + n).bitwiseAND(F.lit(1).cast("long")), b))
        rows = rows.where(index.between(lo, hi))
    for c, (lo, hi) in box.items():
        rows = rows.where(F.col(c).between(lo, hi))
    return rows.drop("cell")


PROFILE_LEVEL = "profile_id string, wmo string, time timestamp, lat double, lon double, pres double, depth double, temp double, temp_qc smallint, psal double, psal_qc smallint, source_id string"


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profile table; an absent one is empty with the full schema."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], PROFILE_LEVEL)
    return spark.read.parquet(path)


def write_provenance(levels: DataFrame, path: str) -> None:
    """Per source the profiles, levels, platforms and surviving values, as JSON beside the table."""
    counts = [F.count(c).alias(f"n_{c}") for c in ("temp", "psal") if c in levels.columns]
    levels.groupBy("source_id").agg(F.countDistinct("profile_id").alias("n_profiles"), F.count(F.lit(1)).alias("n_levels"), F.countDistinct("wmo").alias("n_platforms"), *counts).write.mode("overwrite").json(path)
