"""Derived products: a registry of transforms with declared inputs and checked outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ocean
from . import columns
from .fields import snap_depth

KEYS = ("t_idx", "k_idx", "depth", "j", "lat", "i", "lon")


@dataclass(frozen=True)
class Product:
    """compute takes the input columns' frame and returns one with the product's column."""

    name: str
    label: str
    units: str
    requires: dict[str, str]
    compute: Callable[[DataFrame], DataFrame]
    output: str = "column"
    method: str = ""
    params: dict = default(default_factory=dict)
    applies_to: tuple[str, ...] = ()


PRODUCTS: dict[str, Product] = {}
READERS: dict[str, Callable] = {}


def register(product: Product) -> Product:
    """Refuses what can't be served: no name, label, units, inputs or method; unknown output; a name already taken."""
    if not (product.name.isidentifier() and product.label and product.units and product.requires and product.method):
        raise ValueError("a product declares name, label, units, inputs and method")
    if product.output not in ("surface", "column"):
        raise ValueError("output is 'surface' or 'column'")
    if product.name in PRODUCTS:
        raise ValueError(f"{product.name} is already registered")
    PRODUCTS[product.name] = product
    return product


def register_reader(kind: str, read: Callable) -> None:
    if not kind or not callable(read) or kind in READERS:
        raise ValueError("a reader has a kind of its own and can be called")
    READERS[kind] = read


def opened(spark: SparkSession, kind: str, spec: dict) -> DataFrame:
    """What the reader of a kind makes of a source's spec; refused if nobody registered the kind."""
    if kind not in READERS:
        raise ValueError(f"no reader is registered for {kind}; there are {sorted(READERS)}")
    return READERS[kind](spark, spec)


def shaped(result: DataFrame, name: str, depth: float | None = None) -> DataFrame:
    """A product's rows as a stored variable is served: a surface has no depth (null), a column is cut to the level nearest to
    depth (the shallower on a tie), or whole where none is asked for."""
    if PRODUCTS[name].output == "surface":
        return result.withColumn("depth", F.lit(None).cast("double"))
    if depth is None:
        return result
    k, served = snap_depth(result, depth)
    return result.where(F.col("k_idx") == k).withColumn("depth", F.lit(served))


def offered(field: DataFrame, source: str = "") -> list[str]:
    """Products whose inputs exist and whose name no stored variable has."""
    have = set(field.columns)
    return sorted(p.name for p in PRODUCTS.values() if set(p.requires) <= have and p.name not in have and (not p.applies_to or source in p.applies_to))


def run(field: DataFrame, name: str, units: dict[str, str]) -> DataFrame:
    """The product's rows after the unit check of its inputs; a surface has no depth."""
    p = PRODUCTS[name]
    wrong = {v: (units.get(v), want) for v, want in p.requires.items() if units.get(v) != want}
    if wrong:
        raise ValueError(f"{name}: units disagree {wrong}")
    out = p.compute(field)
    if out.schema[name].dataType.simpleString() not in ("double", "float"):
        raise ValueError(f"{name}: the result isn't floating")
    return out


def violations(field: DataFrame, result: DataFrame, name: str) -> DataFrame:
    """Counts of breaches of the output contract: infinities, values on dry columns, missing or surplus keys; and cells and valid cells."""
    p = PRODUCTS[name]
    keys = ["t_idx", "j", "i"] if p.output == "surface" else ["t_idx", "k_idx", "j", "i"]
    wet = field.groupBy("t_idx", "j", "i").agg(*[F.count(v).alias(f"w_{v}") for v in p.requires])
    expect = field.select(*keys).distinct()
    both = expect.withColumn("e", F.lit(1)).join(result.select(*keys, name).withColumn("r", F.lit(1)), keys, "full").join(wet, ["t_idx", "j", "i"], "left")
    v = F.col(name)
    dry = F.least(*[F.col(f"w_{x}") for x in p.requires]) == 0 if len(p.requires) > 1 else F.col(f"w_{next(iter(p.requires))}") == 0
    return both.agg(
        F.count("e").alias("n_cells"), F.count(v).alias("n_valid"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_infinite"), F.count_if(v.isNotNull() & dry).alias("n_on_dry"),
        F.count_if(F.col("e").isNull()).alias("n_surplus"), F.count_if(F.col("r").isNull()).alias("n_absent"),
    )


def _chain(field: DataFrame):
    p = ocean.pressure_of(F.col("depth"), F.col("lat"))
    sa = ocean.absolute_salinity(F.col("sal"))
    return field.withColumns({"__p": p, "__sa": sa}).withColumn("__ct", ocean.conservative_temperature(F.col("temp"), F.col("__sa"), F.col("__p")))


SALT_NOTE = "Reference salinity stands for absolute salinity unless an anomaly table is joined; conservative temperature within 6e-4 degC over 0 to 1000 dbar."
register(Product("d26", "Depth of the 26 degC isotherm", "m", {"temp": "degC"}, lambda f: columns.isotherm_depth(f).select("t_idx", "j", "lat", "i", "lon", F.col("depth").alias("d26")), "surface", "first downward crossing, linear in depth"))
register(Product("sigma0", "Potential density anomaly", "kg m-3", {"temp": "degC", "sal": "1"}, lambda f: _chain(f).select(*KEYS, ocean.sigma0(F.col("__sa"), F.col("__ct")).alias("sigma0")), "column", SALT_NOTE))
register(Product("sound", "Speed of sound", "m s-1", {"temp": "degC", "sal": "1"}, lambda f: _chain(f).select(*KEYS, ocean.sound_speed(F.col("__sa"), F.col("__ct"), F.col("__p")).alias("sound")), "column", SALT_NOTE))
