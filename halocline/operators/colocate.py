"""Colocation of observed levels with a model field, and the scorecard over the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..ledger import first_reason, ledger
from ..session import written
from .axes import axes_of, bracketed, nearest, seconds
from .ranks import percentiles

#: Farthest model step in days, accepted flags, depth bands in metres (half-open), least pairs of a worst band.
MAX_DAYS = 5
ACCEPT = (1, 2)
BANDS = (0, 10, 50, 100, 200, 500, 1000, 2000)
WORST_MIN = 20
#: Columns of a tile along a side, besides the halo.
TILE = 8
REASONS = ["no_model_time", "outside_grid", "no_observation", "no_qc_flag", "rejected_qc", "outside_depth_range", "missing_stencil"]


def columns_of(field: DataFrame, var: str, *more: str) -> DataFrame:
    """Water columns (t_idx, j, i, vals), vals[k] being the value at level k, null where missing."""
    slots = F.sort_array(F.collect_list(F.struct("k_idx", F.col(var).alias("v"))))
    return field.groupBy("t_idx", "j", "i", *more).agg(F.transform(slots, lambda s: s["v"]).alias("vals"))


def tiles(field: DataFrame, var: str, side: int = TILE) -> DataFrame:
    """(t_idx, tj, ti, cells): squares of `side` by `side` columns and the next row and column beyond, so that a stencil lies in one tile.

    cells maps (j - tj * side) * (side + 1) + i - ti * side to the column's values.  A cell is dealt once to each tile it's in, and columns
    and tiles are then made without another shuffle.
    """
    own = lambda x: F.floor(F.col(x) / side).cast("int")
    within = lambda x: F.explode(F.when((F.col(x) % side == 0) & (F.col(x) > 0), F.array(own(x) - 1, own(x))).otherwise(F.array(own(x))))
    cells = field.select("t_idx", "j", "i", "k_idx", var).withColumn("tj", within("j")).withColumn("ti", within("i")).repartition("t_idx", "tj", "ti")
    at = ((F.col("j") - F.col("tj") * side) * (side + 1) + F.col("i") - F.col("ti") * side).cast("int")
    cols = columns_of(cells, var, "tj", "ti")
    return cols.groupBy("t_idx", "tj", "ti").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "vals"))).alias("cells"))


def heads(levels: DataFrame) -> DataFrame:
    """(profile_id, p_time, p_lat, p_lon) of each profile's first level (least depth)."""
    h = levels.groupBy("profile_id").agg(F.min(F.struct(F.coalesce("depth", F.lit(0.0)).alias("d"), "time", "lat", "lon")).alias("h"))
    return h.select("profile_id", F.col("h.time").alias("p_time"), F.col("h.lat").alias("p_lat"), F.col("h.lon").alias("p_lon"))


def placed(profiles: DataFrame, field_axes: dict[str, DataFrame], max_days: float = MAX_DAYS) -> DataFrame:
    """Profiles with their model step (t_idx, gap) and the brackets of their position (j0, j1, jf, i0, i1, if)."""
    out = nearest(profiles, seconds(F.col("p_time")), field_axes["time"], "t_")
    out = bracketed(out, F.col("p_lat"), field_axes["lat"], "j")
    out = bracketed(out, F.col("p_lon"), field_axes["lon"], "i")
    reason = first_reason(("no_model_time", F.col("t_idx").isNull() | (F.col("t_gap") > max_days * 86400)), ("outside_grid", F.col("j1").isNull() | F.col("i1").isNull()))
    return out.withColumn("p_reason", reason)


CORNERS = (("j0", "i0"), ("j0", "i1"), ("j1", "i0"), ("j1", "i1"))


def stencils(profiles: DataFrame, field_tiles: DataFrame, side: int = TILE) -> DataFrame:
    """(profile_id, w0 to w3, v0 to v3): weights and columns of the four corners of a profile's position; one join with the tiles."""
    fy, fx = F.col("jf"), F.col("if")
    weights = ((1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx)
    place = lambda j, i: ((F.col(j) - F.col("tj") * side) * (side + 1) + F.col(i) - F.col("ti") * side).cast("int")
    rows = profiles.where("p_reason is null").withColumns({"tj": F.floor(F.col("j0") / side).cast("int"), "ti": F.floor(F.col("i0") / side).cast("int")})
    both = rows.join(field_tiles, ["t_idx", "tj", "ti"], "left")
    return both.select("profile_id", *[w.alias(f"w{n}") for n, w in enumerate(weights)], *[F.try_element_at("cells", place(j, i)).alias(f"v{n}") for n, (j, i) in enumerate(CORNERS)])


def at_level(k: Column) -> Column:
    """Bilinear value of the stencil at level k; null unless every corner that weighs has a value there."""
    part = [F.when(F.col(f"w{n}") == 0, F.lit(0.0)).otherwise(F.col(f"w{n}") * F.get(f"v{n}", k)) for n in range(4)]
    return part[0] + part[1] + part[2] + part[3]


def colocate(field: DataFrame, levels: DataFrame, var: str = "temp", observed: str = "temp", qc: str | None = "temp_qc", accept: tuple[int, ...] = ACCEPT, max_days: float = MAX_DAYS) -> DataFrame:
    """levels with modelled, residual, t_gap and reason (null where paired).

    Time and position are settled once per profile, which meets the tile that holds its four columns by one join.  Levels find
    their two model levels first, and of the columns keep what they need as they meet them by profile_id.
    """
    axes = axes_of(field, "time", "lat", "lon", "depth")
    profiles = placed(heads(levels), axes, max_days)
    found = profiles.select("profile_id", "t_idx", "t_gap", "p_reason").join(stencils(profiles, tiles(field, var)), "profile_id", "left")
    rows = bracketed(levels, F.col("depth"), axes["depth"], "d").join(found, "profile_id")
    rows = rows.select(*levels.columns, "t_idx", "t_gap", "p_reason", "d0", "d1", "df", at_level(F.col("d0")).alias("lo_"), at_level(F.col("d1")).alias("hi_"))
    rows = rows.withColumn("modelled", F.col("lo_") + F.col("df") * (F.col("hi_") - F.col("lo_"))).drop("lo_", "hi_")
    flagged = [("no_qc_flag", F.col(qc).isNull()), ("rejected_qc", ~F.col(qc).isin(*accept))] if qc and qc in levels.columns else []
    reason = first_reason(
        ("no_model_time", F.col("p_reason") == "no_model_time"), ("outside_grid", F.col("p_reason") == "outside_grid"), ("no_observation", F.col(observed).isNull()),
        *flagged, ("outside_depth_range", F.col("d1").isNull()), ("missing_stencil", F.col("modelled").isNull()),
    )
    rows = rows.withColumn("reason", reason)
    residual = F.when(F.col("reason").isNull(), F.col("modelled") - F.col(observed))
    return rows.withColumn("residual", residual).drop("p_reason", "d0", "d1", "df")


def refusals(pairs: DataFrame) -> DataFrame:
    return ledger(pairs, REASONS, accepted="matched")


def stats(r: str = "residual") -> list[Column]:
    """n, bias, rmse, mae and population deviation of residuals, rounded to 4."""
    c = F.col(r)
    return [
        F.count(c).alias("n"), F.round(F.avg(c), 4).alias("bias"), F.round(F.sqrt(F.avg(c * c)), 4).alias("rmse"), F.round(F.avg(F.abs(c)), 4).alias("mae"),
        F.round(F.stddev_pop(c), 4).alias("std"),
    ]


def band_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(BANDS, BANDS[1:]))], "band int, lo double, hi double")


def scorecard(pairs: DataFrame) -> DataFrame:
    """One row per depth band, empty ones included, and one over all pairs (band -1): a depth of 2000 is only in that."""
    ok = pairs.where("reason is null")
    index = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(BANDS, BANDS[1:])):
        index = F.when((F.col("depth") >= a) & (F.col("depth") < b), F.lit(i)).otherwise(index)
    # one aggregation gives bands and total: a level is counted in its band and in -1
    rows = ok.select("residual", F.explode(F.array(index, F.lit(-1))).alias("band")).where("band is not null")
    by = rows.groupBy("band").agg(*stats())
    spark = pairs.sparkSession
    every = band_table(spark).unionByName(spark.createDataFrame([(-1, None, None)], "band int, lo double, hi double"))
    return every.join(F.broadcast(by), "band", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def head(pairs: DataFrame) -> DataFrame:
    """Distinct profiles and platforms of the pairs, median and largest time offset in hours."""
    ok = written(pairs.where("reason is null").select("profile_id", "wmo", (F.col("t_gap") / 3600).alias("hours")), "pairs")
    median = percentiles(ok, "hours", [0.5])[0]
    return ok.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("profile_id").alias("n_profiles"), F.countDistinct(F.when(F.col("wmo") != "", F.col("wmo"))).alias("n_platforms"),
        F.round(F.lit(median).cast("double"), 2).alias("median_hours"), F.round(F.max("hours"), 2).alias("max_hours"),
    )


def platforms(pairs: DataFrame) -> DataFrame:
    return pairs.where("reason is null and wmo <> ''").select("wmo").distinct()


def worst_band(card: DataFrame, least: int = WORST_MIN) -> DataFrame:
    """The band of largest RMSE among those with enough pairs; the first on a tie."""
    return card.where((F.col("band") >= 0) & (F.col("n") >= least)).orderBy(F.desc("rmse"), "band").limit(1)
