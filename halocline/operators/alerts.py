"""Hazard alerts: which are in force at an instant, and why the others are not."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..ledger import first_reason, ledger
from ..session import unwritten, written
from .ranks import placed

#: Closed vocabularies, in order of rank (fixed values).
SEVERITY = ("Unknown", "Minor", "Moderate", "Severe", "Extreme")
URGENCY = ("Immediate", "Expected", "Future", "Past", "Unknown")
KM_PER_DEGREE = 111.0
REASONS = ["cancelled", "superseded", "not_a_warning", "not_actual", "not_yet_effective", "expired"]
#: Rings above so many points are simplified, within so many degrees.
SIMPLIFY_ABOVE, TOLERANCE = 200, 0.01
#: Points of a block of a ring; degrees, far above rounding, by which a point must lie within a hull to be out of question.
BLOCK, DEEP = 50_000, 1e-8


def folded(value: Column, words: tuple[str, ...]) -> Column:
    """The word itself if it's of the vocabulary, else Unknown."""
    return F.when(value.isin(*words), value).otherwise(F.lit("Unknown"))


def severity_rank(value: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), value) - 1, F.lit(0)).cast("int")


def urgency_index(value: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in URGENCY]), value)
    return F.when(at > 0, at - 1).otherwise(len(URGENCY) - 1).cast("int")


def parsed_time(text: Column) -> Column:
    """Offsets and Z are honoured, no offset means UTC, anything unreadable is null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def referenced(alerts: DataFrame, kind: str) -> DataFrame:
    """Identifiers that alerts of a kind refer to, once each."""
    return alerts.where(F.col("msg_type") == kind).select(F.explode("references").alias("identifier")).distinct()


def reason_at(at: datetime, exercises: bool = False) -> Column:
    """Why a message isn't in force at an instant, null if it is; c and u tell that a Cancel or an Update names it.  Cancels count first."""
    now = F.lit(at)
    status = ["Actual", "Exercise"] if exercises else ["Actual"]
    return first_reason(
        ("cancelled", F.col("c")), ("superseded", F.col("u")), ("not_a_warning", ~F.col("msg_type").isin("Alert", "Update")), ("not_actual", ~F.col("status").isin(*status)),
        ("not_yet_effective", F.col("effective") > now), ("expired", F.col("expires") <= now),
    )


def resolved(alerts: DataFrame, at: datetime, exercises: bool = False) -> DataFrame:
    """alerts with reason: null where in force at the instant.  Cancels count first, then updates, in any order of arrival."""
    marks = referenced(alerts, "Cancel").withColumn("c", F.lit(True)).join(referenced(alerts, "Update").withColumn("u", F.lit(True)), "identifier", "full")
    return alerts.join(marks, "identifier", "left").withColumn("reason", reason_at(at, exercises)).drop("c", "u")


def refusals(rows: DataFrame) -> DataFrame:
    return ledger(rows, REASONS, accepted="live")


def ordered(live: DataFrame) -> DataFrame:
    """live with place from 1: severity falling, urgency, expiry with none last, then arrival."""
    order = [F.desc(severity_rank(F.col("severity"))), urgency_index(F.col("urgency")).asc(), F.col("expires").asc_nulls_last(), F.col("seq").asc()]
    return placed(live, order, "place").withColumn("place", F.col("place") + 1)


def touches(box: tuple[float, float, float, float], ring: Column, c_lon: Column, c_lat: Column, radius_km: Column) -> Column:
    """A vertex in the box, or the circle's centre in the box padded by its radius; over-inclusive by design."""
    w, s, e, n = box
    inside = F.exists(ring, lambda p: p["lon"].between(w, e) & p["lat"].between(s, n))
    pad = radius_km / KM_PER_DEGREE
    round_ = c_lon.between(F.lit(w) - pad, F.lit(e) + pad) & c_lat.between(F.lit(s) - pad, F.lit(n) + pad)
    return F.coalesce(inside, F.lit(False)) | F.coalesce(round_, F.lit(False))


def block_for(infos: Column, language: str) -> Column:
    """The info block in a language: exact, else one a prefix of the other, else the first."""
    want = language.lower()
    exact = F.filter(infos, lambda b: F.lower(b["language"]) == want)
    near = F.filter(infos, lambda b: F.lower(b["language"]).startswith(want) | F.lit(want).startswith(F.lower(b["language"])))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)), F.get(infos, F.lit(0)))


def ring_of(text: Column) -> Column:
    """Closed ring of (lon, lat) from 'lat,lon lat,lon ...'; null if any pair is bad or fewer than three points stand."""
    parts = F.split(F.trim(text), r"\s+")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    good = F.forall(parts, lambda p: (F.size(F.split(p, ",")) == 2) & F.get(F.split(p, ","), F.lit(0)).rlike(number) & F.get(F.split(p, ","), F.lit(1)).rlike(number))
    coords = F.transform(parts, lambda p: F.struct(F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("lon"), F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("lat")))
    legal = F.forall(coords, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180))
    closed = F.when(F.element_at(coords, 1) == F.element_at(coords, -1), coords).otherwise(F.concat(coords, F.slice(coords, 1, 1)))
    return F.when(good & legal & (F.size(coords) >= 3), closed)


def circle_of(text: Column) -> Column:
    """(lon, lat, radius_km) from 'lat,lon radius'; null unless the radius is a positive number."""
    pattern = r"^\s*([+-]?[\d.]+),([+-]?[\d.]+)\s+([\d.eE+-]+)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("double")
    return F.when(part(3) > 0, F.struct(part(2).alias("lon"), part(1).alias("lat"), part(3).alias("radius_km")))


def _outer(block: pd.DataFrame) -> pd.DataFrame:
    """The points of a block that may be farthest from a segment, whichever segment that is.

    The distance from a segment is convex, so it's greatest on the hull; a point goes only if the hull reaches DEEP beyond it to all
    four sides, so that none of equal distance goes.
    """
    x, y = block["lon"].to_numpy("float64"), block["lat"].to_numpy("float64")
    finite = np.isfinite(x) & np.isfinite(y)
    keep = ~finite
    for u, v in ((x, y), (y, x)):
        order = np.lexsort((v, u))
        order = order[finite[order]]
        for side in (v, -v):
            keep[_chain(u, side, order)] = True
    return block[keep]


def _chain(u: np.ndarray, v: np.ndarray, order: np.ndarray) -> list[int]:
    """The points, in rising u, above which no line between two others passes at DEEP or more; some others may stay."""
    for size in (32, 1024):
        # lines between the highest points of stretches take most of the others away
        m = len(order) // size
        if m < 2:
            break
        top = order[: m * size].reshape(m, size)
        top = np.concatenate([order[:1], top[np.arange(m), v[top].argmax(axis=1)], order[-1:]])
        order = order[v[order] >= np.interp(u[order], u[top], v[top]) - DEEP]
    us, vs, stack = u[order].tolist(), v[order].tolist(), []
    for i in range(len(us)):
        while len(stack) > 1:
            o, a = stack[-2], stack[-1]
            dx = us[i] - us[o]
            if not (vs[o] - vs[a]) * dx + (us[a] - us[o]) * (vs[i] - vs[o]) > DEEP * dx:
                break
            stack.pop()
        stack.append(i)
    return order[stack]


def _cuts(tolerance: float):
    def cuts(part: pd.DataFrame) -> pd.DataFrame:
        """Points at which a segment is cut (b is -1), and the segments (a, b) for which blocks must be read whole that weren't."""
        part = part.sort_values("at")
        x, y, at, full = part["lon"].to_numpy("float64"), part["lat"].to_numpy("float64"), part["at"].to_numpy(), part["full"].to_numpy()
        own, to, asked = [], [], [(0, len(at) - 1)]
        while asked:
            p, q = asked.pop()
            if q - p < 2:
                continue
            px, py, dx, dy = x[p + 1 : q] - x[p], y[p + 1 : q] - y[p], x[q] - x[p], y[q] - y[p]
            long2 = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / long2, 0.0, 1.0) if long2 > 0 else 0.0
            d = np.hypot(px - t * dx, py - t * dy)
            d[np.isnan(d)] = -1.0
            c = int(d.argmax())
            if d[c] > tolerance:
                c += p + 1
                own.append(c)
                to.append(-1)
                if full[c]:
                    asked += [(p, c), (c, q)]
                else:
                    own += [p, c]
                    to += [at[c], at[q]]
        out = part.iloc[own]
        return out[["ring", "idx", "lon", "lat"]].assign(a=out["at"], b=np.array(to, dtype="int64"))

    return cuts


def simplified(points: DataFrame, tolerance: float = TOLERANCE, above: int = SIMPLIFY_ABOVE) -> DataFrame:
    """points(ring, idx, lon, lat) that stay after Douglas and Peucker's rule; rings up to `above` points stay whole.

    A segment is split at its farthest point (first on a tie) if that's beyond the tolerance.  Points are dealt to blocks of BLOCK.  A round
    splits every open segment as long as the cuts fall into the blocks of its two ends, of which it has all points; of the blocks between
    it has those that can be farthest from anything.  A cut between opens a block, each one once, so rounds are bounded by a ring's blocks and
    not by its depth of splitting, and no task reads a ring.
    """
    shape = ["ring", "idx", "lon", "lat"]
    size = points.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    whole = points.join(size.where(F.col("n") <= above).select("ring"), "ring", "left_semi")
    dealt = placed(points.join(size.where(F.col("n") > above).select("ring"), "ring", "left_semi").select(*shape), [F.col("ring"), F.col("idx")], "at")
    rows = written(dealt.withColumn("block", F.floor(F.col("at") / BLOCK)), "points")
    unwritten(dealt)
    blocks = written(rows.groupBy("ring", "block").agg(F.min("at").alias("first"), F.max("at").alias("last")), "blocks")
    spans = blocks.groupBy("ring").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.count(F.lit(1)).alias("n"))
    done = [written(rows.join(spans, "ring").where("at = a or at = b").select(*shape), "ends")]
    long = rows.join(spans.where("n > 2").select("ring"), "ring", "left_semi")
    outer = written(long.groupBy("ring", "block").applyInPandas(_outer, rows.schema), "outer")
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in points.select(*shape).dtypes)
    asked = spans.where("b > a + 1").select("ring", "a", "b")
    while asked.limit(1).count():
        reach = asked.join(blocks, "ring").where("first <= b and last >= a").withColumn("full", F.expr("first <= a or last >= b")).drop("first", "last")
        near = rows.join(reach.where("full"), ["ring", "block"]).where("at between a and b")
        far = outer.join(reach.where("not full"), ["ring", "block"])
        got = written(near.unionByName(far).groupBy("ring", "a", "b").applyInPandas(_cuts(tolerance), f"{kinds}, a long, b long"), "cuts")
        done.append(got.where("b < 0").select(*shape))
        asked = got.where("b >= 0").select("ring", "a", "b")
    unwritten(rows, blocks, outer)
    return reduce(DataFrame.unionByName, done, whole.select(*shape))
