"""Isosurfaces of a field: cells, vertices, triangles, topology.

A field is one step, or many told apart by the columns `by`, which then lead every key and vertex id.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written
from .graph import components

DIMS = ("k_idx", "j", "i")
#: Corner number of (dk, dj, di) is 4 dk + 2 dj + di; an edge is (lower corner, axis), axis 0 to 2 along k, j, i.
CORNERS = list(product((0, 1), repeat=3))
EDGES = [(c, axis) for c in range(8) for axis in range(3) if CORNERS[c][axis] == 0]


def cells(field: DataFrame, var: str, iso: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Per cell of eight nodes: valid corners, mask of corners at or above iso, ties, and active, skipped, straddling."""
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), *[F.lit(o).alias(f"d{x}") for x, o in enumerate(off)]) for n, off in enumerate(CORNERS)]))
    v = F.col(var)
    near = field.select(*by, *DIMS, v.alias("v"), corner.alias("o"))
    near = near.select(*by, *[(F.col(d) - F.col(f"o.d{x}")).alias(d) for x, d in enumerate(DIMS)], F.col("o.c").alias("c"), "v")
    inside = F.col("v") >= iso
    out = near.groupBy(*by, *DIMS).agg(
        F.count("v").alias("valid"), F.count(F.lit(1)).alias("nodes"), F.coalesce(F.bit_or(F.when(inside, F.expr("shiftleft(1, c)"))), F.lit(0)).alias("mask"),
        F.count_if(inside).alias("n_in"), F.count_if(F.col("v") < iso).alias("n_out"), F.count_if(F.col("v") == iso).alias("ties"),
        F.map_from_entries(F.collect_list(F.struct("c", (F.col("v") - iso).alias("v")))).alias("vals"),
    ).where("nodes = 8")
    straddles = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    return out.withColumns({"active": (F.col("valid") == 8) & straddles, "skipped": F.col("valid") < 8, "masked_straddle": (F.col("valid") < 8) & straddles}).withColumn("bits", face_bits())


def faces() -> list[tuple[int, int, int, int]]:
    """The six faces, corners counter-clockwise as seen from outside."""
    out = []
    for axis in range(3):
        b, c = [d for d in range(3) if d != axis]
        for side in (0, 1):
            ring = []
            for u, w in ((0, 0), (1, 0), (1, 1), (0, 1)):
                at = [0, 0, 0]
                at[axis], at[b], at[c] = side, u, w
                ring.append(4 * at[0] + 2 * at[1] + at[2])
            outward = (side == 1) == (axis != 1)  # (b, c, axis) is a right-handed triple but for axis 1
            out.append(tuple(ring if outward else ring[::-1]))
    return out


FACES = faces()


def ambiguous_face(ring: tuple[int, ...]) -> tuple[Column, Column]:
    """Whether the first and third corner of a face are inside and the others not, and the other way round."""
    side = lambda x: F.col("mask").bitwiseAND(1 << x) > 0
    a, b, c, d = ring
    return side(a) & side(c) & ~side(b) & ~side(d), side(b) & side(d) & ~side(a) & ~side(c)


def face_bits() -> Column:
    """Bit per face whose diagonals differ in side: set where the inside corners are joined across the face."""
    out = F.lit(0)
    for n, (a, b, c, d) in enumerate(FACES):
        val = lambda x: F.element_at("vals", F.lit(x))
        ac, bd = val(a) * val(c), val(b) * val(d)
        first, second = ambiguous_face((a, b, c, d))
        joined = (first & (ac > bd)) | (second & (bd > ac))
        out = out + F.when(F.coalesce(joined, F.lit(False)), 1 << n).otherwise(0)
    return out


def ambiguous() -> Column:
    out = F.lit(False)
    for ring in FACES:
        first, second = ambiguous_face(ring)
        out = out | first | second
    return out


def edge_between(a: int, b: int) -> int:
    low = min(a, b)
    axis = {4: 0, 2: 1, 1: 2}[a ^ b]
    return EDGES.index((low, axis))


def loops(mask: int, bits: int) -> list[list[int]]:
    """Closed chains of crossed edges of a cell.  On a face the line runs from where its border leaves the inside to where it
    comes back; the neighbour face walks the shared edge the other way, so lines chain into directed loops."""
    nxt: dict[int, int] = {}
    for n, ring in enumerate(FACES):
        side = [bool(mask >> c & 1) for c in ring]
        leave = [i for i in range(4) if side[i] and not side[(i + 1) % 4]]
        enter = [i for i in range(4) if not side[i] and side[(i + 1) % 4]]
        for i in leave:
            # joined inside: round the outside corner just passed; else back round the inside corner
            j = enter[0] if len(enter) == 1 else (i + 1) % 4 if bits >> n & 1 else (i + 3) % 4
            nxt[edge_between(ring[i], ring[(i + 1) % 4])] = edge_between(ring[j], ring[(j + 1) % 4])
    out, left = [], set(nxt)
    while left:
        e = start = min(left)
        chain = []
        while True:
            chain.append(e)
            left.discard(e)
            e = nxt[e]
            if e == start:
                break
        out.append(chain)
    return out


def case_table(spark) -> DataFrame:
    """(mask, bits, loop, pos, edge) for every mask and every choice on its ambiguous faces."""
    rows = []
    for mask in range(1, 255):
        open_ = [n for n, r in enumerate(FACES) if len({mask >> r[0] & 1, mask >> r[2] & 1}) == 1 == len({mask >> r[1] & 1, mask >> r[3] & 1}) and (mask >> r[0] & 1) != (mask >> r[1] & 1)]
        for choice in product((0, 1), repeat=len(open_)):
            bits = sum(1 << n for n, b in zip(open_, choice) if b)
            rows += [(mask, bits, x, p, e) for x, chain in enumerate(loops(mask, bits)) for p, e in enumerate(chain)]
    return spark.createDataFrame(rows, "mask int, bits int, loop int, pos int, edge int")


def crossings(field: DataFrame, var: str, iso: float, active: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Mesh vertices: (k_idx, j, i, axis) of the edge's lower node, lat, lon, depth and the bracket's thickness on depth edges.

    With active cells given, only edges of at least one of them.
    """
    v = F.col(var)
    parts = []
    for axis, d in enumerate(DIMS):
        others = [x for x in DIMS if x != d]
        order = W.partitionBy(*by, *others).orderBy(d)
        nxt = lambda c: F.when(F.lead(d).over(order) == F.col(d) + 1, F.lead(c).over(order))  # noqa: B023, E731
        row = field.select(*by, *DIMS, "lat", "lon", "depth", v.alias("v"), nxt(var).alias("v2"), nxt("lat").alias("lat2"), nxt("lon").alias("lon2"), nxt("depth").alias("depth2"))
        row = row.where(((F.col("v") >= iso) & (F.col("v2") < iso)) | ((F.col("v") < iso) & (F.col("v2") >= iso)))
        t = (iso - F.col("v")) / (F.col("v2") - F.col("v"))
        mid = lambda c: (F.col(c) + t * (F.col(f"{c}2") - F.col(c))).alias(c)  # noqa: B023, E731
        parts.append(row.select(*by, *DIMS, F.lit(axis).alias("axis"), mid("lat"), mid("lon"), mid("depth"), F.when(F.lit(axis == 0), F.col("depth2") - F.col("depth")).alias("dz")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if active is None:
        return out
    own = active.select(*by, *[F.col(d).alias(f"c_{d}") for d in DIMS])
    off = [F.struct(*[F.lit(o).alias(f"d{x}") for x, o in enumerate(CORNERS[c])], F.lit(axis).alias("axis")) for c, axis in EDGES]
    used = own.select("*", F.explode(F.array(*off)).alias("o")).select(*by, *[(F.col(f"c_{d}") + F.col(f"o.d{x}")).alias(d) for x, d in enumerate(DIMS)], F.col("o.axis").alias("axis")).distinct()
    return out.join(used, [*by, *DIMS, "axis"], "left_semi")


def _key(edge: str) -> list[Column]:
    """Global key (k, j, i, axis) of a cell's edge number."""
    offs = F.array(*[F.array(*[F.lit(x) for x in (*CORNERS[c], axis)]) for c, axis in EDGES])
    at = F.element_at(offs, F.col(edge) + 1)
    return [*[F.col(d) + F.element_at(at, n + 1) for n, d in enumerate(DIMS)], F.element_at(at, 4)]


def vertex_id(*key: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in key])


def fans(field: DataFrame, var: str, iso: float, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) before triangles of zero area go: vertices(by, id, lat, lon, depth, dz), triangles(by, a, b, c, area2).

    Every loop of a cell is a fan about the mean of its ring.  A ring is put together once, with its places, so triangles need
    no joins of their own.
    """
    active = written(cells(field, var, iso, by).where("active").select(*by, *DIMS, "mask", "bits"), "active")
    parts = active.join(F.broadcast(case_table(field.sparkSession)), ["mask", "bits"])  # the case table has a fixed size
    edge_v = crossings(field, var, iso, active, by).withColumn("id", vertex_id(*[F.col(d) for d in (*by, *DIMS)], F.col("axis")))
    edge_v = written(edge_v.select(*by, "id", "lat", "lon", "depth", F.coalesce("dz", F.lit(0.0)).alias("dz")), "edge_v")
    parts = parts.select(*by, *DIMS, "loop", "pos", vertex_id(*[F.col(d) for d in by], *_key("edge")).alias("id"))
    item = F.struct("pos", "id", "lat", "lon", "depth")
    mean = [F.avg(c).alias(c) for c in ("lat", "lon", "depth", "dz")]
    rings = parts.join(edge_v.drop(*by), "id").groupBy(*by, *DIMS, "loop").agg(F.sort_array(F.collect_list(item)).alias("ring"), *mean)
    centre = F.concat_ws(":", F.lit("m"), *[F.col(d).cast("string") for d in (*by, *DIMS)], F.col("loop").cast("string"))
    rings = written(rings.withColumn("id", centre).select(*by, "id", "lat", "lon", "depth", "dz", "ring"), "rings")
    vertices = edge_v.unionByName(rings.drop("ring"))
    tri = rings.select(*by, F.struct("id", "lat", "lon", "depth").alias("pa"), F.col("ring"), F.posexplode("ring").alias("at", "pb"))
    tri = tri.withColumn("pc", F.get("ring", (F.col("at") + 1) % F.size("ring")))
    d = lambda p, q, x: F.col(f"p{q}.{x}") - F.col(f"p{p}.{x}")
    cross = [d("a", "b", x) * d("a", "c", y) - d("a", "b", y) * d("a", "c", x) for x, y in (("lat", "lon"), ("lon", "depth"), ("depth", "lat"))]
    area2 = cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]
    return vertices, tri.select(*by, F.col("pa.id").alias("a"), F.col("pb.id").alias("b"), F.col("pc.id").alias("c"), area2.alias("area2"))


def triangles(field: DataFrame, var: str, iso: float, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles).  vertices(id, lat, lon, depth); triangles(a, b, c), directed, without those of zero area."""
    vertices, tri = fans(field, var, iso, by)
    return vertices.select("id", "lat", "lon", "depth"), tri.where("area2 > 0").select("a", "b", "c")


def mesh_counts(field: DataFrame, var: str, iso: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Per mesh its vertices, triangles, culled triangles, depth range and thickest depth bracket."""
    vertices, tri = fans(field, var, iso, by)
    v = vertices.groupBy(*by).agg(F.count(F.lit(1)).alias("n_vertices"), F.round(F.min("depth"), 4).alias("depth_min"), F.round(F.max("depth"), 4).alias("depth_max"), F.round(F.max("dz"), 4).alias("max_bracket"))
    t = tri.groupBy(*by).agg(F.count_if(F.col("area2") > 0).alias("n_triangles"), F.count_if(F.col("area2") == 0).alias("n_culled"))
    return v.join(t, list(by), "left") if by else v.join(F.broadcast(t))  # one row each


def boundary_edges(tri: DataFrame) -> DataFrame:
    """Undirected edges used by exactly one triangle."""
    pairs = F.array(*[F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))])
    return tri.select(F.explode(pairs).alias("e")).groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u", "v")


def mesh_components(tri: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))
    return components(tri.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct())


def accounting(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of cells by fate; active, skipped and uncrossed ones add up to all.  Ties count in whole cells only."""
    flag = lambda x: F.count_if(F.col(x))
    return c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), flag("active").alias("n_active"), flag("skipped").alias("n_skipped"), flag("masked_straddle").alias("n_masked_straddle"),
        F.count_if((F.col("ties") > 0) & ~F.col("skipped")).alias("n_tied"), F.count_if(~F.col("active") & ~F.col("skipped")).alias("n_uncrossed"),
        F.count_if(F.col("active") & ambiguous()).alias("n_ambiguous"),
    )
