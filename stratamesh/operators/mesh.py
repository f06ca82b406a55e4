"""From meshes (flat positions, indices, transform) to vertices and triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .numbering import sums_before

MESH_SCHEMA = "mesh_id bigint, format string, positions array<float>, indices array<bigint>, transform array<double>"
#: Geometry of a triangle, in this order after its ids.
GEOMETRY = ["nx", "ny", "nz", "cx", "cy", "cz", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "area"]


def _is_indexed() -> Column:
    return F.coalesce(F.size("indices"), F.lit(-1)) >= 3


def with_offsets(meshes: DataFrame) -> DataFrame:
    """``meshes`` with counts and the sums of counts before each, in the order of mesh_id."""
    counted = meshes.withColumns({
        "n_vertices": F.floor(F.size("positions") / 3),
        "n_triangles": F.floor(F.when(_is_indexed(), F.size("indices")).otherwise(F.size("positions") / 3) / 3),
    })
    slim = sums_before(counted.select("mesh_id", "n_vertices", "n_triangles"), ["mesh_id"], {"first_vertices": "n_vertices", "first_triangles": "n_triangles"})
    return counted.join(slim.select("mesh_id", "first_vertices", "first_triangles"), "mesh_id")


def vertices(meshes: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, x, y, z) as stored, without transforms; ids run on from mesh to mesh."""
    at = lambda i, k: F.get("positions", (3 * i + k).cast("int")).cast("double")
    each = F.transform(
        F.when(F.col("n_vertices") > 0, F.sequence(F.lit(0), (F.col("n_vertices") - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i + F.col("first_vertices")).alias("vertex_id"), *(at(i, k).alias(c) for k, c in enumerate("xyz"))),
    )
    return with_offsets(meshes).select("mesh_id", each.alias("e")).select("mesh_id", F.inline("e"))


def triangle_corners(meshes: DataFrame, transformed: bool = True) -> DataFrame:
    """(mesh_id, tri_id, v0, v1, v2 and the corners' coordinates); indexed with three indices or more, else a triangle list.

    Left-over positions or indices are dropped; the struct of each triangle is made inside
    one array, so a mesh's arrays are not copied for each triangle.
    """
    corner = lambda t, k: F.when(_is_indexed(), F.get("indices", (3 * t + k).cast("int"))).otherwise((3 * t + k).cast("long"))

    def point(i: Column) -> list[Column]:
        p = tuple(F.get("positions", (3 * i + k).cast("int")).cast("double") for k in range(3))
        if not transformed:
            return list(p)
        moved = V.transform_point(F.col("transform"), p)
        return [F.when(F.col("transform").isNotNull(), m).otherwise(q) for m, q in zip(moved, p)]

    def fields(t: Column) -> Column:
        ids = [corner(t, k) for k in range(3)]
        points = [c.alias(f"p{k}{axis}") for k in range(3) for axis, c in zip("xyz", point(ids[k]))]
        return F.struct((t + F.col("first_triangles")).alias("tri_id"), *((i + F.col("first_vertices")).alias(f"v{k}") for k, i in enumerate(ids)), *points)

    numbers = F.when(F.col("n_triangles") > 0, F.sequence(F.lit(0), (F.col("n_triangles") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return with_offsets(meshes).select("mesh_id", F.transform(numbers, fields).alias("t")).select("mesh_id", F.inline("t"))


def geometry(corners: DataFrame) -> DataFrame:
    """Normal, centroid, box and area of triangles given by ``p0x`` to ``p2z``; other columns stay."""
    p = [V.vec(f"p{k}") for k in range(3)]
    crossed = V.cross(V.minus(p[1], p[0]), V.minus(p[2], p[0]))
    with_cross = corners.withColumns(dict(zip(("__x", "__y", "__z"), crossed)))
    c = tuple(map(F.col, ("__x", "__y", "__z")))
    columns = dict(zip(("nx", "ny", "nz"), V.normalize(c)))
    for k, axis in enumerate("xyz"):
        values = [q[k] for q in p]
        columns |= {f"c{axis}": (values[0] + values[1] + values[2]) / F.lit(3.0), f"min_{axis}": F.least(*values), f"max_{axis}": F.greatest(*values)}
    columns["area"] = F.lit(0.5) * V.length(c)
    made = with_cross.withColumns(columns).drop("__x", "__y", "__z", *(f"p{k}{a}" for k in range(3) for a in "xyz"))
    return made.select(*(x for x in made.columns if x not in GEOMETRY), *GEOMETRY)


def triangles(meshes: DataFrame, transformed: bool = True) -> DataFrame:
    """(mesh_id, tri_id, v0, v1, v2, geometry) of all meshes."""
    return geometry(triangle_corners(meshes, transformed))


def from_vertices(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles from (vertex_id, x, y, z) and (tri_id, v0, v1, v2), by three joins."""
    out = faces
    for k in range(3):
        out = out.join(points.select(F.col("vertex_id").alias(f"v{k}"), *(F.col(a).alias(f"p{k}{a}") for a in "xyz")), f"v{k}")
    made = geometry(out)
    return made.select("tri_id", "v0", "v1", "v2", *GEOMETRY)


def with_chunks(tris: DataFrame, size: int) -> DataFrame:
    """``tris`` with chunk_id, the number of whole chunks of ``size`` before the triangle."""
    return tris.withColumn("chunk_id", F.expr(f"tri_id div {int(size)}"))


def vertex_centroid(points: DataFrame) -> DataFrame:
    """Mean of x, y and z; the origin of no points."""
    return points.agg(*(F.coalesce(F.avg(a), F.lit(0.0)).alias(a) for a in "xyz"))
