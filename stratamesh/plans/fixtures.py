"""Meshes, boxes and trees derived from the relational test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh

# Spacing of the height field, scale of heights, centres and half sizes of boxes.
STEP_X, STEP_Y, STEP_Z = 0.31, 0.29, 0.004
CENTRE, HALF = 8.0, 6.0
TILE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vertex_id, i, j, w, x, y, z): parts on a square lattice, their size as height."""
    part = table(spark, sf_dir, "part")
    width = part.agg(F.floor(F.sqrt(F.count("*"))).alias("w"))
    at = part.select("p_partkey", "p_size").crossJoin(F.broadcast(width))  # one row
    i, j = F.col("p_partkey") % F.col("w"), F.expr("p_partkey div w")
    return at.select(
        F.col("p_partkey").alias("vertex_id"), i.alias("i"), j.alias("j"), "w",
        (i * F.lit(STEP_X)).alias("x"), (j * F.lit(STEP_Y)).alias("y"), (F.col("p_size") * F.lit(STEP_Z)).alias("z"),
    )


def height_faces(points: DataFrame) -> DataFrame:
    """(tri_id, v0, v1, v2, i, j): two triangles for each quad whose four corners exist."""
    a = points.select(F.col("vertex_id").alias("a"), "i", "j", "w").filter("i < w - 1")
    have = points.select("vertex_id")
    quads = a.withColumns({"b": F.col("a") + 1, "c": F.col("a") + F.col("w") + 1, "d": F.col("a") + F.col("w")})
    for k in "bcd":
        quads = quads.join(have.withColumnRenamed("vertex_id", k), k, "left_semi")
    two = F.explode(F.array(*(F.struct((2 * F.col("a") + n).alias("tri_id"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(corners))) for n, corners in ((0, "abc"), (1, "acd")))))
    return quads.select("i", "j", two.alias("t")).select("t.*", "i", "j")


def height_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = height_vertices(spark, sf_dir)
    faces = height_faces(points)
    return mesh.from_vertices(points.select("vertex_id", "x", "y", "z"), faces.select("tri_id", "v0", "v1", "v2"))


def height_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tri_id, region_id): square tiles of the height field."""
    faces = height_faces(height_vertices(spark, sf_dir))
    return faces.select("tri_id", F.expr(f"(j div {TILE}) * 1000 + (i div {TILE})").alias("region_id"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, box, label): a box for each embedding."""
    v = table(spark, sf_dir, "embeddings")
    e = [F.col("embedding")[k].cast("double") for k in range(6)]
    corners = {f"{m}_{a}": e[k] * F.lit(CENTRE) + s * (F.abs(e[k + 3]) * F.lit(HALF)) for m, s in (("min", -1), ("max", 1)) for k, a in enumerate("xyz")}
    return v.select(F.col("vec_id").alias("entity_id"), *(c.alias(n) for n, c in corners.items()), F.element_at(F.array(*map(F.lit, ("ground", "wall", "roof", "ceiling", "surface"))), F.col("label") % 5 + 1).alias("label"))


def soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles with vertices of their own, one for each embedding, and the embedding's label."""
    v = table(spark, sf_dir, "embeddings")
    coordinates = [F.col("embedding")[3 * k + n].cast("double").alias(f"p{k}{a}") for k in range(3) for n, a in enumerate("xyz")]
    corners = v.select(F.col("vec_id").alias("tri_id"), *((3 * F.col("vec_id") + k).alias(f"v{k}") for k in range(3)), "label", *coordinates)
    return mesh.geometry(corners)


def scene_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of regions, nations and suppliers: nodes 1, 100 + nation, 1000 + supplier under root 0."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda df, i, p, e, label, o: df.select(*(c.cast(t).alias(n) for n, t, c in (("node_id", "long", i), ("parent_id", "long", p), ("entity_id", "long", e), ("label", "string", label), ("ordinal", "long", o))))
    root = node(spark.range(1), F.lit(0), F.lit(None), F.lit(-1), F.lit("scene"), F.lit(0))
    r = node(region, F.col("r_regionkey") + 1, F.lit(0), F.lit(-1), F.col("r_name"), F.col("r_regionkey"))
    n = node(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.lit(-1), F.col("n_name"), F.col("n_nationkey"))
    s = node(supplier, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, F.col("s_suppkey"), F.col("s_name"), F.col("s_suppkey"))
    return root.unionByName(r).unionByName(n).unionByName(s)


# ------------------------------------------------------------------ in SQL

HF = """
hw AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part),
hv AS (SELECT p_partkey AS id, p_partkey % w AS i, p_partkey // w AS j, w, (p_partkey % w) * 0.31e0 AS x, (p_partkey // w) * 0.29e0 AS y, p_size * 0.004e0 AS z FROM part, hw),
hq AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d, a.i AS i, a.j AS j FROM hv a JOIN hv b ON b.id = a.id + 1 JOIN hv d ON d.id = a.id + a.w JOIN hv c ON c.id = a.id + a.w + 1 WHERE a.i < a.w - 1),
hf AS (SELECT 2 * a AS tri_id, a AS v0, b AS v1, c AS v2, i, j FROM hq UNION ALL SELECT 2 * a + 1, a, c, d, i, j FROM hq),
hp AS (SELECT f.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, r.x AS rx, r.y AS ry, r.z AS rz
  FROM hf f JOIN hv p ON p.id = v0 JOIN hv q ON q.id = v1 JOIN hv r ON r.id = v2)"""

#: Geometry of corners p, q, r in a relation ``src``, as a relation ``name``.
GEO = """
{name}_c AS (SELECT *, (qy-py)*(rz-pz)-(qz-pz)*(ry-py) AS kx, (qz-pz)*(rx-px)-(qx-px)*(rz-pz) AS ky, (qx-px)*(ry-py)-(qy-py)*(rx-px) AS kz FROM {src}),
{name}_l AS (SELECT *, sqrt(kx*kx+ky*ky+kz*kz) AS kl FROM {name}_c),
{name} AS (SELECT * EXCLUDE (kx, ky, kz, kl), CASE WHEN kl > 1e-12 THEN kx/kl ELSE kx END AS nx, CASE WHEN kl > 1e-12 THEN ky/kl ELSE ky END AS ny, CASE WHEN kl > 1e-12 THEN kz/kl ELSE kz END AS nz,
  (px+qx+rx)/3.0e0 AS cx, (py+qy+ry)/3.0e0 AS cy, (pz+qz+rz)/3.0e0 AS cz,
  least(px,qx,rx) AS min_x, least(py,qy,ry) AS min_y, least(pz,qz,rz) AS min_z, greatest(px,qx,rx) AS max_x, greatest(py,qy,ry) AS max_y, greatest(pz,qz,rz) AS max_z, 0.5e0*kl AS area FROM {name}_l)"""

HT = HF + "," + GEO.format(name="ht", src="hp")
HE = HT + """,
hs AS (SELECT tri_id, least(v0,v1) AS lo, greatest(v0,v1) AS hi FROM ht UNION ALL SELECT tri_id, least(v1,v2), greatest(v1,v2) FROM ht UNION ALL SELECT tri_id, least(v2,v0), greatest(v2,v0) FROM ht),
he AS (SELECT DISTINCT a.tri_id AS src, b.tri_id AS dst FROM hs a JOIN hs b USING (lo, hi) WHERE a.tri_id <> b.tri_id)"""
HR = HE + """,
hr AS (SELECT tri_id, (j // 5) * 1000 + (i // 5) AS region_id FROM hf),
hk AS (SELECT a.region_id AS a, b.region_id AS b, count(*) AS count FROM he JOIN hr a ON a.tri_id = src JOIN hr b ON b.tri_id = dst WHERE a.region_id < b.region_id GROUP BY ALL),
hb AS (SELECT DISTINCT src AS tri_id, a.region_id FROM he JOIN hr a ON a.tri_id = src JOIN hr b ON b.tri_id = dst WHERE a.region_id <> b.region_id),
hm AS (SELECT region_id, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz, avg(cx) AS cx, avg(cy) AS cy, avg(cz) AS cz, sum(area) AS area, count(*) AS triangle_count FROM ht JOIN hr USING (tri_id) GROUP BY region_id),
hg AS (SELECT region_id, mx/sqrt(mx*mx+my*my+mz*mz) AS nx, my/sqrt(mx*mx+my*my+mz*mz) AS ny, mz/sqrt(mx*mx+my*my+mz*mz) AS nz, cx, cy, cz, area, triangle_count, coalesce(k, 0) AS boundary_count
  FROM hm LEFT JOIN (SELECT region_id, count(*) AS k FROM hb GROUP BY 1) USING (region_id))"""
BX = """
bx AS (SELECT vec_id AS entity_id, ['ground','wall','roof','ceiling','surface'][label % 5 + 1] AS label,
  e[1]*8.0e0 - abs(e[4])*6.0e0 AS min_x, e[2]*8.0e0 - abs(e[5])*6.0e0 AS min_y, e[3]*8.0e0 - abs(e[6])*6.0e0 AS min_z,
  e[1]*8.0e0 + abs(e[4])*6.0e0 AS max_x, e[2]*8.0e0 + abs(e[5])*6.0e0 AS max_y, e[3]*8.0e0 + abs(e[6])*6.0e0 AS max_z
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
BR = BX + """,
bp AS (SELECT a.entity_id AS i, b.entity_id AS j,
  a.min_x <= b.max_x AND a.max_x >= b.min_x AND a.min_y <= b.max_y AND a.max_y >= b.min_y AND a.min_z <= b.max_z AND a.max_z >= b.min_z AS meet,
  a.min_x <= b.min_x AND a.max_x >= b.max_x AND a.min_y <= b.min_y AND a.max_y >= b.max_y AND a.min_z <= b.min_z AND a.max_z >= b.max_z AS a_in,
  b.min_x <= a.min_x AND b.max_x >= a.max_x AND b.min_y <= a.min_y AND b.max_y >= a.max_y AND b.min_z <= a.min_z AND b.max_z >= a.max_z AS b_in,
  greatest(a.min_x - b.max_x, b.min_x - a.max_x) AS gx, greatest(a.min_y - b.max_y, b.min_y - a.max_y) AS gy, greatest(a.min_z - b.max_z, b.min_z - a.max_z) AS gz,
  a.min_z - b.max_z AS up_a, b.min_z - a.max_z AS up_b
  FROM bx a JOIN bx b ON a.entity_id < b.entity_id),
br AS (
  SELECT i AS from_id, j AS to_id, 'intersect' AS type, 0.5e0 AS weight FROM bp WHERE meet
  UNION ALL SELECT CASE WHEN a_in THEN i ELSE j END, CASE WHEN a_in THEN j ELSE i END, 'contain', 1.0e0 FROM bp WHERE a_in OR b_in
  UNION ALL SELECT i, j, 'adjacent', 0.7e0 FROM bp WHERE gz <= 0 AND ((gx BETWEEN -0.1e0 AND 0.5e0 AND gy <= 0) OR (gy BETWEEN -0.1e0 AND 0.5e0 AND gx <= 0))
  UNION ALL SELECT CASE WHEN up_a BETWEEN -0.5e0 AND 1.5e0 THEN j ELSE i END, CASE WHEN up_a BETWEEN -0.5e0 AND 1.5e0 THEN i ELSE j END, 'support', 0.8e0 FROM bp
    WHERE gx <= 0 AND gy <= 0 AND (up_a BETWEEN -0.5e0 AND 1.5e0 OR up_b BETWEEN -0.5e0 AND 1.5e0))"""
SP = """
sp AS (SELECT vec_id AS tri_id, label, e[1] AS px, e[2] AS py, e[3] AS pz, e[4] AS qx, e[5] AS qy, e[6] AS qz, e[7] AS rx, e[8] AS ry, e[9] AS rz
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),""" + GEO.format(name="st", src="sp")
TREE = """
tn AS (
  SELECT CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CAST(-1 AS BIGINT) AS entity_id, 'scene' AS label, CAST(0 AS BIGINT) AS ordinal
  UNION ALL SELECT r_regionkey + 1, 0, -1, r_name, r_regionkey FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, -1, n_name, n_nationkey FROM nation
  UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_suppkey, s_name, s_suppkey FROM supplier)"""
