"""Registered queries over the test tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import adjacency, components, entities, geometry, mesh, regions, relations, scene, topology
from ..operators.geometry import CORNERS
from ..operators.mesh import GEOMETRY
from ..operators.numbering import with_dense_ids
from ..sources import decoders, formats, synthetic, tiles3d
from . import fixtures as X
from .engine import MeshEngine, overlays
from .options import EngineOptions, MeshLoadOptions, RegionGrowingOptions
from .storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Decimals of results.
DIGITS = 6
PROXIMITY = 0.5
SOUP_NEAR = 0.05


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, negative zeros made positive, whole numbers as bigint."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if k in ("double", "float") else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in kinds.items()))


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, {DIGITS}) + 0.0e0 AS {c}" for c in columns)


# ------------------------------------------------------------ scalar, scans


@query("tri_geometry", f"WITH {X.HT} SELECT tri_id, v0, v1, v2, {_r(*GEOMETRY)} FROM ht")
def tri_geometry(spark, sf_dir):
    return rounded(X.height_field(spark, sf_dir))


@query("mesh_triangles", f"WITH {X.SP} SELECT tri_id, 3 * tri_id AS v0, 3 * tri_id + 1 AS v1, 3 * tri_id + 2 AS v2, {_r('cx', 'cy', 'cz', 'area')} FROM st")
def mesh_triangles(spark, sf_dir):
    """Meshes of one triangle list each, flattened with running ids."""
    v = X.table(spark, sf_dir, "embeddings")
    meshes = v.select(F.col("vec_id").alias("mesh_id"), F.lit("glb").alias("format"), F.slice("embedding", 1, 9).cast("array<float>").alias("positions"), F.lit(None).cast("array<bigint>").alias("indices"), F.lit(None).cast("array<double>").alias("transform"))
    return rounded(mesh.triangles(meshes).select("tri_id", "v0", "v1", "v2", "cx", "cy", "cz", "area"))


@query("mesh_transform", f"WITH {X.SP} SELECT tri_id, round(cy + 10, {DIGITS}) AS cx, round(-cx + 20, {DIGITS}) AS cy, round(2 * cz + 30, {DIGITS}) AS cz FROM st")
def mesh_transform(spark, sf_dir):
    """Triangles under a turn, a stretch and a shift."""
    v = X.table(spark, sf_dir, "embeddings")
    matrix = F.array(*(F.lit(float(m)) for m in (0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 2, 0, 10, 20, 30, 1)))
    meshes = v.select(F.col("vec_id").alias("mesh_id"), F.lit("glb").alias("format"), F.slice("embedding", 1, 9).cast("array<float>").alias("positions"), F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>").alias("indices"), matrix.alias("transform"))
    return rounded(mesh.triangles(meshes).select("tri_id", "cx", "cy", "cz"))


@query("vertex_centroid", f"WITH {X.HF} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM hv")
def vertex_centroid(spark, sf_dir):
    return rounded(mesh.vertex_centroid(X.height_vertices(spark, sf_dir)))


@query("chunk_assign", f"WITH {X.HF} SELECT tri_id // 500 AS chunk_id, count(*) AS triangles, min(tri_id) AS first_tri, max(tri_id) AS last_tri FROM hf GROUP BY 1")
def chunk_assign(spark, sf_dir):
    tris = mesh.with_chunks(X.height_field(spark, sf_dir), 500)
    return tris.groupBy("chunk_id").agg(F.count("*").alias("triangles"), F.min("tri_id").alias("first_tri"), F.max("tri_id").alias("last_tri"))


_FORMATS = " ".join(f"WHEN ends_with(u, '{s}') THEN '{k}'" for s, k in formats.SUFFIXES.items())


@query("detect_format", f"SELECT page_id, CASE {_FORMATS} ELSE 'obj' END AS format FROM (SELECT page_id, lower(url || ['.GLB', '.obj', '/tileset.json', '.b3dm', '.ply', '.x'][page_id % 6 + 1]) AS u FROM pages)")
def detect_format(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".GLB", ".obj", "/tileset.json", ".b3dm", ".ply", ".x"))), (F.col("page_id") % 6 + 1).cast("int"))
    return X.table(spark, sf_dir, "pages").select("page_id", formats.detect_format(F.concat("url", ending)).alias("format"))


def _obj_files(spark, sf_dir):
    """The height field as one OBJ text."""
    points = X.height_vertices(spark, sf_dir)
    n = F.row_number().over(Window.orderBy("vertex_id"))
    v = points.select(n.cast("long").alias("k"), F.concat_ws(" ", F.lit("v"), *(F.format_string("%.6f", a) for a in "xyz")).alias("line"))
    f = X.height_faces(points).select((F.col("tri_id") + (1 << 40)).alias("k"), F.concat_ws(" ", F.lit("f"), *(F.concat((F.col(f"v{k}") + 1).cast("string"), F.lit("//1")) for k in range(3))).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n")
    return v.unionByName(f).agg(lines.cast("binary").alias("content")).select(F.lit(0).cast("long").alias("ordinal"), F.lit("a/field.obj").alias("path"), "content")


@query("decode_obj", f"WITH {X.HT} SELECT row_number() OVER (ORDER BY tri_id) - 1 AS tri_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz, v0, v1, v2 FROM ht")
def decode_obj(spark, sf_dir):
    """The height field written as OBJ and read back."""
    meshes = decoders.numbered(decoders.DecoderRegistry().decode_files(_obj_files(spark, sf_dir)))
    return rounded(mesh.triangles(meshes).select("tri_id", "cx", "cy", "cz", "v0", "v1", "v2"), 4)


@query("decode_binary", f"WITH {X.SP} SELECT kind, tri_id, {_r('cx', 'cy', 'cz')} FROM st, (VALUES ('glb'), ('ply')) AS k(kind)")
def decode_binary(spark, sf_dir):
    """Each soup triangle as a GLB and as a binary PLY file."""
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 9).alias("p"))

    def write(frames):
        import json
        import struct

        for frame in frames:
            out = []
            for i, p in zip(frame["vec_id"], frame["p"]):
                body = np.asarray(p, dtype="<f4").tobytes() + np.arange(3, dtype="<u2").tobytes() + b"\0\0"
                document = {"meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "buffers": [{"byteLength": 44}], "bufferViews": [{"buffer": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 6}],
                            "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 3}]}
                head = json.dumps(document).encode()
                head += b" " * (-len(head) % 4)
                glb = struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body
                glb = b"glTF" + struct.pack("<II", 2, 12 + len(glb)) + glb
                ply = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
                ply += np.asarray(p, dtype="<f4").tobytes() + b"\x03" + np.arange(3, dtype="<i4").tobytes()
                out += [(2 * i, "m.glb", glb), (2 * i + 1, "m.ply", ply)]
            yield pd.DataFrame(out, columns=["ordinal", "path", "content"])

    files = v.mapInPandas(write, "ordinal long, path string, content binary")
    decoded = decoders.DecoderRegistry().decode_files(files)
    meshes = decoded.select(F.col("ordinal").alias("mesh_id"), "format", "positions", "indices", "transform")
    made = mesh.triangles(meshes)
    return rounded(made.select(F.when(F.col("mesh_id") % 2 == 0, "glb").otherwise("ply").alias("kind"), F.expr("mesh_id div 2").alias("tri_id"), "cx", "cy", "cz"))


@query("decode_text", f"WITH {X.SP} SELECT kind, tri_id, {_r('cx', 'cy', 'cz')} FROM st, (VALUES ('ply'), ('gltf'), ('b3dm')) AS k(kind)")
def decode_text(spark, sf_dir):
    """Each soup triangle as ASCII PLY, as glTF with its buffer in a data URI, and as a GLB within a b3dm."""
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 9).alias("p"))

    def write(frames):
        import base64
        import json
        import struct

        def document(buffer: dict) -> bytes:
            text = json.dumps({"meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "buffers": [{"byteLength": 36, **buffer}], "bufferViews": [{"buffer": 0, "byteLength": 36}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}]}).encode()
            return text + b" " * (-len(text) % 4)

        for frame in frames:
            out = []
            for i, p in zip(frame["vec_id"], frame["p"]):
                body = np.asarray(p, dtype="<f4").tobytes()
                lines = [" ".join(f"{x:.9g}" for x in p[k : k + 3]) for k in (0, 3, 6)]
                ply = "\n".join(["ply", "format ascii 1.0", "element vertex 3", *(f"property float {a}" for a in "xyz"), "element face 1", "property list uchar int vertex_indices", "end_header", *lines, "3 0 1 2", ""]).encode()
                gltf = document({"uri": "data:application/octet-stream;base64," + base64.b64encode(body).decode()})
                head = document({})
                glb = struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body
                glb = b"glTF" + struct.pack("<II", 2, 12 + len(glb)) + glb
                b3dm = b"b3dm" + struct.pack("<II4I", 1, 28 + 8 + len(glb), 8, 0, 0, 0) + b'{"a":0} ' + glb
                out += [(3 * i, "m.ply", ply), (3 * i + 1, "m.gltf", gltf), (3 * i + 2, "m.b3dm", b3dm)]
            yield pd.DataFrame(out, columns=["ordinal", "path", "content"])

    decoded = decoders.DecoderRegistry().decode_files(v.mapInPandas(write, "ordinal long, path string, content binary"))
    made = mesh.triangles(decoded.select(F.col("ordinal").alias("mesh_id"), "format", "positions", "indices", "transform"))
    kind = F.element_at(F.array(*map(F.lit, ("ply", "gltf", "b3dm"))), (F.col("mesh_id") % 3 + 1).cast("int"))
    return rounded(made.select(kind.alias("kind"), F.expr("mesh_id div 3").alias("tri_id"), "cx", "cy", "cz"))


@query("tile_set", "SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS mesh_id, round(20 * n_regionkey + 2 / 3.0e0, 6) AS cx, round(2 * n_nationkey + 2 / 3.0e0, 6) AS cy, round(5.0e0, 6) AS cz FROM nation WHERE n_nationkey <> 3")
def tile_set(spark, sf_dir):
    """A tile set written and read back: a nested one for each region, shifted and doubled in size, a file for each nation; one file is missing."""
    import json
    import uuid

    from .storage import put, shared_dir

    folder = f"{shared_dir(spark)}/strata-tiles-{uuid.uuid4().hex}"
    shift = lambda scale, *at: [scale if k % 5 == 0 and k < 15 else 0 for k in range(12)] + [*at, 1]
    nations = X.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()  # 25 rows
    children = []
    for r in sorted({n.n_regionkey for n in nations}):
        inner = [{"transform": shift(1, 0, n.n_nationkey, 0), "content": {"url": f"n{n.n_nationkey}.obj?v=2#top"}} for n in nations if n.n_regionkey == r]
        put(spark, f"{folder}/sub/r{r}.json", json.dumps({"root": {"children": inner}}).encode())
        children.append({"transform": shift(2, 20 * r, 0, 5), "content": {"uri": f"sub/r{r}.json?x=1"}})
    for n in nations:
        if n.n_nationkey != 3:
            put(spark, f"{folder}/sub/n{n.n_nationkey}.obj", b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    put(spark, f"{folder}/tileset.json", json.dumps({"root": {"children": children}}).encode())
    made = mesh.triangles(tiles3d.read_tileset(spark, f"{folder}/tileset.json"))
    return rounded(made.select("mesh_id", "cx", "cy", "cz"))


@query("matrix_product", "WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, c * 4 + r AS slot, round(e[r + 1] * e[16 + 4 * c + 1] + e[4 + r + 1] * e[16 + 4 * c + 2] + e[8 + r + 1] * e[16 + 4 * c + 3] + e[12 + r + 1] * e[16 + 4 * c + 4], 6) + 0.0e0 AS value FROM m, range(4) AS a(c), range(4) AS b(r)")
def matrix_product(spark, sf_dir):
    """Products of two column-major matrices from each embedding."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(i, k, x) for i, e in zip(frame["vec_id"], frame["embedding"]) for k, x in enumerate(tiles3d.matrix_product([float(a) for a in e[:16]], [float(a) for a in e[16:32]]))], columns=["vec_id", "slot", "value"])

    return rounded(X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, slot long, value double"))


@query("tile_budget", "WITH t AS (SELECT o_orderkey AS ordinal, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), r AS (SELECT ordinal, n, coalesce(sum(n) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT ordinal, n AS triangles FROM r WHERE before < 1000")
def tile_budget(spark, sf_dir):
    """Orders as tiles, line items as triangles: tiles in order until 1000 triangles were loaded."""
    joined = X.table(spark, sf_dir, "orders").join(X.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    tiles = joined.groupBy(F.col("o_orderkey").alias("ordinal")).agg(F.count("*").alias("n"))
    decoded = tiles.select("ordinal", "n", F.lit(None).cast("string").alias("error"), F.array_repeat(F.lit(0.0), (F.col("n") * 9).cast("int")).alias("positions"), F.lit(None).cast("array<bigint>").alias("indices"))
    return tiles3d.within_budget(decoded, MeshLoadOptions(max_triangles=1000)).select("ordinal", F.col("n").alias("triangles"))


@query("synthetic_scenes", "SELECT i AS mesh_id, CAST(2 * 6 * 6 + 22 AS BIGINT) AS triangles, round(16 + 6 + 2 * 0.1e0 + 2 * 2 * 1.0e0 + 0.1e0 * 2, 4) AS area FROM range(4) t(i)")
def synthetic_scenes(spark, sf_dir):
    tris = mesh.triangles(synthetic.tiled_scenes(spark, 4, 6))
    return tris.groupBy("mesh_id").agg(F.count("*").cast("long").alias("triangles"), F.round(F.sum("area"), 4).alias("area"))


@query("random_mesh")
def random_mesh(spark, sf_dir):
    return rounded(mesh.triangles(synthetic.random_mesh(spark, 1000)).select("tri_id", "area", "cx", "cy", "cz"))


# --------------------------------------------------------- adjacency, graphs


@query("edge_adjacency", f"WITH {X.HE} SELECT src, dst FROM he")
def edge_adjacency(spark, sf_dir):
    return adjacency.both_ways(adjacency.edge_pairs(X.height_field(spark, sf_dir))).select("src", "dst")


@query("tri_degree", f"WITH {X.HE} SELECT tri_id, count(src) AS degree FROM ht LEFT JOIN he ON src = tri_id GROUP BY tri_id")
def tri_degree(spark, sf_dir):
    return adjacency.TriangleGraph.build(X.height_field(spark, sf_dir)).degree()


@query("proximity_pairs", f"WITH {X.HT} SELECT p.tri_id AS a, q.tri_id AS b FROM ht p JOIN ht q ON p.tri_id < q.tri_id AND abs(p.cx - q.cx) <= 0.5e0 WHERE sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cz-q.cz)*(p.cz-q.cz)) <= 0.5e0")
def proximity_pairs(spark, sf_dir):
    return adjacency.grid_pairs(X.height_field(spark, sf_dir), PROXIMITY).select("a", "b")


@query("proximity_only", f"WITH {X.HE} SELECT p.tri_id AS src, q.tri_id AS dst FROM ht p JOIN ht q ON p.tri_id <> q.tri_id AND abs(p.cx - q.cx) <= 0.36e0 ANTI JOIN he ON he.src = p.tri_id AND he.dst = q.tri_id WHERE sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cz-q.cz)*(p.cz-q.cz)) <= 0.36e0")
def proximity_only(spark, sf_dir):
    """Near triangles that share no edge."""
    return adjacency.adjacency(X.height_field(spark, sf_dir), 0.36).filter("kind = 'proximity'").select("src", "dst")


@query("soup_proximity", f"WITH {X.SP} SELECT p.tri_id AS a, q.tri_id AS b, round(sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cz-q.cz)*(p.cz-q.cz)), 6) AS distance FROM st p JOIN st q ON p.tri_id < q.tri_id WHERE sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)+(p.cz-q.cz)*(p.cz-q.cz)) <= {SOUP_NEAR}e0")
def soup_proximity(spark, sf_dir):
    return rounded(adjacency.grid_pairs(X.soup(spark, sf_dir), SOUP_NEAR).select("a", "b", "distance"))


_REACH = "r(id, reach) AS (SELECT tri_id, tri_id FROM {nodes} UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)"


@query("components", f"WITH RECURSIVE {X.SP}, p AS (SELECT a.tri_id AS a, b.tri_id AS b FROM st a JOIN st b ON a.tri_id <> b.tri_id WHERE sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) <= {SOUP_NEAR}e0), e AS (SELECT a, b FROM p), {_REACH.format(nodes='st')} SELECT id AS tri_id, min(reach) AS component FROM r GROUP BY id")
def components_of_soup(spark, sf_dir):
    tris = X.soup(spark, sf_dir)
    pairs = adjacency.grid_pairs(tris, SOUP_NEAR).select("a", "b").unionByName(tris.select(F.col("tri_id").alias("a"), F.col("tri_id").alias("b")))
    found = components.components(pairs, "a", "b")
    return found.select(F.col("node").alias("tri_id"), F.col("root").alias("component"))


@query("components_kernel", SQL["components"])
def components_kernel(spark, sf_dir):
    """The same by the kernel that works on whole chunks."""
    tris = mesh.with_chunks(X.soup(spark, sf_dir), 1 << 40)
    return regions.triangle_components(tris, SOUP_NEAR).select("tri_id", "component")


# ------------------------------------------------------------------ regions


def _curved(spark, sf_dir):
    tris = X.height_field(spark, sf_dir)
    return regions.curvature(tris, adjacency.both_ways(adjacency.edge_pairs(tris)))


@query("tri_curvature", f"WITH {X.HE} SELECT t.tri_id, round(CAST(CAST(coalesce(avg(degrees(acos(least(1.0e0, abs(t.nx*u.nx+t.ny*u.ny+t.nz*u.nz))))), 0) AS FLOAT) AS DOUBLE), 3) + 0.0e0 AS curvature FROM ht t LEFT JOIN he ON src = t.tri_id LEFT JOIN ht u ON u.tri_id = dst GROUP BY t.tri_id")
def tri_curvature(spark, sf_dir):
    return rounded(_curved(spark, sf_dir).select("tri_id", F.col("curvature").cast("double").alias("curvature")), 3)


@query("seed_order", f"WITH {X.HE}, c AS (SELECT t.tri_id, round(coalesce(avg(degrees(acos(least(1.0e0, abs(t.nx*u.nx+t.ny*u.ny+t.nz*u.nz))))), 0), 3) AS c FROM ht t LEFT JOIN he ON src = t.tri_id LEFT JOIN ht u ON u.tri_id = dst GROUP BY t.tri_id) SELECT tri_id, row_number() OVER (ORDER BY c, tri_id) - 1 AS seed_rank FROM c")
def seed_order(spark, sf_dir):
    """Triangles by (curvature, id), the order of seeds; doubles are rounded, since a float may lie on the other side of a half."""
    tris = X.height_field(spark, sf_dir)
    at = regions.mean_angles(tris, adjacency.both_ways(adjacency.edge_pairs(tris))).select("tri_id", F.round("curvature", 3).alias("c"))
    return with_dense_ids(materialise(at, counted=True), ["c", "tri_id"], "seed_rank").select("tri_id", "seed_rank")


def _field(spark, sf_dir):
    tris = X.height_field(spark, sf_dir)
    return tris, adjacency.both_ways(adjacency.edge_pairs(tris)), X.height_regions(spark, sf_dir)


@query("region_adjacency", f"WITH {X.HR} SELECT a, b FROM hk")
def region_adjacency(spark, sf_dir):
    _, edges, own = _field(spark, sf_dir)
    return regions.region_adjacency(edges, own)


@query("touch_counts", f"WITH {X.HR} SELECT a, b, count FROM hk")
def touch_counts(spark, sf_dir):
    _, edges, own = _field(spark, sf_dir)
    return regions.touch_counts(edges, own)


@query("region_boundary", f"WITH {X.HR} SELECT tri_id, region_id FROM hb")
def region_boundary(spark, sf_dir):
    _, edges, own = _field(spark, sf_dir)
    return regions.boundary(edges, own)


_SUMMARY = ("nx", "ny", "nz", "cx", "cy", "cz", "area")


@query("region_summary", f"WITH {X.HR} SELECT region_id, {_r(*_SUMMARY)}, triangle_count, boundary_count FROM hg")
def region_summary(spark, sf_dir):
    return rounded(regions.region_summary(*_field(spark, sf_dir)).select("region_id", *_SUMMARY, "triangle_count", "boundary_count"))


@query("region_labels", f"WITH {X.HR} SELECT region_id, CASE WHEN nz > 0.7 THEN CASE WHEN area > 50 THEN 'ground' ELSE 'roof' END WHEN nz < -0.7 THEN 'ceiling' WHEN abs(nz) < 0.3 THEN 'wall' ELSE 'surface' END AS label FROM hg")
def region_labels(spark, sf_dir):
    return regions.region_summary(*_field(spark, sf_dir)).select("region_id", V.label_of(F.col("nz"), F.col("area")).alias("label"))


@query("region_merge_pairs", f"WITH {X.HR} SELECT a, b FROM hk JOIN hg p ON p.region_id = a JOIN hg q ON q.region_id = b WHERE count >= 2 AND degrees(acos(least(1.0e0, abs(p.nx*q.nx+p.ny*q.ny+p.nz*q.nz)))) <= 25 AND (p.boundary_count >= 1 OR q.boundary_count >= 1)")
def region_merge_pairs(spark, sf_dir):
    tris, edges, own = _field(spark, sf_dir)
    return topology.merge_pairs(regions.touch_counts(edges, own), regions.region_summary(tris, edges, own))


@query("support_merge_pairs", f"WITH {X.HR} SELECT p.region_id AS a, q.region_id AS b FROM hg p JOIN hg q ON p.region_id <> q.region_id WHERE p.nz > 0.7 AND p.cz - q.cz > 0 AND p.cz - q.cz <= 1 AND sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)) <= 2")
def support_merge_pairs(spark, sf_dir):
    return topology.support_pairs(regions.region_summary(*_field(spark, sf_dir)))


@query("connected_regions", f"WITH RECURSIVE {X.HR}, k AS (SELECT a, b FROM hk), e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), r(id, reach) AS (SELECT region_id, region_id FROM hg UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach) SELECT id AS region_id, min(reach) AS component FROM r GROUP BY id")
def connected_regions(spark, sf_dir):
    """Tiles joined with all tiles they border on."""
    _, edges, own = _field(spark, sf_dir)
    return regions.connected_regions(regions.region_adjacency(edges, own), own)


@query("region_growing")
def region_growing(spark, sf_dir):
    """Growth and absorption in chunks of the height field."""
    tris = mesh.with_chunks(X.height_field(spark, sf_dir), 2000)
    return regions.grow_regions(tris, RegionGrowingOptions(max_curvature=15.0))


_MERGED = f"""WITH RECURSIVE {X.HR},
p AS (SELECT a, b FROM hk JOIN hg p ON p.region_id = a JOIN hg q ON q.region_id = b
    WHERE count >= 2 AND degrees(acos(least(1.0e0, abs(p.nx*q.nx+p.ny*q.ny+p.nz*q.nz)))) <= 25 AND (p.boundary_count >= 1 OR q.boundary_count >= 1)
  UNION ALL SELECT p.region_id, q.region_id FROM hg p JOIN hg q ON p.region_id <> q.region_id WHERE p.nz > 0.7 AND p.cz - q.cz > 0 AND p.cz - q.cz <= 1 AND sqrt((p.cx-q.cx)*(p.cx-q.cx)+(p.cy-q.cy)*(p.cy-q.cy)) <= 2),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, reach) AS (SELECT region_id, region_id FROM hg UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
g AS (SELECT id, min(reach) AS root FROM r GROUP BY id),
x AS (SELECT root, avg(nz) AS m, sum(area) AS area, count(*) AS region_count, CAST(sum(triangle_count) AS BIGINT) AS triangle_count FROM hg JOIN g ON id = region_id GROUP BY root),
y AS (SELECT root, {', '.join(f'{c[:3]}({c}) AS {c}' for c in CORNERS)} FROM ht JOIN hr USING (tri_id) JOIN g ON id = region_id GROUP BY root)
SELECT dense_rank() OVER (ORDER BY root) - 1 AS entity_id, CASE WHEN m > 0.7 THEN CASE WHEN area > 50 THEN 'ground' ELSE 'roof' END WHEN m < -0.7 THEN 'ceiling' WHEN abs(m) < 0.3 THEN 'wall' ELSE 'surface' END AS label,
  {_r('area', *CORNERS)}, region_count, triangle_count FROM x JOIN y USING (root)"""


@query("topology_entities", _MERGED)
def topology_entities(spark, sf_dir):
    """Tiles merged where they touch and agree, and where one supports another."""
    tris, edges, own = _field(spark, sf_dir)
    summary = regions.region_summary(tris, edges, own)
    pairs = topology.merge_pairs(regions.touch_counts(edges, own), summary).unionByName(topology.support_pairs(summary))
    made, _ = topology.entities_of(summary, pairs)
    return rounded(with_dense_ids(made, "key").select("entity_id", "label", "area", "region_count", "triangle_count", *CORNERS))


@query("extract_entities")
def extract_entities(spark, sf_dir):
    """Entities of the height field, end to end."""
    tris = mesh.with_chunks(X.height_field(spark, sf_dir), EngineOptions().chunk_size)
    return MeshEngine(spark).extract_triangles(tris)


@query("extract_scenes", "SELECT count(*) AS entities, CAST(246 AS BIGINT) AS regions, CAST(145760 AS BIGINT) AS triangles FROM range(81)")
def extract_scenes(spark, sf_dir):
    """Eighty scenes side by side."""
    engine = MeshEngine(spark, EngineOptions(chunk_size=100_000)).set_meshes(synthetic.tiled_scenes(spark, 80, 30))
    found = engine.extract()
    return found.agg(F.count("*").alias("entities"), F.sum("region_count").cast("long").alias("regions"), F.sum("triangle_count").cast("long").alias("triangles"))


# ----------------------------------------------------------------- geometry


_MOMENTS = ("mean_x", "mean_y", "mean_z", "cov_xx", "cov_yy", "cov_zz", "cov_xy", "cov_xz", "cov_yz")
_MOMENTS_SQL = "m AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS n, avg(cx) AS mean_x, avg(cy) AS mean_y, avg(cz) AS mean_z, var_pop(cx) AS cov_xx, var_pop(cy) AS cov_yy, var_pop(cz) AS cov_zz, covar_pop(cx, cy) AS cov_xy, covar_pop(cx, cz) AS cov_xz, covar_pop(cy, cz) AS cov_yz FROM st GROUP BY label)"


@query("entity_moments", f"WITH {X.SP}, {_MOMENTS_SQL} SELECT label, n, {_r(*_MOMENTS)} FROM m")
def entity_moments(spark, sf_dir):
    return rounded(geometry.moments(X.soup(spark, sf_dir), "label"))


@query("entity_pca_values", f"""WITH {X.SP}, {_MOMENTS_SQL},
a AS (SELECT *, (cov_xx + cov_yy + cov_zz) / 3 AS q FROM m),
b AS (SELECT *, sqrt(((cov_xx-q)*(cov_xx-q) + (cov_yy-q)*(cov_yy-q) + (cov_zz-q)*(cov_zz-q) + 2*(cov_xy*cov_xy + cov_xz*cov_xz + cov_yz*cov_yz)) / 6) AS p FROM a),
c AS (SELECT *, acos(greatest(-1, least(1, ((cov_xx-q)*((cov_yy-q)*(cov_zz-q) - cov_yz*cov_yz) - cov_xy*(cov_xy*(cov_zz-q) - cov_yz*cov_xz) + cov_xz*(cov_xy*cov_yz - (cov_yy-q)*cov_xz)) / (2*p*p*p)))) / 3 AS f FROM b)
SELECT label, round(q + 2*p*cos(f), 6) AS l1, round(q - 2*p*cos(f) - 2*p*cos(f + 2.0943951023931953e0), 6) AS l2, round(q + 2*p*cos(f + 2.0943951023931953e0), 6) AS l3 FROM c""")
def entity_pca_values(spark, sf_dir):
    found = geometry.principal_axes(X.soup(spark, sf_dir), "label")
    return rounded(found.select("label", *(F.col("eigenvalues")[k].alias(f"l{k + 1}") for k in range(3))))


@query("entity_bbox", f"WITH {X.SP} SELECT CAST(label AS BIGINT) AS label, " + ", ".join(f"round({c[:3]}({c}), 6) AS {c}" for c in CORNERS) + " FROM st GROUP BY label")
def entity_bbox(spark, sf_dir):
    return rounded(geometry.boxes(X.soup(spark, sf_dir), "label"))


@query("entity_obb")
def entity_obb(spark, sf_dir):
    """Oriented boxes: volume and half extents."""
    found = geometry.oriented_boxes(X.soup(spark, sf_dir), "label")
    return rounded(found.select("label", V.obb_volume(F.col("half")).alias("volume"), *(F.col("half")[k].alias(f"h{k}") for k in range(3))))


@query("obb_aabb", f"""WITH {X.BX}, o AS (SELECT entity_id, (min_x+max_x)/2 AS x, (min_y+max_y)/2 AS y, (min_z+max_z)/2 AS z, (max_x-min_x)/2 AS a, (max_y-min_y)/2 AS b, (max_z-min_z)/2 AS c FROM bx)
SELECT entity_id, round(x - (0.6e0*a + 0.8e0*b), 6) AS low_x, round(y - (0.8e0*a + 0.6e0*b), 6) AS low_y, round(z - c, 6) AS low_z, round(x + (0.6e0*a + 0.8e0*b), 6) AS high_x, round(y + (0.8e0*a + 0.6e0*b), 6) AS high_y, round(z + c, 6) AS high_z, round(8*a*b*c, 6) AS volume FROM o""")
def obb_aabb(spark, sf_dir):
    """Envelopes of the boxes turned about z."""
    b = X.boxes(spark, sf_dir)
    low, high = V.box()
    center = F.array(*V.centre(low, high))
    half = F.array(*(s / F.lit(2.0) for s in V.minus(high, low)))
    axes = F.array(*(F.array(*map(F.lit, row)) for row in ((0.6, 0.8, 0.0), (-0.8, 0.6, 0.0), (0.0, 0.0, 1.0))))
    at = b.select("entity_id", center.alias("center"), half.alias("half"), axes.alias("axes"))
    least, most = V.obb_to_aabb(F.col("center"), F.col("axes"), F.col("half"))
    return rounded(at.select("entity_id", *(c.alias(f"low_{k}") for k, c in zip("xyz", least)), *(c.alias(f"high_{k}") for k, c in zip("xyz", most)), V.obb_volume(F.col("half")).alias("volume")))


_COLORS = " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in (("ground", (0.3, 0.7, 0.3, 1.0)), ("wall", (0.8, 0.5, 0.2, 1.0)), ("roof", (0.8, 0.2, 0.2, 1.0)), ("ceiling", (0.5, 0.5, 0.8, 1.0))))


@query("overlays", f"""WITH {X.BX}, c AS (SELECT *, CAST(CASE label {_COLORS} ELSE [0.2, 0.8, 1.0, 1.0] END AS DOUBLE[]) AS color FROM bx)
SELECT entity_id, round((min_x+max_x)/2, 6) AS center_x, round((min_y+max_y)/2, 6) AS center_y, round((min_z+max_z)/2, 6) AS center_z, round(max_x-min_x, 6) AS size_x, round(max_y-min_y, 6) AS size_y, round(max_z-min_z, 6) AS size_z,
color[1] AS red, color[2] AS green, color[3] AS blue, round(3 * greatest(max_x-min_x, max_y-min_y, max_z-min_z), 6) AS range FROM c""")
def overlays_of_boxes(spark, sf_dir):
    made = overlays(X.boxes(spark, sf_dir))
    return rounded(made.select("entity_id", *(f"{p}_{k}" for p in ("center", "size") for k in "xyz"), *(F.col("color")[k].alias(c) for k, c in enumerate(("red", "green", "blue"))), "range"))


@query("bbox_diagonal", f"WITH {X.BX} SELECT entity_id, round(sqrt((max_x-min_x)*(max_x-min_x)+(max_y-min_y)*(max_y-min_y)+(max_z-min_z)*(max_z-min_z)), 6) AS diagonal FROM bx")
def bbox_diagonal(spark, sf_dir):
    return rounded(X.boxes(spark, sf_dir).select("entity_id", V.bbox_diagonal(*V.box()).alias("diagonal")))


# ---------------------------------------------------------------- relations


def _graph(spark, sf_dir):
    return relations.SpatialGraph.from_entities(X.boxes(spark, sf_dir))


@query("spatial_relations", f"WITH {X.BR} SELECT * FROM br")
def spatial_relations(spark, sf_dir):
    return _graph(spark, sf_dir).edges


@query("relation_counts", f"WITH {X.BR} SELECT type, count(*) AS n FROM br GROUP BY type")
def relation_counts(spark, sf_dir):
    return _graph(spark, sf_dir).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("relation_query", f"WITH {X.BR} SELECT * FROM br WHERE type = 'adjacent' AND (from_id = 7 OR to_id = 7)")
def relation_query(spark, sf_dir):
    return _graph(spark, sf_dir).query("adjacent", 7)


@query("supporters", f"WITH {X.BR} SELECT from_id AS id FROM br WHERE type = 'support' AND to_id = 7")
def supporters(spark, sf_dir):
    return _graph(spark, sf_dir).supporters(7)


@query("supported", f"WITH {X.BR} SELECT to_id AS id FROM br WHERE type = 'support' AND from_id = 7")
def supported(spark, sf_dir):
    return _graph(spark, sf_dir).supported(7)


@query("contained", f"WITH {X.BR} SELECT from_id, to_id AS id FROM br WHERE type = 'contain'")
def contained(spark, sf_dir):
    return _graph(spark, sf_dir).query("contain").select("from_id", F.col("to_id").alias("id"))


@query("neighbors", f"WITH {X.BR} SELECT DISTINCT CASE WHEN from_id = 7 THEN to_id ELSE from_id END AS id FROM br WHERE from_id = 7 OR to_id = 7")
def neighbors(spark, sf_dir):
    return _graph(spark, sf_dir).neighbors(7)


@query("touching", f"WITH {X.HR} SELECT a AS from_id, b AS to_id, 'touch' AS type, 1.0e0 AS weight FROM hk")
def touching(spark, sf_dir):
    """Touch relations of tiles taken as entities."""
    _, edges, own = _field(spark, sf_dir)
    bridge = own.select("region_id", F.col("region_id").alias("entity_id")).distinct()
    return relations.touches(topology.entity_neighbors(regions.touch_counts(edges, own), bridge))


@query("contained_in", f"WITH {X.BR}, most AS (SELECT from_id FROM br WHERE type = 'contain' GROUP BY 1 ORDER BY count(*) DESC, from_id LIMIT 1) SELECT to_id AS id FROM br WHERE type = 'contain' AND from_id = (SELECT from_id FROM most)")
def contained_in(spark, sf_dir):
    """What the box holds that holds most."""
    graph = _graph(spark, sf_dir)
    most = graph.query("contain").groupBy("from_id").count().orderBy(F.desc("count"), "from_id").first()
    return graph.nodes.filter("false").select(F.col("entity_id").alias("id")) if most is None else graph.contained(most["from_id"])


def _touching_graph(spark, sf_dir):
    tris, edges, own = _field(spark, sf_dir)
    bridge = own.select("region_id", F.col("region_id").alias("entity_id")).distinct()
    touches = relations.touches(topology.entity_neighbors(regions.touch_counts(edges, own), bridge))
    return relations.SpatialGraph(touches, bridge.select("entity_id"))


@query("touching_of", f"WITH {X.HR} SELECT CASE WHEN a = 1001 THEN b ELSE a END AS id FROM hk WHERE a = 1001 OR b = 1001")
def touching_of(spark, sf_dir):
    return _touching_graph(spark, sf_dir).touching(1001)


@query("graph_edit", f"WITH {X.HR} SELECT a AS from_id, b AS to_id, 'touch' AS type, 1.0e0 AS weight FROM hk UNION ALL SELECT 1001, 5, 'support', 0.5e0")
def graph_edit(spark, sf_dir):
    return _touching_graph(spark, sf_dir).add_edge(1001, 5, "support", 0.5).edges


@query("graph_nodes", f"WITH {X.HR} SELECT region_id AS entity_id FROM hg UNION ALL SELECT -5")
def graph_nodes(spark, sf_dir):
    return _touching_graph(spark, sf_dir).add_node(spark.createDataFrame([(-5,)], "entity_id long")).nodes


@query("triangle_neighbors", f"WITH {X.HE} SELECT tri_id, {_r('cx', 'cy', 'cz')} FROM ht WHERE tri_id IN (SELECT dst FROM he WHERE src = 40)")
def triangle_neighbors(spark, sf_dir):
    return rounded(adjacency.TriangleGraph.build(X.height_field(spark, sf_dir)).neighbors(40).select("tri_id", "cx", "cy", "cz"))


@query("triangle_graph_edit", f"WITH {X.HE}, e AS (SELECT src, dst FROM he UNION SELECT 0, 40 UNION SELECT 40, 0) SELECT tri_id, count(dst) AS degree FROM ht LEFT JOIN e ON src = tri_id GROUP BY tri_id")
def triangle_graph_edit(spark, sf_dir):
    """Degrees once two triangles have been joined, twice."""
    return adjacency.TriangleGraph.build(X.height_field(spark, sf_dir)).add_edge(0, 40).add_edge(40, 0).degree()


_POINT = "(user_id % 100) / 25.0e0 - 2 AS x, (event_id % 97) / 24.0e0 - 2 AS y, (event_id % 89) / 22.0e0 - 2 AS z"


@query("pick_points", f"WITH {X.BX}, p AS (SELECT event_id AS point_id, {_POINT} FROM events) SELECT point_id, coalesce(min(entity_id), -1) AS entity_id FROM p LEFT JOIN bx ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z GROUP BY point_id")
def pick_points(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    points = events.select(F.col("event_id").alias("point_id"), *(((F.col(c) % m) / F.lit(d) - 2).alias(k) for k, c, m, d in (("x", "user_id", 100, 25.0), ("y", "event_id", 97, 24.0), ("z", "event_id", 89, 22.0))))
    return relations.pick(X.boxes(spark, sf_dir), points).fillna(-1, ["entity_id"])


_CROSS = "x AS (SELECT *, CAST(floor((min_x+max_x)/2) AS BIGINT) AS kx, CAST(floor((min_y+max_y)/2) AS BIGINT) AS ky, CAST(floor((min_z+max_z)/2) AS BIGINT) AS kz FROM bx), c AS (SELECT a.entity_id AS a, b.entity_id AS b FROM x a JOIN x b ON a.entity_id < b.entity_id WHERE abs(a.kx-b.kx) <= 1 AND abs(a.ky-b.ky) <= 1 AND abs(a.kz-b.kz) <= 1 AND a.min_x <= b.max_x+0.5e0 AND a.max_x >= b.min_x-0.5e0 AND a.min_y <= b.max_y+0.5e0 AND a.max_y >= b.min_y-0.5e0 AND a.min_z <= b.max_z+0.5e0 AND a.max_z >= b.min_z-0.5e0)"


@query("cross_chunk_pairs", f"WITH {X.BX}, {_CROSS} SELECT a, b FROM c")
def cross_chunk_pairs(spark, sf_dir):
    return topology.cross_chunk_pairs(X.boxes(spark, sf_dir))


@query("cross_chunk_merge", f"""WITH RECURSIVE {X.BX}, s AS (SELECT entity_id, label, min_x + 3 * entity_id AS min_x, min_y, min_z, max_x + 3 * entity_id AS max_x, max_y, max_z FROM bx), {_CROSS.replace('FROM bx', 'FROM s')},
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c), r(id, reach) AS (SELECT entity_id, entity_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
g AS (SELECT id, min(reach) AS root FROM r GROUP BY id)
SELECT dense_rank() OVER (ORDER BY root) - 1 AS entity_id, arg_min(label, id) AS label, round(min(min_x), 6) AS min_x, round(max(max_x), 6) AS max_x, count(*) AS members FROM s JOIN g ON id = entity_id GROUP BY root""")
def cross_chunk_merge(spark, sf_dir):
    """Boxes in a row, stitched where they come near; the label is that of the lowest id."""
    b = X.boxes(spark, sf_dir).withColumns({c: F.col(c) + 3 * F.col("entity_id") for c in ("min_x", "max_x")}).withColumn("region_count", F.lit(1).cast("long"))
    made, _ = topology.merge_across_chunks(b, topology.cross_chunk_pairs(b))
    return rounded(made.select("entity_id", "label", "min_x", "max_x", F.col("region_count").alias("members")))


@query("text_filter", f"WITH {X.BX} SELECT entity_id, label FROM bx WHERE contains(lower('#' || entity_id || ' ' || label), '1 roof')")
def text_filter(spark, sf_dir):
    b = X.boxes(spark, sf_dir)
    return b.filter(V.matches_text(F.col("entity_id"), F.col("label"), "1 ROOF")).select("entity_id", "label")


# --------------------------------------------------------------- scene tree


_WALK = "w AS (SELECT node_id, 0 AS depth, [ordinal] AS path FROM tn WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.depth + 1, list_append(w.path, n.ordinal) FROM w JOIN tn n ON n.parent_id = w.node_id)"


@query("scene_preorder", f"WITH RECURSIVE {X.TREE}, {_WALK} SELECT t.node_id, t.label, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY path) - 1 AS rank FROM w JOIN tn t USING (node_id)")
def scene_preorder(spark, sf_dir):
    walked = scene.preorder(X.scene_nodes(spark, sf_dir))
    return with_dense_ids(walked, "path", "rank").select("node_id", "label", F.col("depth").cast("long").alias("depth"), "rank")


@query("scene_descendants", f"WITH RECURSIVE {X.TREE}, d AS (SELECT node_id AS ancestor, node_id, 0 AS depth FROM tn UNION ALL SELECT d.ancestor, n.node_id, d.depth + 1 FROM d JOIN tn n ON n.parent_id = d.node_id) SELECT ancestor, node_id, CAST(depth AS BIGINT) AS depth FROM d")
def scene_descendants(spark, sf_dir):
    return rounded(scene.descendants(X.scene_nodes(spark, sf_dir)))


@query("scene_remove", f"WITH RECURSIVE {X.TREE}, d AS (SELECT node_id FROM tn WHERE node_id = 2 UNION ALL SELECT n.node_id FROM d JOIN tn n ON n.parent_id = d.node_id) SELECT node_id, coalesce(parent_id, -1) AS parent_id, entity_id, label, ordinal FROM tn WHERE node_id NOT IN (SELECT node_id FROM d)")
def scene_remove(spark, sf_dir):
    tree = scene.SceneGraph(spark, X.scene_nodes(spark, sf_dir))
    tree.remove(2)
    return tree.nodes.fillna(-1, ["parent_id"])


@query("scene_move", f"WITH {X.TREE} SELECT node_id, CASE WHEN node_id = 100 THEN 4 ELSE coalesce(parent_id, -1) END AS parent_id, entity_id, label, CASE WHEN node_id = 100 THEN (SELECT max(ordinal) + 1 FROM tn WHERE parent_id = 4) ELSE ordinal END AS ordinal FROM tn")
def scene_move(spark, sf_dir):
    tree = scene.SceneGraph(spark, X.scene_nodes(spark, sf_dir))
    tree.move(100, 4)
    return tree.nodes.fillna(-1, ["parent_id"])


def _tree(spark, sf_dir):
    return scene.SceneGraph(spark, X.scene_nodes(spark, sf_dir))


_NODE = "node_id, coalesce(parent_id, -1) AS parent_id, entity_id, label, ordinal"


@query("scene_root", "SELECT 0::BIGINT AS node_id, -1::BIGINT AS parent_id, -1::BIGINT AS entity_id, 'scene' AS label, 0::BIGINT AS ordinal")
def scene_root(spark, sf_dir):
    return scene.SceneGraph(spark).nodes.fillna(-1, ["parent_id"])


@query("scene_add", f"WITH {X.TREE}, k AS (SELECT max(node_id) + 1 AS id, max(CASE WHEN parent_id = 3 THEN ordinal END) + 1 AS o FROM tn) SELECT {_NODE} FROM tn UNION ALL SELECT id, 3, -1, 'group', o FROM k UNION ALL SELECT id + 1, id, 77, 'one', 0 FROM k UNION ALL SELECT id + 2, id, 78, 'two', 1 FROM k")
def scene_add(spark, sf_dir):
    """A group under a node, and two entities in it."""
    tree = _tree(spark, sf_dir)
    group = tree.add_group("group", 3)
    tree.add_entity(77, "one", group)
    tree.add_entity(78, "two", group)
    return tree.nodes.fillna(-1, ["parent_id"])


@query("scene_rebuild", f"WITH {X.TREE}, {X.BX} SELECT {_NODE} FROM tn WHERE node_id = 0 UNION ALL SELECT (SELECT max(node_id) FROM tn) + row_number() OVER (ORDER BY entity_id), 0, entity_id, label, row_number() OVER (ORDER BY entity_id) - 1 FROM bx")
def scene_rebuild(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    tree.rebuild(X.boxes(spark, sf_dir))
    return tree.nodes.fillna(-1, ["parent_id"])


@query("scene_lookup", f"WITH {X.TREE} SELECT {_NODE}, entity_id AS of_node FROM tn WHERE node_id = 1003")
def scene_lookup(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return tree.get_node(1003).fillna(-1, ["parent_id"]).withColumn("of_node", F.lit(tree.get_entity_by_node(1003)).cast("long"))


@query("scene_query", f"WITH {X.TREE} SELECT node_id FROM tn WHERE label LIKE '%A%'")
def scene_query(spark, sf_dir):
    return _tree(spark, sf_dir).query(F.col("label").contains("A")).select("node_id")


@query("scene_size", f"WITH {X.TREE} SELECT count(*) AS size FROM tn")
def scene_size(spark, sf_dir):
    return spark.createDataFrame([(_tree(spark, sf_dir).size(),)], "size long")


@query("scene_entities", f"WITH RECURSIVE {X.TREE}, {_WALK} SELECT t.entity_id, row_number() OVER (ORDER BY path) - 1 AS rank FROM w JOIN tn t USING (node_id) WHERE t.entity_id <> -1")
def scene_entities(spark, sf_dir):
    """Entities in pre-order."""
    return with_dense_ids(_tree(spark, sf_dir).iter_entities(), "path", "rank").select("entity_id", "rank")


@query("scene_is_below", f"WITH RECURSIVE {X.TREE}, u AS (SELECT node_id, parent_id FROM tn WHERE node_id = 1003 UNION ALL SELECT t.node_id, t.parent_id FROM u JOIN tn t ON t.node_id = u.parent_id) SELECT r_regionkey + 1 AS node_id, r_regionkey + 1 IN (SELECT node_id FROM u) AS below FROM region")
def scene_is_below(spark, sf_dir):
    """For each region whether a supplier hangs below it."""
    tree = _tree(spark, sf_dir)
    return spark.createDataFrame([(r.r_regionkey + 1, tree.is_descendant(1003, r.r_regionkey + 1)) for r in X.table(spark, sf_dir, "region").collect()], "node_id long, below boolean")  # five rows


# ------------------------------------------------------------------ entities


def _members(spark, sf_dir):
    """Memberships: tiles of the height field are regions, rows of tiles are entities."""
    tris, edges, own = _field(spark, sf_dir)
    at = own.withColumn("entity_id", F.expr("region_id div 1000"))
    of_regions = regions.region_summary(tris, edges, own).select("region_id", F.expr("region_id div 1000").alias("entity_id"), "nz", "area")
    return of_regions, tris.join(at, "tri_id").select("entity_id", "tri_id", "region_id", *CORNERS)


_ENTITY = "SELECT CAST({e} AS BIGINT) AS entity_id, avg(nz) AS m, sum(area) AS area, count(*) AS region_count FROM hg WHERE {w} GROUP BY 1"
_BOXED = "SELECT CAST({e} AS BIGINT) AS entity_id, count(*) AS triangle_count, " + ", ".join(f"{c[:3]}({c}) AS {c}" for c in CORNERS) + " FROM ht JOIN hr USING (tri_id) WHERE {w} GROUP BY 1"
_LABEL = "CASE WHEN m > 0.7 THEN CASE WHEN {a} > 50 THEN 'ground' ELSE 'roof' END WHEN m < -0.7 THEN 'ceiling' WHEN abs(m) < 0.3 THEN 'wall' ELSE 'surface' END"


def _entity_sql(e: str, w: str = "true", area: str = "area") -> str:
    return f"WITH {X.HR}, a AS ({_ENTITY.format(e=e, w=w)}), b AS ({_BOXED.format(e=e, w=w)}) SELECT entity_id, {_LABEL.format(a=area)} AS label, {_r('area', *CORNERS)}, region_count, triangle_count FROM a JOIN b USING (entity_id)"


_ENTITY_COLUMNS = ("entity_id", "label", "area", *CORNERS, "region_count", "triangle_count")


@query("entity_build", _entity_sql("region_id // 1000"))
def entity_build(spark, sf_dir):
    of_regions, tris = _members(spark, sf_dir)
    return rounded(entities.build(of_regions, tris).select(*_ENTITY_COLUMNS))


@query("entity_merge", _entity_sql("CASE WHEN region_id // 1000 = 1 THEN 0 ELSE region_id // 1000 END", area="CASE WHEN entity_id = 0 THEN triangle_count ELSE area END"))
def entity_merge(spark, sf_dir):
    of_regions, tris = _members(spark, sf_dir)
    near = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "entity_id long, neighbor_id long")
    made, _, _ = entities.merge(0, 1, of_regions, tris, near)
    return rounded(made.select(*_ENTITY_COLUMNS))


@query("entity_split", _entity_sql("CASE WHEN region_id IN (0, 1) THEN 0 ELSE 1 END", "region_id // 1000 = 0"))
def entity_split(spark, sf_dir):
    of_regions, tris = _members(spark, sf_dir)
    made = entities.split(0, [0, 1], of_regions, tris.select("entity_id", "tri_id", *CORNERS), tris.select("tri_id", "region_id"))
    return rounded(made.select(*_ENTITY_COLUMNS))


@query("entity_rebuild", f"WITH {X.HR}, b AS ({_BOXED.format(e='region_id // 1000', w='true')}) SELECT entity_id, triangle_count, {_r(*CORNERS)} FROM b")
def entity_rebuild(spark, sf_dir):
    """Boxes of entities from their triangles anew, once those they had are lost."""
    of_regions, tris = _members(spark, sf_dir)
    lost = entities.build(of_regions, tris).withColumns({c: F.lit(0.0) for c in CORNERS})
    made = entities.rebuild_geometry(lost, tris)
    return rounded(made.select("entity_id", "triangle_count", *CORNERS))
