"""Formats, decoders, tile sets and the mesh stream."""

import base64
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.operators import mesh
from stratamesh.plans.engine import MeshEngine
from stratamesh.plans.options import EngineOptions, MeshLoadOptions
from stratamesh.sources import decoders, formats, synthetic, tiles3d
from stratamesh.streaming.ingest import stream_meshes

QUAD = b"# quad\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\n\nf 1/1/1 2//2 3 -1\n"
POINTS = np.array([0, 0, 0, 1, 0, 0, 0, 1, 0], dtype="<f4")


def glb(points=POINTS, stride=0):
    rows = points.reshape(-1, 3)
    body = b"".join(r.tobytes().ljust(stride or 12, b"\0") for r in rows)
    document = {
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}, {"attributes": {}}, {"attributes": {"POSITION": 0}, "mode": 1}]}],
        "buffers": [{"byteLength": len(body)}], "bufferViews": [{"buffer": 0, "byteOffset": 0, **({"byteStride": stride} if stride else {})}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": len(rows)}],
    }
    head = json.dumps(document).encode()
    head += b" " * (-len(head) % 4)
    chunks = struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body
    return b"glTF" + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def b3dm(inner):
    return b"b3dm" + struct.pack("<II4I", 1, 28 + 4 + len(inner), 4, 0, 0, 0) + b"feat" + inner


@pytest.mark.parametrize(
    ("path", "content", "kind"),
    [("a/TILESET.json", None, "3dtiles"), ("a.osgb", None, "osgb"), ("a.OBJ", None, "obj"), ("a.gltf", None, "gltf"), ("a.b3dm", None, "glb"), ("a.ply", None, "ply"), ("a.las", None, "las"), ("a.laz", None, "laz"), ("a", b"glTF1234", "glb"), ("a", b"b3dm1234", "glb"), ("a", b"x", "obj")],
)
def test_formats(spark, path, content, kind):
    assert formats.format_of(path, content) == kind
    row = spark.createDataFrame([(path, content)], "path string, content binary").select(formats.detect_format(F.col("path"), F.col("content"))).first()
    assert row[0] == kind


def test_obj_fans_and_negative_indices():
    (m,) = decoders.decode_obj(QUAD)
    assert m["positions"].tolist() == [0, 0, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0] and m["indices"].tolist() == [0, 1, 2, 0, 2, 3]


HEADER = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"


def test_ply_in_every_encoding():
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    plain = HEADER.format("ascii") + "".join(f"{x} {y} {z} 9\n" for x, y, z in corners) + "4 0 1 2 3\n"
    prefixed = HEADER.format("ascii") + "".join(f"v {x} {y} {z} 9\n" for x, y, z in corners) + "f 4 0 1 2 3\n"
    files = [plain.encode(), prefixed.encode()]
    for name, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        body = b"".join(struct.pack(order + "fffB", *c, 9) for c in corners) + struct.pack(order + "B4i", 4, 0, 1, 2, 3)
        files.append(HEADER.format(name).encode() + body)
    for data in files:
        (m,) = decoders.decode_ply(data)
        assert m["positions"].reshape(-1, 3).tolist() == [list(map(float, c)) for c in corners] and m["indices"].tolist() == [0, 1, 2, 0, 2, 3]
    assert decoders.decode_ply(POINTS.tobytes())[0]["positions"].tolist() == POINTS.tolist()


def test_gltf_containers():
    for data in (glb(), glb(stride=16), b3dm(glb())):
        (m,) = decoders.decode_glb(data)
        assert m["positions"].tolist() == POINTS.tolist() and m["indices"] is None
    document = {"meshes": {"m": {"primitives": [{"attributes": {"POSITION": "a"}, "indices": "i"}]}}, "accessors": {"a": {"bufferView": "v", "byteOffset": 0, "byteStride": 12, "componentType": 5126, "type": "VEC3", "count": 3}, "i": {"bufferView": "w", "componentType": 5123, "type": "SCALAR", "count": 3}},
                "bufferViews": {"v": {"buffer": "b", "byteOffset": 0}, "w": {"buffer": "b", "byteOffset": 36}}, "buffers": {"b": {}}}
    head = json.dumps(document).encode()
    one = b"glTF" + struct.pack("<IIII", 1, 0, len(head), 0) + head + POINTS.tobytes() + np.arange(3, dtype="<u2").tobytes()
    assert decoders.decode_glb(one)[0]["indices"].tolist() == [0, 1, 2]
    inline = {"meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 3}], "bufferViews": [{"buffer": 0}], "buffers": [{"uri": "data:application/octet-stream;base64," + base64.b64encode(POINTS.tobytes()).decode()}]}
    assert decoders.decode_gltf(json.dumps(inline).encode())[0]["positions"].tolist() == POINTS.tolist()
    assert decoders.data_uri("data:,a%20b") == b"a b" and decoders.decode_glb(POINTS.tobytes())[0]["positions"].size == 9
    with pytest.raises(ValueError):
        decoders.decode_glb(b"12345")
    assert formats.strip_b3dm(b"b3dm") == b"b3dm"


def test_registry_and_files(spark, tmp_path):
    registry = decoders.DecoderRegistry()
    with pytest.raises(ValueError):
        registry.decode("osgb", b"")
    registry.register("osgb", lambda data, path: [decoders.mesh("osgb", POINTS), decoders.mesh("osgb", POINTS)])
    assert len(registry.decode("osgb", b"")) == 2
    (tmp_path / "a.obj").write_bytes(QUAD)
    (tmp_path / "b.osgb").write_bytes(b"x")
    (tmp_path / "c.glb").write_bytes(glb())
    engine = MeshEngine(spark)
    engine.registry = registry
    engine.load(str(tmp_path))
    assert [(r.mesh_id, r.format) for r in engine.meshes.orderBy("mesh_id").collect()] == [(0, "obj"), (1, "osgb"), (2, "osgb"), (3, "glb")]
    assert engine.triangles.count() == 5


def shift(x):
    return [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, 0, 0, 1]


def tile_set(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "tileset.json").write_text(json.dumps({"root": {"transform": shift(100), "content": {"uri": "sub/nested.json"}, "children": [{"content": {"uri": "last.b3dm"}}, {"content": {"url": "missing.json"}}, {"content": {"uri": "cloud.pnts"}}]}}))
    (tmp_path / "sub" / "nested.json").write_text(json.dumps({"root": {"children": [{"content": {"url": "leaf.obj"}, "transform": [2.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]}]}}))
    (tmp_path / "sub" / "leaf.obj").write_bytes(QUAD)
    (tmp_path / "last.b3dm").write_bytes(b3dm(glb()))
    (tmp_path / "cloud.pnts").write_bytes(b"pnts")
    return str(tmp_path / "tileset.json")


def test_tile_set(spark, tmp_path):
    path = tile_set(tmp_path)
    engine = MeshEngine(spark).load(path)
    rows = engine.meshes.orderBy("mesh_id").collect()
    assert [r.format for r in rows] == ["obj", "glb"] and rows[0].transform[12] == 100 and rows[0].transform[0] == 2
    assert engine.triangles.agg(F.max("max_x")).first()[0] == 102
    assert tiles3d.read_tileset(spark, path, compat=True).orderBy("mesh_id").first().transform[12] == 200
    assert tiles3d.read_tileset(spark, path, MeshLoadOptions(max_tiles=1)).count() == 1
    assert tiles3d.read_tileset(spark, path, MeshLoadOptions(max_triangles=2)).count() == 1
    assert tiles3d.read_tileset(spark, path, MeshLoadOptions(max_depth=0)).count() == 0


def test_synthetic_scenes(spark):
    tris = mesh.triangles(synthetic.tiled_scenes(spark, 5, 4))
    assert tris.groupBy("mesh_id").count().select("count").distinct().collect() == [(54,)]
    assert tris.agg(F.round(F.max("max_x"), 3)).first()[0] == 12.0
    assert mesh.triangles(synthetic.random_mesh(spark, 50, 3)).count() == 50


def test_stream_extracts_what_has_arrived(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    for k in range(2):
        synthetic.tiled_scenes(spark, 1, 6).withColumn("mesh_id", F.lit(k).cast("long")).coalesce(1).write.mode("append").parquet(source)
        stream = stream_meshes(spark, source, str(tmp_path / "state"), lambda found, number: seen.append(found.agg(F.sum("triangle_count")).first()[0]), EngineOptions())
        stream.awaitTermination(120)
    assert seen == [94, 188]
