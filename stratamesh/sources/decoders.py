"""Decoders from bytes to meshes: OBJ, PLY, glTF and GLB, and a registry for more.

A decoder takes (bytes, path) and returns meshes as dictionaries with
format, positions (flat), indices (or None) and transform (or None).
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import MESH_SCHEMA
from ..operators.numbering import with_dense_ids
from ..plans.storage import materialise
from .formats import detect_format, format_of, strip_b3dm

Mesh = dict
Decoder = Callable[[bytes, str], "Mesh | list[Mesh]"]


def mesh(kind: str, positions, indices=None, transform=None) -> Mesh:
    return {
        "format": kind,
        "positions": np.asarray(positions, dtype=np.float32).ravel(),
        "indices": None if indices is None else np.asarray(indices, dtype=np.int64).ravel(),
        "transform": None if transform is None else [float(v) for v in transform],
    }


def decode_obj(data: bytes, path: str = "") -> list[Mesh]:
    """Vertices and faces, fans of polygons; indices from one, or negative from the latest vertex; other lines are skipped."""
    points: list[float] = []
    faces: list[int] = []
    for line in data.decode("utf-8", "replace").splitlines():
        word, *rest = line.split() or [""]
        if word == "v" and len(rest) >= 3:
            points += map(float, rest[:3])
        elif word == "f":
            numbers = [int(r.split("/")[0]) for r in rest]
            corners = [i - 1 if i > 0 else len(points) // 3 + i for i in numbers]
            for k in range(1, len(corners) - 1):
                faces += (corners[0], corners[k], corners[k + 1])
    return [mesh("obj", points, faces)]


# PLY number types and numpy's names for them.
PLY_TYPES = {
    "char": "i1",
    "int8": "i1",
    "uchar": "u1",
    "uint8": "u1",
    "short": "i2",
    "int16": "i2",
    "ushort": "u2",
    "uint16": "u2",
    "int": "i4",
    "int32": "i4",
    "uint": "u4",
    "uint32": "u4",
    "float": "f4",
    "float32": "f4",
    "double": "f8",
    "float64": "f8",
}


def decode_ply(data: bytes, path: str = "") -> list[Mesh]:
    """ASCII or binary of either byte order, properties as the header names them; polygons become fans.

    ASCII lines may be prefixed by v, vertex, f or face. Without a header the bytes are 32-bit coordinates.
    """
    end = data.find(b"end_header")
    if end < 0:
        return [mesh("ply", np.frombuffer(data[: len(data) // 4 * 4], dtype="<f4"))]
    body_at = data.index(b"\n", end) + 1 if b"\n" in data[end:] else len(data)
    order, elements, ascii_ = "<", [], True
    for line in data[:end].decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            ascii_, order = word[1] == "ascii", ">" if word[1].endswith("big_endian") else "<"
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"] and elements:
            elements[-1][2].append(word[1:])
    points: list = []
    faces: list[int] = []

    def fan(corners) -> None:
        for k in range(1, len(corners) - 1):
            faces.extend((int(corners[0]), int(corners[k]), int(corners[k + 1])))

    if ascii_:
        lines = [w for w in (line.split() for line in data[body_at:].decode("ascii", "replace").splitlines()) if w]
        at = 0
        for name, n, properties in elements:
            names = [p[-1] for p in properties]
            for words in lines[at : at + n]:
                if words[0] in ("v", "vertex", "f", "face"):
                    words = words[1:]
                if name == "vertex":
                    places = [names.index(a) for a in "xyz"] if {"x", "y", "z"} <= set(names) else [0, 1, 2]
                    points.append([float(words[k]) for k in places])
                elif name == "face":
                    fan([int(w) for w in words[1 : 1 + int(words[0])]])
            at += n
        return [mesh("ply", points, faces)]
    at = body_at
    for name, n, properties in elements:
        if all(p[0] != "list" for p in properties):
            kind = np.dtype([(p[-1], order + PLY_TYPES[p[0]]) for p in properties])
            rows = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += n * kind.itemsize
            if name == "vertex":
                points = np.stack([rows[a] for a in "xyz"], axis=1).astype(np.float32)
            continue
        for _ in range(n):
            for p in properties:
                if p[0] == "list":
                    count = int(np.frombuffer(data, dtype=order + PLY_TYPES[p[1]], count=1, offset=at)[0])
                    at += np.dtype(PLY_TYPES[p[1]]).itemsize
                    values = np.frombuffer(data, dtype=order + PLY_TYPES[p[2]], count=count, offset=at)
                    at += values.nbytes
                    if name == "face":
                        fan(values)
                else:
                    at += np.dtype(PLY_TYPES[p[0]]).itemsize
    return [mesh("ply", points, faces)]


def data_uri(uri: str) -> bytes:
    head, _, body = uri.partition(",")
    return base64.b64decode(body) if head.endswith(";base64") else unquote_to_bytes(body)


# glTF component types as numpy names, and components of accessor types.
GLTF_COMPONENTS = {
    5120: "<i1",
    5121: "<u1",
    5122: "<i2",
    5123: "<u2",
    5125: "<u4",
    5126: "<f4",
}
GLTF_WIDTHS = {
    "SCALAR": 1,
    "VEC2": 2,
    "VEC3": 3,
    "VEC4": 4,
    "MAT4": 16,
}


def _each(table) -> dict:
    """Objects of version 1 by name, those of version 2 by number."""
    return table if isinstance(table, dict) else dict(enumerate(table or []))


def gltf_meshes(document: dict, binary: bytes, kind: str) -> list[Mesh]:
    """A mesh for each primitive of triangles that has positions; counts, offsets and strides of accessors are followed."""
    buffers, views, accessors = (_each(document.get(k)) for k in ("buffers", "bufferViews", "accessors"))

    def read(name) -> np.ndarray:
        a = accessors[name]
        view = views[a["bufferView"]]
        uri = buffers.get(view.get("buffer", 0), {}).get("uri", "")
        raw = data_uri(uri) if uri.startswith("data:") else binary
        component, width = np.dtype(GLTF_COMPONENTS[a["componentType"]]), GLTF_WIDTHS[a["type"]]
        start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
        stride = view.get("byteStride") or a.get("byteStride") or component.itemsize * width
        return np.ndarray((a["count"], width), dtype=component, buffer=raw, offset=start, strides=(stride, component.itemsize))

    out = []
    for m in _each(document.get("meshes")).values():
        for p in m.get("primitives", []):
            at = p.get("attributes", {}).get("POSITION")
            if at is None or p.get("mode", 4) != 4:
                continue
            indices = None if p.get("indices") is None else read(p["indices"]).astype(np.int64)
            out.append(mesh(kind, read(at).astype(np.float32), indices))
    return out


def decode_gltf(data: bytes, path: str = "") -> list[Mesh]:
    return gltf_meshes(json.loads(data), data, "gltf")


def decode_glb(data: bytes, path: str = "") -> list[Mesh]:
    """Containers of version 1 and 2, also inside b3dm; other data of whole triplets are 32-bit coordinates."""
    data = strip_b3dm(data)
    if data[:4] != b"glTF":
        if len(data) % 12:
            raise ValueError("neither a GLB container nor 32-bit coordinates")
        return [mesh("glb", np.frombuffer(data, dtype="<f4"))]
    version = struct.unpack_from("<I", data, 4)[0]
    if version == 1:
        size = struct.unpack_from("<I", data, 12)[0]
        return gltf_meshes(json.loads(data[20 : 20 + size]), data[20 + size :], "glb")
    document, binary, at = {}, b"", 12
    while at + 8 <= len(data):
        size, tag = struct.unpack_from("<I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if tag == b"JSON":
            document = json.loads(body)
        elif tag[:3] == b"BIN":
            binary = body
        at += 8 + size
    return gltf_meshes(document, binary, "glb")


class DecoderRegistry:
    """Decoders by format; what is registered later overrides. Formats without one raise an error."""

    def __init__(self):
        self.decoders: dict[str, Decoder] = {"obj": decode_obj, "ply": decode_ply, "gltf": decode_gltf, "glb": decode_glb}

    def register(self, kind: str, decoder: Decoder) -> None:
        self.decoders[kind] = decoder

    def decode(self, kind: str, data: bytes, path: str = "") -> list[Mesh]:
        if kind not in self.decoders:
            raise ValueError(f"no decoder for {kind}")
        found = self.decoders[kind](data, path)
        return [found] if isinstance(found, dict) else list(found)

    def decode_files(self, files: DataFrame, keep_failures: bool = False) -> DataFrame:
        """Meshes of (ordinal, path, content[, format, transform]): (ordinal, part, error, format, positions, indices, transform).

        Files are decoded where they are read. With ``keep_failures`` a file that fails gives a row with its error, else the job fails.
        """
        decoders = dict(self.decoders)
        own = files if "format" in files.columns else files.withColumn("format", detect_format(F.col("path"), F.col("content")))
        own = own if "transform" in own.columns else own.withColumn("transform", F.lit(None).cast("array<double>"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    try:
                        if row.format not in decoders:
                            raise ValueError(f"no decoder for {row.format}")
                        found = decoders[row.format](bytes(row.content), row.path)
                        meshes = [found] if isinstance(found, dict) else list(found)
                        out = [(row.ordinal, k, None, m["format"], m["positions"], m["indices"], m.get("transform") if row.transform is None else list(row.transform)) for k, m in enumerate(meshes)]
                    except Exception as error:
                        if not keep_failures:
                            raise
                        out = [(row.ordinal, 0, str(error)[:500], row.format, None, None, None)]
                    yield pd.DataFrame(out, columns=["ordinal", "part", "error", "format", "positions", "indices", "transform"])

        kind = "ordinal long, part int, error string, format string, positions array<float>, indices array<bigint>, transform array<double>"
        return own.select("ordinal", "path", "content", "format", "transform").mapInPandas(run, kind)


def numbered(decoded: DataFrame) -> DataFrame:
    """Meshes with mesh_id in the order of files and parts, failures left out; files are decoded once, into a shared table."""
    good = materialise(decoded.filter("error IS NULL"))
    ids = with_dense_ids(good.select("ordinal", "part"), ["ordinal", "part"], "mesh_id")
    return good.join(ids, ["ordinal", "part"]).select(*(c.split()[0] for c in MESH_SCHEMA.split(", ")))


def read_meshes(spark: SparkSession, path: str, registry: DecoderRegistry | None = None) -> DataFrame:
    """Meshes of all files at a path or pattern, in the order of their paths, through Spark's file readers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = with_dense_ids(files.select("path"), "path", "ordinal")
    return numbered((registry or DecoderRegistry()).decode_files(files.join(names, "path")))


def decode(kind: str, data: bytes, path: str = "") -> list[Mesh]:
    """Meshes of one buffer with the built-in decoders."""
    return DecoderRegistry().decode(kind or format_of(path, data), data, path)
