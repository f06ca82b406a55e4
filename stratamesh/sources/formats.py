"""Which format a file has, as column expressions and for single buffers."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name endings and the formats they mean.
SUFFIXES = {
    "tileset.json": "3dtiles",
    ".osgb": "osgb",
    ".obj": "obj",
    ".gltf": "gltf",
    ".glb": "glb",
    ".b3dm": "glb",
    ".ply": "ply",
    ".las": "las",
    ".laz": "laz",
}
#: First four bytes that mean a binary mesh.
MAGIC = (b"glTF", b"b3dm")


def detect_format(path: Column, content: Column | None = None) -> Column:
    """Format by the ending of the path, else by the first bytes, else obj."""
    name = F.lower(path)
    found = None
    for suffix, kind in SUFFIXES.items():
        found = (F if found is None else found).when(name.endswith(suffix), kind)
    if content is not None:
        head = F.substring(content, 1, 4)
        found = found.when(head.isin(*(F.lit(m) for m in MAGIC)), "glb")
    return found.otherwise("obj")


def format_of(path: str, content: bytes | None = None) -> str:
    """The same for one file."""
    for suffix, kind in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return kind
    return "glb" if content is not None and content[:4] in MAGIC else "obj"


def strip_b3dm(data: bytes) -> bytes:
    """What a b3dm file wraps, known by its first bytes; other data, and headers beyond the end, are left as they are."""
    if data[:4] != b"b3dm" or len(data) < 28:
        return data
    start = 28 + sum(struct.unpack_from("<4I", data, 12))
    return data if start >= len(data) else data[start:]
