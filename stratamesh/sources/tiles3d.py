"""3D Tiles: the tile tree is walked on the driver, its contents are decoded in parallel."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import sums_before
from ..plans.options import MeshLoadOptions
from ..plans.storage import materialise
from .decoders import DecoderRegistry, numbered

IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
#: Tile contents without a mesh.
SKIPPED = (".i3dm", ".pnts", ".cmpt")


def matrix_product(a: list[float], b: list[float]) -> list[float]:
    """a b of column-major matrices: b acts first."""
    return [sum(a[4 * k + r] * b[4 * c + k] for k in range(4)) for c in range(4) for r in range(4)]


def resolve(base: str, uri: str) -> str:
    """The file that ``uri`` names beside ``base``; what follows ? or # names no file."""
    if not uri.startswith("data:"):
        uri = uri.split("#")[0].split("?")[0]
    return uri if uri.startswith(("http://", "https://", "data:", "file:", "/")) or "://" in uri else posixpath.join(base, uri)


def walk(load: Callable[[str], bytes], path: str, options: MeshLoadOptions = MeshLoadOptions(), compat: bool = False) -> list[tuple[int, str, list[float]]]:  # noqa: B008
    """(ordinal, path, transform) of tile contents, depth first, a tile before its children.

    Tile sets named by a tile are entered one level deeper. Local transforms act before the parent's, the other way
    round with ``compat``. A tile set that cannot be read is left out.
    """
    out: list[tuple[int, str, list[float]]] = []

    def product(parent: list[float], local: list[float]) -> list[float]:
        return matrix_product(local, parent) if compat else matrix_product(parent, local)

    def tile_set(at: str, transform: list[float], depth: int) -> None:
        try:
            root = json.loads(load(at))["root"]
        except Exception:
            if depth == 0:
                raise
            return
        tile(root, posixpath.dirname(at), transform, depth)

    def tile(node: dict, base: str, parent: list[float], depth: int) -> None:
        if options.max_depth is not None and depth > options.max_depth:
            return
        transform = product(parent, node["transform"]) if node.get("transform") else parent
        content = node.get("content") or {}
        uri = content.get("uri") or content.get("url")
        if uri:
            at = resolve(base, uri)
            if uri.lower().split("?")[0].endswith(".json"):
                tile_set(at, transform, depth + 1)
            elif not uri.lower().split("?")[0].endswith(SKIPPED):
                out.append((len(out), at, transform))
        for child in node.get("children") or []:
            tile(child, base, transform, depth + 1)

    tile_set(path, IDENTITY, 0)
    return out


def within_budget(decoded: DataFrame, options: MeshLoadOptions) -> DataFrame:
    """Decoded tiles up to the budgets: a tile stays if the ones before it had not used them up. Exact, since ordinals are depth first."""
    if options.max_tiles is None and options.max_triangles is None:
        return decoded
    triangles = F.when(F.col("error").isNull(), F.floor(F.when(F.coalesce(F.size("indices"), F.lit(-1)) >= 3, F.size("indices")).otherwise(F.size("positions") / 3) / 3)).otherwise(0)
    slim = decoded.select("ordinal", F.col("error").isNull().cast("long").alias("meshes"), triangles.alias("triangles")).groupBy("ordinal").agg(F.sum("meshes").alias("meshes"), F.sum("triangles").alias("triangles"))
    used = sums_before(materialise(slim), ["ordinal"], {"meshes_before": "meshes", "triangles_before": "triangles"})
    limits = [(f"{c}_before", m) for c, m in (("meshes", options.max_tiles), ("triangles", options.max_triangles)) if m is not None]
    for c, most in limits:
        used = used.filter(F.col(c) < most)
    return decoded.join(used.select("ordinal"), "ordinal", "left_semi")


def existing(spark: SparkSession, paths: set[str]) -> list[str]:
    """Those of ``paths`` that are there, by listing each of their folders once; a folder that cannot be listed has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, set[str]] = {}
    for p in paths:
        folders.setdefault(posixpath.dirname(p), set()).add(posixpath.basename(p))
    found = []
    for folder, names in folders.items():
        try:
            at = jvm.org.apache.hadoop.fs.Path(folder or ".")
            there = {status.getPath().getName() for status in at.getFileSystem(conf).listStatus(at)}
        except Py4JJavaError:
            continue
        found += [posixpath.join(folder, n) for n in sorted(names & there)]
    return sorted(found)


def read_tileset(spark: SparkSession, path: str, options: MeshLoadOptions = MeshLoadOptions(), registry: DecoderRegistry | None = None, compat: bool = False) -> DataFrame:  # noqa: B008
    """Meshes of a tile set, in depth-first order; contents that are missing or fail are left out and not counted."""

    def load(at: str) -> bytes:
        return bytes(spark.read.format("binaryFile").load(at).select("content").first()[0])

    tiles = walk(load, path, options, compat)
    there = existing(spark, {p for _, p, _ in tiles if not p.startswith("data:")})
    if not there:
        return numbered((registry or DecoderRegistry()).decode_files(spark.createDataFrame([], "ordinal long, path string, content binary, transform array<double>")))
    named = spark.createDataFrame([(i, p, t, posixpath.basename(p)) for i, p, t in tiles], "ordinal long, at string, transform array<double>, name string")
    files = spark.read.format("binaryFile").load(there).select(F.col("path"), "content")
    # Readers give paths with a scheme; the written ones are their ends.
    joined = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name").filter(F.col("path").endswith(F.regexp_replace("at", "^[a-z0-9]+:/*", "")))
    decoded = (registry or DecoderRegistry()).decode_files(joined.select("ordinal", "path", "content", "transform"), keep_failures=True)
    return numbered(within_budget(materialise(decoded), options))


