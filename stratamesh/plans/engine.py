"""The engine: load meshes, extract entities, read relations."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import geometry, mesh, regions, relations, topology
from ..operators.geometry import CORNERS
from ..operators.numbering import with_dense_ids
from ..operators.relations import SpatialGraph
from ..operators.scene import SceneGraph
from ..sources.decoders import DecoderRegistry, read_meshes
from ..sources.tiles3d import read_tileset
from .options import EngineOptions, MeshLoadOptions
from .storage import materialise, row_count


def segment(tris: DataFrame, tolerance: float, exact: regions.RegionGrowingOptions | None = None) -> DataFrame:
    """``tris`` (with chunk_id) with component, the first triangle of each one's component in its chunk, and ``first``.

    ``first`` orders the components of a chunk: by first triangle, or with ``exact`` by the first grown region.
    """
    out = tris.withColumns({"component": F.col("tri_id"), "first": F.col("tri_id")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tri_id", ignore_index=True)
        points, corners = frame[["cx", "cy", "cz"]].to_numpy(), frame[["v0", "v1", "v2"]].to_numpy()
        root = regions.chunk_components(points, corners, tolerance)
        component = frame["tri_id"].to_numpy()[root]
        first = component
        if exact is not None:
            grown = pd.Series(regions.grow(points, frame[["nx", "ny", "nz"]].to_numpy(), corners, exact))
            first = grown.groupby(root).transform("min").to_numpy()
        return frame.assign(component=component, first=first)

    return out.groupBy("chunk_id").applyInPandas(run, out.schema)


def regions_of(segmented: DataFrame) -> DataFrame:
    """One row for each component, with a dense region_id over all chunks; nothing borders on a whole component."""
    made = regions.summaries(segmented, "chunk_id", "component", "first").withColumn("boundary_count", F.lit(0).cast("long"))
    made = materialise(made, counted=True)
    if not row_count(made):
        raise ValueError("no mesh loaded")
    return with_dense_ids(made, ["chunk_id", "first"], "region_id")


class MeshEngine:
    """Meshes in, entities and their relations out; every table is a DataFrame."""

    def __init__(self, spark: SparkSession, options: EngineOptions = EngineOptions()):  # noqa: B008
        self.spark, self.options = spark, options
        self.registry = DecoderRegistry()
        self.meshes: DataFrame | None = None
        self._cache: OrderedDict[int, Row] = OrderedDict()
        self.segmented = self.regions = self.bridge = self.entities = self.entity_ids = self.relations = self.scene = None

    # ------------------------------------------------------------- sources

    def register_decoder(self, kind: str, decoder) -> None:
        self.registry.register(kind, decoder)

    def load(self, path: str, options: MeshLoadOptions = MeshLoadOptions()) -> MeshEngine:  # noqa: B008
        """Meshes of files, or of the tile set that ``path`` names."""
        if path.lower().endswith("tileset.json"):
            self.meshes = read_tileset(self.spark, path, options, self.registry, self.options.compat)
        else:
            self.meshes = read_meshes(self.spark, path, self.registry)
        return self

    def set_meshes(self, meshes: DataFrame) -> MeshEngine:
        self.meshes = meshes
        return self

    @property
    def triangles(self) -> DataFrame:
        return mesh.triangles(self._known())

    @property
    def vertices(self) -> DataFrame:
        return mesh.vertices(self._known())

    def _known(self) -> DataFrame:
        if self.meshes is None:
            raise ValueError("no mesh loaded")
        return self.meshes

    # ---------------------------------------------------------- extraction

    def extract(self) -> DataFrame:
        """Entities of the loaded meshes: (entity_id, label, area, counts, box)."""
        tris = mesh.triangles(self._known(), transformed=not self.options.compat)
        return self.extract_triangles(mesh.with_chunks(tris, self.options.chunk_size))

    def extract_triangles(self, tris: DataFrame) -> DataFrame:
        """Entities of triangles with chunk_id; a chunk's triangles stand in one task's memory."""
        o = self.options
        self._cache.clear()
        self.segmented = materialise(segment(tris, o.regions.max_distance, o.regions if o.exact_ids else None))
        self.regions = regions_of(self.segmented)
        pairs = topology.support_pairs(self.regions, o.topology) if o.topology.merge_support else self.regions.select(F.col("region_id").alias("a"), F.col("region_id").alias("b")).filter("false")
        made, keys = topology.entities_of(self.regions, pairs)
        made = with_dense_ids(materialise(made, counted=True), "key")
        self.bridge = keys.join(made.select("key", "entity_id"), "key").select("region_id", "entity_id")
        entities = made.select("entity_id", "label", "area", "region_count", "triangle_count", *CORNERS)
        met = topology.cross_chunk_pairs(entities)
        self.entities, ids = topology.merge_across_chunks(entities, met)
        self.entity_ids = ids
        self.relations = relations.relations(self.entities)
        self.scene = SceneGraph(self.spark)
        self.scene.rebuild(self.entities)
        return self.entities

    def entity_triangles(self) -> DataFrame:
        """(entity_id, triangle columns): the members of each entity."""
        ids = self.bridge.join(self.entity_ids.withColumnRenamed("entity_id", "final"), F.col("entity_id") == F.col("old_id")).select("region_id", F.col("final").alias("entity_id"), "old_id")
        of = self.regions.select("chunk_id", "component", "region_id").join(ids, "region_id")
        return self.segmented.join(of, ["chunk_id", "component"])

    def oriented_boxes(self) -> DataFrame:
        """(entity_id, center, axes, half): of an entity stitched across chunks, the box of its first part."""
        members = self.entity_triangles()
        first = members.groupBy("entity_id").agg(F.min("old_id").alias("old_id"))
        return geometry.oriented_boxes(members.join(first, ["entity_id", "old_id"]), "entity_id")

    def incremental_update(self, ids: set[int] | None = None) -> DataFrame:
        """Extraction again; whatever changed, the result is that of all meshes."""
        return self.extract()

    # --------------------------------------------------------------- reads

    @property
    def graph(self) -> SpatialGraph:
        return SpatialGraph(self.relations, self.entities)

    def query(self, kind: str | None = None, node_id: int | None = None) -> DataFrame:
        return self.graph.query(kind, node_id)

    def get_entity(self, entity_id: int) -> Row | None:
        """One entity, from a small cache of the last ones asked for."""
        if entity_id in self._cache:
            self._cache.move_to_end(entity_id)
            return self._cache[entity_id]
        row = self.entities.filter(F.col("entity_id") == entity_id).first()
        if row is not None:
            self._cache[entity_id] = row
            if len(self._cache) > self.options.cache_capacity:
                self._cache.popitem(last=False)
        return row

    def pick(self, point: tuple[float, float, float]) -> int | None:
        """The first entity whose closed box holds the point."""
        inside = [F.lit(float(p)).between(F.col(f"min_{k}"), F.col(f"max_{k}")) for k, p in zip("xyz", point)]
        return self.entities.filter(inside[0] & inside[1] & inside[2]).agg(F.min("entity_id")).first()[0]

    def overlays(self) -> DataFrame:
        return overlays(self.entities)

    def register_views(self, prefix: str = "") -> None:
        """Temporary views of the tables, for SQL."""
        for name in ("entities", "regions", "relations"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        self.scene.nodes.createOrReplaceTempView(f"{prefix}scene_nodes")


def overlays(entities: DataFrame) -> DataFrame:
    """(entity_id, center_, size_, color, range): what a viewer draws; the camera stands back three times the longest side."""
    low, high = V.box()
    middle, size = V.centre(low, high), V.minus(high, low)
    return entities.select(
        "entity_id", *(c.alias(f"center_{k}") for c, k in zip(middle, "xyz")), *(s.alias(f"size_{k}") for s, k in zip(size, "xyz")),
        V.label_color(F.col("label")).alias("color"), (F.greatest(*size) * 3).alias("range"),
    )
