"""Entities made and changed by hand: build, merge, split, rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from .geometry import box_aggregates, oriented_boxes


def build(regions: DataFrame, tris: DataFrame) -> DataFrame:
    """(entity_id, label, region_count, triangle_count, area, box) of entities given as (entity_id, region_id, nz, area) and (entity_id, tri_id, box)."""
    of_regions = regions.groupBy("entity_id").agg(F.avg("nz").alias("mean_nz"), F.sum("area").alias("area"), F.count("*").alias("region_count"))
    of_tris = tris.groupBy("entity_id").agg(F.count("*").alias("triangle_count"), *box_aggregates())
    made = of_tris.join(of_regions, "entity_id", "full")
    return made.withColumn("label", V.label_of(F.col("mean_nz"), F.col("area"))).drop("mean_nz").fillna(0, ["triangle_count", "region_count", "area"])


def merge(a: int, b: int, regions: DataFrame, tris: DataFrame, neighbors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity ``b`` goes into ``a``: entities, memberships of triangles, and neighbours (without the two themselves).

    The label of the merged entity takes its triangle count for its area.
    """
    into = lambda df, c: df.withColumn(c, F.when(F.col(c) == b, F.lit(a).cast("long")).otherwise(F.col(c)))
    regions, tris = into(regions, "entity_id"), into(tris, "entity_id")
    made = build(regions, tris)
    nz = regions.filter(F.col("entity_id") == a).groupBy("entity_id").agg(F.avg("nz").alias("nz"))
    made = made.join(nz, "entity_id", "left")
    made = made.withColumn("label", F.when(F.col("entity_id") == a, V.label_of(F.col("nz"), F.col("triangle_count").cast("double"))).otherwise(F.col("label"))).drop("nz")
    near = into(into(neighbors, "entity_id"), "neighbor_id").filter("entity_id <> neighbor_id").distinct()
    return made, tris, near


def split(entity_id: int, keep: list[int], regions: DataFrame, tris: DataFrame, tri_region: DataFrame) -> DataFrame:
    """Two entities of one: ``entity_id`` with the regions in ``keep``, and the id after it with the others."""
    part = F.when(F.col("region_id").isin(keep), F.lit(entity_id)).otherwise(F.lit(entity_id + 1)).cast("long")
    own = regions.filter(F.col("entity_id") == entity_id)
    members = tris.filter(F.col("entity_id") == entity_id).join(tri_region.select("tri_id", "region_id"), "tri_id")
    return build(own.withColumn("entity_id", part), members.withColumn("entity_id", part))


def rebuild_geometry(entities: DataFrame, tris: DataFrame) -> DataFrame:
    """Boxes and counts of ``entities`` from their triangles as they are; an entity without any keeps its box."""
    new = tris.groupBy("entity_id").agg(F.count("*").alias("n"), *box_aggregates())
    corners = [f"{m}_{k}" for m in ("min", "max") for k in "xyz"]
    joined = entities.alias("e").join(new.alias("t"), "entity_id", "left")
    return joined.select("entity_id", *(F.coalesce(f"t.{c}", f"e.{c}").alias(c) if c in corners else F.coalesce("t.n", F.lit(0)).alias(c) if c == "triangle_count" else F.col(f"e.{c}") for c in entities.columns if c != "entity_id"))


def with_oriented_boxes(entities: DataFrame, tris: DataFrame) -> DataFrame:
    """``entities`` with center, axes and half of their oriented boxes."""
    return entities.join(oriented_boxes(tris, "entity_id"), "entity_id", "left")
