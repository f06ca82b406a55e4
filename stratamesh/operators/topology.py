"""From regions to entities: which regions merge, what an entity is, and stitching across chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from ..plans import options as O
from ..plans.options import TopologyMergeOptions
from ..plans.storage import materialise
from .adjacency import FORWARD
from .components import components
from .geometry import CORNERS, box_aggregates
from .numbering import with_dense_ids


def merge_pairs(touch: DataFrame, regions: DataFrame, options: TopologyMergeOptions = TopologyMergeOptions()) -> DataFrame:  # noqa: B008
    """(a, b) of touching regions that merge: enough adjacent pairs, similar normals, and a boundary on either side."""
    of = lambda p: regions.select(F.col("region_id").alias(p), *(F.col(f"n{k}").alias(f"{p}_{k}") for k in "xyz"), F.col("boundary_count").alias(f"{p}_boundary"))
    met = touch.filter(F.col("count") >= options.min_touch_area).join(of("a"), "a").join(of("b"), "b")
    flat = V.angle_between(V.vec("a_"), V.vec("b_")) <= options.max_merge_angle
    edged = (F.col("a_boundary") >= options.min_boundary) | (F.col("b_boundary") >= options.min_boundary)
    return met.filter(flat & edged).select("a", "b")


def support_pairs(regions: DataFrame, options: TopologyMergeOptions = TopologyMergeOptions(), key: str = "region_id") -> DataFrame:  # noqa: B008
    """(a, b): a faces up and its centroid lies above b's, by up to the support gap, and near it in x and y.

    Regions are binned in x and y by the radius (and by chunk, if there is one), so no pair farther apart is met.
    Means of equal heights come out unequal in their last bits, as the order of summing has it: a rise counts from there on.
    """
    own = regions if "chunk_id" in regions.columns else regions.withColumn("chunk_id", F.lit(0).cast("long"))
    r = O.SUPPORT_RADIUS
    cell = [F.floor(F.col(f"c{k}") / F.lit(r)) for k in "xy"]
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    upper = own.filter(V.is_up_facing(F.col("nz"))).withColumn("o", around)
    upper = upper.select("chunk_id", (cell[0] + F.col("o.i")).alias("i"), (cell[1] + F.col("o.j")).alias("j"), F.col(key).alias("a"), *(F.col(f"c{k}").alias(f"a{k}") for k in "xyz"))
    lower = own.select("chunk_id", cell[0].alias("i"), cell[1].alias("j"), F.col(key).alias("b"), *(F.col(f"c{k}").alias(f"b{k}") for k in "xyz"))
    rise, noise = F.col("az") - F.col("bz"), F.lit(O.EPSILON) * F.greatest(F.lit(1.0), F.abs("az"), F.abs("bz"))
    flat = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return upper.join(lower, ["chunk_id", "i", "j"]).filter("a <> b").filter((rise > noise) & (rise <= options.support_gap) & (flat <= r)).select("a", "b")


def entities_of(regions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities from regions and the pairs that merge: (entity key, label, area, counts, box), and (region_id, key).

    The key of an entity is its smallest region.
    """
    found = components(pairs, "a", "b").withColumnRenamed("node", "region_id")
    bridge = regions.select("region_id").join(found, "region_id", "left").select("region_id", F.coalesce("root", "region_id").alias("key"))
    made = regions.join(bridge, "region_id").groupBy("key").agg(
        F.avg("nz").alias("mean_nz"), F.sum("area").alias("area"), F.count("*").alias("region_count"), F.sum("triangle_count").alias("triangle_count"), *box_aggregates()
    )
    return made.withColumn("label", V.label_of(F.col("mean_nz"), F.col("area"))).drop("mean_nz"), bridge


def entity_neighbors(touch: DataFrame, bridge: DataFrame) -> DataFrame:
    """(entity_id, neighbor_id) both ways: entities (``bridge``: region_id, entity_id) whose regions touch."""
    of = lambda p: bridge.select(F.col("region_id").alias(p), F.col("entity_id").alias(f"{p}_entity"))
    met = touch.join(of("a"), "a").join(of("b"), "b").filter("a_entity <> b_entity")
    ends = F.explode(F.array(F.struct(F.col("a_entity").alias("entity_id"), F.col("b_entity").alias("neighbor_id")), F.struct(F.col("b_entity").alias("entity_id"), F.col("a_entity").alias("neighbor_id"))))
    return met.select(ends.alias("e")).select("e.*").distinct()


def cross_chunk_pairs(boxes: DataFrame, key: str = "entity_id") -> DataFrame:
    """(a, b), a < b: boxes that overlap when padded, with centres in the same or neighbouring cells."""
    middle = V.centre(*V.box())
    cell = [F.floor(c / F.lit(O.CROSS_CHUNK_CELL)) for c in middle]
    right = boxes.select(*(c.alias(f"k{k}") for c, k in zip(cell, "xyz")), F.col(key).alias("j"), *(F.col(c).alias(f"r_{c}") for c in CORNERS))
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for v, k in zip(o, "xyz"))) for o in FORWARD)))
    left = boxes.withColumn("o", around).select(
        *((c + F.col(f"o.{k}")).alias(f"k{k}") for c, k in zip(cell, "xyz")), F.col(key).alias("i"), *(F.col(c).alias(f"l_{c}") for c in CORNERS),
        ((F.col("o.x") == 0) & (F.col("o.y") == 0) & (F.col("o.z") == 0)).alias("own"),
    )
    met = left.join(right, ["kx", "ky", "kz"]).filter("(own AND i < j) OR (NOT own AND i <> j)")
    near = met.filter(V.intersects(V.box("l_"), V.box("r_"), O.CROSS_CHUNK_PAD))
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def merge_across_chunks(entities: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged entities with dense ids, and (old_id, entity_id); box and counts add up, the rest is that of the lowest id."""
    found = components(pairs, "a", "b").withColumnRenamed("node", "entity_id")
    keyed = entities.join(found, "entity_id", "left").withColumn("key", F.coalesce("root", "entity_id")).drop("root")
    summed = [c for c in ("area", "region_count", "triangle_count") if c in entities.columns]
    other = [c for c in entities.columns if c not in (*summed, *CORNERS, "entity_id")]
    made = keyed.groupBy("key").agg(*box_aggregates(), *(F.sum(c).alias(c) for c in summed), *(F.min_by(c, "entity_id").alias(c) for c in other))
    made = with_dense_ids(materialise(made, counted=True), "key")
    ids = keyed.select(F.col("entity_id").alias("old_id"), "key").join(made.select("key", "entity_id"), "key").select("old_id", "entity_id")
    return made.drop("key").select("entity_id", *(c for c in entities.columns if c != "entity_id")), ids
