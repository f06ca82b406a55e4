"""Topology, relations, the scene tree, entity edits and the engine."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamesh.operators import entities, geometry, mesh, regions, relations, topology
from stratamesh.operators.numbering import with_dense_ids
from stratamesh.operators.relations import SpatialGraph
from stratamesh.operators.scene import SceneGraph
from stratamesh.plans.engine import MeshEngine
from stratamesh.plans.options import EngineOptions
from stratamesh.plans.queries import QUERIES
from stratamesh.plans.storage import materialise
from stratamesh.sources import synthetic

from .test_vectors import meshes

BOX = "entity_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, label string"
#: A desk under a ceiling lamp's shelf, a crate that stands on the desk with a ball in it, and a hall around all.
HALL = [
    (10, -8.0, -8.0, -2.0, 8.0, 8.0, 12.0, "wall"), (11, -3.0, -2.0, 0.0, 3.0, 2.0, 1.25, "ground"), (12, -1.0, -1.0, 1.75, 1.0, 1.0, 3.25, "roof"),
    (13, -0.25, -0.25, 2.0, 0.25, 0.25, 2.5, "surface"), (14, 3.375, -2.0, 0.0, 5.0, 2.0, 1.0, "ground"),
]


def test_hall(spark):
    graph = SpatialGraph.from_entities(spark.createDataFrame(HALL, BOX), spark.createDataFrame([(11, 14), (14, 11)], "entity_id long, neighbor_id long"))
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(graph.contained(10)) == {11, 12, 13, 14} and ids(graph.contained(12)) == {13}
    assert 11 in ids(graph.supporters(12)) and 12 in ids(graph.supported(11))
    assert ids(graph.touching(14)) == {11} and ids(graph.query("adjacent", 14).select(F.col("from_id").alias("id"))) == {11}
    assert graph.neighbors(13).count() >= 2 and graph.get_node(14).count() == 1 and graph.node_count() == 5
    assert graph.add_edge(13, 10, "touch").edge_count() == graph.edge_count() + 1
    assert SpatialGraph.from_entities(spark.createDataFrame(HALL, BOX)).query("touch").count() == 0


def test_lookups_find_only_what_is_asked(spark):
    graph, whole = (SpatialGraph.from_entities(spark.createDataFrame(HALL, BOX)) for _ in range(2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    every = rows(whole.edges)
    for node in (10, 11, 12, 13, 14, 99):
        assert rows(graph.query(None, node)) == [r for r in every if node in r[:2]]
        assert rows(graph.contained(node)) == [r[1:2] for r in every if r[0] == node and r[2] == "contain"]
        assert rows(graph.supporters(node)) == sorted(r[:1] for r in every if r[1] == node and r[2] == "support")
    for kind in ("intersect", "contain", "adjacent", "support", "touch"):
        assert rows(graph.query(kind)) == [r for r in every if r[2] == kind]
    assert graph._edges is None and rows(graph.add_node(spark.createDataFrame(HALL[:1], BOX)).edges) == every


def test_most_held_where_no_box_holds_another(spark, tmp_path):
    spark.createDataFrame([(k, [0.1 + 0.3 * k] * 6, 0) for k in range(3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["contained_in"](spark, str(tmp_path)).count() == 0


def test_equal_boxes_contain_once(spark):
    twice = [(i, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, "") for i in (3, 5)]
    found = relations.relations(spark.createDataFrame(twice, BOX)).filter("type = 'contain'").collect()
    assert [(r.from_id, r.to_id) for r in found] == [(3, 5)]


def test_pick_takes_the_first_box(spark):
    points = spark.createDataFrame([(0, 0.1, 0.1, 2.25), (1, 4.0, 0.0, 0.5), (2, 99.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert {r.point_id: r.entity_id for r in relations.pick(spark.createDataFrame(HALL[1:], BOX), points).collect()} == {0: 12, 1: 14, 2: None}


def test_boxes_and_axes(spark):
    assert list(geometry.boxes(spark.createDataFrame([], BOX)).first()) == [0.0] * 6
    line = spark.createDataFrame([(0, 10.0 * i, 0.0, 0.0) for i in range(50)], "g long, cx double, cy double, cz double")
    found = geometry.principal_axes(line, "g").first()
    assert abs(found.axes[0][0]) > 0.99 and found.eigenvalues[1] == 0
    single = geometry.principal_axes(line.limit(1), "g").first()
    assert single.axes == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_oriented_box_of_a_tent_has_volume_and_covers(spark):
    tent = mesh.triangles(meshes(spark, ([0, 0, 0, 1, 0, 0, 0.5, 1, 0.5, 0, 0, 0, 1, 0, 0, 0.5, -1, 0.5], None, None))).withColumn("g", F.lit(1))
    found = geometry.oriented_boxes(tent, "g").first()
    assert 8 * found.half[0] * found.half[1] * found.half[2] > 0


def region_rows(spark, *rows):
    names = "region_id long, nz double, cx double, cy double, cz double, area double, boundary_count long"
    df = spark.createDataFrame(rows, names).withColumns({"nx": F.sqrt(1 - F.col("nz") * F.col("nz")), "ny": F.lit(0.0), "triangle_count": F.lit(1).cast("long")})
    return df.withColumns({f"{m}_{k}": F.col(f"c{k}") for m in ("min", "max") for k in "xyz"})


def test_touching_coplanar_regions_merge(spark):
    own = region_rows(spark, (0, 1.0, 0.0, 0.0, 0.0, 1.0, 1), (1, 0.99, 1.0, 0.0, 0.0, 1.0, 0), (2, 0.0, 9.0, 0.0, 9.0, 1.0, 1))
    touch = spark.createDataFrame([(0, 1, 2), (1, 2, 5)], "a long, b long, count long")
    pairs = topology.merge_pairs(touch, own)
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    made, bridge = topology.entities_of(own, pairs)
    assert {(r.key, r.region_count, r.label) for r in made.collect()} == {(0, 2, "roof"), (2, 1, "wall")}
    near = topology.entity_neighbors(touch, with_dense_ids(made, "key").join(bridge, "key").select("region_id", "entity_id"))
    assert {tuple(r) for r in near.collect()} == {(0, 1), (1, 0)}


def test_support_needs_a_rise_within_the_gap(spark):
    own = region_rows(spark, (0, 1.0, 0.0, 0.0, 1.0, 1.0, 0), (1, 0.0, 1.0, 1.0, 0.5, 1.0, 0), (2, 0.0, 5.0, 0.0, 0.5, 1.0, 0), (3, 1.0, 0.0, 0.0, 1.0, 1.0, 0))
    assert {tuple(r) for r in topology.support_pairs(own).collect()} == {(0, 1), (3, 1)}


def test_equal_heights_do_not_support_each_other(spark):
    own = region_rows(spark, (0, 1.0, 0.0, 0.0, 0.1 + 0.2, 1.0, 0), (1, 1.0, 1.0, 1.0, 0.3, 1.0, 0), (2, 1.0, 0.0, 1.0, 0.3 - 1e-9, 1.0, 0))
    assert {tuple(r) for r in topology.support_pairs(own).collect()} == {(0, 2), (1, 2)}


def test_scene_tree(spark):
    tree = SceneGraph(spark)
    group = tree.add_group("floor")
    a, b = tree.add_entity(7, "wall", group), tree.add_entity(8, "roof")
    assert tree.size() == 4 and tree.get_entity_by_node(a) == 7 and tree.get_entity_by_node(group) is None
    assert [r.entity_id for r in tree.iter_entities().collect()] == [7, 8]
    assert tree.is_descendant(a, group) and tree.is_descendant(a, a) and not tree.is_descendant(group, a)
    assert not tree.move(0, a) and not tree.move(group, a) and not tree.move(a, 99) and not tree.move(99, a)
    assert tree.move(a, 0) and [r.entity_id for r in tree.iter_entities().collect()] == [8, 7]
    assert tree.query(F.col("label") == "roof").count() == 1
    tree.remove(99)
    tree.remove(group)
    assert tree.size() == 3
    tree.rebuild(spark.createDataFrame([(1, "x"), (0, "y")], "entity_id long, label string"))
    assert [r.node_id for r in tree.iter_entities().collect()] == [4, 5] and b == 3


def test_entity_edits(spark):
    tris = mesh.triangles(meshes(spark, ([0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0], [0, 1, 2, 1, 3, 2], None)))
    owned = tris.withColumns({"region_id": F.col("tri_id"), "entity_id": F.lit(0).cast("long")})
    of_regions = owned.select("region_id", "entity_id", "nz", "area")
    built = entities.build(of_regions, owned).first()
    assert (built.triangle_count, built.region_count, built.area, built.label, built.max_x) == (2, 2, 1.0, "roof", 1.0)
    parts = entities.split(0, [0], of_regions, owned.drop("region_id"), owned).orderBy("entity_id").collect()
    assert [(p.entity_id, p.triangle_count) for p in parts] == [(0, 1), (1, 1)]
    moved = owned.withColumn("entity_id", F.col("tri_id") + 4)
    made, members, near = entities.merge(4, 5, moved.select("region_id", "entity_id", "nz", "area"), moved, spark.createDataFrame([(4, 5), (5, 6), (6, 5)], "entity_id long, neighbor_id long"))
    assert made.first().triangle_count == 2 and members.select("entity_id").distinct().count() == 1
    assert {tuple(r) for r in near.collect()} == {(4, 6), (6, 4)}
    rebuilt = entities.rebuild_geometry(entities.build(of_regions, owned), owned.filter("false")).first()
    assert rebuilt.triangle_count == 0 and rebuilt.max_x == 1.0
    assert entities.with_oriented_boxes(entities.build(of_regions, owned), owned).first().half[0] > 0


@pytest.mark.parametrize(("count", "grid", "triangles", "n_regions", "n_entities"), [(2, 12, 620, 6, 2), (8, 20, 6576, 24, 8), (30, 30, 54660, 90, 30)])
def test_scaling_scenes(spark, count, grid, triangles, n_regions, n_entities):
    engine = MeshEngine(spark, EngineOptions(chunk_size=100_000)).set_meshes(synthetic.tiled_scenes(spark, count, grid))
    found = engine.extract()
    assert (found.agg(F.sum("triangle_count")).first()[0], engine.regions.count(), found.count()) == (triangles, n_regions, n_entities)
    assert engine.scene.size() == n_entities + 1


def test_engine_reads(spark):
    engine = MeshEngine(spark, EngineOptions(chunk_size=200, cache_capacity=1))
    with pytest.raises(ValueError, match="no mesh"):
        engine.extract()
    engine.set_meshes(synthetic.tiled_scenes(spark, 2, 12))
    engine.extract()
    assert engine.entity_triangles().count() == 620 == engine.triangles.count() and engine.vertices.count() == 1860
    assert engine.get_entity(0).entity_id == 0 and engine.get_entity(10**6) is None
    assert engine.pick((0.0, 0.0, 0.0)) == 0 and engine.pick((99.0, 99.0, 99.0)) is None
    assert engine.oriented_boxes().count() == engine.entities.count() == engine.overlays().count()
    engine.register_views("t_")
    assert spark.sql("SELECT count(*) FROM t_entities JOIN t_scene_nodes USING (entity_id)").first()[0] == engine.entities.count()
    assert engine.incremental_update({1}).count() == engine.entities.count()


def test_exact_ids_give_the_same_entities(spark):
    tables = []
    for exact in (False, True):
        engine = MeshEngine(spark, EngineOptions(exact_ids=exact)).set_meshes(synthetic.tiled_scenes(spark, 2, 6))
        tables.append({(r.triangle_count, round(r.min_x, 5), round(r.max_x, 5)) for r in engine.extract().collect()})
    assert tables[0] == tables[1]


def test_transforms_count_unless_compat(spark):
    shift = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 0, 0, 1]
    df = meshes(spark, ([0, 0, 0, 1, 0, 0, 0, 1, 0], [0, 1, 2], shift))
    assert MeshEngine(spark).set_meshes(df).extract().first().max_x == 11
    assert MeshEngine(spark, EngineOptions(compat=True)).set_meshes(df).extract().first().max_x == 1


def test_materialised_table_is_whole(spark):
    assert materialise(spark.range(10)).agg(F.sum("id")).first()[0] == 45


def test_kernel_timing(spark):
    tris = mesh.with_chunks(mesh.triangles(synthetic.tiled_scenes(spark, 1, 6)), 1000)
    row = regions.with_timing(tris, 0.5).first()
    assert (row.triangles, row.components) == (94, 3) and row.seconds >= 0


def test_pick_in_a_crowd_meets_few_boxes(spark):
    """Points that all boxes hold would make four thousand million pairs; places that only later boxes hold, and none, are right too."""
    n = 10_000
    numbers, side = spark.range(n), lambda k: (F.lit(1.0) + F.col("id") / n).alias(k)
    crowd = numbers.select((F.col("id") + 7).alias("entity_id"), *((-side(f"min_{k}")).alias(f"min_{k}") for k in "xyz"), *(side(f"max_{k}") for k in "xyz"))
    points = spark.range(400_000).select(F.col("id").alias("point_id"), *((F.rand(k) * 1.8 - 0.9).alias(a) for k, a in enumerate("xyz")))
    outer = spark.createDataFrame([(500_000 + k, 1.0 + k / 10, 0.0, -0.5) for k in range(12)] + [(600_000, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    began = time.perf_counter()
    found = relations.pick(crowd, points.unionByName(outer)).filter("point_id < 500000").groupBy("entity_id").count().collect()
    assert [tuple(r) for r in found] == [(7, 400_000)] and time.perf_counter() - began < 40
    held = {r.point_id - 500_000: r.entity_id for r in relations.pick(crowd, outer).collect()}
    first = {k: next((i + 7 for i in range(n) if 1.0 + i / n >= 1.0 + k / 10), None) for k in range(12)}
    assert held == first | {100_000: None} and first[9] == 9007 and first[10] is None


def test_crowded_boxes_are_compared_in_blocks(spark):
    """Over a block of boxes, most of which meet most others, and some far off: the relations are those of the pairs."""
    rng = np.random.default_rng(5)
    n = relations.BLOCK + 100
    middle, half = rng.normal(0, 1, (n, 3)), np.abs(rng.normal(0, 1, (n, 3)))
    middle[::9] *= 40
    middle[1:400:4], half[1:400:4] = middle[0:400:4], half[0:400:4]
    half[::50] = 0
    boxes = spark.createDataFrame([(i, *(m - h).tolist(), *(m + h).tolist()) for i, m, h in zip(rng.permutation(n).tolist(), middle, half)], "entity_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    boxes = boxes.unionByName(boxes.limit(1).withColumns({"entity_id": F.lit(-1).cast("long"), "max_y": F.lit(None).cast("double")}))
    found, by_pairs = relations.relations_of_boxes(boxes).cache(), relations.relations_of_pairs(relations.box_pairs(boxes)).cache()
    assert found.count() == by_pairs.count() > n * n // 8 and found.exceptAll(by_pairs).isEmpty()
    assert relations.relations_of_boxes(boxes, kinds=("contain",)).exceptAll(by_pairs.filter("type = 'contain'")).isEmpty()
    assert found.dtypes == by_pairs.dtypes
    assert relations.relations_of_boxes(boxes.limit(0)).count() == 0
    found.unpersist(), by_pairs.unpersist()


def test_boxes_of_all_sizes_meet_and_are_picked(spark):
    """Against all pairs: huge, flat, equal and zero-sized boxes among others; no huge box is laid on many cells."""
    rng = np.random.default_rng(11)
    n = 160
    low, size = rng.normal(0, 20, (n, 3)), np.exp(rng.normal(0, 2, (n, 3)))
    low[0], size[0] = -90_000, (200_000, 200_000, 2)
    low[2], size[1:3] = low[1], 0
    low[4], size[4] = low[3], size[3]
    high, ids = low + size, np.arange(n)[::-1].tolist()
    boxes = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, a, b in zip(ids, low, high)], "entity_id long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    met = [(r.i, r.j) for r in relations.box_pairs(boxes).select("i", "j").collect()]
    gap = np.maximum(low[:, None] - high[None], low[None] - high[:, None])[:, :, :2].max(axis=2)
    near = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(n) for b in range(a) if gap[a, b] <= relations.REACH}
    assert near <= set(met) and len(met) == len(set(met)) and all(i < j for i, j in met)
    points = np.concatenate([rng.normal(0, 20, (60, 3)), low[:5], high[:5]])
    held = {i: min((ids[k] for k in range(n) if (low[k] <= p).all() and (p <= high[k]).all()), default=None) for i, p in enumerate(points)}
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point_id int, x double, y double, z double")
    assert {r.point_id: r.entity_id for r in relations.pick(boxes, asked).collect()} == held
    assert relations.pick(boxes.limit(0), asked).filter("entity_id IS NOT NULL").count() == 0 and relations.box_pairs(boxes.limit(0)).count() == 0
