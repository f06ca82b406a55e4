"""Adjacency, components, regions and growth, also against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratamesh.operators import adjacency, components, mesh, numbering, regions
from stratamesh.operators.scene import SceneGraph
from stratamesh.plans.options import RegionGrowingOptions
from stratamesh.plans.storage import materialise
from stratamesh.sources import synthetic

from .test_vectors import meshes

SQUARE = ([0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0], [0, 1, 2, 1, 3, 2], None)


def grid_mesh(n, shift=0.0):
    points = [c for j in range(n + 1) for i in range(n + 1) for c in (i + shift, float(j), 0.0)]
    at = lambda i, j: j * (n + 1) + i
    quads = [(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)) for j in range(n) for i in range(n)]
    return points, [k for a, b, c, d in quads for k in (a, b, c, a, c, d)], None


def test_square(spark):
    graph = adjacency.TriangleGraph.build(mesh.triangles(meshes(spark, SQUARE)))
    assert graph.neighbor_ids(0) == [1] and graph.neighbor_ids(1) == [0] and graph.neighbor_ids(9) == []
    assert [r.degree for r in graph.degree().collect()] == [1, 1] and graph.size() == 2
    more = graph.add_edge(0, 1)
    assert more.has_edge(1, 0) and more.neighbor_ids(0) == [1] and more.neighbors(0).count() == 1


@pytest.mark.parametrize(("tolerance", "pairs"), [(2.0, 0), (10.0, 1), (0.0, 0)])
def test_nearness(spark, tolerance, pairs):
    far = ([0, 0, 0, 1, 0, 0, 0, 1, 0, 5, 5, 0, 6, 5, 0, 5, 6, 0], [0, 1, 2, 3, 4, 5], None)
    graph, added = adjacency.TriangleGraph.build(mesh.triangles(meshes(spark, far))).add_proximity_neighbours(tolerance)
    assert added == pairs and graph.edges.count() == 2 * pairs


def test_grid_pairs_match_brute_force(spark):
    p = np.random.default_rng(3).uniform(-2, 2, (300, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "tri_id long, cx double, cy double, cz double")
    got = {(r.a, r.b) for r in adjacency.grid_pairs(df, 0.4).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if np.sqrt(((p[i] - p[j]) ** 2).sum()) <= 0.4}


def roots(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("local", [0, 1000])
def test_components_match_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = np.random.default_rng(local)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(60, 80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = roots(81, edges)
    assert got == {n: want[n] for n in {x for e in edges for x in e}}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.05, 0.6))
def test_chunk_components_match_brute_force(seed, tolerance):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    points, corners = rng.uniform(0, 2, (n, 3)), rng.integers(0, 80, (n, 3))
    sides = [{frozenset((int(c[a]), int(c[b]))) for a, b in ((0, 1), (1, 2), (2, 0))} for c in corners]
    edges = [(i, j) for i in range(n) for j in range(i) if sides[i] & sides[j] or np.sqrt(((points[i] - points[j]) ** 2).sum()) <= tolerance]
    assert regions.chunk_components(points, corners, tolerance).tolist() == roots(n, edges)


def kernel_input(spark, *rows):
    return mesh.with_chunks(mesh.triangles(meshes(spark, *rows)), 1000)


def test_flat_grid_is_one_partition(spark):
    found = regions.grow_regions(kernel_input(spark, grid_mesh(6)), RegionGrowingOptions(max_distance=2.0))
    assert found.count() == found.select("tri_id").distinct().count() == 72


def test_patches_apart_are_two_regions(spark):
    found = regions.grow_regions(kernel_input(spark, grid_mesh(1), grid_mesh(1, 10.0)), RegionGrowingOptions(max_distance=2.0, min_region_size=1))
    assert found.select("region_id").distinct().count() == 2


def test_isolated_small_region_stays(spark):
    lone = ([50, 50, 0, 51, 50, 0, 50, 51, 0], [0, 1, 2], None)
    found = {r.tri_id: r.region_id for r in regions.grow_regions(kernel_input(spark, SQUARE, lone), RegionGrowingOptions()).collect()}
    assert found[2] not in (found[0], found[1])


def test_growth_never_joins_components(spark):
    tris = mesh.with_chunks(mesh.triangles(synthetic.tiled_scenes(spark, 1, 6)), 10_000)
    whole = regions.triangle_components(tris, 0.5).join(regions.grow_regions(tris), "tri_id")
    assert whole.groupBy("region_id").agg(F.count_distinct("component").alias("n")).filter("n > 1").count() == 0
    assert whole.select("component").distinct().count() == 3


def test_region_chain_is_one_component_for_every_algorithm(spark):
    own = spark.createDataFrame([(i, i) for i in range(5)], "tri_id long, region_id long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    pairs = regions.region_adjacency(edges, own)
    assert pairs.count() == 3
    for algorithm in ("bfs", "dfs", "union-find"):
        got = {r.region_id: r.component for r in regions.connected_regions(pairs, own, algorithm).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    with pytest.raises(ValueError):
        regions.connected_regions(pairs, own, "other")


def test_touch_counts(spark):
    own = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2)], "tri_id long, region_id long")
    edges = spark.createDataFrame([(a, b) for x, y in ((0, 1), (1, 2), (2, 3)) for a, b in ((x, y), (y, x))], "src long, dst long")
    assert {tuple(r) for r in regions.touch_counts(edges, own).collect()} == {(0, 1, 1), (1, 2, 1)}
    assert {r.tri_id for r in regions.boundary(edges, own).collect()} == {1, 2, 3}


@pytest.mark.parametrize("rows", [0, 10**6])
def test_running_sums_by_ranges_and_in_one_window(spark, monkeypatch, rows):
    monkeypatch.setattr(numbering, "WINDOW_ROWS", rows)
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.lit(2).alias("two"))
    got = {r.k: r.s for r in numbering.sums_before(df, ["k"], {"s": "two"}).collect()}
    assert got == {k: 2 * k for k in range(100)}
    assert [r.n for r in numbering.with_dense_ids(df, "k", "n").orderBy("k").collect()] == list(range(100))


def test_trees_deeper_than_the_sessions_limit(spark):
    rows = [(0, None, -1, "scene", 0), *((k, k - 1, k, "link", 0) for k in range(1, 131))]
    tree = SceneGraph(spark, materialise(spark.createDataFrame(rows, "node_id bigint, parent_id bigint, entity_id bigint, label string, ordinal bigint")))
    assert tree.is_descendant(130, 0) and not tree.is_descendant(0, 130)
    tree.remove(125)
    assert tree.size() == 125


def brute_regions(points, normals, corners, o):
    """Growth and absorption, one triangle at a time."""
    n = len(points)
    angle = lambda a, b: np.degrees(np.arccos(min(1.0, abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))))
    apart = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    sides = [{frozenset((c[k], c[(k + 1) % 3])) for k in range(3)} for c in corners.tolist()]
    near = [[j for j in range(n) if j != i and (sides[i] & sides[j] or apart(points[i], points[j]) <= o.max_distance)] for i in range(n)]
    curved = [np.float32(sum(angle(normals[i], normals[j]) for j in near[i]) / max(1, len(near[i]))) for i in range(n)]
    of, regions = {}, []
    for seed in sorted(range(n), key=lambda i: (curved[i], i)):
        if seed in of:
            continue
        of[seed], queue = len(regions), [seed]
        for t in queue:
            for j in near[t]:
                if j not in of and angle(normals[j], normals[seed]) <= o.max_angle and apart(points[j], points[seed]) <= o.max_distance and curved[j] <= o.max_curvature:
                    of[j] = len(regions)
                    queue.append(j)
        regions.append(queue)
    for r in [r for r, own in enumerate(regions) if len(own) < o.min_region_size]:
        counts = {}
        for t in regions[r]:
            for j in near[t]:
                if of[j] != r:
                    counts[of[j]] = counts.get(of[j], 0) + 1
        if counts:
            target = max(counts, key=counts.get)  # the first of equals
            for t in regions[r]:
                of[t] = target
            regions[target] += regions[r]
            regions[r] = []
    order = sorted(set(of.values()))
    return [order.index(of[i]) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_growth_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(6), np.arange(6))
    z = rng.choice([0.0, 0.02, 0.6], 36)
    v = np.stack([x.ravel() * 0.5, y.ravel() * 0.5, z], axis=1)
    corners = np.array([c for j in range(5) for i in range(5) for a in [6 * j + i] for c in ((a, a + 1, a + 7), (a, a + 7, a + 6))])
    p = v[corners]
    cross = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    normals = cross / np.linalg.norm(cross, axis=1, keepdims=True)
    options = RegionGrowingOptions(max_angle=25.0, max_distance=1.1, max_curvature=30.0, min_region_size=4)
    assert regions.grow(p.mean(axis=1), normals, corners, options).tolist() == brute_regions(p.mean(axis=1), normals, corners, options)
