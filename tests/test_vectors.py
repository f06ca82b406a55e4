"""Scalar arithmetic, predicates and triangle geometry on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from stratamesh.functions import vec as V
from stratamesh.operators import mesh


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


def meshes(spark, *rows):
    floats = lambda v: None if v is None else [float(x) for x in v]
    return spark.createDataFrame([(i, "obj", floats(p), n, floats(t)) for i, (p, n, t) in enumerate(rows)], mesh.MESH_SCHEMA)


def test_vector_arithmetic(spark):
    row = one(spark, *V.cross(lits(1, 0, 0), lits(0, 1, 0)), V.dot(lits(1, 2, 3), lits(4, 5, 6)), V.distance(lits(0, 0, 0), lits(3, 4, 0)), *V.normalize(lits(0, 0, 1e-13)))
    assert list(row) == [0, 0, 1, 32, 5, 0, 0, 1e-13]


def test_angles_ignore_orientation(spark):
    z, x = lits(0, 0, 1), lits(1, 0, 0)
    assert list(one(spark, V.angle_between(z, z), V.angle_between(z, x), V.angle_between(z, lits(0, 0, -1)))) == pytest.approx([0, 90, 0])


def test_right_triangle(spark):
    t = mesh.triangles(meshes(spark, ([0, 0, 0, 2, 0, 0, 0, 2, 0], None, None))).first()
    assert (t.area, t.nz) == (2, 1) and (t.cx, t.cy, t.cz) == pytest.approx((2 / 3, 2 / 3, 0))


def test_indexed_quad_and_leftovers(spark):
    quad = ([0, 0, 0, 1, 0, 0, 0, 1, 0, 1, 1, 0], [0, 1, 2, 1, 3, 2, 0], None)
    df = meshes(spark, quad, ([0.0] * 11, None, None), ([], None, None), quad)
    assert mesh.vertices(df).groupBy("mesh_id").count().orderBy("mesh_id").collect() == [(0, 4), (1, 3), (3, 4)]
    rows = mesh.triangles(df).orderBy("tri_id").select("mesh_id", "tri_id", "v0").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (0, 1, 1), (1, 2, 4), (3, 3, 7), (3, 4, 8)]


def test_transform_moves_triangles_not_vertices(spark):
    shift = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 20, 30, 1]
    df = meshes(spark, ([0, 0, 0, 1, 0, 0, 0, 1, 0], [0, 1, 2], shift))
    t = mesh.triangles(df).first()
    assert (t.cx, t.cy, t.cz) == pytest.approx((10 + 1 / 3, 20 + 1 / 3, 30))
    assert mesh.vertices(df).agg(F.max("x")).first()[0] == 1
    assert mesh.triangles(df, transformed=False).first().cz == 0


def test_degenerate_triangle_is_at_right_angles(spark):
    t = mesh.triangles(meshes(spark, ([0, 0, 0, 1, 1, 1, 2, 2, 2], None, None))).first()
    assert t.area == 0 and (t.nx, t.ny, t.nz) == (0, 0, 0)


@pytest.mark.parametrize(
    ("nz", "area", "label"),
    [(1.0, 100.0, "ground"), (1.0, 50.0, "roof"), (-1.0, 1.0, "ceiling"), (0.0, 1.0, "wall"), (0.5, 1.0, "surface"), (None, 0.0, "unknown")],
)
def test_labels(spark, nz, area, label):
    assert one(spark, V.label_of(F.lit(nz).cast("double"), F.lit(area)))[0] == label


def test_box_predicates(spark):
    box = lambda *v: (lits(*v[:3]), lits(*v[3:]))
    a, b, far = box(0, 0, 0, 2, 2, 2), box(1, 1, 1, 3, 3, 3), box(9, 9, 9, 10, 10, 10)
    row = one(spark, V.intersects(a, b), V.intersects(a, far), V.contains(a, b), V.contains(a, a), V.rests_on(box(0, 0, 2.1, 1, 1, 3), a), V.is_adjacent(a, box(2.2, 0, 0, 3, 2, 2)), V.is_adjacent(a, far))
    assert list(row) == [True, False, False, True, True, True, False]
    assert one(spark, V.bbox_diagonal(*box(0, 0, 0, 3, 4, 0)))[0] == 5


def test_matrix_product_lets_the_second_act_first(spark):
    shift = F.array(*map(F.lit, [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 5.0, 0, 0, 1.0]))
    double = F.array(*map(F.lit, [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1.0]))
    assert list(one(spark, *V.transform_point(V.multiply(shift, double), lits(1, 1, 1)))) == [7, 2, 2]
    assert list(one(spark, *V.transform_point(V.multiply(double, shift), lits(1, 1, 1)))) == [12, 2, 2]


def test_envelope_of_an_oriented_box(spark):
    s = math.sqrt(0.5)
    axes = F.array(*(F.array(*map(F.lit, r)) for r in ((s, s, 0.0), (-s, s, 0.0), (0.0, 0.0, 1.0))))
    low, high = V.obb_to_aabb(F.array(*lits(0, 0, 0)), axes, F.array(*lits(1, 1, 2)))
    assert list(one(spark, *low, *high)) == pytest.approx([-2 * s, -2 * s, -2, 2 * s, 2 * s, 2])
