"""Made-up scenes: a square of ground, a box and a thin wall; random triangles; many scenes side by side."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import MESH_SCHEMA

# Side of the ground; corners of the box and of the wall; distance of scenes.
GROUND = 4.0
BOX = ((-1.0, -1.0, 0.0), (0.0, 0.0, 1.0))
WALL = ((1.0, -0.05, 0.0), (1.1, 1.95, 1.0))
SPACING = 5.0


def _face(low, high, axis: int, end: int) -> list[tuple[float, ...]]:
    """Corners of a face of a box, in order round it."""
    u, v = (k for k in range(3) if k != axis)
    out = []
    for pick_u, pick_v in ((0, 0), (1, 0), (1, 1), (0, 1)):
        p = [0.0, 0.0, 0.0]
        p[axis], p[u], p[v] = (low, high)[end][axis], (low, high)[pick_u][u], (low, high)[pick_v][v]
        out.append(tuple(p))
    return out


def scene_quads(grid: int) -> np.ndarray:
    """Corners of all quads of a scene: grid x grid of ground, six of the box, five of the wall (it has no floor)."""
    edge = -GROUND / 2 + np.arange(grid + 1) * (GROUND / grid)
    x, y = (a.ravel() for a in np.meshgrid(np.arange(grid), np.arange(grid), indexing="ij"))
    ground = np.stack([np.stack([edge[x + i], edge[y + j], np.zeros(len(x))], axis=1) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))], axis=1)
    solid = [_face(*BOX, axis, end) for axis in range(3) for end in (0, 1)]
    solid += [_face(*WALL, axis, end) for axis in range(3) for end in (0, 1) if (axis, end) != (2, 0)]
    return np.concatenate([ground, np.array(solid)])


def scene_positions(grid: int, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """Flat 32-bit positions of 2 grid^2 + 22 triangles with vertices of their own."""
    quads = scene_quads(grid)
    return (quads[:, [0, 1, 2, 0, 2, 3]].reshape(-1, 3) + np.array(offset)).astype(np.float32).ravel()


def tiled_scenes(spark: SparkSession, count: int, grid: int, spacing: float = SPACING) -> DataFrame:
    """``count`` scenes in a square, as meshes; each is made where it is used."""
    side = max(1, math.ceil(math.sqrt(count)))

    def run(frames):
        for frame in frames:
            rows = []
            for k in frame["id"]:
                p = scene_positions(grid, (k % side * spacing, k // side * spacing, 0.0))
                rows.append((k, "glb", p, np.arange(len(p) // 3), None))
            yield pd.DataFrame(rows, columns=["mesh_id", "format", "positions", "indices", "transform"])

    return spark.range(count, numPartitions=max(1, min(count, 8))).mapInPandas(run, MESH_SCHEMA)


def random_mesh(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """One mesh of ``count`` random triangles in the unit cube; the seed fixes it."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(9 * count - 1)), lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24)))
    return spark.range(1).select(F.lit(0).cast("long").alias("mesh_id"), F.lit("glb").alias("format"), draw.cast("array<float>").alias("positions"), F.lit(None).cast("array<bigint>").alias("indices"), F.lit(None).cast("array<double>").alias("transform"))
