"""Regions: curvature, growth, absorption of small ones, summaries, components of triangles."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V
from ..plans.options import RegionGrowingOptions
from .components import components, roots_of
from .geometry import box_aggregates

#: What the kernels read of a triangle.
KERNEL = ["chunk_id", "tri_id", "v0", "v1", "v2", "nx", "ny", "nz", "cx", "cy", "cz"]


def mean_angles(tris: DataFrame, edges: DataFrame) -> DataFrame:
    """(tri_id, curvature): mean angle to the neighbours in degrees, as a double; 0 without neighbours."""
    at = lambda p: tris.select(F.col("tri_id").alias(p), *(F.col(f"n{a}").alias(f"{p}_{a}") for a in "xyz"))
    angles = edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst")
    mean = angles.groupBy(F.col("src").alias("tri_id")).agg(F.avg(V.angle_between(V.vec("src_"), V.vec("dst_"))).alias("curvature"))
    return tris.select("tri_id").join(mean, "tri_id", "left").select("tri_id", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def curvature(tris: DataFrame, edges: DataFrame) -> DataFrame:
    """``mean_angles`` as 32-bit floats."""
    return mean_angles(tris, edges).select("tri_id", F.col("curvature").cast("float").alias("curvature"))


def region_adjacency(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(a, b), a < b: regions of ``regions`` (tri_id, region_id) with adjacent triangles."""
    return touch_counts(edges, regions).select("a", "b")


def touch_counts(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(a, b, count), a < b: pairs of adjacent triangles, one in each region."""
    met = edges.join(regions.select(F.col("tri_id").alias("src"), F.col("region_id").alias("a")), "src").join(regions.select(F.col("tri_id").alias("dst"), F.col("region_id").alias("b")), "dst")
    return met.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("count"))


def boundary(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(tri_id, region_id) of triangles with a neighbour outside their region, or in none."""
    own = regions.select(F.col("tri_id").alias("src"), F.col("region_id").alias("own"))
    other = regions.select(F.col("tri_id").alias("dst"), F.col("region_id").alias("other"))
    out = edges.join(own, "src").join(other, "dst", "left").filter(~F.col("own").eqNullSafe(F.col("other")))
    return out.select(F.col("src").alias("tri_id"), F.col("own").alias("region_id")).distinct()


def summaries(tris: DataFrame, *by: str) -> DataFrame:
    """Of each group: unit mean normal, mean centroid, area, number of triangles, box; means are unweighted."""
    means = [F.avg(c).alias(c) for c in ("nx", "ny", "nz", "cx", "cy", "cz")]
    made = tris.groupBy(*by).agg(*means, F.sum("area").alias("area"), F.count("*").alias("triangle_count"), *box_aggregates())
    return made.withColumns(dict(zip(("nx", "ny", "nz"), V.normalize(V.vec("n")))))


def region_summary(tris: DataFrame, edges: DataFrame, regions: DataFrame) -> DataFrame:
    """``summaries`` by region_id with the number of boundary triangles."""
    at_edge = boundary(edges, regions).groupBy("region_id").agg(F.count("*").alias("boundary_count"))
    return summaries(tris.join(regions, "tri_id"), "region_id").join(at_edge, "region_id", "left").fillna(0, ["boundary_count"])


def connected_regions(pairs: DataFrame, regions: DataFrame, algorithm: str = "union-find") -> DataFrame:
    """(region_id, component): the smallest region that adjacency leads to. Every ``algorithm`` of bfs, dfs and union-find gives these."""
    if algorithm not in ("bfs", "dfs", "union-find"):
        raise ValueError(f"no algorithm {algorithm}")
    found = components(pairs, "a", "b").withColumnRenamed("node", "region_id")
    return regions.select("region_id").distinct().join(found, "region_id", "left").select("region_id", F.coalesce("root", "region_id").alias("component"))


# ------------------------------------------------------- kernels of one chunk


def _edge_links(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (rows of vertex ids) with a common edge, each linked to the next in the edge's list."""
    n = len(v)
    ends = np.sort(np.concatenate([v[:, [0, 1]], v[:, [1, 2]], v[:, [2, 0]]]), axis=1)
    order = np.lexsort((ends[:, 1], ends[:, 0]))
    same = (ends[order[1:]] == ends[order[:-1]]).all(axis=1)
    tri = order % n
    return tri[:-1][same], tri[1:][same]


def _length(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Lengths of vectors given by their parts; a sum over an axis of three is several times as slow."""
    return np.sqrt(x * x + y * y + z * z)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def _cells(points: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points by cell: their order, bounds of each cell in it, sorted cell keys, and steps of a key along the axes."""
    cell = np.floor(points / size).astype(np.int64)
    cell -= cell.min(axis=0) - 2
    span = cell.max(axis=0) + 3
    step = np.array([span[1] * span[2], span[2], 1])
    key = cell @ step
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return order, np.append(first, len(points)), keys, step


def chunk_components(points: np.ndarray, corners: np.ndarray, tolerance: float) -> np.ndarray:
    """For each triangle of a chunk the first one of its component, linked by shared edges and centroids within ``tolerance``.

    Points of one cell of side tolerance / sqrt(3) are near one another, so cells are the nodes; two cells, at most
    two apart, are compared point by point only while nothing else connects them.
    """
    n = len(points)
    a, b = _edge_links(corners)
    root = roots_of(a, b, n)
    if tolerance <= 0 or not n:
        return root
    order, bound, keys, step = _cells(points, tolerance / np.sqrt(3) * (1 - 1e-9))
    head = order[bound[:-1]]  # a point for each cell
    root = roots_of(np.concatenate([np.arange(n), order]), np.concatenate([root, np.repeat(head, np.diff(bound))]), n)
    offsets = sorted((o for o in product(range(-2, 3), repeat=3) if o > (0, 0, 0)), key=lambda o: sum(map(abs, o)))
    limit = tolerance * tolerance
    for o in offsets:
        near = keys + int(np.dot(o, step))
        at = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
        mine = np.flatnonzero(keys[at] == near)
        other = at[mine]
        open_ = root[head[mine]] != root[head[other]]
        mine, other = mine[open_], other[open_]
        if not len(mine):
            continue
        count_a, count_b = bound[mine + 1] - bound[mine], bound[other + 1] - bound[other]
        pairs = count_a * count_b
        which = np.repeat(np.arange(len(mine)), pairs)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        p = order[bound[mine][which] + k // count_b[which]]
        q = order[bound[other][which] + k % count_b[which]]
        met = _length(*(points[p] - points[q]).T) <= tolerance if limit else np.zeros(len(p), dtype=bool)
        hit = np.unique(which[met])
        if len(hit):
            root = roots_of(np.concatenate([np.arange(n), head[mine[hit]]]), np.concatenate([root, head[other[hit]]]), n)
    return root


def triangle_components(tris: DataFrame, tolerance: float) -> DataFrame:
    """(chunk_id, tri_id, component): the smallest triangle of each component of a chunk; chunks are tasks of bounded size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tri_id", ignore_index=True)
        root = chunk_components(frame[["cx", "cy", "cz"]].to_numpy(), frame[["v0", "v1", "v2"]].to_numpy(), tolerance)
        return pd.DataFrame({"chunk_id": frame["chunk_id"], "tri_id": frame["tri_id"], "component": frame["tri_id"].to_numpy()[root]})

    return tris.select(*KERNEL).groupBy("chunk_id").applyInPandas(run, "chunk_id long, tri_id long, component long")


#: Pairs of triangles compared at a time.
PAIR_BLOCK = 2_000_000


class Neighbours:
    """Adjacency of a chunk by shared edge or nearness; near pairs are found when asked for and never held all at once."""

    def __init__(self, points: np.ndarray, corners: np.ndarray, tolerance: float):
        self.points, self.tolerance, n = points, tolerance, len(points)
        ends = np.sort(np.concatenate([corners[:, [0, 1]], corners[:, [1, 2]], corners[:, [2, 0]]]), axis=1)
        edge = np.unique(ends[:, 0] * (int(ends.max(initial=0)) + 1) + ends[:, 1], return_inverse=True)[1]
        order = np.argsort(edge, kind="stable")
        edge, owner = edge[order], (np.arange(3 * n) % max(n, 1))[order]
        pairs, live, d = [np.empty(0, dtype=np.int64)], np.arange(3 * n), 1
        while len(live := live[live + d < 3 * n]) and len(live := live[edge[live] == edge[live + d]]):
            x, y = owner[live], owner[live + d]
            pairs += [(x * n + y)[x != y], (y * n + x)[x != y]]
            d += 1
        both = np.unique(np.concatenate(pairs))
        self.edge_from, self.edge_to = (both // n, both % n) if n else (both, both)
        self.edge_bound = np.searchsorted(self.edge_from, np.arange(n + 1))
        self.near = tolerance > 0 and n > 0
        if self.near:
            self.order, self.bound, keys, step = _cells(points, tolerance)
            self.cell = np.empty(n, dtype=np.int64)
            self.cell[self.order] = np.repeat(np.arange(len(keys)), np.diff(self.bound))
            to = keys[:, None] + np.array([int(np.dot(o, step)) for o in product((-1, 0, 1), repeat=3)])
            self.around = np.minimum(np.searchsorted(keys, to), len(keys) - 1)
            self.met = keys[self.around] == to

    def _about(self, cell: int) -> np.ndarray:
        """Triangles in and around a cell."""
        return np.concatenate([self.order[self.bound[c] : self.bound[c + 1]] for c in self.around[cell][self.met[cell]].tolist()])

    def of(self, t: int) -> np.ndarray:
        """Sorted neighbours of a triangle."""
        out = self.edge_to[self.edge_bound[t] : self.edge_bound[t + 1]]
        if self.near:
            about = self._about(self.cell[t])
            close = about[_length(*(self.points[about] - self.points[t]).T) <= self.tolerance]
            out = np.union1d(out, close[close != t])
        return out

    def mean_angles(self, normals: np.ndarray) -> np.ndarray:
        """The mean angle in degrees between each triangle's normal and those of its neighbours, 0 without any."""
        n = len(self.points)
        total, count = np.zeros(n), np.zeros(n)
        a, b = self.edge_from, self.edge_to
        if self.near:
            apart = _length(*(self.points[a] - self.points[b]).T) > self.tolerance
            a, b = a[apart], b[apart]  # the others are met among the near ones
            for cell in range(len(self.bound) - 1):
                own, about = self.order[self.bound[cell] : self.bound[cell + 1]], self._about(cell)
                step = max(1, PAIR_BLOCK // len(about))
                for at in range(0, len(own), step):
                    t = own[at : at + step]
                    i, j = np.nonzero(_length(*(k[t][:, None] - k[about] for k in self.points.T)) <= self.tolerance)
                    i, j = i[t[i] != about[j]], j[t[i] != about[j]]
                    turn = np.arccos(np.minimum(1.0, np.abs(_dot(normals[t[i]], normals[about[j]]))))
                    total[t] += np.bincount(i, weights=turn, minlength=len(t))
                    count[t] += np.bincount(i, minlength=len(t))
        turn = np.arccos(np.minimum(1.0, np.abs(_dot(normals[a], normals[b]))))
        total += np.bincount(a, weights=turn, minlength=n)
        count += np.bincount(a, minlength=n)
        return np.degrees(total) / np.maximum(count, 1)


def grow(points: np.ndarray, normals: np.ndarray, corners: np.ndarray, options: RegionGrowingOptions) -> np.ndarray:
    """Region of each triangle of a chunk: greedy growth from seeds by (curvature, position), then small regions absorbed.

    A neighbour joins if it agrees with the seed in angle and distance and is flat enough itself. Regions below the least size go,
    in their order, to the neighbour region they share most adjacent pairs with, of equals the one met first along
    the region's triangles as they joined; those without neighbours stay. Ids are dense, in the order of seeds.
    """
    n = len(points)
    near = Neighbours(points, corners, options.max_distance)
    curved = near.mean_angles(normals).astype(np.float32)
    region = np.full(n, -1)
    count, joined = 0, []  # triangles of each region in the order in which they joined
    for seed in np.lexsort((np.arange(n), curved)).tolist():
        if region[seed] >= 0:
            continue
        # What may join lies within the distance of the seed, so it is a neighbour of the seed itself: one step reaches all.
        out = near.of(seed)
        out = out[(region[out] < 0) & (curved[out] <= options.max_curvature)]
        turn = np.degrees(np.arccos(np.minimum(1.0, np.abs(normals[out] @ normals[seed]))))
        apart = _length(*(points[out] - points[seed]).T)
        out = out[(turn <= options.max_angle) & (apart <= options.max_distance)]
        region[seed] = region[out] = count
        joined.append([seed, *out.tolist()])
        count += 1
    small = np.flatnonzero(np.bincount(region, minlength=count) < options.min_region_size)
    if len(small):
        members = dict(enumerate(joined))
        for r in small.tolist():
            out = np.concatenate([near.of(t) for t in members[r]] or [np.empty(0, dtype=np.int64)])
            other = region[out]
            other = other[other != r]
            if len(other):
                ids, first, times = np.unique(other, return_index=True, return_counts=True)
                target = int(ids[np.lexsort((first, -times))[0]])
                region[members[r]] = target
                members[target] += members.pop(r)
                members[r] = []
        region = np.unique(region, return_inverse=True)[1]
    return region


def grow_regions(tris: DataFrame, options: RegionGrowingOptions = RegionGrowingOptions()) -> DataFrame:  # noqa: B008
    """(chunk_id, tri_id, region_id): growth and absorption in each chunk; region ids are dense in their chunk."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tri_id", ignore_index=True)
        found = grow(frame[["cx", "cy", "cz"]].to_numpy(), frame[["nx", "ny", "nz"]].to_numpy(), frame[["v0", "v1", "v2"]].to_numpy(), options)
        return pd.DataFrame({"chunk_id": frame["chunk_id"], "tri_id": frame["tri_id"], "region_id": found})

    return tris.select(*KERNEL).groupBy("chunk_id").applyInPandas(run, "chunk_id long, tri_id long, region_id long")


def with_timing(tris: DataFrame, tolerance: float) -> DataFrame:
    """(chunk_id, triangles, components, seconds) of the component kernel in each chunk."""
    import time

    def timed(frame: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        root = chunk_components(frame[["cx", "cy", "cz"]].to_numpy(), frame[["v0", "v1", "v2"]].to_numpy(), tolerance)
        return pd.DataFrame({"chunk_id": [frame["chunk_id"].iloc[0]], "triangles": [len(frame)], "components": [len(np.unique(root))], "seconds": [time.perf_counter() - began]})

    return tris.select(*KERNEL).groupBy("chunk_id").applyInPandas(timed, "chunk_id long, triangles long, components long, seconds double")
