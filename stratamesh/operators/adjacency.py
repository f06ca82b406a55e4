"""Adjacency of triangles: shared edges, nearness, and lookups."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as V

#: Half of the 27 cells around one, its own first: each unordered pair of cells appears once.
FORWARD = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]


def _keyed(df: DataFrame) -> DataFrame:
    return df if "chunk_id" in df.columns else df.withColumn("chunk_id", F.lit(0).cast("long"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(chunk_id, src, dst) from (chunk_id, a, b), each pair in both directions."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select("chunk_id", ends.alias("e")).select("chunk_id", "e.*")


def edge_pairs(tris: DataFrame) -> DataFrame:
    """(chunk_id, a, b) with a < b: triangles of a chunk with a common edge, by vertex ids; more than two may share one."""
    sides = F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    edges = _keyed(tris).select("chunk_id", "tri_id", F.explode(sides).alias("s")).select("chunk_id", "tri_id", "s.lo", "s.hi")
    left, right = edges.withColumnRenamed("tri_id", "a"), edges.withColumnRenamed("tri_id", "b")
    return left.join(right, ["chunk_id", "lo", "hi"]).filter("a < b").select("chunk_id", "a", "b").distinct()


def grid_pairs(points: DataFrame, tolerance: float, key: str = "tri_id", columns: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """(chunk_id, a, b, distance) with a < b: points of a chunk at most ``tolerance`` apart.

    Points are binned to cells of that size; one side is copied to half of the neighbour cells, so
    a pair meets once, in an equi-join on the cell. A tolerance of zero or less gives no pairs.
    """
    own = _keyed(points).select("chunk_id", F.col(key).alias("id"), *(F.col(c).alias(a) for c, a in zip(columns, "xyz")))
    if tolerance <= 0:
        return own.filter("false").select("chunk_id", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance"))
    cell = [F.floor(F.col(a) / F.lit(float(tolerance))) for a in "xyz"]
    right = own.select("chunk_id", *(c.alias(f"k{a}") for c, a in zip(cell, "xyz")), F.col("id").alias("j"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    offsets = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{a}") for v, a in zip(o, "xyz"))) for o in FORWARD)))
    left = own.withColumn("o", offsets).select("chunk_id", *((c + F.col(f"o.o{a}")).alias(f"k{a}") for c, a in zip(cell, "xyz")), F.col("id").alias("i"), *(F.col(a).alias(f"p{a}") for a in "xyz"), (F.col("o.ox") == 0).__and__(F.col("o.oy") == 0).__and__(F.col("o.oz") == 0).alias("own"))
    met = left.join(right, ["chunk_id", "kx", "ky", "kz"]).filter("(own AND i < j) OR (NOT own AND i <> j)")
    apart = met.withColumn("distance", V.distance(V.vec("p"), V.vec("q"))).filter(F.col("distance") <= tolerance)
    return apart.select("chunk_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


def adjacency(tris: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(chunk_id, src, dst, kind) both ways: shared edges, then nearness where no edge is shared."""
    edges = edge_pairs(tris)
    out = both_ways(edges).withColumn("kind", F.lit("edge"))
    if tolerance > 0:
        near = grid_pairs(tris, tolerance).join(edges, ["chunk_id", "a", "b"], "left_anti")
        out = out.unionByName(both_ways(near).withColumn("kind", F.lit("proximity")))
    return out


class TriangleGraph:
    """Lookups on an adjacency table; edges can be added, twice the same counting once."""

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges, self.nodes = edges.select("src", "dst").distinct(), nodes

    @classmethod
    def build(cls, tris: DataFrame) -> TriangleGraph:
        return cls(both_ways(edge_pairs(tris)), tris)

    def add_edge(self, a: int, b: int) -> TriangleGraph:
        more = self.edges.sparkSession.createDataFrame([(a, b), (b, a)], self.edges.schema)
        return TriangleGraph(self.edges.unionByName(more), self.nodes)

    def add_proximity_neighbours(self, tolerance: float) -> tuple[TriangleGraph, int]:
        """The graph with near triangles joined, and how many pairs that added."""
        near = grid_pairs(self.nodes, tolerance).select("chunk_id", "a", "b")
        new = near.join(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
        return TriangleGraph(self.edges.unionByName(both_ways(new).select("src", "dst")), self.nodes), new.count()

    def has_edge(self, a: int, b: int) -> bool:
        return bool(self.edges.filter((F.col("src") == a) & (F.col("dst") == b)).limit(1).count())

    def neighbor_ids(self, tri_id: int) -> list[int]:
        """Sorted; none for an unknown id."""
        return [r[0] for r in self.edges.filter(F.col("src") == tri_id).orderBy("dst").select("dst").collect()]

    def neighbors(self, tri_id: int) -> DataFrame:
        return self.nodes.join(self.edges.filter(F.col("src") == tri_id).select(F.col("dst").alias("tri_id")), "tri_id", "left_semi")

    def degree(self) -> DataFrame:
        """(tri_id, degree), zero for triangles without neighbours."""
        counts = self.edges.groupBy(F.col("src").alias("tri_id")).count().withColumnRenamed("count", "degree")
        return self.nodes.select("tri_id").join(counts, "tri_id", "left").fillna(0, ["degree"])

    def size(self) -> int:
        return self.nodes.count()
