"""Scene tree as a table (node_id, parent_id, entity_id, label, ordinal); the root has no parent, groups have entity -1."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import with_dense_ids

SCENE_SCHEMA = "node_id bigint, parent_id bigint, entity_id bigint, label string, ordinal bigint"
GROUP = -1


def _recursive(nodes: DataFrame, body: str) -> DataFrame:
    """The recursive query ``body`` over ``nodes``, of any depth and size: the session's limits of such queries are lifted."""
    view, spark = f"scene_{uuid.uuid4().hex}", nodes.sparkSession
    for limit in ("Level", "Row"):
        spark.conf.set(f"spark.sql.cteRecursion{limit}Limit", "-1")
    nodes.createOrReplaceTempView(view)
    return spark.sql(body.replace("{nodes}", view))


def descendants(nodes: DataFrame, of: int | None = None) -> DataFrame:
    """(ancestor, node_id, depth) for all nodes, or only below ``of``; each is its own descendant at depth 0."""
    where = "" if of is None else f"WHERE node_id = {int(of)}"
    return _recursive(nodes, f"""
        WITH RECURSIVE r(ancestor, node_id, depth) AS (
          SELECT node_id, node_id, 0 FROM {{nodes}} {where}
          UNION ALL SELECT r.ancestor, n.node_id, r.depth + 1 FROM r JOIN {{nodes}} n ON n.parent_id = r.node_id)
        SELECT ancestor, node_id, depth FROM r""")  # fmt: skip


def ancestors(nodes: DataFrame, of: int) -> DataFrame:
    """(node_id, depth) of the node ``of``, at depth 0, and those above it."""
    return _recursive(nodes, f"""
        WITH RECURSIVE r(node_id, parent_id, depth) AS (
          SELECT node_id, parent_id, 0 FROM {{nodes}} WHERE node_id = {int(of)}
          UNION ALL SELECT n.node_id, n.parent_id, r.depth + 1 FROM r JOIN {{nodes}} n ON n.node_id = r.parent_id)
        SELECT node_id, depth FROM r""")  # fmt: skip


def preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` reached from roots with depth and ``path``, the ordinals from the root on; sorting by path walks in pre-order."""
    return _recursive(nodes, """
        WITH RECURSIVE r(node_id, depth, path) AS (
          SELECT node_id, 0, array(ordinal) FROM {nodes} WHERE parent_id IS NULL
          UNION ALL SELECT n.node_id, r.depth + 1, concat(r.path, array(n.ordinal)) FROM r JOIN {nodes} n ON n.parent_id = r.node_id)
        SELECT n.*, r.depth, r.path FROM r JOIN {nodes} n USING (node_id)""")  # fmt: skip


class SceneGraph:
    """A scene tree; changes give the tree a new table. Node ids grow and are not used again."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, next_id: int | None = None):
        self.spark = spark
        self.nodes = nodes if nodes is not None else spark.createDataFrame([(0, None, GROUP, "scene", 0)], SCENE_SCHEMA)
        self.next_id = next_id if next_id is not None else 1 if nodes is None else (self.nodes.agg(F.max("node_id")).first()[0] or 0) + 1

    def _append(self, rows: list[tuple]) -> None:
        self.nodes = self.nodes.unionByName(self.spark.createDataFrame(rows, SCENE_SCHEMA))

    def _next_ordinal(self, parent_id: int) -> int:
        top = self.nodes.filter(F.col("parent_id") == parent_id).agg(F.max("ordinal")).first()[0]
        return 0 if top is None else top + 1

    def add_entity(self, entity_id: int, label: str, parent_id: int = 0) -> int:
        node = self.next_id
        self._append([(node, parent_id, entity_id, label, self._next_ordinal(parent_id))])
        self.next_id += 1
        return node

    def add_group(self, label: str, parent_id: int = 0) -> int:
        return self.add_entity(GROUP, label, parent_id)

    def add_entities(self, entities: DataFrame, parent_id: int = 0, ordinal: int | None = None) -> None:
        """All of ``entities`` (entity_id, label) in the order of their ids, under one parent, last or from ``ordinal`` on; numbered without leaving Spark."""
        k, rows = F.col("__k"), entities.count()
        ordinal = self._next_ordinal(parent_id) if ordinal is None else ordinal
        more = with_dense_ids(entities.select("entity_id", "label"), "entity_id", "__k", rows).select((k + self.next_id).alias("node_id"), F.lit(parent_id).cast("long").alias("parent_id"), F.col("entity_id").cast("long"), "label", (k + ordinal).alias("ordinal"))
        self.next_id += rows
        self.nodes = self.nodes.unionByName(more)

    def remove(self, node_id: int) -> None:
        """The node with all below it; an unknown id changes nothing."""
        gone = descendants(self.nodes, node_id).select("node_id")
        self.nodes = self.nodes.join(gone, "node_id", "left_anti").select(*self.nodes.columns)

    def move(self, node_id: int, parent_id: int) -> bool:
        """Hang a node last under another; False, and nothing changes, for the root, unknown nodes and cycles."""
        known = {r[0] for r in self.nodes.filter(F.col("node_id").isin(node_id, parent_id)).select("node_id").collect()}
        if node_id == 0 or node_id == parent_id or known != {node_id, parent_id} or self.is_descendant(parent_id, node_id):
            return False
        last, moved = self._next_ordinal(parent_id), F.col("node_id") == node_id
        self.nodes = self.nodes.withColumns({"parent_id": F.when(moved, F.lit(parent_id).cast("long")).otherwise(F.col("parent_id")), "ordinal": F.when(moved, F.lit(last).cast("long")).otherwise(F.col("ordinal"))})
        return True

    def get_node(self, node_id: int) -> DataFrame:
        return self.nodes.filter(F.col("node_id") == node_id)

    def get_entity_by_node(self, node_id: int) -> int | None:
        row = self.get_node(node_id).filter(F.col("entity_id") != GROUP).select("entity_id").first()
        return row and row[0]

    def iter_entities(self) -> DataFrame:
        """Entity nodes in pre-order, left to right."""
        return preorder(self.nodes).filter(F.col("entity_id") != GROUP).orderBy("path")

    def is_descendant(self, child: int, ancestor: int) -> bool:
        """Whether ``ancestor`` is ``child`` or above it."""
        return bool(ancestors(self.nodes, child).filter(F.col("node_id") == ancestor).limit(1).count())

    def query(self, predicate) -> DataFrame:
        """Nodes for which a column expression holds."""
        return self.nodes.filter(predicate)

    def size(self) -> int:
        return self.nodes.count()

    def rebuild(self, entities: DataFrame) -> None:
        """Drop what hangs on the root and add all entities anew; ids go on growing."""
        self.nodes = self.nodes.filter(F.col("node_id") == 0)
        self.add_entities(entities, ordinal=0)
