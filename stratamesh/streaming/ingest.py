"""A stream of mesh tables: scenes are extracted again as their meshes arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.mesh import MESH_SCHEMA
from ..plans.engine import MeshEngine
from ..plans.options import EngineOptions


def stream_meshes(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], options: EngineOptions = EngineOptions()) -> StreamingQuery:  # noqa: B008
    """For each batch of new mesh files under ``path`` (Parquet of meshes), ``sink`` gets the entities of all meshes so far.

    A batch extracts what is there, so a batch that is run again after a loss gives the same entities.
    """
    schema = ", ".join(MESH_SCHEMA.split(", "))

    def batch(_: DataFrame, number: int) -> None:
        engine = MeshEngine(spark, options).set_meshes(spark.read.schema(schema).parquet(path))
        sink(engine.extract(), number)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
