"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import discard, materialise, shared_dir

__all__ = ["FOLD", "LOWER", "UPPER", "discard", "fold", "fold_id", "materialise", "shared_dir", "table", "trim", "worker_state"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Translation table for bytes: only A-Z change.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for later tasks to use."""
    name = "strata_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def trim() -> None:
    """Give freed memory back to the system, so that workers that wait for tasks stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fold_id(doc_id: Column, k: int) -> Column:
    """crc32 of the id's text, modulo ``k``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k
