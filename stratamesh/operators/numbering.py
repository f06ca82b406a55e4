"""Running sums and dense numbers over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise, row_count

#: A table of up to so many (narrow) rows is summed in one window; a larger one by ranges.
WINDOW_ROWS = 1_000_000


def sums_before(df: DataFrame, order: list[str], sums: dict[str, str], rows: int | None = None) -> DataFrame:
    """``df`` with, for each new name in ``sums``, the sum of a column over all rows before, in ``order``.

    ``df`` is read twice, so it should be a table; ``rows`` spares the count if known. Ranges of rows are summed
    first, one number each, then each range by itself.
    """
    before = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = lambda w: {name: F.coalesce(F.sum(column).over(before(w)), F.lit(0)).cast("long") for name, column in sums.items()}
    if (row_count(df) if rows is None else rows) <= WINDOW_ROWS:
        return df.withColumns(within(Window.partitionBy()))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy("__part").collect()  # one row for each range
    running, starts = dict.fromkeys(sums, 0), []
    for t in totals:
        starts.append((t["__part"], *(int(running[n]) for n in sums)))
        running = {n: running[n] + (t[n] or 0) for n in sums}
    starts = F.broadcast(spark.createDataFrame(starts, "__part int, " + ", ".join(f"`__{n}` long" for n in sums)))
    summed = ranged.withColumns(within(Window.partitionBy("__part"))).join(starts, "__part")
    return summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", *(f"__{n}" for n in sums))


def with_dense_ids(df: DataFrame, order: str | list[str], name: str = "entity_id", rows: int | None = None) -> DataFrame:
    """``df`` with numbers 0, 1, ... in ``order``."""
    one = df.withColumn("__one", F.lit(1))
    return sums_before(one, [order] if isinstance(order, str) else order, {name: "__one"}, row_count(df) if rows is None else rows).drop("__one")
