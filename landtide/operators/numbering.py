"""Numbers 0, 1, 2, ... for the rows of a table in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landtide.session import written


def dense(rows: DataFrame, order: Sequence[str], name: str = "id", first: int = 0) -> DataFrame:
    """``rows`` with the column ``name``: the place of each row by the columns ``order``, from ``first`` on.

    Rows are dealt to ranges of the order and written, each with the number of its
    range; ranges are counted, their counts summed up (a row a range), and rows are
    numbered within their range. Rows equal in ``order`` are in one range, and which of them comes
    first is not told; a null comes before any value.
    """
    made: list[str] = []
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    keys = [f"o{k}" for k in range(len(order))]
    ranged = written(held.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "numbering", made)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("range").orderBy(*keys)) - 1
    numbered = ranged.withColumn("own", own).join(starts, "range").select("row.*", (F.col("own") + F.col("before") + first).cast("long").alias(name))
    return written(numbered, "numbered", [], made)
