"""Class changes of pixels and the report that sums them up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.functions.bands import scaled

#: Fixed thresholds of the report: detections for a validated change, of an index change, of a classifier change; percent; counts of each side.
LEAST_VALIDATED, LEAST_INDEX, LEAST_CLASSIFIER, LEAST_PERCENT, LEAST_FROM, LEAST_TO = 2, 5, 5, 50, 2, 2
LAYERS = [f"l{k}" for k in range(18)]


def change_day(old: Column, new: Column, day: Column, from_classes: Sequence[int], to_classes: Sequence[int]) -> Column:
    """The day where the class goes from one set to the other, 0 elsewhere, -1 where the new class is missing."""
    return F.when(new == 0, -1).when(old.isin(*from_classes) & new.isin(*to_classes), day).otherwise(0)


def index_drop(new_index: Column, old_index: Column, near_infrared: Column) -> tuple[Column, Column]:
    """Scaled index and its difference; -1 and 1 (scaled) where the new image has no data in its first band."""
    gone = near_infrared == 0
    return F.when(gone, -100).otherwise(scaled(new_index)), F.when(gone, 100).otherwise(scaled(new_index - old_index))


def report(observations: DataFrame, pixel: str, at: str, from_classes: Sequence[int], to_classes: Sequence[int], drop: float = -0.2) -> DataFrame:
    """The 18 layers of each pixel from ``(pixel, at, day, change, dn, class_code)``.

    One shuffle: the first validated time of a pixel is a window over the same
    key that the layers are then summed by.
    """
    validated = (F.col("change") > 0) & (F.col("dn") < int(drop * 100))
    rows = observations.withColumn("__val", validated)
    rows = rows.withColumn("__first", F.min(F.when(F.col("__val"), F.col(at))).over(Window.partitionBy(pixel)))
    after = F.col(at) >= F.col("__first")
    sums = rows.groupBy(pixel).agg(
        F.count("*").alias("l0"),
        F.count_if(F.col("change") == -1).alias("l1"),
        F.count_if(F.col("change") > 0).alias("l2"),
        F.coalesce(F.min(F.when(F.col("__val"), F.col("day"))), F.lit(0)).alias("l3"),
        F.count_if("__val").alias("l4"),
        F.count_if((F.col("change") == 0) & after).alias("l5"),
        F.count_if((F.col("change") == -1) & after).alias("l6"),
        F.count_if((F.col("change") >= 0) & (F.col("dn") < int(drop * 100))).alias("l11"),
        F.count_if(F.col("class_code").isin(*from_classes)).alias("l15"),
        F.count_if(F.col("class_code").isin(*to_classes)).alias("l16"),
    )
    return finish(sums, pixel)


def finish(sums: DataFrame, pixel: str) -> DataFrame:
    """The layers that follow from the counted ones."""
    flag = lambda c: c.cast("int")
    out = sums.withColumn("l7", F.when(F.col("l3") > 0, F.col("l4") + F.col("l5")).otherwise(0))
    out = out.withColumn("l8", F.when(F.col("l3") > 0, F.expr("(100 * l4) div nullif(l7, 0)")).otherwise(0))
    out = out.withColumn("l9", flag((F.col("l8") >= LEAST_PERCENT) & (F.col("l4") >= LEAST_VALIDATED))).withColumn("l10", F.col("l3") * F.col("l9"))
    out = out.withColumn("l12", flag(F.col("l11") >= LEAST_INDEX)).withColumn("l13", flag(F.col("l2") >= LEAST_CLASSIFIER))
    out = out.withColumn("l14", F.col("l12") * F.col("l13")).withColumn("l17", flag((F.col("l15") >= LEAST_FROM) & (F.col("l16") >= LEAST_TO)))
    return out.select(pixel, *(F.col(x).cast("int").alias(x) for x in LAYERS))
