"""The change report as a stream: partial reports that merge in any order.

Layers 5 and 6 count what comes at or after the first validated time, which a late
image may bring forward. A partial report of a pixel has its counts, its first validated
time, how many unchanged and hidden observations come from then on, and those before
it by their times: what an earlier first time would still have to count. Merging adds counts, takes the
earliest first time and moves earlier runs across it; it is associative and
commutative, so micro-batches, late images and compactions give the batch report.
A pixel's state holds at most the times before its first validated change.

A micro-batch is aggregated on its own and written as a part under its number, so a
batch that is run again replaces itself. Every ``COMPACT`` parts all parts are merged
into one. All is done by aggregations in the JVM; no state is kept by the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.operators import change
from landtide.session import deleted, scratch

SUMS = ["l0", "l1", "l2", "l3", "l4", "l5", "l6", "l11", "l15", "l16"]
#: Parts that are merged into one.
COMPACT = 16
_COUNTS = ["l0", "l1", "l2", "l4", "l11", "l15", "l16"]


def _settled(runs: Column, first: Column) -> tuple[Column, Column, Column]:
    """Of runs ``(at, unchanged, hidden)``: those before ``first``, and what the others count."""
    late = F.filter(runs, lambda r: r["at"] >= first)
    total = lambda name: F.aggregate(late, F.lit(0).cast("long"), lambda s, r: s + r[name])
    return F.when(first.isNull(), runs).otherwise(F.filter(runs, lambda r: r["at"] < first)), total("unchanged"), total("hidden")


def partial(rows: DataFrame, pixel: str, from_classes: Sequence[int], to_classes: Sequence[int], drop: float = -0.2) -> DataFrame:
    """The partial report of rows ``(pixel, acquired, day, change, dn, class_code)``, one row a pixel."""
    dropped = F.col("dn") < int(drop * 100)
    validated = (F.col("change") > 0) & dropped
    by_time = rows.groupBy(pixel, F.col("acquired").alias("at")).agg(
        F.count("*").alias("l0"), F.count_if(F.col("change") == -1).alias("l1"), F.count_if(F.col("change") > 0).alias("l2"), F.count_if(validated).alias("l4"), F.count_if((F.col("change") >= 0) & dropped).alias("l11"),
        F.count_if(F.col("class_code").isin(*from_classes)).alias("l15"), F.count_if(F.col("class_code").isin(*to_classes)).alias("l16"), F.count_if(F.col("change") == 0).alias("unchanged"), F.min(F.when(validated, F.col("day"))).alias("day"),
    )
    run = F.when((F.col("unchanged") > 0) | (F.col("l1") > 0), F.struct("at", "unchanged", F.col("l1").alias("hidden")))
    per = by_time.groupBy(pixel).agg(*(F.sum(c).alias(c) for c in _COUNTS), F.min(F.when(F.col("l4") > 0, F.col("at"))).alias("first"), F.min("day").alias("day"), F.collect_list(run).alias("runs"))
    early, unchanged, hidden = _settled(F.col("runs"), F.col("first"))
    return per.select(pixel, *_COUNTS, "first", "day", unchanged.alias("unchanged"), hidden.alias("hidden"), early.alias("early"))


def merged(parts: DataFrame, pixel: str) -> DataFrame:
    """Partial reports of equal pixels as one; the same columns."""
    added = [*_COUNTS, "unchanged", "hidden"]
    per = parts.groupBy(pixel).agg(*(F.sum(c).alias(c) for c in added), F.min("first").alias("first"), F.min("day").alias("day"), F.flatten(F.collect_list("early")).alias("runs"))
    early, unchanged, hidden = _settled(F.col("runs"), F.col("first"))
    return per.select(pixel, *_COUNTS, "first", "day", (F.col("unchanged") + unchanged).alias("unchanged"), (F.col("hidden") + hidden).alias("hidden"), early.alias("early"))


def sums(state: DataFrame, pixel: str) -> DataFrame:
    """The counted layers of merged partial reports; finish them with ``operators.change.finish``."""
    seen = F.col("first").isNotNull()
    return state.select(pixel, "l0", "l1", "l2", F.coalesce("day", F.lit(0)).alias("l3"), "l4", F.when(seen, F.col("unchanged")).otherwise(0).alias("l5"), F.when(seen, F.col("hidden")).otherwise(0).alias("l6"), "l11", "l15", "l16")


class State:
    """Partial reports in a folder, with the list of those that count."""

    def __init__(self, spark: SparkSession, folder: str, pixel: str) -> None:
        self.spark, self.folder, self.pixel = spark, folder, pixel
        self.parts: dict[int, str] = {}

    def add(self, batch: int, part: DataFrame) -> None:
        path = f"{self.folder}/batch={batch}"
        part.write.mode("overwrite").parquet(path)
        self.schema = part.schema
        self.parts[batch] = path
        if len(self.parts) >= COMPACT:
            old, whole = list(self.parts.values()), f"{self.folder}/until={batch}"
            self.read().write.mode("overwrite").parquet(whole)
            self.parts = {batch: whole}
            deleted(self.spark, old)

    def read(self) -> DataFrame:
        return merged(self.spark.read.schema(self.schema).parquet(*self.parts.values()), self.pixel)


def run_available(stream: DataFrame, pixel: str, from_classes: Sequence[int], to_classes: Sequence[int], drop: float = -0.2) -> DataFrame:
    """The report after all that the stream has now."""
    spark = stream.sparkSession
    state, log = State(spark, scratch(spark, "report-parts"), pixel), scratch(spark, "report-progress")
    query = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(lambda rows, batch: state.add(batch, partial(rows, pixel, from_classes, to_classes, drop))).start()
    query.awaitTermination()
    if not state.parts:
        return change.report(spark.createDataFrame([], stream.schema), pixel, "acquired", from_classes, to_classes, drop)
    return change.finish(sums(state.read(), pixel), pixel)


def tumbling(events: DataFrame, at: str, size: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    """Counts of each window; for a stream or a table."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return _named(rows.groupBy(F.window(at, size), *by).agg(F.count("*").alias("n")), by)


def sliding(events: DataFrame, at: str, size: str, step: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return _named(rows.groupBy(F.window(at, size, step), *by).agg(F.count("*").alias("n")), by)


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], late: str = "1 day") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    got = rows.groupBy(F.session_window(at, gap).alias("window"), *by).agg(F.count("*").alias("n"))
    return _named(got, by)


def _named(got: DataFrame, by: Sequence[str]) -> DataFrame:
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
