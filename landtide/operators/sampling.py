"""Stratified accuracy assessment: sample sizes, allocation, standard errors and samples. Rounding is to even."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _all():
    """The frame of all rows: class tables have a row a class."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def deviation(accuracy: Column) -> Column:
    return F.sqrt(accuracy * (1 - accuracy))


def least_n(accuracy: Column, tolerance: float) -> Column:
    return accuracy * (1 - accuracy) / tolerance


def weights(classes: DataFrame) -> DataFrame:
    """``classes (class_code, n, ...)`` with the share of each."""
    return classes.withColumn("weight", F.col("n") / F.sum("n").over(_all()))


def total_size(classes: DataFrame, error: float, kind: str = "simple") -> DataFrame:
    """One row ``sample_size`` for ``classes (n, accuracy)`` and a wanted standard error; ``full`` corrects for the finite map."""
    w = weights(classes).withColumn("s", deviation(F.col("accuracy")))
    sums = w.agg(F.sum(F.col("weight") * F.col("s")).alias("ws"), F.sum(F.col("weight") * F.col("s") ** 2).alias("wss"), F.sum("n").alias("all"))
    simple = (F.col("ws") / error) ** 2
    full = F.col("ws") ** 2 / (error**2 + F.col("wss") / F.col("all"))
    return sums.select(F.bround(full if kind == "full" else simple).cast("long").alias("sample_size"))


def pinned(classes: DataFrame, total: int) -> DataFrame:
    """``classes (class_code, n, pinned)``: pinned classes have their number; the rest of ``total`` goes by size to the others."""
    rest = F.lit(total) - F.coalesce(F.sum("pinned").over(_all()), F.lit(0))
    free = F.sum(F.when(F.col("pinned").isNull(), F.col("n"))).over(_all())
    return classes.withColumn("sample_size", F.coalesce(F.col("pinned").cast("long"), F.bround(rest * F.col("n") / free).cast("long")))


def allocate(classes: DataFrame, total: int, kind: str = "prop") -> DataFrame:
    """Equal or proportional numbers of samples."""
    if kind == "equal":
        size = F.bround(F.lit(total) / F.count("*").over(_all()))
    elif kind == "prop":
        size = F.bround(F.lit(total) * F.col("n") / F.sum("n").over(_all()))
    else:
        raise ValueError(f"unknown allocation {kind!r}")
    return classes.withColumn("sample_size", size.cast("long"))


def by_variance(classes: DataFrame, total: int, tolerance: float) -> DataFrame:
    """``classes (class_code, n, accuracy)`` with a ``floor`` for each class and its ``sample_size``.

    The floor is the least number that keeps the variance of the class's accuracy
    within ``tolerance``. Classes whose share of ``total`` by size is under their floor get the
    floor; the others share what is left by size, which may bring more of them under
    theirs. In the order of floor over size, those with a floor are the last ones: a sum
    from the end tells for each class how it fares where all behind it have theirs, so one pass finds
    where they begin. Where floors exceed ``total``, every class has its floor.
    """
    least = F.ceil(F.round(F.greatest(least_n(F.col("accuracy"), tolerance), F.lit(0.0)), 6)).cast("long")
    rated = classes.withColumn("floor", least)
    behind = Window.orderBy(F.desc(F.col("floor") / F.col("n")), "class_code").rowsBetween(Window.unboundedPreceding, -1)
    pinned_before, size_before = F.coalesce(F.sum("floor").over(behind), F.lit(0)), F.coalesce(F.sum("n").over(behind), F.lit(0))
    share = (F.lit(total) - pinned_before) / (F.sum("n").over(_all()) - size_before)  # for each unit of size, were just those before at their floors
    rated = rated.withColumn("share", share).withColumn("under", F.col("share") * F.col("n") < F.col("floor"))
    free = F.first(F.when(~F.col("under"), F.col("share")), ignorenulls=True).over(Window.orderBy(F.desc(F.col("floor") / F.col("n")), "class_code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    size = F.coalesce(F.greatest(F.bround(free * F.col("n")).cast("long"), F.col("floor")), F.col("floor"))
    return rated.withColumn("sample_size", size).drop("share", "under")


def standard_errors(classes: DataFrame) -> DataFrame:
    """``classes (class_code, n, accuracy, sample_size)`` with the error of each class's accuracy (null for a sample of one) and of the overall one."""
    own = F.col("accuracy") * (1 - F.col("accuracy")) / F.nullif(F.col("sample_size") - 1, F.lit(0))
    return weights(classes).withColumn("user_error", F.sqrt(own)).withColumn("overall_error", F.sqrt(F.sum(F.col("weight") ** 2 * own).over(_all())))


def stratified(cells: DataFrame, sizes: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """As many cells of each class as ``sizes (class_code, sample_size)`` says, the first in ``order`` (a hash for a random draw)."""
    most = sizes.agg(F.max("sample_size")).first()[0] or 0  # bounds the ranks, so only heads of classes are shuffled
    w = Window.partitionBy("class_code").orderBy(*order)
    ranked = cells.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= int(most)).join(sizes.select("class_code", "sample_size"), "class_code")
    return ranked.where("__rank <= sample_size").drop("__rank", "sample_size")


def arithmetic_hash(x: Column, seed: int = 0) -> Column:
    """Multiplicative hash modulo 2^32, the same in any SQL engine."""
    return ((x + seed) * F.lit(2654435761)) % F.lit(4294967296)


def scenario(cells: DataFrame, accuracy: Column, error: float, order: Sequence[Column | str], corner: tuple[float, float], res: float, nodata: int = 0) -> tuple[DataFrame, DataFrame]:
    """A validation of a class map: its manifest, a row a class, and the points to look at.

    ``cells (row, col, class_code, ...)`` are counted by class without ``nodata``;
    ``accuracy`` is a column of ``class_code``. The total for the wanted standard
    error is dealt in proportion to size; points are at the centres of their cells.
    """
    mapped = cells.where(F.col("class_code") != nodata)
    classes = mapped.groupBy("class_code").agg(F.count("*").alias("n")).withColumn("accuracy", accuracy)
    total = total_size(classes, error, "full").first()[0] or 0
    manifest = standard_errors(allocate(classes, int(total)))
    points = stratified(mapped, manifest, order)
    x, y = F.lit(corner[0]) + (F.col("col") + 0.5) * res, F.lit(corner[1]) - (F.col("row") + 0.5) * res
    return manifest, points.withColumns({"x": x, "y": y})
