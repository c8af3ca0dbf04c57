"""Training tables, classifiers and their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.operators.polygons import cells_within


def signatures(samples: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Least, greatest, mean and sample deviation of each band in each class, a row for both."""
    long = samples.select(label, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))).alias("s")).select(label, "s.*")
    return long.groupBy(label, "band").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stdev"))


def confusion(scored: DataFrame, truth: str, prediction: str) -> DataFrame:
    return scored.groupBy(truth, prediction).agg(F.count("*").alias("n"))


def class_report(scored: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of each class of the truth."""
    cells = confusion(scored, truth, prediction)
    t = cells.groupBy(F.col(truth).alias("class_code")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col(truth) == F.col(prediction), F.col("n"))), F.lit(0)).alias("hits"))
    p = cells.groupBy(F.col(prediction).alias("class_code")).agg(F.sum("n").alias("claimed"))
    j = t.join(p, "class_code", "left")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("hits"), F.coalesce("claimed", F.lit(0))), ratio(F.col("hits"), F.col("support"))
    return j.select("class_code", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def balanced(samples: DataFrame, label: str, order: Sequence[Column | str], times: int = 10) -> DataFrame:
    """Every class cut to ``times`` the smallest, the first in ``order`` (a hash for a random draw)."""
    least = samples.groupBy(label).count().agg(F.min("count")).first()[0]
    w = Window.partitionBy(label).orderBy(*order)
    return samples.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= times * (least or 0)).drop("__rank")


def forest(samples: DataFrame, label: str, features: Sequence[str], trees: int = 100, depth: int = 12, seed: int = 101):
    """A random forest over feature columns, class weights balanced."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sizes = samples.groupBy(label).count()
    n, k = sizes.agg(F.sum("count"), F.count("*")).first()
    weighed = samples.join(sizes.select(label, (F.lit(float(n)) / (F.lit(k) * F.col("count"))).alias("__w")), label)
    stages = [VectorAssembler(inputCols=list(features), outputCol="__features"), RandomForestClassifier(labelCol=label, featuresCol="__features", weightCol="__w", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="prediction")]
    return Pipeline(stages=stages).fit(weighed)


def classify(image: DataFrame, model, bands: Sequence[str], nodata: float = 0) -> DataFrame:
    """``class_code`` and class probabilities where all bands have data; 0 and null elsewhere."""
    from pyspark.ml.functions import vector_to_array

    full = F.lit(True)
    for b in bands:
        full = full & (F.col(b) != nodata)
    scored = model.transform(image)
    return scored.select(*image.columns, F.when(full, F.col("prediction").cast("int")).otherwise(0).alias("class_code"), F.when(full, vector_to_array("__probability")).alias("probabilities"))


def change_from_composite(image: DataFrame, composite: DataFrame, keys: Sequence[str], bands: Sequence[str], model: Callable[[DataFrame, list[str]], DataFrame], mask: str | None = None) -> DataFrame:
    """Class changes by a model of pairs: each pixel of ``image`` with the ``bands`` of ``composite`` beside its own.

    ``model`` gets the stacked pixels and the names of the bands, those of the
    composite (``old_...``) first, and adds ``class_code``: a forest's ``classify`` or
    any other function. The class is 0 where a band of either has no data or the
    image's column ``mask`` is 0; pixels of one side only are left out. One join.
    """
    old = composite.select(*keys, *(F.col(b).alias(f"old_{b}") for b in bands))
    names = [*(f"old_{b}" for b in bands), *bands]
    seen = F.lit(True) if mask is None else F.coalesce(F.col(mask) != 0, F.lit(False))
    for n in names:
        seen = seen & F.coalesce(F.col(n) != 0, F.lit(False))
    stacked = image.join(old, list(keys)).withColumn("__seen", seen)
    return model(stacked, names).withColumn("class_code", F.when(F.col("__seen"), F.col("class_code")).otherwise(0)).drop("__seen")


def cross_validated(samples: DataFrame, label: str, features: Sequence[str], folds: int = 10, trees: int = 100, seed: int = 101, depth: int = 12) -> DataFrame:
    """Accuracy of each fold, trained on the others; folds follow from a hash of the features."""
    fold = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(folds))
    rows = samples.withColumn("__fold", fold)
    out = None
    for k in range(folds):
        model = forest(rows.where(F.col("__fold") != k).drop("__fold"), label, features, trees, depth, seed)
        part = model.transform(rows.where(F.col("__fold") == k)).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("fold", "accuracy")


def under_polygons(cells: DataFrame, layer: DataFrame, label: str, features: Sequence[str], ulx: float, uly: float, res: float, nodata: float = 0, scene: Sequence[str] = ()) -> DataFrame:
    """Samples ``(scene, row, col, label, features)``: the cells under labelled ``layer (scene, rings, label)`` with data in every feature.

    A cell under polygons of several labels is a sample of each.
    """
    full = F.lit(True)
    for f in features:
        full = full & (F.col(f) != nodata)
    keys = [*scene, "row", "col"]
    on = cells_within(cells.select(*keys, *features).where(full), layer.select(*scene, "rings", label), ulx, uly, res, scene)
    return on.select(*keys, label, *features).distinct()


def grid_search(samples: DataFrame, label: str, features: Sequence[str], grid: Sequence[dict], folds: int = 5, seed: int = 101) -> DataFrame:
    """``(trees, depth, accuracy, deviation)`` over the folds of each of ``grid``'s settings (``trees`` and ``depth``), the best first."""
    out = None
    for setting in grid:
        scored = cross_validated(samples, label, features, folds, setting["trees"], seed, setting["depth"])
        one = scored.agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("deviation")).select(F.lit(setting["trees"]).alias("trees"), F.lit(setting["depth"]).alias("depth"), "accuracy", "deviation")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("accuracy"), "trees", "depth")
