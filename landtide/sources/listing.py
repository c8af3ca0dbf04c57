"""Files as tables: sizes, patterns and completeness of product folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.functions import names


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, dir, name, bytes, modified)`` of all files below ``path``; contents are not read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return got.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), names.last_segment(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def folder_sizes(listing: DataFrame, folder: str = "dir") -> DataFrame:
    return listing.groupBy(folder).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def small_folders(listing: DataFrame, threshold: int, folder: str = "dir") -> DataFrame:
    return folder_sizes(listing, folder).where(F.col("bytes") < threshold)


def matching(listing: DataFrame, file_part: str, folder_part: str = "") -> DataFrame:
    return listing.where(F.contains("name", F.lit(file_part)) & F.contains("dir", F.lit(folder_part))).orderBy("path")


def by_pattern(listing: DataFrame, patterns: Sequence[str], folder: str = "dir", name: str = "name") -> DataFrame:
    """A row a folder, a column a pattern: the one name that has it, or empty if none or several have."""
    hits = [F.when(F.count_if(F.contains(name, F.lit(p))) == 1, F.max(F.when(F.contains(name, F.lit(p)), F.col(name)))).otherwise("").alias(p) for p in patterns]
    return listing.groupBy(folder).agg(*hits)


def validity(listing: DataFrame, product: str, band: str, wanted: int, name: str = "name") -> DataFrame:
    """1 for products with all bands, 0 for those that lack some, 2 for names that are none."""
    good = F.endswith(product, F.lit(".SAFE"))
    return listing.groupBy(product).agg(F.when(~F.first(good), 2).when(F.count_distinct(band) >= wanted, 1).otherwise(0).alias("validity"))


def finest_band(listing: DataFrame, product: str, band: str, resolution: str, name: str = "name") -> DataFrame:
    """The name of each band at its highest resolution."""
    return listing.groupBy(product, band).agg(F.min_by(name, resolution).alias(name))


def with_stamp(listing: DataFrame, name: str = "name", recent_first: bool = True) -> DataFrame:
    """Names that have a time, by time."""
    at = names.acquired(F.col(name))
    return listing.withColumn("acquired", at).where("acquired is not null").orderBy(F.desc("acquired") if recent_first else F.asc("acquired"), name)


def related(listing: DataFrame, stamp: str, name: str = "name") -> DataFrame:
    return listing.where(F.contains(name, F.lit(stamp)))


def lines(texts: DataFrame, part: str, keys: Sequence[str] = ("path",), text: str = "text") -> DataFrame:
    """``(keys, line, value)``: lines of whole texts that contain ``part``, numbered from 0; a null text has none."""
    each = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "value"))
    return each.where(F.contains("value", F.lit(part)))
