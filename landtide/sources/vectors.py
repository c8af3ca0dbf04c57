"""Polygon layers: GeoJSON in and out, extents, KML placemarks. A ring is an array of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.functions import geo

FEATURES = "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(properties, ring)``: the outer rings of the polygons of feature collections; other geometries are passed over."""
    text = spark.read.option("wholetext", "true").text(path)
    f = text.select(F.explode(F.from_json("value", FEATURES)["features"]).alias("f")).where(F.col("f.geometry.type") == "Polygon")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("f.properties", ring.alias("ring"))


def first_area(spark: SparkSession, path: str) -> DataFrame:
    """The first polygon of a file, as an area of interest."""
    return read_geojson(spark, path).limit(1)


def extent(layer: DataFrame, ring: str = "ring") -> DataFrame:
    """The bounding box of a layer."""
    box = layer.select(geo.bounding_box(F.col(ring)).alias("b"))
    return box.agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def wkt(ring: Column) -> Column:
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", F.transform(ring, point)), F.lit("))"))


def geometry(ring: Column) -> Column:
    """The geometry part of a GeoJSON feature."""
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def largest(layer: DataFrame, most: int, ring: str = "ring", least_points: int = 6) -> DataFrame:
    """The largest polygons first, without those of few points (single squares)."""
    return layer.where(F.size(ring) >= least_points).withColumn("area", geo.ring_area(F.col(ring))).orderBy(F.desc("area"), wkt(F.col(ring))).limit(most)


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature a line."""
    features.select("feature").write.mode("overwrite").text(path)


def placemark(name: Column, ring: Column) -> Column:
    point = lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("<Placemark><name>"), name, F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.concat_ws(" ", F.transform(ring, point)), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def projection(spark: SparkSession, path: str) -> DataFrame:
    """``(path, crs)``: the named reference system of each GeoJSON file, longitude and latitude where it names none."""
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.from_json("value", "crs struct<properties:struct<name:string>>").alias("j"))
    return text.select("path", F.coalesce("j.crs.properties.name", F.lit("urn:ogc:def:crs:OGC:1.3:CRS84")).alias("crs"))


def required_ring(kind: Column, ring: Column) -> Column:
    """The ring of an area of interest; a geometry of another kind than a polygon ends the job."""
    return F.when(kind == "Polygon", ring).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no geometry")))))
