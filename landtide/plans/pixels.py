"""Queries over pixels: indices, masks, composites, the change report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landtide import model
from landtide.functions import bands
from landtide.operators import change, composites, masks
from landtide.plans.registry import query
from landtide.streaming import report as streaming

FROM, TO = model.FROM_CLASSES, model.TO_CLASSES

CHANGES = """{obs}, {base}, joined AS (SELECT o.*, b.class_code AS old_class,
 CASE WHEN o.b4 + o.b3 = 0 THEN 0 ELSE (o.b4 - o.b3) / (o.b4 + o.b3) END AS ix, CASE WHEN b.b4 + b.b3 = 0 THEN 0 ELSE (b.b4 - b.b3) / (b.b4 + b.b3) END AS old_ix
 FROM obs o JOIN base b USING (pixel)), changes AS (SELECT pixel, "row", col, acquired, day, class_code, zone,
 CASE WHEN class_code = 0 THEN -1 WHEN old_class IN (1, 2, 3) AND class_code IN (4, 5, 6) THEN day ELSE 0 END::INT AS change,
 CASE WHEN b4 = 0 THEN -100 ELSE CAST(trunc(ix * 100) AS INT) END AS nd, CASE WHEN b4 = 0 THEN 100 ELSE CAST(trunc((ix - old_ix) * 100) AS INT) END AS dn FROM joined)"""
REPORT = CHANGES + """, marked AS (SELECT *, change > 0 AND dn < -20 AS val, min(CASE WHEN change > 0 AND dn < -20 THEN acquired END) OVER (PARTITION BY pixel) AS first FROM changes),
 sums AS (SELECT pixel, count(*) AS l0, count(*) FILTER (change = -1) AS l1, count(*) FILTER (change > 0) AS l2, coalesce(min(CASE WHEN val THEN day END), 0) AS l3,
 count(*) FILTER (val) AS l4, count(*) FILTER (change = 0 AND acquired >= first) AS l5, count(*) FILTER (change = -1 AND acquired >= first) AS l6,
 count(*) FILTER (change >= 0 AND dn < -20) AS l11, count(*) FILTER (class_code IN (1, 2, 3)) AS l15, count(*) FILTER (class_code IN (4, 5, 6)) AS l16 FROM marked GROUP BY pixel),
 more AS (SELECT *, CASE WHEN l3 > 0 THEN l4 + l5 ELSE 0 END AS l7, CASE WHEN l3 > 0 THEN (100 * l4) // (l4 + l5) ELSE 0 END AS l8 FROM sums),
 report AS (SELECT pixel, l0::INT AS l0, l1::INT AS l1, l2::INT AS l2, l3::INT AS l3, l4::INT AS l4, l5::INT AS l5, l6::INT AS l6, l7::INT AS l7, l8::INT AS l8, (l8 >= 50 AND l4 >= 2)::INT AS l9,
 (l3 * (l8 >= 50 AND l4 >= 2)::INT)::INT AS l10, l11::INT AS l11, (l11 >= 5)::INT AS l12, (l2 >= 5)::INT AS l13, (l11 >= 5 AND l2 >= 5)::INT AS l14, l15::INT AS l15, l16::INT AS l16, (l15 >= 2 AND l16 >= 2)::INT AS l17 FROM more)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with change day, scaled index and its difference to the map before."""
    return against_baseline(model.observations(spark, sf_dir), spark, sf_dir)


def against_baseline(observations: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of any table or stream of observations."""
    base = model.baseline(spark, sf_dir).select("pixel", F.col("class_code").alias("old_class"), bands.ndvi(F.col("b4"), F.col("b3")).alias("old_ix"))
    rows = observations.join(base, "pixel")
    nd, dn = change.index_drop(bands.ndvi(F.col("b4"), F.col("b3")), F.col("old_ix"), F.col("b4"))
    day = change.change_day(F.col("old_class"), F.col("class_code"), F.col("day"), FROM, TO)
    return rows.select("pixel", "row", "col", "acquired", "day", "class_code", "zone", day.alias("change"), nd.alias("nd"), dn.alias("dn"))


@query("WITH " + REPORT + " SELECT * FROM report")
def report18(spark, sf_dir):
    return change.report(changes(spark, sf_dir), "pixel", "acquired", FROM, TO)


@query("WITH " + REPORT + " SELECT * FROM report")
def stream_report(spark, sf_dir):
    """The report over a stream of line item files, run until no more are there."""
    schema = model.table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    rows = against_baseline(model.observed(stream), spark, sf_dir)
    return streaming.run_available(rows, "pixel", FROM, TO)


@query("WITH " + CHANGES + " SELECT pixel, acquired, change, nd, dn FROM changes")
def change_raster(spark, sf_dir):
    return changes(spark, sf_dir).select("pixel", "acquired", "change", "nd", "dn")


@query("WITH {obs} SELECT pixel, acquired, round(CASE WHEN b4 + b3 = 0 THEN 0 ELSE (b4 - b3) / (b4 + b3) END, 6) AS ndvi FROM obs")
def ndvi_index(spark, sf_dir):
    return model.observations(spark, sf_dir).select("pixel", "acquired", F.round(bands.ndvi(F.col("b4"), F.col("b3")), 6).alias("ndvi"))


@query("WITH {obs} SELECT pixel, acquired, round(CASE WHEN b3 + b4 = 0 THEN 0 ELSE (b3 - b4) / (b3 + b4) END, 6) AS ndvi FROM obs")
def ndvi_signflip(spark, sf_dir):
    return model.observations(spark, sf_dir).select("pixel", "acquired", F.round(bands.ndvi_flipped(F.col("b4"), F.col("b3")), 6).alias("ndvi"))


@query("""WITH {obs}, m AS (SELECT *, class_code NOT IN (0, 2) AS clear FROM obs) SELECT pixel,
 coalesce(trunc(median(CASE WHEN clear THEN nullif(b1, 0) END)), 0)::BIGINT AS b1, coalesce(trunc(median(CASE WHEN clear THEN nullif(b2, 0) END)), 0)::BIGINT AS b2 FROM m GROUP BY pixel""")
def masked_median_composite(spark, sf_dir):
    return composites.median(model.observations(spark, sf_dir), ["pixel"], ["b1", "b2"], masks.not_of_classes(F.col("class_code"), (0, 2)))


@query("WITH {obs} SELECT pixel, max(CASE WHEN class_code NOT IN (0, 2) THEN 1 ELSE 0 END)::INT AS mask FROM obs GROUP BY pixel")
def composite_mask(spark, sf_dir):
    return composites.combined_mask(model.observations(spark, sf_dir), ["pixel"], masks.not_of_classes(F.col("class_code"), (0, 2)))


@query("WITH {obs} SELECT class_code, count(*) AS n FROM obs WHERE class_code <> 0 GROUP BY 1")
def class_histogram(spark, sf_dir):
    return composites.class_counts(model.observations(spark, sf_dir))


@query("WITH {obs}, c AS (SELECT class_code, count(*) AS n FROM obs WHERE class_code <> 0 GROUP BY 1) SELECT class_code, n, round(n / sum(n) OVER (), 9) AS share FROM c")
def class_share(spark, sf_dir):
    return composites.class_shares(model.observations(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("WITH {obs} SELECT class_code, \"row\", col FROM obs WHERE class_code <> 0")
def class_coordinates(spark, sf_dir):
    return composites.class_coordinates(model.observations(spark, sf_dir))


@query("WITH {obs} " + " UNION ALL ".join(f"SELECT '{b}' AS band, min(nullif({b}, 0))::DOUBLE AS \"min\", max(nullif({b}, 0))::DOUBLE AS \"max\", round(avg(nullif({b}, 0)), 6) AS mean, round(stddev_pop(nullif({b}, 0)), 6) AS std FROM obs" for b in ("b1", "b2", "b3", "b4")))
def band_stats_excl_missing(spark, sf_dir):
    got = composites.band_stats(model.observations(spark, sf_dir), ["b1", "b2", "b3", "b4"])
    return got.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# Masks.

@query("WITH {base} SELECT pixel, (class_code IN (1, 3, 5))::INT AS mask FROM base")
def mask_from_class(spark, sf_dir):
    return model.baseline(spark, sf_dir).select("pixel", masks.of_classes(F.col("class_code"), (1, 3, 5)).alias("mask"))


@query("WITH {obs} SELECT pixel, acquired, (b1 < 25)::INT AS mask FROM obs")
def mask_from_band_lt(spark, sf_dir):
    return model.observations(spark, sf_dir).select("pixel", "acquired", masks.of_band(F.col("b1"), 25, "<").alias("mask"))


@query("WITH {obs} SELECT pixel, acquired, (b2 > 30000)::INT AS mask FROM obs")
def mask_from_band_gt(spark, sf_dir):
    return model.observations(spark, sf_dir).select("pixel", "acquired", masks.of_band(F.col("b2"), 30000, ">").alias("mask"))


@query("SELECT p_partkey AS pixel, (p_size % 12 NOT IN (0, 1, 2, 3, 8, 9, 10, 11))::INT AS mask FROM part")
def mask_not_in(spark, sf_dir):
    return model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), masks.not_of_classes(F.col("p_size") % 12).alias("mask"))


@query("SELECT p_partkey AS pixel, (p_retailprice % 100 < 40)::INT AS by_probability, (p_size % 12 IN (4, 5, 6))::INT AS by_class FROM part")
def mask_confidence(spark, sf_dir):
    probability, code = F.col("p_retailprice") % 100, F.col("p_size") % 12
    return model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), masks.of_confidence(probability, code, 40).alias("by_probability"), masks.of_confidence(probability, code, 0).alias("by_class"))


THREE = """{base}, m1 AS (SELECT pixel, (class_code IN (1, 2, 3, 4))::INT AS mask FROM base WHERE pixel % 3 <> 0), m2 AS (SELECT pixel, (reflectance > 1200)::INT AS mask FROM base WHERE pixel % 4 <> 0),
 stacked AS (SELECT *, 0 AS part FROM m1 UNION ALL SELECT *, 1 FROM m2), f AS (SELECT pixel, min(mask) AS low, max(mask) AS high, sum(mask) AS total, count(*) AS parts FROM stacked GROUP BY pixel)"""


def _two_masks(spark, sf_dir):
    base = model.baseline(spark, sf_dir)
    a = base.where("pixel % 3 <> 0").select("pixel", masks.of_classes(F.col("class_code"), (1, 2, 3, 4)).alias("mask"))
    b = base.where("pixel % 4 <> 0").select("pixel", masks.of_band(F.col("reflectance"), 1200, ">").alias("mask"))
    return [a, b]


@query("WITH " + THREE + " SELECT pixel, low::INT AS mask FROM f WHERE parts = 2")
def mask_and_intersect(spark, sf_dir):
    return masks.combine(_two_masks(spark, sf_dir), ["pixel"])


@query("WITH " + THREE + " SELECT pixel, CASE WHEN parts < 2 THEN 1 ELSE high END::INT AS mask FROM f")
def mask_or_union(spark, sf_dir):
    return masks.combine(_two_masks(spark, sf_dir), ["pixel"], "or", "union")


@query("WITH " + THREE + " SELECT pixel, (1 - high)::INT AS mask FROM f WHERE parts = 2")
def mask_nor(spark, sf_dir):
    return masks.combine(_two_masks(spark, sf_dir), ["pixel"], "nor")


@query("WITH " + THREE + " SELECT pixel, total::BIGINT AS mask FROM f")
def mask_sum(spark, sf_dir):
    return masks.add(_two_masks(spark, sf_dir), ["pixel"])


@query("WITH {obs}, {base} SELECT o.pixel, acquired, CASE WHEN m.mask = 0 THEN 0 ELSE b1 END AS b1, CASE WHEN m.mask = 0 THEN 0 ELSE b2 END AS b2 FROM obs o LEFT JOIN (SELECT pixel, (class_code IN (1, 3))::INT AS mask FROM base) m USING (pixel)")
def apply_mask(spark, sf_dir):
    return masks.apply(model.observations(spark, sf_dir).select("pixel", "acquired", "b1", "b2"), mask_from_map(spark, sf_dir), ["pixel"], ["b1", "b2"])


def mask_from_map(spark, sf_dir):
    return model.baseline(spark, sf_dir).select("pixel", masks.of_classes(F.col("class_code"), (1, 3)).alias("mask"))


@query("WITH {obs}, {base} SELECT o.pixel, acquired, CASE WHEN b.class_code IN (1, 2, 3) THEN 0 ELSE b1 END AS b1 FROM obs o LEFT JOIN base b USING (pixel)")
def filter_by_class_map(spark, sf_dir):
    return masks.filter_by_classes(model.observations(spark, sf_dir).select("pixel", "acquired", "b1"), model.baseline(spark, sf_dir), ["pixel"], ["b1"], (1, 2, 3), invert=True)


GRID = """{base}, m AS (SELECT "row", col, (class_code NOT IN (0, 6))::INT AS mask FROM base)"""
DISK = "d AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4)"


def _grid_mask(spark, sf_dir):
    return model.baseline(spark, sf_dir).select("row", "col", masks.not_of_classes(F.col("class_code"), (0, 6)).alias("mask"))


@query("WITH " + GRID + ", " + DISK + """, near AS (SELECT DISTINCT m."row" + i AS "row", m.col + j AS col FROM m, d WHERE mask = 0)
 SELECT m."row", m.col, CASE WHEN n."row" IS NOT NULL THEN 0 ELSE mask END::INT AS mask FROM m LEFT JOIN near n ON m."row" = n."row" AND m.col = n.col""")
def mask_erosion(spark, sf_dir):
    return masks.erode(_grid_mask(spark, sf_dir), 2)


@query("WITH " + GRID + """, hi AS (SELECT a."row", a.col, max(b.mask) AS mask FROM m a JOIN m b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2)
 SELECT a."row", a.col, min(b.mask)::INT AS mask FROM hi a JOIN hi b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2""")
def mask_closing(spark, sf_dir):
    return masks.close(_grid_mask(spark, sf_dir))


# Map algebra.

@query("SELECT p_partkey AS pixel, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE least(greatest(p_retailprice, 1000), 10000) - 1000 END AS b1 FROM part")
def offset_correction(spark, sf_dir):
    baseline = F.when(F.col("p_size") % 3 == 0, F.lit("A400")).otherwise(F.lit("0400"))
    return model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), bands.offset_corrected(F.col("p_retailprice"), baseline).alias("b1"))


@query("WITH {obs} SELECT pixel, acquired, CASE WHEN b2 / 100 - 100 > 0 THEN round(b1 - (b2 / 100 - 100) * 12 / (ln(b2 / 100 - 100) + 1), 6) END AS b1 FROM obs")
def cirrus_correction(spark, sf_dir):
    return model.observations(spark, sf_dir).select("pixel", "acquired", F.round(bands.cirrus_corrected(F.col("b1"), F.col("b2") / 100), 6).alias("b1"))


@query("WITH {obs}, e AS (SELECT quantile_cont(b2, 0.02) AS lo, quantile_cont(b2, 0.98) AS hi FROM obs) SELECT pixel, acquired, CASE WHEN hi > lo THEN trunc((least(greatest(b2, lo), hi) - lo) * 255 / (hi - lo)) ELSE 0 END::INT AS b2 FROM obs, e")
def scale_uint8(spark, sf_dir):
    return bands.to_byte(model.observations(spark, sf_dir).select("pixel", "acquired", "b2"), "b2", "b2")


@query("WITH {base} SELECT pixel, (class_code = 4)::INT AS hit, CASE WHEN class_code = 4 THEN class_code ELSE 0 END::INT AS only FROM base")
def reclass_binary(spark, sf_dir):
    return model.baseline(spark, sf_dir).select("pixel", bands.equals(F.col("class_code"), 4).alias("hit"), bands.isolated(F.col("class_code"), 4).cast("int").alias("only"))


@query("SELECT vec_id, list_max(embedding)::DOUBLE AS p FROM embeddings")
def flatten_probability(spark, sf_dir):
    return model.table(spark, sf_dir, "embeddings").select("vec_id", bands.most_likely(F.col("embedding")).cast("double").alias("p"))


@query("WITH {base} SELECT pixel, CASE class_code WHEN 1 THEN 0 WHEN 2 THEN 200 WHEN 3 THEN 120 END::INT AS r, CASE class_code WHEN 1 THEN 100 WHEN 2 THEN 180 WHEN 3 THEN 90 END::INT AS g FROM base")
def display_layer(spark, sf_dir):
    color = bands.display_color(F.col("class_code"), {1: (0, 100, 0), 2: (200, 180, 20), 3: (120, 90, 60)})
    return model.baseline(spark, sf_dir).select("pixel", color[0].alias("r"), color[1].alias("g"))


@query("WITH {obs} SELECT pixel, acquired, round(b1 * 2 + b2, 6) AS v FROM obs")
def band_function(spark, sf_dir):
    return bands.apply_bands(model.observations(spark, sf_dir), lambda a, b: F.round(a * 2 + b, 6), ["b1", "b2"], "v").select("pixel", "acquired", "v")


@query("WITH {obs} SELECT pixel, round(stddev_pop(b1), 6) AS v FROM obs GROUP BY pixel")
def image_function(spark, sf_dir):
    return bands.apply_images(model.observations(spark, sf_dir), ["pixel"], lambda c: F.round(F.stddev_pop(c), 6), "b1", "v")


# Composites.

@query("""WITH {obs}, r AS (SELECT *, row_number() OVER (PARTITION BY pixel ORDER BY acquired DESC, scene DESC, line DESC, b2 DESC, b1 DESC) AS k FROM obs WHERE class_code NOT IN (0, 2))
 SELECT pixel, b1, b2, CAST(strftime(acquired, '%Y%m%d') AS INT) AS date_image FROM r WHERE k = 1""")
def latest_valid_composite(spark, sf_dir):
    return composites.latest_valid(model.observations(spark, sf_dir), ["pixel"], ["b1", "b2"], "acquired", ~F.col("class_code").isin(0, 2), ["scene", "line", "b2", "b1"])


@query("""WITH {base}, t AS (SELECT pixel, class_code AS v, 0 AS seq FROM base UNION ALL SELECT pixel, CAST(b4 AS INT) % 3, 1 FROM (SELECT pixel, trunc(b4) AS b4 FROM base WHERE pixel % 2 = 0))
 SELECT pixel, coalesce(arg_max(v, seq) FILTER (v <> 0), 0)::INT AS class_code FROM t GROUP BY pixel""")
def mosaic_overwrite(spark, sf_dir):
    base = model.baseline(spark, sf_dir)
    return composites.mosaic([base, base.where("pixel % 2 = 0").select("pixel", (F.col("b4").cast("int") % 3).alias("class_code"))], ["pixel"], "class_code")


@query("""WITH {obs}, {base}, n AS (SELECT pixel, max(b2) AS v FROM obs WHERE class_code = 6 GROUP BY pixel)
 SELECT pixel, coalesce(nullif(n.v, 0), b.reflectance) AS v FROM base b FULL JOIN n USING (pixel)""")
def update_composite(spark, sf_dir):
    new = model.observations(spark, sf_dir).where("class_code = 6").groupBy("pixel").agg(F.max("b2").alias("v"))
    return composites.update(model.baseline(spark, sf_dir).select("pixel", F.col("reflectance").alias("v")), new, ["pixel"], "v")


@query("WITH {obs} SELECT pixel, round(sum(b2), 4) AS b2 FROM obs GROUP BY pixel")
def raster_sum(spark, sf_dir):
    return composites.total(model.observations(spark, sf_dir), ["pixel"], "b2").withColumn("b2", F.round("b2", 4))


@query("WITH {obs} SELECT pixel, round(avg(b2), 3) AS b2 FROM obs GROUP BY pixel")
def raster_mean(spark, sf_dir):
    return composites.mean(model.observations(spark, sf_dir), ["pixel"], "b2").withColumn("b2", F.round("b2", 3))


@query("WITH {obs} SELECT pixel, count(*) FILTER (class_code IN (4, 5)) AS detections FROM obs GROUP BY pixel")
def verify_change_count(spark, sf_dir):
    return composites.agreement(model.observations(spark, sf_dir), ["pixel"], (4, 5))


@query("WITH " + CHANGES + " SELECT pixel, coalesce(min(CASE WHEN change > 0 THEN change END), 0)::INT AS first_day, count(*) FILTER (change > 0) AS n_days FROM changes GROUP BY pixel")
def date_map_combine(spark, sf_dir):
    got = composites.combine_dates(changes(spark, sf_dir), ["pixel"], "change")
    return got.withColumn("first_day", F.col("first_day").cast("int"))


# Functions of whole arrays, where columns cannot say it.

@query("WITH {obs} SELECT scene, line, CASE WHEN b2 > 100 THEN round(b1 - (b2 - 100) * 12 / (ln(b2 - 100) + 1), 4) END AS b1, CASE WHEN b2 > 100 THEN round(b3 - (b2 - 100) * 12 / (ln(b2 - 100) + 1), 4) END AS b3, CASE WHEN b2 > 100 THEN round(b4 - (b2 - 100) * 12 / (ln(b2 - 100) + 1), 4) END AS b4 FROM obs")
def cirrus_bands(spark, sf_dir):
    image = model.observations(spark, sf_dir).select("scene", "line", *(F.col(b).cast("double").alias(b) for b in ("b1", "b2", "b3", "b4")))
    got = bands.cirrus_corrected_image(image, ["b1", "b3", "b4"], "b2")
    return got.select("scene", "line", *(F.round(b, 4).alias(b) for b in ("b1", "b3", "b4")))


@query("WITH {base} SELECT pixel, round(sqrt(b3 * b3 + b4 * b4), 6) AS length FROM base")
def band_array_function(spark, sf_dir):
    image = model.baseline(spark, sf_dir).select("pixel", "b3", "b4")
    return bands.apply_array_bands(image, np.hypot, ["b3", "b4"], "length").select("pixel", F.round("length", 6).alias("length"))


@query("""WITH {obs}, v AS (SELECT pixel, b1::DOUBLE AS b1, lag(b1::DOUBLE) OVER (PARTITION BY pixel ORDER BY acquired, scene, line) AS before FROM obs)
 SELECT pixel, round(coalesce(sum(abs(b1 - before)), 0), 6) AS variation FROM v GROUP BY pixel""")
def image_array_function(spark, sf_dir):
    """The total variation of each pixel's series, by a function of the matrix of all its images."""
    order = Window.partitionBy("pixel").orderBy("acquired", "scene", "line")
    images = model.observations(spark, sf_dir).withColumn("k", F.row_number().over(order) - 1)
    most = (images.agg(F.max("k")).first()[0] or 0) + 1
    got = bands.apply_array_images(images, ["pixel"], "k", "b1", lambda m: np.nansum(np.abs(np.diff(m, axis=0)), 0), "variation", most)
    return got.select("pixel", F.round("variation", 6).alias("variation"))
