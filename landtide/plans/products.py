"""Queries over product tables and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.functions import names
from landtide.operators import catalog
from landtide.plans.registry import query
from landtide.sources import listing

L1C, L2A = catalog.L1C, catalog.L2A


def _levels(spark, sf_dir):
    p = model.products(spark, sf_dir)
    return p.where(F.col("level") == L1C), p.where(F.col("level") == L2A)


@query("WITH {products} SELECT uuid, tile, cloud FROM products WHERE cloud BETWEEN 0 AND 100000 AND beginposition BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND tile = 7")
def catalogue_filter(spark, sf_dir):
    return catalog.matching(model.products(spark, sf_dir), 100000, "1996-01-01", "1996-12-31", tile=7).select("uuid", "tile", "cloud")


@query("WITH {products} SELECT uuid FROM products ORDER BY beginposition, uuid LIMIT 100 OFFSET 100")
def catalogue_page(spark, sf_dir):
    return catalog.page(model.products(spark, sf_dir), 100).select("uuid")


@query("WITH {products} SELECT uuid, beginposition FROM products a WHERE level = 'Level-1C' AND NOT EXISTS (SELECT 1 FROM products b WHERE b.level = 'Level-2A' AND b.beginposition = a.beginposition AND b.tile = a.tile)")
def l1c_l2a_anti(spark, sf_dir):
    return catalog.without_counterpart(*_levels(spark, sf_dir), on=("beginposition", "tile")).select("uuid", "beginposition")


@query("WITH {products}, g AS (SELECT tile, orbit, CAST(beginposition AS DATE) AS d FROM products GROUP BY ALL HAVING count(*) FILTER (level = 'Level-1C') = 1 AND count(*) FILTER (level = 'Level-2A') = 1) SELECT p.uuid FROM products p JOIN g ON p.tile = g.tile AND p.orbit = g.orbit AND CAST(p.beginposition AS DATE) = g.d")
def pair_filter_semi(spark, sf_dir):
    return catalog.exact_pairs(model.products(spark, sf_dir).withColumn("d", F.to_date("beginposition")), ["tile", "orbit", "d"]).select("uuid")


@query("""WITH {products}, n AS (SELECT *, lead(beginposition) OVER w AS nb, lead(level) OVER w AS nl, lag(beginposition) OVER w AS pb, lag(level) OVER w AS pl FROM products WINDOW w AS (PARTITION BY tile ORDER BY beginposition, level, uuid))
 SELECT uuid, tile FROM n WHERE NOT (level = 'Level-1C' AND (coalesce(nb = beginposition AND nl = 'Level-2A', false) OR coalesce(pb = beginposition AND pl = 'Level-2A', false)))""")
def adjacent_dedupe(spark, sf_dir):
    return catalog.adjacent_unique(model.products(spark, sf_dir)).select("uuid", "tile")


@query("WITH {products}, r AS (SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY cloud, uuid) AS k FROM products) SELECT uuid, orbit FROM r WHERE k <= 6")
def orbit_topk(spark, sf_dir):
    return catalog.clearest_per_orbit(model.products(spark, sf_dir), 30).select("uuid", "orbit")


@query("WITH {products}, r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY beginposition DESC, uuid DESC) AS k FROM products) SELECT uuid, tile FROM r WHERE k <= 4")
def keep_newest_n(spark, sf_dir):
    return catalog.newest(model.products(spark, sf_dir)).select("uuid", "tile")


@query("WITH {products} SELECT uuid, (SELECT max(b.beginposition) FROM products b WHERE b.tile = a.tile AND b.beginposition < a.beginposition) AS previous FROM products a")
def preceding_image_asof(spark, sf_dir):
    return catalog.preceding(model.products(spark, sf_dir)).select("uuid", "previous")


@query("WITH {products}, n AS (SELECT tile, uuid AS newer, lead(uuid) OVER (PARTITION BY tile ORDER BY beginposition DESC, uuid DESC) AS older FROM products) SELECT * FROM n WHERE older IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return catalog.consecutive(model.products(spark, sf_dir))


@query("WITH {products} SELECT a.tile, a.uuid AS l1c, b.uuid AS l2a, datediff('day', CAST(a.beginposition AS DATE), CAST(b.beginposition AS DATE))::INT AS days_apart FROM products a JOIN products b ON a.tile = b.tile AND a.level = 'Level-1C' AND b.level = 'Level-2A' AND abs(datediff('day', CAST(a.beginposition AS DATE), CAST(b.beginposition AS DATE))) <= 1")
def counterpart_within_day(spark, sf_dir):
    return catalog.counterparts(model.products(spark, sf_dir))


@query("WITH {products}, a AS (SELECT DISTINCT tile, CAST(beginposition AS DATE) AS d FROM products WHERE level = 'Level-1C'), b AS (SELECT DISTINCT tile, CAST(beginposition AS DATE) AS d FROM products WHERE level = 'Level-2A') SELECT coalesce(a.tile, b.tile) AS tile, coalesce(a.d, b.d) AS d, CASE WHEN a.tile IS NULL THEN 'Level-1C' ELSE 'Level-2A' END AS missing FROM a FULL JOIN b ON a.tile = b.tile AND a.d = b.d WHERE a.tile IS NULL OR b.tile IS NULL")
def one_sided_pairs(spark, sf_dir):
    a, b = (x.withColumn("d", F.to_date("beginposition")) for x in _levels(spark, sf_dir))
    return catalog.one_sided(a, b, ["tile", "d"])


@query("WITH {products} SELECT uuid FROM products WHERE uuid NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def download_pending(spark, sf_dir):
    there = model.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uuid"))
    return catalog.pending(model.products(spark, sf_dir), there).select("uuid")


@query("WITH {products} SELECT uuid FROM products WHERE uuid IN (SELECT l_orderkey FROM lineitem)")
def download_present(spark, sf_dir):
    there = model.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uuid"))
    return catalog.present_already(model.products(spark, sf_dir), there).select("uuid")


@query("WITH {products} SELECT uuid, max(k)::INT AS k FROM (SELECT uuid, 0 AS k FROM products WHERE tile < 12 UNION ALL SELECT uuid, 1 FROM products WHERE tile > 8) GROUP BY uuid")
def pages_last_wins(spark, sf_dir):
    p = model.products(spark, sf_dir).select("uuid", "tile")
    pages = p.where("tile < 12").withColumn("k", F.lit(0)).unionByName(p.where("tile > 8").withColumn("k", F.lit(1)))
    return catalog.last_wins(pages, "uuid", "k").select("uuid", "k")


@query("WITH {products} SELECT tile, max(beginposition) AS resume_from FROM products WHERE beginposition < TIMESTAMP '1997-01-01' GROUP BY tile")
def resume_point(spark, sf_dir):
    return catalog.newest_before(model.products(spark, sf_dir), "1997-01-01")


# Names, dates, sizes.

NAMES = "named AS (SELECT o_orderkey AS uuid, 'S2A_MSIL1C_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_N0' || CAST(200 + o_custkey % 300 AS VARCHAR) || '_R' || lpad(CAST(o_custkey % 143 AS VARCHAR), 3, '0') || '_T36NX' || chr(CAST(65 + o_custkey % 26 AS INT)) || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '.SAFE' AS title, o_totalprice, o_orderdate FROM orders)"


def _names(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")
    parts = F.concat(F.lit("S2A_MSIL1C_"), stamp, F.lit("_N0"), (200 + F.col("o_custkey") % 300).cast("string"), F.lit("_R"), F.lpad((F.col("o_custkey") % 143).cast("string"), 3, "0"), F.lit("_T36NX"), F.char(65 + F.col("o_custkey") % 26), F.lit("_"), stamp, F.lit(".SAFE"))
    return o.select(F.col("o_orderkey").alias("uuid"), parts.alias("title"), "o_totalprice", "o_orderdate")


@query("WITH " + NAMES + r""" SELECT uuid, regexp_extract(title, '\d{8}T\d{6}') AS stamp, regexp_extract(title, 'T\d{2}[A-Z]{3}') AS tile, split_part(title, '_', 5) AS orbit, split_part(title, '_', 4) AS baseline, split_part(title, '_', 2) AS kind,
 split_part(title, '_', 6) AS granule, regexp_replace(title, '\.SAFE$', '') AS granule_id, split_part(title, '.', 1) || '.msk' AS mask_path, len(regexp_extract_all(title, '\d{8}T\d{6}'))::INT AS n_stamps, title LIKE '%.tif' AS is_tif FROM named""")
def filename_parse(spark, sf_dir):
    t = F.col("title")
    return _names(spark, sf_dir).select("uuid", names.timestamp_text(t).alias("stamp"), names.tile(t).alias("tile"), names.orbit(t).alias("orbit"), names.baseline(t).alias("baseline"), names.product_type(t).alias("kind"), names.granule(t).alias("granule"), names.granule_id(t).alias("granule_id"), names.mask_path(t).alias("mask_path"), F.size(names.all_timestamps(t)).alias("n_stamps"), names.is_tif(t).alias("is_tif"))


@query("WITH " + NAMES + r""" SELECT uuid, strptime(regexp_extract(title, '\d{8}T\d{6}'), '%Y%m%dT%H%M%S') AS acquired, replace(replace(title, 'MSIL1C', 'MSIL2A'), '_' || split_part(title, '_', 4) || '_', '_N9999_') AS renamed FROM named""")
def acquisition_time(spark, sf_dir):
    t = F.col("title")
    swapped = F.regexp_replace(F.regexp_replace(t, "MSIL1C", "MSIL2A"), r"_N\d{4}_", "_N9999_")
    return _names(spark, sf_dir).select("uuid", names.acquired(t).cast("timestamp_ntz").alias("acquired"), swapped.alias("renamed"))


@query("WITH " + NAMES + r""" SELECT uuid, split_part(title, '_', 1) AS satellite, split_part(title, '_', 3) AS date, split_part(title, '_', 5) AS orbit, split_part(title, '_', 6) AS granule, o_orderdate::TIMESTAMP AS processed,
 strftime(o_orderdate, '%Y-%m-%d') AS day, replace(replace(title, 'MSIL1C', 'MSIL2A'), split_part(title, '_', 4), 'N0500')[: length(title) - 20] || '20240102T030405.SAFE' AS renamed FROM named""")
def product_identifiers(spark, sf_dir):
    t = F.col("title")
    who = names.identifiers(t)
    day = names.iso_date(F.date_format("o_orderdate", "yyyy/MM/dd"))
    renamed = names.corrected_output_name(t, "20240102T030405", "0500")
    return _names(spark, sf_dir).select("uuid", *(who[c].alias(c) for c in ("satellite", "date", "orbit", "granule")), names.processing_time(t).cast("timestamp_ntz").alias("processed"), day.alias("day"), renamed.alias("renamed"))


@query("SELECT o_orderkey AS uuid, strftime(DATE '2000-01-01' + CAST(o_custkey AS INT), '%Y-%m-%d') AS day, 'band' || CAST(1 + o_custkey % 18 AS VARCHAR) AS band, datediff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE))::INT AS number FROM orders")
def serial_date(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("uuid"), names.serial_date(F.col("o_custkey") + 0.4).alias("day"), names.band_name(1 + F.col("o_custkey") % 18).alias("band"), names.day_number(F.col("o_orderdate")).alias("number"))


@query("SELECT o_orderkey AS uuid, round(CASE o_custkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1.0 ELSE 1e-3 END * (o_custkey % 500 + 0.5), 6) AS mb, round(o_orderkey * 1e-6, 2) AS from_bytes FROM orders")
def size_parse(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders")
    unit = F.element_at(F.array(F.lit("GB"), F.lit("MB"), F.lit("KB")), (F.col("o_custkey") % 3 + 1).cast("int"))
    text = F.concat((F.col("o_custkey") % 500).cast("string"), F.lit(".5 "), unit)
    return o.select(F.col("o_orderkey").alias("uuid"), F.round(names.size_mb(text), 6).alias("mb"), names.bytes_to_mb(F.col("o_orderkey")).alias("from_bytes"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return model.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"SELECT page_id, split_part(split_part(url, '?', 1), '/', -1) AS last FROM pages")
def url_segment(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", names.last_segment(F.split_part("url", F.lit("?"), F.lit(1))).alias("last"))


# Listings: documents stand for files, their source for a folder.

FILES = "files AS (SELECT source AS dir, 'f' || CAST(doc_id AS VARCHAR) || '_' || coalesce(lang, '') AS name, n_chars AS bytes, lang AS band, doc_id FROM documents)"


def _files(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("dir"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("_"), F.coalesce("lang", F.lit(""))).alias("name"), F.col("n_chars").alias("bytes"), F.col("lang").alias("band"), "doc_id")


@query("WITH " + FILES + " SELECT dir, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM files GROUP BY dir HAVING sum(bytes) < 120000")
def small_dirs(spark, sf_dir):
    return listing.small_folders(_files(spark, sf_dir), 120000)


@query("WITH " + FILES + """ SELECT dir, CASE WHEN count(*) FILTER (contains(name, 'f1_')) = 1 THEN max(CASE WHEN contains(name, 'f1_') THEN name END) ELSE '' END AS "f1_",
 CASE WHEN count(*) FILTER (contains(name, '_en')) = 1 THEN max(CASE WHEN contains(name, '_en') THEN name END) ELSE '' END AS "_en" FROM files GROUP BY dir""")
def path_pattern_pivot(spark, sf_dir):
    return listing.by_pattern(_files(spark, sf_dir), ["f1_", "_en"])


@query("WITH " + FILES + " SELECT dir || '.SAFE' AS product, CASE WHEN count(DISTINCT band) >= 4 THEN 1 ELSE 0 END::INT AS validity FROM files GROUP BY dir")
def product_validity(spark, sf_dir):
    return listing.validity(_files(spark, sf_dir).withColumn("product", F.concat("dir", F.lit(".SAFE"))), "product", "band", 4)


@query("WITH " + FILES + " SELECT dir, band, arg_min(name, doc_id) AS name FROM files GROUP BY dir, band")
def finest_band(spark, sf_dir):
    return listing.finest_band(_files(spark, sf_dir), "dir", "band", "doc_id")


@query("WITH {products} SELECT DISTINCT tile FROM products ORDER BY tile")
def tile_distinct(spark, sf_dir):
    return model.products(spark, sf_dir).select("tile").distinct().orderBy("tile")


# Sets of scenes.

@query("WITH {products} SELECT uuid, tile FROM products WHERE tile = 1 UNION ALL SELECT uuid, tile FROM products WHERE tile = 2")
def union_tiles(spark, sf_dir):
    p = model.products(spark, sf_dir).select("uuid", "tile")
    return p.where("tile = 1").unionByName(p.where("tile = 2"))


@query("WITH {products} SELECT beginposition FROM products WHERE level = 'Level-1C' INTERSECT SELECT beginposition FROM products WHERE level = 'Level-2A'")
def intersect_scenes(spark, sf_dir):
    a, b = _levels(spark, sf_dir)
    return a.select("beginposition").intersect(b.select("beginposition"))


@query("WITH {products} SELECT uuid FROM products EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1")
def except_processed(spark, sf_dir):
    done = model.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey")
    return model.products(spark, sf_dir).select("uuid").subtract(done)


@query("WITH {products} SELECT tile, level, count(*) AS n, round(sum(cloud), 2) AS cloud FROM products GROUP BY ROLLUP (tile, level)")
def rollup_admin(spark, sf_dir):
    return model.products(spark, sf_dir).rollup("tile", "level").agg(F.count("*").alias("n"), F.round(F.sum("cloud"), 2).alias("cloud"))


@query("WITH {products} SELECT orbit, level, count(*) AS n FROM products GROUP BY CUBE (orbit, level)")
def cube_class(spark, sf_dir):
    return model.products(spark, sf_dir).cube("orbit", "level").agg(F.count("*").alias("n"))
