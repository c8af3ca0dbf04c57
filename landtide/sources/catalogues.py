"""Catalogue responses as product tables: JSON pages, Atom entries, tables of a job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landtide.functions import names

#: Fields that are read of a JSON page.
PAGE = "struct<features:array<struct<id:string,properties:struct<title:string,startDate:string,status:string,relativeOrbitNumber:int,cloudCover:double,processingLevel:string,services:struct<download:struct<size:bigint,url:string>>>>>>"
ENTRY = "title string, id string, beginposition string, cloudcoverpercentage double, processinglevel string, size string"


def from_json_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """``(title, size, beginposition, relativeorbitnumber, cloudcoverpercentage, processinglevel, uuid, status)``; sizes in megabytes, a row a product."""
    f = pages.select(F.explode(F.from_json(text, PAGE)["features"]).alias("f")).select("f.id", "f.properties.*")
    return f.select(
        "title", names.bytes_to_mb(F.col("services.download.size")).alias("size"), F.try_to_timestamp("startDate").alias("beginposition"), F.col("relativeOrbitNumber").alias("relativeorbitnumber"),
        F.col("cloudCover").alias("cloudcoverpercentage"), F.col("processingLevel").alias("processinglevel"), F.coalesce(names.last_segment(F.col("services.download.url")), "id").alias("uuid"), "status",
    )


def from_atom(pages: DataFrame, text: str = "text") -> DataFrame:
    """Products of Atom feeds: named elements of each entry; the title becomes that of a folder."""
    each = pages.select(F.explode(F.split(F.col(text), "<entry>")).alias("e")).where(F.contains("e", F.lit("</entry>")))
    named = lambda n: F.regexp_extract("e", rf'<\w+ name="{n}">([^<]*)<', 1)
    return each.select(
        F.concat(named("identifier"), F.lit(".SAFE")).alias("title"), F.regexp_extract("e", "<id>([^<]*)</id>", 1).alias("uuid"), F.try_to_timestamp(named("beginposition")).alias("beginposition"),
        F.expr("try_cast(regexp_extract(e, '<double name=\"cloudcoverpercentage\">([^<]*)<', 1) AS double)").alias("cloudcoverpercentage"), named("processinglevel").alias("processinglevel"), names.size_mb(named("size")).alias("size"),
    )


def known_sizes(products: DataFrame, least_mb: float) -> DataFrame:
    """Products whose size is known and not below the least."""
    return products.where(F.col("size").isNotNull() & (F.col("size") >= least_mb))


def request(max_cloud: int, start: str, end: str, tile: str | None = None, area_wkt: str | None = None, rows: int = 100) -> dict[str, str]:
    """Parameters of a catalogue request; an area wins over a tile."""
    out = {"cloudCover": f"[0,{max_cloud}]", "startDate": start, "completionDate": end, "maxRecords": str(rows)}
    return out | ({"geometry": area_wkt} if area_wkt else {"tileId": tile} if tile else {})


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a queue listing: words between blanks under a header, with a ruled line below it."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.regexp_like(F.trim("value"), F.lit(r"^[-\s]+$")))
    words = F.split(F.trim("value"), r"\s+")
    return lines.where(~F.startswith(F.trim("value"), F.lit("Job"))).select(words[0].alias("job"), words[1].alias("name"), words[2].alias("user"), words[3].alias("time"), words[4].alias("state"), words[5].alias("queue"))


def runs_by_stage(log: DataFrame, run: str, stage: str, stages: list[str]) -> DataFrame:
    """Counts of each stage's files in each run, side by side."""
    return log.groupBy(run).pivot(stage, stages).count().fillna(0)
