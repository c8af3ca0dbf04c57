"""Product names, dates, sizes and documents as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_text(name: Column) -> Column:
    """The first ``yyyymmddThhmmss`` of a name; empty without one."""
    return F.regexp_extract(name, r"\d{8}T\d{6}", 0)


def acquired(name: Column) -> Column:
    return F.try_to_timestamp(timestamp_text(name), F.lit("yyyyMMdd'T'HHmmss"))


def all_timestamps(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"\d{8}T\d{6}"), F.lit(0))


def all_dates(name: Column) -> Column:
    return F.array_sort(F.transform(all_timestamps(name), lambda x: F.try_to_timestamp(x, F.lit("yyyyMMdd'T'HHmmss"))))


def run_stamp(name: Column) -> Column:
    """The first 14 digits."""
    return F.regexp_extract(name, r"\d{14}", 0)


def landsat_band(name: Column) -> Column:
    """The number of the band that a file of a Landsat scene holds (``..._B4.TIF``); null without one."""
    return F.regexp_extract(name, r"_B(\d{1,2})\.(?i:tiff?)$", 1).try_cast("int")


def landsat_scene(name: Column) -> Column:
    """The part of such a name before its band."""
    return F.regexp_extract(name, r"^(.*)_B\d{1,2}\.(?i:tiff?)$", 1)


def tile(name: Column) -> Column:
    return F.regexp_extract(name, r"T\d{2}[A-Z]{3}", 0)


def component(name: Column, k: int) -> Column:
    """The ``k``-th part between underscores, from 0; null beyond the last."""
    return F.get(F.split(name, "_"), F.lit(k))


def product_type(name: Column) -> Column:
    return component(name, 1)


def baseline(name: Column) -> Column:
    return component(name, 3)


def orbit(name: Column) -> Column:
    return component(name, 4)


def granule(name: Column) -> Column:
    return component(name, 5)


def processing_time(name: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(component(name, 6), r"\d{8}T\d{6}", 0), F.lit("yyyyMMdd'T'HHmmss"))


def identifiers(name: Column) -> Column:
    """Satellite, date, orbit and granule."""
    return F.struct(component(name, 0).alias("satellite"), component(name, 2).alias("date"), orbit(name).alias("orbit"), granule(name).alias("granule"))


def granule_id(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.SAFE$", "")


def mask_path(path: Column) -> Column:
    return F.concat(F.split_part(path, F.lit("."), F.lit(1)), F.lit(".msk"))


def is_tif(path: Column) -> Column:
    return F.endswith(path, F.lit(".tif"))


def band_name(number: Column) -> Column:
    return F.when(number.between(1, 18), F.concat(F.lit("band"), number.cast("string")))


def serial_date(days: Column, epoch: str = "2000-01-01") -> Column:
    """``yyyy-mm-dd`` of a number of days, its fraction dropped."""
    return F.date_format(F.date_add(F.lit(epoch).cast("date"), F.floor(days).cast("int")), "yyyy-MM-dd")


def day_number(at: Column, epoch: str = "2000-01-01") -> Column:
    """Whole days since the epoch."""
    return F.datediff(at, F.lit(epoch).cast("date"))


def iso_date(text: Column) -> Column:
    """``yyyy?mm?dd`` with any separators as an ISO instant; null if it isn't one."""
    found = F.regexp_extract(text, r"^(\d{4})\D?(\d{2})\D?(\d{2})$", 1), F.regexp_extract(text, r"^(\d{4})\D?(\d{2})\D?(\d{2})$", 2), F.regexp_extract(text, r"^(\d{4})\D?(\d{2})\D?(\d{2})$", 3)
    return F.when(found[0] != "", F.concat_ws("-", *found)).cast("string")


def required_date(text: Column) -> Column:
    """``iso_date``, which ends the job for a text that is no date; null stays null."""
    got = iso_date(text)
    return F.when(text.isNotNull() & got.isNull(), F.raise_error(F.concat(F.lit("not a date: "), text))).otherwise(got)


def run_id(area: Column, started: Column, salt: Column) -> Column:
    """Area, time of the start and eight digits that tell runs of one second apart."""
    return F.concat_ws("_", area, F.date_format(started, "yyyyMMdd'T'HHmmss"), F.lower(F.substring(F.sha2(F.concat_ws("/", area, salt.cast("string")), 256), 1, 8)))


def size_mb(text: Column) -> Column:
    """Megabytes of texts like ``1.2 GB``."""
    number, unit = F.try_to_number(F.split_part(text, F.lit(" "), F.lit(1)), F.lit("999999999D999999999")).cast("double"), F.split_part(text, F.lit(" "), F.lit(2))
    return number * F.when(unit == "GB", 1e3).when(unit == "MB", 1.0).when(unit == "KB", 1e-3)


def bytes_to_mb(n: Column) -> Column:
    return F.round(n * 1e-6, 2)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def corrected_output_name(name: Column, stamp: str, version: str) -> Column:
    """The name of a level 2A product made from a level 1C one: level, version and run time replaced."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "MSIL1C", "MSIL2A"), r"_N\d{4}_", f"_N{version}_"), r"_\d{8}T\d{6}(\.SAFE)?$", f"_{stamp}$1")
