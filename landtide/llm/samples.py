"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(rows: DataFrame, n: int, distinct: int, which: Column | None = None) -> list[str]:
    """The texts of ``n`` distinct 64-bit hashes ``h``, the smallest, from ``rows (h, text)`` where ``which`` holds; of all, if they are fewer.

    A bar on the hash leaves about three times as many before ``which`` is tried
    and anything is shuffled or sent, whatever the number of tasks; copies are one
    row. ``distinct``, about how many hashes there are, only sets the first bar:
    it is raised until the rows suffice or there is none.
    """
    share = min(1.0, 3 * n / max(1, distinct))
    while True:
        low = rows if share == 1.0 else rows.where(F.col("h") < int(-(1 << 63) + share * float(1 << 64)))
        low = low if which is None else low.where(which)
        got = [r["text"] for r in low.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(n).collect()]
        if len(got) == n or share == 1.0:
            return got
        share = min(1.0, 8 * share)
