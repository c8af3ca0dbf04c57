"""URL filters: host and path rules, and a ratio of character language models.

Rules name a host (and all its subdomains) and the start of a path; the longest
that fits decides. Two variable-order Markov models of characters, of accepted and
of rejected URLs, judge the rest: each character's probability is interpolated
over contexts of 0 to ``ORDER`` characters with Witten-Bell weights, and the
difference of the log-likelihoods a character is held against a bar. The models
read all that follows ``://``, the host in lower case. They and the bar are fitted
on every URL that rules decide, each in its full length: the rejected and three
quarters of the accepted ones are counted, the bar is set on the other quarter so
that at most ``LOST`` of it fall. Judged are whole URLs.

A character in its context is a gram, a number of 54 bits. Grams of all URLs are
counted in one aggregation; shorter contexts are sums of longer ones, so each order
is an aggregation, a window over contexts and a join with the order below. URLs meet
their grams in a join. No model is held by the driver or a task, sums are of whole
numbers (logarithms in units of 2^-24), so results do not follow the partitions.

Defined results: a null URL and one without ``://`` have an empty host and path; an
empty host is allowed, as is everything where one of the models has nothing to
learn from; equal addresses are learnt from once; repeated rows and ids are judged
row by row; an empty table has no rows; other columns are not read. Addresses are
told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.store import drop, settle

#: Longest context, share of held accepted URLs that may fall, and the unit of scores when the bar is set.
ORDER, LOST, STEP = 5, 0.01, 1e-4
ALLOW, BLOCK = "allow", "block"
_END, _UNIT = 257, 1 << 24


class Rule(NamedTuple):
    verdict: str
    text: str  # host and path, like "net/" or "example.com/en/7"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("1"))
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.when(rest.isNotNull(), F.translate(found[0], upper, lower)).otherwise(""), F.when(rest.isNotNull(), found[1]).otherwise(""))


def address(url: Column) -> Column:
    """Host, with A-Z in lower case, and all that follows it."""
    return F.concat(parts(url)[0], F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1))


def fitting(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits, or null; among equals the first."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    hit = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    return F.coalesce(*(F.when(hit(r), F.lit(r.text)) for r in ordered)) if ordered else F.lit(None).cast("string")


class Markov:
    """Interpolated character model over contexts of up to ``order`` bytes of a few URLs in memory: what ``ratios`` makes of tables."""

    def __init__(self, urls: Sequence[bytes], order: int = ORDER) -> None:
        self.order = order
        self.tables = []
        for k in range(order + 1):
            both = _keys(urls, k)
            context = both >> 9
            keys, first, counts = np.unique(both, return_index=True, return_counts=True)
            contexts, total = np.unique(context, return_counts=True)
            kinds = np.bincount(np.searchsorted(contexts, context[first]), minlength=len(contexts))
            self.tables.append((keys, counts.astype(float), contexts, total.astype(float), kinds.astype(float)))

    def score(self, urls: Sequence[bytes]) -> np.ndarray:
        """Natural log-likelihood of each URL and its end."""
        lens = np.array([len(u) + 1 for u in urls])
        p = np.full(int(lens.sum()), 1 / 257)
        for k, (keys, counts, contexts, total, kinds) in enumerate(self.tables):
            if not len(keys):
                continue
            both = _keys(urls, k)
            context = both >> 9
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            to = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
            count = np.where(keys[to] == both, counts[to], 0)
            p = np.where(known, (count + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.add.reduceat(np.log(p), np.cumsum(lens) - lens) if len(lens) else np.zeros(0)


def _keys(urls: Sequence[bytes], order: int) -> np.ndarray:
    return _grams(np.frombuffer(b"".join(urls), np.uint8), np.cumsum([0, *map(len, urls)]), order)


def _grams(buf: np.ndarray, texts: np.ndarray, order: int) -> np.ndarray:
    """For every byte and end: a number for it and the ``order`` bytes before it, 9 bits each, zero before the first."""
    lens = np.diff(texts) + 1
    ends = np.cumsum(lens) - 1
    codes = np.full(int(lens.sum()), _END, np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = buf.astype(np.int64) + 1
    within = np.arange(len(codes)) - np.repeat(ends - lens + 1, lens)
    grams = codes.copy()
    for k in range(1, order + 1):
        grams[k:] |= np.where(within[k:] >= k, codes[:-k], 0) << 9 * k
    return grams


def _parts(column: pa.Array, order: int, limit: int = W.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and grams of all bytes and ends, about ``limit`` at a time; longer texts come in parts."""
    for lo, hi, buf, texts in W.slices(column, limit):
        if len(buf) <= limit:
            yield lo + np.repeat(np.arange(hi - lo), np.diff(texts) + 1), _grams(buf, texts, order)
            continue
        for at in range(0, len(buf), limit):
            piece, before = buf[max(0, at - order) : at + limit], min(at, order)
            grams = _grams(piece, np.array([0, len(piece)]), order)[before : None if at + limit >= len(buf) else -1]
            yield np.full(len(grams), lo), grams


def counted(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, accepted, rejected)`` of ``texts (address, accepted, rejected)``: how often each gram stands where these flags hold, perhaps nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = [np.array(b.column(k).to_pylist(), bool) for k in (1, 2)]
            for row, grams in _parts(b.column(0), order):
                keys, at = np.unique(grams, return_inverse=True)
                sums = [np.bincount(at, f[row], len(keys)).astype(np.int64) for f in flags]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums)], ["gram", "accepted", "rejected"])

    grams = texts.select("address", "accepted", "rejected").mapInArrow(run, "gram long, accepted long, rejected long")
    return grams.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected")))


def ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, ratio)``: how much likelier the last character of each gram is under the rejected model, in natural logarithms of 2^-24."""
    kinds = ("accepted", "rejected")
    levels = [grams]
    for k in range(order, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 9 * k) - 1))
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(*(F.sum(c).alias(c) for c in kinds)))
    known = None
    for k, level in enumerate(reversed(levels)):
        same = Window.partitionBy(F.shiftright("gram", 9))
        seen = (f(c) for c in kinds for f in (lambda c: F.sum(c).over(same).alias(f"{c}_all"), lambda c: F.count(F.when(F.col(c) > 0, 1)).over(same).alias(f"{c}_kinds")))
        level = level.select("*", F.col("gram").bitwiseAND(F.lit((1 << 9 * k) - 1)).alias("below"), *seen)
        level = level.join(known, "below") if known is not None else level.select("*", *(F.lit(1 / 257).alias(f"{c}_p") for c in kinds))
        p = {c: F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")) for c in kinds}
        known = level.select(F.col("gram").alias("below"), *(p[c].alias(f"{c}_p") for c in kinds))
    ratio = (F.log("rejected_p") - F.log("accepted_p")) * _UNIT
    return known.select(F.col("below").alias("gram"), F.round(ratio).cast("long").alias("ratio"))


def scored(texts: DataFrame, ratio: DataFrame, order: int = ORDER) -> DataFrame:
    """``(h1, h2, held, score)`` of ``texts (h1, h2, held, address)``: the mean ratio of a character and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, grams in _parts(b.column(3), order):
                by = np.lexsort((grams, row))
                row, grams = row[by], grams[by]
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]))))
                own = [b.column(k).take(pa.array(row[first])) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grams[first]), pa.array(np.diff(np.append(first, len(row))))], ["h1", "h2", "held", "gram", "n"])

    each = texts.select("h1", "h2", "held", "address").mapInArrow(run, "h1 long, h2 long, held boolean, gram long, n long")
    sums = each.join(ratio, "gram").groupBy("h1", "h2", "held").agg(F.sum(F.col("ratio") * F.col("n")).alias("sum"), F.sum("n").alias("n"))
    return sums.select("h1", "h2", "held", (F.col("sum") / F.lit(float(_UNIT)) / F.col("n")).alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", order: int = ORDER, lost: float = LOST) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row of ``pages``; the score is null where a rule decides."""
    verdicts = {r.text: r.verdict for r in rules}
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("address"))
    rows = rows.withColumn("rule", fitting(F.col("host"), F.col("path"), rules))
    known = F.create_map(*(F.lit(x) for kv in verdicts.items() for x in kv))[F.col("rule")] if verdicts else F.lit(None).cast("string")
    rows = rows.withColumns({"verdict": known, "h1": F.xxhash64("address"), "h2": F.xxhash64(F.lit(1), "address")})
    free = F.col("rule").isNull() & (F.col("address") != "")

    urls = settle(rows.where(F.col("rule").isNotNull() | free).select("address", "verdict", "h1", "h2").distinct(), "urls")
    allowed, quarter = F.col("verdict").eqNullSafe(ALLOW), F.col("h1").bitwiseAND(F.lit(3)) == 0
    seen = urls.agg(F.count(F.when(allowed & ~quarter, 1)), F.count(F.when(allowed, 1)), F.count(F.when(F.col("verdict") == BLOCK, 1))).first()
    texts = urls.withColumn("accepted", allowed & ~quarter if seen[0] else allowed).withColumn("rejected", F.col("verdict").eqNullSafe(BLOCK))
    texts = texts.withColumn("held", allowed & quarter).where(F.lit(bool(seen[1] and seen[2])))
    grams = settle(counted(texts, order), "grams")
    scores = settle(scored(texts.where(F.col("verdict").isNull() | F.col("held")), ratios(grams, order), order), "scores")
    drop(urls, grams)
    # The least step that at most this share of the held ones is above; there are few steps, so one row counts them.
    step = F.ceil(F.col("score") / STEP)
    bar = scores.where("held").agg(F.expr(f"percentile_disc({1 - lost}) within group (order by ceil(score / {STEP}D))").alias("bar")).first()["bar"]

    judged = rows.where(free).join(scores.where("not held").select("h1", "h2", "score"), ["h1", "h2"], "left")
    judged = judged.withColumn("verdict", F.when(step > max(0, int(bar or 0)), BLOCK).otherwise(ALLOW))
    others = rows.where(~free).withColumn("verdict", F.coalesce("verdict", F.lit(ALLOW))).withColumn("score", F.lit(None).cast("double"))
    return judged.unionByName(others).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")


def keep(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed: ids need be neither unique nor there."""
    urls = pages.select(F.col(url_col).alias("own"), F.col(url_col).alias("url")).distinct()
    blocked = judge(urls, rules, "own", "url").where(F.col("verdict") == BLOCK).select("own")
    return pages.join(blocked, pages[url_col] == blocked["own"], "left_anti")
