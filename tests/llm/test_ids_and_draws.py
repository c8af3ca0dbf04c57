"""Ids of any type, columns of any name, and the law of the splitting tree."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landtide.llm import capfilters, mixing, simhash

NAMES = ("__h", "id", "node", "h", "fp", "row", "keys", "__keep", "__of")


@pytest.fixture(scope="module")
def texts(spark):
    words = [f"word{k}" for k in range(60)]
    rows = [(f"doc-{k:02}", " ".join(words[k % 3 :])) for k in range(9)] + [("other", "nothing like it at all but some words of its own"), (None, "no id"), ("other", None)]
    return spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(5) for c in NAMES})


def test_groups_of_text_ids(texts):
    rows = simhash.groups(texts).collect()
    assert len(rows) == texts.count()
    name = {r["id"]: r["component_id"] for r in rows if r["id"] and r["id"].startswith("doc")}
    assert name["doc-00"] == "doc-00" and set(name.values()) <= set(name)


def test_kept_rows_of_text_ids_and_clashing_columns(texts):
    kept = simhash.keep_first(texts)
    assert kept.columns == texts.columns and kept.schema["doc_id"].dataType.simpleString() == "string"
    rows = kept.collect()
    assert sorted((r["doc_id"] or "", r["text"] or "") for r in rows if not (r["doc_id"] or "").startswith("doc")) == sorted([("other", "nothing like it at all but some words of its own"), ("", "no id"), ("other", "")])
    assert [r["doc_id"] for r in rows if (r["doc_id"] or "").startswith("doc")] == ["doc-00"] and all(r[c] == 5 for r in rows for c in NAMES)


def test_vectors_of_text_ids(spark):
    rows = [("b", [1.0, 0.0, 0.1]), ("a", [1.0, 0.0, 0.1]), ("c", [0.0, 1.0, 0.0]), ("d", None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capfilters.groups(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()}
    assert got == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c"), "d": (0, "d")}


@pytest.mark.parametrize(("units", "places", "own"), [(10, 5, 4), (60, 30, 37), (900, 450, 300), (7, 3, 7), (5, 0, 3), (4, 4, 2)])
def test_draws_follow_the_law(spark, units, places, own):
    n = 6000
    u = [mixing._uniform(F.col("id"), F.lit(k)) for k in range(3)]
    z = F.sqrt(-2 * F.log(1 - u[1])) * F.cos(u[2] * 2 * math.pi)
    drawn = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(units), F.lit(places), F.lit(own), u[0], z)).collect())
    law = {k: n * math.comb(places, k) * math.comb(units - places, own - k) / math.comb(units, own) for k in range(max(0, own + places - units), min(own, places) + 1)}
    assert set(drawn) <= set(law)
    usual = {k: v for k, v in law.items() if v > 5}
    assert sum((drawn[k] - v) ** 2 / v for k, v in usual.items()) < len(usual) + 6 * (2 * len(usual)) ** 0.5


def test_large_draws_are_normal_and_within_bounds(spark):
    u = [mixing._uniform(F.col("id"), F.lit(k)) for k in range(3)]
    z = F.sqrt(-2 * F.log(1 - u[1])) * F.cos(u[2] * 2 * math.pi)
    units, places, own = 10**10, 5 * 10**9, 3 * 10**9
    mean, sd = spark.range(4000).select(mixing.hypergeometric(F.lit(units), F.lit(places), F.lit(own), u[0], z).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    law = (own * 0.25 * (units - own) / (units - 1)) ** 0.5
    assert abs(mean - own / 2) < 4 * law / 4000**0.5 and abs(sd / law - 1) < 0.06


def test_tree_of_ten_billion_blocks(spark):
    given = {"a": 10**10, "b": 3 * 10**9, None: 5, "c": 0, "d": 10**6}
    rows = mixing.splitting_tree(spark.createDataFrame(list(given.items()), "source string, quota long"), 5, 1).collect()
    assert {s: sum(r["quota"] for r in rows if r["source"] == s) for s in given} == given
    per = Counter()
    for r in rows:
        assert r["quota"] >= 0
        per[r["shard"]] += r["quota"]
    assert len(per) == 32 and max(per.values()) - min(per.values()) <= 1
