"""Queries on accuracy assessment, training tables and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.operators import composites, sampling, training
from landtide.plans.registry import query
from landtide.streaming import report as streaming

CLASSES = "{obs}, k AS (SELECT class_code, count(*) AS n, 0.6 + 0.05 * class_code AS accuracy FROM obs WHERE class_code <> 0 GROUP BY class_code), w AS (SELECT *, n / sum(n) OVER () AS weight, sqrt(accuracy * (1 - accuracy)) AS s FROM k)"


def _classes(spark, sf_dir):
    k = composites.class_counts(model.observations(spark, sf_dir))
    return k.withColumn("accuracy", F.lit(0.6).cast("double") + F.lit(0.05).cast("double") * F.col("class_code"))


@query("WITH " + CLASSES + " SELECT round_even(pow(sum(weight * s) / 0.01, 2), 0)::BIGINT AS sample_size FROM w")
def sample_size_simple(spark, sf_dir):
    return sampling.total_size(_classes(spark, sf_dir), 0.01)


@query("WITH " + CLASSES + " SELECT round_even(pow(sum(weight * s), 2) / (0.0001 + sum(weight * s * s) / sum(n)), 0)::BIGINT AS sample_size FROM w")
def sample_size_full(spark, sf_dir):
    return sampling.total_size(_classes(spark, sf_dir), 0.01, "full")


@query("WITH " + CLASSES + " SELECT class_code, n, CASE WHEN class_code <= 2 THEN 100 ELSE round_even((641 - 200) * n / sum(CASE WHEN class_code > 2 THEN n END) OVER (), 0) END::BIGINT AS sample_size FROM k")
def pinned_allocation(spark, sf_dir):
    k = _classes(spark, sf_dir).withColumn("pinned", F.when(F.col("class_code") <= 2, 100))
    return sampling.pinned(k, 641).select("class_code", "n", "sample_size")


@query("WITH " + CLASSES + " SELECT class_code, round_even(600 * n / sum(n) OVER (), 0)::BIGINT AS by_size, round_even(600 / count(*) OVER (), 0)::BIGINT AS equal FROM k")
def proportional_allocation(spark, sf_dir):
    k = _classes(spark, sf_dir)
    one = sampling.allocate(k, 600).select("class_code", F.col("sample_size").alias("by_size"))
    return one.join(sampling.allocate(k, 600, "equal").select("class_code", F.col("sample_size").alias("equal")), "class_code")


@query("WITH RECURSIVE " + CLASSES + """, f AS (SELECT class_code, n, ceil(round(accuracy * (1 - accuracy) / 0.001, 6))::BIGINT AS floor FROM k),
 step(k, class_code, n, floor, pinned) AS (SELECT 0, class_code, n, floor, false FROM f UNION ALL
 SELECT k + 1, class_code, n, floor, pinned OR (1200 - coalesce(sum(CASE WHEN pinned THEN floor END) OVER (), 0)) * n::DOUBLE / sum(CASE WHEN NOT pinned THEN n ELSE 0 END) OVER () < floor FROM step WHERE k < 8)
 SELECT class_code, floor, CASE WHEN pinned THEN floor ELSE round_even((1200 - coalesce(sum(CASE WHEN pinned THEN floor END) OVER (), 0)) * n::DOUBLE / sum(CASE WHEN NOT pinned THEN n END) OVER (), 0) END::BIGINT AS sample_size FROM step WHERE k = 8""")
def variance_allocation(spark, sf_dir):
    """Samples by size with a floor for each class (the SQL pins classes round by round)."""
    return sampling.by_variance(_classes(spark, sf_dir), 1200, 0.001).select("class_code", "floor", "sample_size")


@query("WITH " + CLASSES + " SELECT class_code, round(sqrt(accuracy * (1 - accuracy) / 99), 9) AS user_error, round(sqrt(sum(weight * weight * accuracy * (1 - accuracy) / 99) OVER ()), 9) AS overall_error, round(accuracy * (1 - accuracy) / 0.001, 6) AS least_n FROM w")
def accuracy_se(spark, sf_dir):
    got = sampling.standard_errors(_classes(spark, sf_dir).withColumn("sample_size", F.lit(100)))
    return got.select("class_code", F.round("user_error", 9).alias("user_error"), F.round("overall_error", 9).alias("overall_error"), F.round(sampling.least_n(F.col("accuracy"), 0.001), 6).alias("least_n"))


@query("WITH {base}, r AS (SELECT pixel, class_code, row_number() OVER (PARTITION BY class_code ORDER BY ((pixel + 7) * 2654435761) % 4294967296, pixel) AS k FROM base WHERE class_code <> 0) SELECT pixel, class_code FROM r WHERE k <= 5 + class_code")
def stratified_sample(spark, sf_dir):
    cells = model.baseline(spark, sf_dir).where("class_code <> 0").select("pixel", "class_code")
    sizes = cells.select("class_code").distinct().withColumn("sample_size", 5 + F.col("class_code"))
    return sampling.stratified(cells, sizes, [sampling.arithmetic_hash(F.col("pixel"), 7), "pixel"])


@query("WITH s AS (SELECT label, 'e' || unnest(range(1, len(embedding) + 1)) AS band, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, band, round(min(v), 6) AS \"min\", round(max(v), 6) AS \"max\", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev FROM s GROUP BY label, band")
def class_signatures(spark, sf_dir):
    names = [f"e{k + 1}" for k in range(64)]
    e = model.table(spark, sf_dir, "embeddings").select("label", *(F.col("embedding")[k].alias(n) for k, n in enumerate(names)))
    return training.signatures(e, "label", names).select("label", "band", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "stdev")))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def confusion_matrix(spark, sf_dir):
    return training.confusion(model.table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT quality AS class_code, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER (quality = toxic), 0) AS hits FROM c GROUP BY 1),
 p AS (SELECT toxic AS class_code, sum(n) AS claimed FROM c GROUP BY 1), r AS (SELECT t.class_code, CASE WHEN coalesce(claimed, 0) > 0 THEN hits / claimed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re, support FROM t LEFT JOIN p USING (class_code))
 SELECT class_code, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 9) AS f1, support FROM r""")
def class_report(spark, sf_dir):
    got = training.class_report(model.table(spark, sf_dir, "labels"), "quality", "toxic")
    return got.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY (event_id * 2654435761) % 4294967296, event_id) AS k FROM events), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) SELECT event_id, event_type FROM r, m WHERE k <= 1 * least")
def balance_cap(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").select("event_id", "event_type")
    return training.balanced(e, "event_type", [sampling.arithmetic_hash(F.col("event_id")), "event_id"], times=1)


@query()
def rf_predict(spark, sf_dir):
    """A forest trained on the vectors of three quarters of the ids, by all components, and applied to all of them."""
    names = [f"e{k}" for k in range(64)]
    e = model.table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names)))
    learned = F.crc32(F.col("vec_id").cast("string")) % 4 != 2
    forest = training.forest(e.where(learned), "label", names, trees=10, depth=6)
    return training.classify(e, forest, names).select("vec_id", "label", learned.alias("learned"), "class_code")


# Windows over the event stream; the same functions take a streaming DataFrame.

@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    return _plain(streaming.tumbling(model.table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"]))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type FROM events, range(4) r(k)) SELECT start, start + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding(spark, sf_dir):
    return _plain(streaming.sliding(model.table(spark, sf_dir, "events"), "ts", "1 day", "6 hours", ["event_type"]))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    return _plain(streaming.sessions(model.table(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"]))


def _plain(windows):
    return windows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
