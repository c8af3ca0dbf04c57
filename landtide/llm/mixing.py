"""Mixing sources to target weights, with DataFrame operations only.

1. Targets: sources in code point order (null last) weigh ``WEIGHTS`` in turn and
   share the words of all documents; a target stops at ``MOST`` times its
   source's size, and the excess is shared again by weight (water filling).
2. Draws: a source's documents are in the order of a digest, which also deals them
   into blocks (its leading digits, as many as the number of shards asks for). Whole passes over the source are taken as
   often as they fit in its target; of one more pass, the leading documents up to
   the number of words that is nearest. The place where that pass ends is found
   digit by digit: sums of blocks first, then of the blocks within one block, so
   no task ever sorts a source.
3. Shards: the block quotas of all sources are split among the output shards by a
   binary tree of multivariate hypergeometric draws: at each node, source after
   source sends as many of its blocks left as the law of the places that remain has it.
   Each source's drawn blocks, in a permuted order, fill its quotas: blocks and
   places of shards are both numbered bucket by bucket and joined by number, so no
   task holds the blocks of a source. Documents are shuffled within their shard.

Everything follows from digests, so reruns agree. Defined results: a null text has
size 0; a source of size 0 has target 0; rows of equal id and text are drawn
together; an empty table gives no rows. Of the input, only the id, text and source
columns are read for the plan; ``mix`` returns its columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from landtide.llm.store import settle

WEIGHTS, MOST = (1, 2, 3), 3
#: Hexadecimal digits of each step towards the end of the last pass, and such steps.
DIGITS, STEPS = 2, 3
#: Words of a shard where the number of shards isn't given; rows that one task numbers, on average.
SHARD_WORDS, BUCKET = 1 << 20, 1 << 16
#: Variance up to which numbers of blocks are drawn by inversion.
EXACT = 1000.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, digest)``: the digest orders the documents of a source."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), digest(id_col, text_col).alias("digest"))


def digest(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target, passes, rest)``, a row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    cap = (most * F.col("source_size")).cast("double")
    ratio = cap / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", share)  # of a weight, were all sources of smaller ratio at their caps
    level = F.max(F.when(F.col("share") <= ratio, F.col("share"))).over(everything)
    per = per.withColumn("target", F.least(cap, level * F.col("weight")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return per.select("source", "source_size", "target", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"))


def _last_pass(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, bound, ...)``: documents with digests below ``bound`` are in the last pass.

    ``bound`` is refined a step of digits at a time; only documents under the one
    block in which a source's pass ends are read on, and they are keyed by source
    and block. The last step orders the few digests that are left.
    """
    edge = goals.where("rest > 0").select("source", F.lit("").alias("bound"), F.lit(0.0).alias("before"), "rest")
    for step in range(1, STEPS + 2):
        last = step > STEPS
        part = F.col("digest") if last else F.substring("digest", 1, DIGITS * step)
        rows = sized.withColumn("bound", F.substring("digest", 1, DIGITS * (step - 1)) if step > 1 else F.lit(""))
        if step > 1:
            rows = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bound") == F.col("e.bound")), "left_semi")
        sums = rows.groupBy("source", "bound", part.alias("block")).agg(F.sum("size").cast("double").alias("size"))
        sums = sums.alias("b").join(edge.alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("b.bound") == F.col("e.bound"))).select("b.source", "b.bound", "block", "size", "before", "rest")
        after = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("block"))
        sums = sums.withColumn("after", after).withColumn("start", F.col("after") - F.col("size"))
        # The first block that the pass doesn't wholly take; at the end, the first digest that would bring it further from its goal.
        ends = F.col("start") + F.col("after") >= 2 * F.col("rest") if last else F.col("after") > F.col("rest")
        at = F.min_by(F.struct("block", "start"), F.when(ends, F.col("block")))
        beyond = F.concat(F.first("bound"), F.lit("g"))  # above every digest of the block: all that is left is taken
        first = sums.groupBy("source").agg(at.alias("at"), beyond.alias("beyond"), F.first("rest").alias("rest"))
        edge = first.select("source", F.coalesce("at.block", "beyond").alias("bound"), F.col("at.start").alias("before"), "rest")
        edge = settle(edge, "mix-edge")
    return edge.select("source", "bound")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hypergeometric(units: Column, places: Column, own: Column, u: Column, z: Column) -> Column:
    """How many of ``own`` of the ``units`` come to ``places`` of them: one draw by the uniform ``u`` or the normal ``z``.

    Up to a variance of ``EXACT`` by inversion: weights follow from each other by their
    ratio, from ten deviations below the mean to ten above it, so neither factorials nor their
    logarithms are needed. Beyond that the law is the normal one, rounded. A draw
    takes as many steps as there are numbers within ten deviations, whatever the number of units.
    """
    n, k, q = (c.cast("double") for c in (units, places, own))
    mean = F.try_divide(q * k, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * F.try_divide(n - k, n) * F.try_divide(n - q, F.greatest(n - 1, F.lit(1.0)))))
    edges = F.struct(F.greatest(F.lit(0.0), q + k - n).alias("low"), F.least(q, k).alias("high"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("sd"), n.alias("n"), k.alias("k"), q.alias("q"), u.alias("u"), z.alias("z"))

    def steps(e: Column) -> Column:
        first = F.greatest(e["low"], F.floor(e["mean"] - 10 * e["sd"] - 20).cast("double"))
        last = F.least(e["high"], F.ceil(e["mean"] + 10 * e["sd"] + 20).cast("double"))
        none = F.array().cast("array<long>")
        return _let(F.struct(first.alias("first"), F.when(last > first, F.sequence(first.cast("long"), last.cast("long") - 1)).otherwise(none).alias("at")), lambda r: inverted(e, r))

    def inverted(e: Column, r: Column) -> Column:
        ratio = lambda x: (e["q"] - x) * (e["k"] - x) / ((x + 1) * (e["n"] - e["q"] - e["k"] + x + 1))
        one = F.lit(1.0)
        total = F.aggregate(r["at"], F.struct(one.alias("w"), one.alias("sum")), lambda s, x: _let(s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))), lambda s: s["sum"])
        # The number of steps before the sum of weights passes the draw.
        seek = lambda bar: F.aggregate(r["at"], F.struct(one.alias("w"), one.alias("sum"), F.lit(0.0).alias("k")), lambda s, x: _let(s["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), (s["k"] + (s["sum"] <= bar).cast("double")).alias("k"))), lambda s: s["k"])
        return r["first"] + _let(e["u"] * total, seek)

    normal = lambda e: F.least(e["high"], F.greatest(e["low"], F.rint(e["mean"] + e["sd"] * e["z"])))
    return _let(edges, lambda e: F.when(e["sd"] * e["sd"] > EXACT, normal(e)).otherwise(steps(e))).cast("long")


def _left(quotas: Column, node: Column, seed: int) -> Column:
    """How many of each source's blocks go left: one multivariate hypergeometric draw, source after source."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)

    def one(state: Column, q: Column) -> Column:
        chance = [_uniform(F.lit(seed), node, F.size(state["out"]), F.lit(k)) for k in range(3)]
        z = F.sqrt(-2 * F.log(1 - chance[1])) * F.cos(chance[2] * 6.283185307179586)
        return _let(hypergeometric(state["units"], state["places"], q, chance[0], z), lambda got: F.struct((state["units"] - q).alias("units"), (state["places"] - got).alias("places"), F.array_append(state["out"], got).alias("out")))

    zero = F.struct(total.alias("units"), F.floor(total / 2).cast("long").alias("places"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(quotas, zero, one, lambda s: s["out"])


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``(source, shard, quota)`` from ``(source, quota)``: exact shares of the quotas for ``2 ** depth`` shards."""
    order = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("source"), F.col("quota").alias("quota"))))
    nodes = quotas.agg(order.alias("all")).select(F.lit(1).alias("node"), F.transform("all", lambda x: x["source"]).alias("sources"), F.transform("all", lambda x: x["quota"].cast("long")).alias("quotas"))
    for _ in range(depth):
        both = nodes.withColumn("left", _left(F.col("quotas"), F.col("node"), seed))
        sides = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        nodes = settle(both.select("sources", F.explode(sides).alias("s")).select("s.node", "sources", "s.quotas"), "mix-tree")
    each = F.arrays_zip(F.col("sources").alias("source"), F.col("quotas").alias("quota"))
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.explode(each).alias("q")).select("q.source", "shard", "q.quota")


def numbered(rows: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``: a number from 1 on within each ``source``, by ``bucket``, then by ``order``; each bucket is numbered on its own."""
    rows = rows.withColumn("__bucket", bucket)
    sizes = rows.groupBy("source", "__bucket").count()
    before = F.sum("count").over(Window.partitionBy("source").orderBy("__bucket")) - F.col("count")
    sizes = sizes.select(F.col("source").alias("__of"), F.col("__bucket").alias("__in"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("source", "__bucket").orderBy(*order))
    joined = rows.withColumn("__own", own).join(sizes, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__in")))
    return joined.withColumn("place", F.col("__own") + F.col("__before")).drop("__bucket", "__own", "__of", "__in", "__before")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int | None = None, seed: int = 1) -> DataFrame:
    """A row for each document: ``(id, source, size, digest, source_size, target, draws)``; ``draws`` has the shard and place of each copy."""
    sized = settle(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    goals = settle(targets(sized), "mix-targets")
    if depth is None:
        words = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        depth = max(0, -(-words // SHARD_WORDS) - 1).bit_length()
    digits = depth // 4 + 2  # sixteen blocks of a source and more for each shard
    ends = _last_pass(sized, goals)
    # Units: a block of a source in a pass. The block in which the last pass ends is drawn in part.
    bound = ends.withColumnRenamed("source", "of")
    per = goals.join(bound, goals["source"].eqNullSafe(bound["of"]), "left").drop("of")
    blocks = sized.groupBy("source", F.substring("digest", 1, digits).alias("block")).count().drop("count").alias("k")
    joined = blocks.join(per.alias("p"), F.col("k.source").eqNullSafe(F.col("p.source"))).select("k.source", "block", "passes", (F.col("rest") > 0).alias("more"), "bound", "source_size", "target")
    extra = F.col("more") & (F.col("bound").isNull() | (F.col("block") <= F.substring("bound", 1, digits)))
    joined = joined.withColumn("units", F.col("passes") + extra.cast("int"))
    joined = settle(joined, "mix-blocks")
    quotas = settle(splitting_tree(joined.groupBy("source").agg(F.sum("units").alias("quota")), depth, seed), "mix-quotas")
    units = joined.where("units > 0").select("source", "block", F.explode(F.sequence(F.lit(1), "units")).alias("pass"))
    many = joined.groupBy("source").agg(F.sum("units").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-many // BUCKET))
    draw = F.xxhash64(F.lit(seed), "source", "block", "pass")
    units = numbered(units, F.pmod(draw, F.lit(buckets)), [draw, F.col("block"), F.col("pass")])
    slots = quotas.where("quota > 0").select("source", "shard", F.explode(F.sequence(F.lit(1), "quota")).alias("k"))
    slots = numbered(slots, F.expr(f"shard * {buckets}L div {1 << depth}L"), [F.col("shard"), F.col("k")]).select(F.col("source").alias("of"), F.col("place").alias("at"), "shard")
    dealt = units.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    dealt = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("shard").cast("int").alias("shard")))).alias("shards"))
    dealt = dealt.select(F.col("source").alias("of"), F.col("block").alias("in"), "shards")
    joined = joined.join(dealt, joined["source"].eqNullSafe(dealt["of"]) & (joined["block"] == dealt["in"]), "left").select(F.col("source").alias("of"), F.col("block").alias("in"), "passes", "bound", "more", "source_size", "target", "shards")
    rows = sized.join(joined, sized["source"].eqNullSafe(joined["of"]) & (F.substring(sized["digest"], 1, digits) == joined["in"]))
    taken = F.coalesce(F.filter("shards", lambda x: (x["pass"] <= F.col("passes")) | F.col("bound").isNull() | (F.col("digest") < F.col("bound"))), F.array().cast("array<struct<pass:int,shard:int>>"))
    draws = F.transform(taken, lambda x: F.struct(x["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("digest"), x["pass"]).alias("place")))
    return rows.select("id", "source", "size", "digest", "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int | None = None, seed: int = 1) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for each copy, shard after shard, shuffled within each."""
    draws = plan(docs, id_col, text_col, source_col, depth, seed).select(F.col("digest").alias("of"), F.col("source").alias("from"), "draws").dropDuplicates(["of", "from"])
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest(id_col, text_col).alias("digest"), F.col(source_col).cast("string").alias("source"))
    copies = keyed.join(draws, (F.col("digest") == F.col("of")) & F.col("source").eqNullSafe(F.col("from"))).select("row", F.explode("draws").alias("d"))
    return copies.repartition("d.shard").sortWithinPartitions("d.shard", "d.place").select("row.*")
