"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a product code: a random rotation, two halves, ``codes``
random unit vectors for each half; a direction is a pair of them. A vector's score
in a direction is the sum of its halves' inner products, so the ``filters`` best
directions are list-decoded from the best few of each half. Vectors that share a
filter are compared in double precision, blocks of a filter's members at a time.
How many filters a vector has follows from how many vectors there are: as many as
pairs made up at the cosine itself need to share one with a chance of ``RECALL``.

Equal vectors are one row with a multiplicity. A pair is counted in the first of
the filters that both members have, found by a product of membership matrices, so
links are summed without listing pairs. For components a block emits at most one
edge a vector. Filters above ``CELL`` members are cut into chunks and every two
chunks meet in a cell of their own.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components have no links and are their own component, as have vectors of another
dimension than all others; repeated rows of equal ids count as rows; rows without
an id link like any other but never name a component, and one of such rows alone
has no name; vectors are equal if two 64-bit hashes of them are; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm.graph import components
from landtide.llm.store import settle

COSINE, RECALL = 0.95, 0.99
#: Filters of a vector at least, members of a filter on average, members compared in one piece.
LEAST, MEMBERS, CELL = 10, 128, 512
SEED = 5


def codes_for(total: int, filters: int) -> int:
    """Codes of a half such that filters have ``MEMBERS`` members on average."""
    return max(8, int(np.ceil((total * filters / MEMBERS) ** 0.5)))


def filters_for(dim: int, total: int, cosine: float = COSINE, recall: float = RECALL, pairs: int = 1024) -> int:
    """The filters that a vector needs, by trial on made-up pairs of vectors at ``cosine``."""
    rng = np.random.default_rng(SEED)
    one, two = rng.normal(size=(2, pairs, dim))
    one = _unit(one)
    two -= (one * two).sum(1, keepdims=True) * one
    size = np.linalg.norm(two, axis=1, keepdims=True)
    two = cosine * one + (1 - cosine**2) ** 0.5 * two / np.where(size > 1e-9, size, 1.0)
    filters = LEAST
    while True:
        codes = codes_for(total, filters)
        parts = directions(dim, codes)
        step = max(16, (1 << 22) // codes)
        met = 0
        for lo in range(0, pairs, step):
            a, b = decode(one[lo : lo + step], parts, filters), decode(two[lo : lo + step], parts, filters)
            met += int((a[:, :, None] == b[:, None]).any((1, 2)).sum())
        if met >= recall * pairs or filters >= codes * codes:
            return filters
        filters = -(-filters * 6 // 5)


def directions(dim: int, codes: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the unit vectors of both halves."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    one, two = rng.normal(size=(codes, dim // 2)), rng.normal(size=(codes, dim - dim // 2))
    return turn, one / np.maximum(np.linalg.norm(one, axis=1, keepdims=True), 1e-300), two / np.maximum(np.linalg.norm(two, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row, best first, and where they are."""
    at = np.argpartition(scores, -k, 1)[:, -k:] if k < scores.shape[1] else np.repeat(np.arange(k)[None], len(scores), 0)
    top = np.take_along_axis(scores, at, 1)
    order = np.argsort(-top, 1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(at, order, 1)


def decode(x: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray], filters: int) -> np.ndarray:
    """The ``filters`` directions of the best scores of each unit vector, in rising order; all, if there are fewer.

    The sum of the i-th best of one half and the j-th best of the other has i * j - 1
    sums that are no worse, so pairs of ranks beyond ``filters`` need not be looked at.
    """
    turn, one, two = parts
    y = (x @ turn).astype(np.float32)
    filters = min(filters, len(one) * len(two))
    low, at_a = _best(y[:, : one.shape[1]] @ one.T.astype(np.float32), min(filters, len(one)))
    high, at_b = _best(y[:, one.shape[1] :] @ two.T.astype(np.float32), min(filters, len(two)))
    i, j = np.nonzero(np.outer(np.arange(1, low.shape[1] + 1), np.arange(1, high.shape[1] + 1)) <= filters)
    _, at = _best(low[:, i] + high[:, j], filters)
    return np.sort(np.take_along_axis(at_a, i[at], 1) * len(two) + np.take_along_axis(at_b, j[at], 1), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _block(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each member that this cell is first to see, and edges that keep linked members connected."""
    node = table.column("node").to_numpy()
    mult = table.column("mult").to_numpy()
    side = table.column("side").to_numpy()
    lists = table.column("earlier").combine_chunks()
    x = _unit(_matrix(table.column("vector").combine_chunks()))
    n = len(node)
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten().to_numpy()
    distinct, inverse = np.unique(values, return_inverse=True)
    has = np.zeros((n, max(1, len(distinct))), np.float32)
    has[owner, inverse] = 1
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if table.column("across")[0].as_py():  # two chunks: only pairs across them
        near &= side[:, None] != side[None]
    rows = np.flatnonzero(near.any(1))
    near = near[np.ix_(rows, rows)]
    count = (near & (has[rows] @ has[rows].T == 0)) @ mult[rows]
    root = np.arange(len(rows))
    while len(rows):  # the smallest member that near pairs lead to
        least = np.minimum(root, np.where(near, root[None], n).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    some, linked = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(rows)))
    return node[rows[some]], count[some], node[rows[linked]], node[rows[root[linked]]]


def links(reps: DataFrame, dim: int, total: int, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """From ``reps (node, mult, vector)``: rows ``(node, n, other)``, either ``n`` more links of a node or an edge to ``other``."""
    filters = filters_for(dim, total, cosine)
    codes = codes_for(total, filters)
    kind = reps.schema["vector"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, step = directions(dim, codes), max(16, (1 << 22) // codes)
        for b in batches:
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                found = decode(_unit(_matrix(s.column(2))), parts, filters)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*s.columns, lists], ["node", "mult", "vector", "filters"])

    listed_rows = settle(reps.mapInArrow(listed, f"node long, mult long, vector {kind}, filters array<long>"), "caps-filters")
    # The count of a filter's members needs the filters alone; what is over the limit is written, so Spark knows its size.
    large = listed_rows.select(F.explode("filters").alias("filter")).groupBy("filter").count().where(F.col("count") > cell)
    large = settle(large.select("filter", F.ceil(F.col("count") / cell).cast("int").alias("chunks")), "caps-large")
    each = listed_rows.select("node", "mult", "vector", "filters", F.posexplode("filters").alias("k", "filter"))
    each = each.select("node", "mult", "vector", F.slice("filters", 1, F.col("k")).alias("earlier"), "filter").join(large, "filter", "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    split = each.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    # A chunk also meets itself; cells of two chunks hold only pairs across them.
    split = split.withColumn("cell", F.xxhash64("filter", F.least("side", "other"), F.greatest("side", "other")))
    cells = split.select("cell", "side", (F.col("side") != F.col("other")).alias("across"), "node", "mult", "vector", "earlier")

    def run(table: pa.Table) -> pa.Table:
        a, n, u, v = _block(table, cosine)
        none = pa.nulls(len(a), pa.int64())
        return pa.table({"node": np.concatenate([a, u]), "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(u), pa.int64())]), "other": pa.concat_arrays([none, pa.array(v, pa.int64())])})

    return cells.groupBy("cell").applyInArrow(run, "node long, n long, other long")


def groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(id, n_links, component_id)`` for every row of ``vectors``."""
    # Single-precision input stays so until it is compared, in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    key = F.struct(F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(SEED), "vector").alias("k2"))
    rows = settle(rows.select("id", F.when(sound, F.col("vector")).alias("vector"), F.when(sound, key).alias("key")), "caps-rows")
    shape = rows.where("key is not null").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()
    reps = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("vector").alias("vector"))
    reps = settle(reps.withColumn("node", F.monotonically_increasing_id()), "caps-reps")
    found = None
    for r in shape:  # one pass for each dimension in the table
        part = links(reps.where(F.size("vector") == r["dim"]).select("node", "mult", "vector"), r["dim"], r["count"], cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = settle(found, "caps-found")
    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "caps-links")
    # A component is named by the smallest id of its rows; those without an id have no say in it.
    linked = settle(linked.join(reps.select("node", "least"), "node"), "caps-linked")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    names = linked.join(names, "component").select("node", "name")
    of = reps.select("key", "node", "mult", "least").join(counts, "node", "left").join(names, "node", "left")
    of = of.select(F.col("key").alias("of"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component"))
    out = rows.select("id", "key").join(of, F.col("key") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
