"""Clustering around centroids with Yinyang bounds, exact in whole numbers.

Vectors are scaled to whole numbers once. Centroids are put into a few groups once,
by a small clustering of their own. Each vector keeps an upper bound of the distance
to its centroid and one lower bound for each group, of the distance to the group's
other centroids. When centroids have moved, bounds move by as much. A vector whose
upper bound is under all lower ones is done; else its upper bound is made
exact; then only the centroids of groups with a lower bound not above it are
scanned, by exact squared distances. Bounds prune with a margin for rounding, so
ties are always decided by exact distances, for the smaller number.

A round is one pass over the vectors with their bounds, written to the shared folder
(the round before is deleted), and one aggregation: the sums of clusters change by
the vectors that moved alone. The driver has the centroids and nothing of the
number of vectors.

Defined results: vectors that are null, of another length, with null or non-finite
components, or with one of 2^27 or more when scaled (distances would not fit) are
left out; a row without an id is clustered, but starts no centroid; rows of equal
ids count as rows; fewer vectors than centroids give as many centroids as vectors;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm.store import drop, settle

DIM, SCALE, CENTRES, ROUNDS = 64, 256, 40, 5
#: Centroids of a group on average; rows compared at a time; share of a distance by which bounds are held apart.
GROUP, SLICE, MARGIN = 10, 4096, 1e-9
LARGEST = 1 << 27


class Model(NamedTuple):
    """Centroids, the numbers of each group's centroids, and how far each centroid and each group's farthest has moved."""

    centres: np.ndarray
    groups: list[np.ndarray]
    moved: np.ndarray
    most: np.ndarray


def grouped(centres: np.ndarray, group: int = GROUP, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids in each of about ``len(centres) / group`` groups of near ones."""
    points = centres.astype(np.float64)
    seeds = points[:: max(1, group)][: max(1, len(points) // group)]
    for _ in range(rounds):
        near = ((points[:, None] - seeds[None]) ** 2).sum(2).argmin(1)
        seeds = np.array([points[near == g].mean(0) if (near == g).any() else seeds[g] for g in range(len(seeds))])
    return [at for g in range(len(seeds)) if len(at := np.flatnonzero(near == g))]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``centres``."""
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * x.shape[1] * high * high < 1 << 53:  # so products in double precision are exact
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def first(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper bound and lower bounds of each row."""
    d = distances(x, model.centres)
    best = d.argmin(1)
    lane = np.arange(len(x))
    upper = np.sqrt(d[lane, best].astype(np.float64))
    others = np.sqrt(d.astype(np.float64))
    others[lane, best] = np.inf
    return best, upper, np.stack([others[:, g].min(1) for g in model.groups], 1)


def again(x: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids have moved, scanning only what the bounds leave open."""
    best, upper, lower = best.copy(), upper + model.moved[best], lower - model.most
    live = np.flatnonzero(upper * (1 + MARGIN) + MARGIN >= lower.min(1))
    own = ((x[live] - model.centres[best[live]]) ** 2).sum(1)
    upper[live] = np.sqrt(own.astype(np.float64))
    still = upper[live] * (1 + MARGIN) + MARGIN >= lower[live].min(1)
    live, own = live[still], own[still]
    was, least, number = best[live], own.copy(), best[live].copy()
    scans = []
    for g, members in enumerate(model.groups):
        at = np.flatnonzero(np.sqrt(least.astype(np.float64)) * (1 + MARGIN) + MARGIN >= lower[live, g])
        if not len(at):
            continue
        d = distances(x[live[at]], model.centres[members])
        k = d.argmin(1)
        lane = np.arange(len(at))
        low, name = d[lane, k], members[k]
        second = d.astype(np.float64)
        second[lane, k] = np.inf
        scans.append((g, at, name, low, second.min(1)))
        closer = (low < least[at]) | ((low == least[at]) & (name < number[at]))
        least[at[closer]], number[at[closer]] = low[closer], name[closer]
    group_of = np.zeros(len(model.centres), np.int64)
    for g, members in enumerate(model.groups):
        group_of[members] = g
    left = np.flatnonzero(number != was)  # the centroid that was is one of its group's others now
    lower[live[left], group_of[was[left]]] = np.minimum(lower[live[left], group_of[was[left]]], np.sqrt(own[left].astype(np.float64)))
    for g, at, name, low, second in scans:
        lower[live[at], g] = np.sqrt(np.where(number[at] == name, second, low.astype(np.float64)))
    best[live], upper[live] = number, np.sqrt(least.astype(np.float64))
    return best, upper, lower


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(id, x)``: the vectors that can be clustered, as whole numbers."""
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda v: F.floor(F.when(F.abs(v.cast("double") * scale) < LARGEST, v.cast("double") * scale)).cast("int")).alias("x"))
    return rows.where((F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull()))


def starts(rows: DataFrame, centres: int = CENTRES, seed: int = 2) -> np.ndarray:
    """The vectors of the ``centres`` smallest digests of seed and id, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = rows.where("id is not null").select(key.alias("key"), "x").orderBy("key", "x").limit(centres).collect()
    return np.array([r["x"] for r in got], np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _pass(rows: DataFrame, model: Model, fresh: bool, last: bool) -> DataFrame:
    """One assignment of all rows: ``(id, x, was, cluster, upper, lower)``, with the exact squared ``distance`` where it is the last."""
    names = ["id", "x", "was", "cluster", "upper", "lower", *(["distance"] if last else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                x = _matrix(s.column(1), np.int64)
                if fresh:
                    was = pa.nulls(len(x), pa.int32())
                    best, upper, lower = first(x, model)
                else:
                    was = s.column(2)
                    best, upper, lower = again(x, was.to_numpy(), s.column(3).to_numpy(), _matrix(s.column(4), np.float64), model)
                bounds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * lower.shape[1], pa.int32()), pa.array(lower.ravel()))
                columns = [s.column(0), s.column(1), was, pa.array(best.astype(np.int32)), pa.array(upper), bounds]
                if last:
                    columns.append(pa.array(((x - model.centres[best]) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = rows.schema["id"].dataType.simpleString()
    given = rows.select("id", "x") if fresh else rows.select("id", "x", "cluster", "upper", "lower")
    return given.mapInArrow(run, f"id {kind}, x array<int>, was int, cluster int, upper double, lower array<double>" + (", distance long" if last else ""))


def _changes(rows: DataFrame, dim: int) -> list:
    """By how much the count and the sums of each cluster change: one row a cluster."""
    sides = F.array(F.struct(F.lit(1).alias("sign"), F.col("cluster").alias("of")), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("of")))
    moved = rows.where("was is null or was <> cluster").select("x", F.explode(sides).alias("s")).where("s.of is not null")
    sums = F.array(*(F.sum(F.col("s.sign") * F.get("x", F.lit(k)).cast("long")) for k in range(dim)))
    return moved.groupBy(F.col("s.of").alias("of")).agg(F.sum("s.sign").alias("n"), sums.alias("sums")).collect()


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE, centres: int = CENTRES, rounds: int = ROUNDS, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` of all vectors that can be clustered, and the final centroids."""
    rows = settle(scaled(vectors, id_col, vector_col, dim, scale), "yinyang-rows")
    middle = starts(rows, centres, seed)
    if not len(middle):
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")).where("false"), middle.reshape(0, dim)
    groups = grouped(middle)
    model = Model(middle, groups, np.zeros(len(middle)), np.zeros(len(groups)))
    counts, sums = [0] * len(middle), [[0] * dim for _ in middle]
    for k in range(rounds + 1):
        after = settle(_pass(rows, model, k == 0, k == rounds), "yinyang-pass")
        drop(rows)
        rows = after
        if k == rounds:
            break
        for r in _changes(rows, dim):
            counts[r["of"]] += r["n"]
            sums[r["of"]] = [a + b for a, b in zip(sums[r["of"]], r["sums"])]
        middle = np.array([[v // n for v in s] if n else c.tolist() for c, s, n in zip(model.centres, sums, counts)], np.int64)
        moved = np.sqrt(((middle - model.centres) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        model = Model(middle, groups, moved, np.array([moved[g].max() for g in groups]))
    return rows.select(F.col("id").alias(id_col), "cluster", "distance"), model.centres


def summary(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """``found`` with the inertia of each cluster and of all, and the digest of its centroid: figures of one row a centroid."""
    per = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(per.values())
    rows = [(k, per.get(k, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centres)]
    of = found.sparkSession.createDataFrame(rows, "__of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), F.col("cluster") == F.col("__of")).drop("__of")
