"""Whitening of vectors by merged singular value decompositions.

Entries become whole numbers first. Each task decomposes its vectors, centred on
their exact mean, slice by slice; a part keeps its count, its exact sums, and all
singular values and right vectors, none cut off. Two parts merge by a decomposition
of both their factors and one more row for the distance of their means,
``sqrt(n m / (n + m)) (mean - mean')``: the scatter of the union, without loss. Parts
merge in a tree, ``FAN`` to a task, each level written to the shared folder; a part
has the size of a few matrices of the dimension, whatever it holds.

Components are the right vectors, numbered from 1 by falling singular value. A vector
is centred exactly and projected in a second pass; a third checks the covariance of
the result.

Defined results: vectors that are null, empty, with null or non-finite entries or one
of 2^34 or more are left out, as are vectors of another length than most (of the
shorter one among equals); components without variance have a null result and no
part in the error; rows of equal ids count as rows, null ids go along; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm.store import drop, settle

SCALE, SHIFT, KEEP = 1024, 100_000, 8
#: Rows decomposed at a time, parts merged by one task.
SLICE, FAN = 4096, 16
LARGEST = 1 << 34


class Part(NamedTuple):
    """How many vectors, their exact sums, and singular values and right vectors (as rows) of them centred."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray


def _decomposed(n: int, sums: list[int], stacked: np.ndarray) -> Part:
    """All singular values and right vectors, also where there are fewer rows than columns."""
    dim = stacked.shape[1]
    if len(stacked) > 2 * dim:
        stacked = np.linalg.qr(stacked, mode="r")
    elif len(stacked) < dim:
        stacked = np.vstack([stacked, np.zeros((dim - len(stacked), dim))])
    _, values, vectors = np.linalg.svd(stacked, full_matrices=False)
    return Part(n, sums, values, vectors)


def part_of(x: np.ndarray) -> Part:
    """The part of a slice of whole-number vectors."""
    base = x[0]
    low = x - base  # so sums stay small
    sums = low.sum(0)
    centred = (len(x) * low - sums) / len(x)
    return _decomposed(len(x), [int(s) + len(x) * int(b) for s, b in zip(sums, base)], centred)


def merged(a: Part, b: Part) -> Part:
    gap = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums)])
    row = (a.n * b.n / (a.n + b.n)) ** 0.5 * gap
    return _decomposed(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums)], np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, row]))


PART = "of long, n long, sums array<decimal(38,0)>, vals array<double>, vecs array<double>"


def _table(of: int, p: Part) -> pa.RecordBatch:
    lists = [pa.array([list(map(Decimal, p.sums))], pa.list_(pa.decimal128(38, 0))), pa.array([p.values.tolist()], pa.list_(pa.float64())), pa.array([p.vectors.ravel().tolist()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([p.n], pa.int64()), *lists], ["of", "n", "sums", "vals", "vecs"])


def _read(row: dict) -> Part:
    values = np.array(row["vals"])
    return Part(row["n"], [int(s) for s in row["sums"]], values, np.array(row["vecs"]).reshape(len(values), -1))


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(id, x)``: the vectors that can be whitened, of the length that most have, as whole numbers."""
    number = lambda v: F.when(F.abs(v.cast("double")) < LARGEST, F.floor(v.cast("double") * scale) + shift)
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), number).alias("x"))
    rows = rows.where((F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull()))
    most = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("x") == (most["dim"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def fit(rows: DataFrame) -> Part | None:
    """The part of all ``rows (x)``; none where there are no rows."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                own = part_of(_matrix(b.column(0).slice(lo, SLICE)))
                part = merged(part, own) if part else own
        if part:
            yield _table(TaskContext.get().partitionId(), part)

    def join(table: pa.Table) -> pa.Table:
        parts = [_read(r) for r in sorted(table.to_pylist(), key=lambda r: r["of"])]
        while len(parts) > 1:
            parts = [merged(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return pa.Table.from_batches([_table(table.column("of")[0].as_py() // FAN, parts[0])])

    level = settle(rows.select("x").mapInArrow(local, PART), "whiten-parts")
    while level.count() > 1:
        after = settle(level.groupBy(F.floor(F.col("of") / FAN)).applyInArrow(join, PART), "whiten-parts")
        drop(level)
        level = after
    row = level.first()
    return _read(row.asDict()) if row else None


def components(part: Part, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (rows), their standard deviations and shares of the variance; a deviation that is only rounding is 0."""
    share = part.values**2 / max(float((part.values**2).sum()), np.finfo(float).tiny)
    dead = part.values <= part.values[:1] * len(part.values) * np.finfo(float).eps
    return part.vectors[:keep], np.where(dead, 0.0, part.values / part.n**0.5)[:keep], share[:keep]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - sums) squared, exactly."""
    base = [s // n for s in sums]
    low, rest = x - np.array(base, np.int64), [s - n * b for s, b in zip(sums, base)]
    high = int(np.abs(low).max(initial=0))
    if high * max(high, n) * x.shape[1] < 1 << 62:  # n^2 sum low^2 - 2 n sum low rest + sum rest^2: these sums fit 64 bits, their multiples need not
        square, cross, own = (low * low).sum(1).tolist(), (low @ np.array(rest, np.int64)).tolist(), sum(r * r for r in rest)
        return [n * n * a - 2 * n * b + own for a, b in zip(square, cross)]
    return [sum((n * a - r) ** 2 for a, r in zip(v, rest)) for v in low.tolist()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = KEEP, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component; ``deviation`` is ``decimal(38,0)``."""
    rows = whole(vectors, id_col, vector_col, scale, shift)
    kind = rows.schema["id"].dataType.simpleString()
    part = fit(rows)
    if part is None:
        empty = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    axes, spread, share = components(part, keep)
    n, sums = part.n, part.sums
    inverse = np.divide(1.0, spread, out=np.full(len(spread), np.nan), where=spread > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.array([s // n for s in sums], np.int64)
        rest = np.array([(s % n) / n for s in sums])
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                x = _matrix(s.column(1))
                flat = (((x - base) - rest) @ axes.T * inverse).ravel()
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(axes), pa.int32()), pa.array(flat, pa.float64(), from_pandas=True))
                exact = pa.array(list(map(Decimal, deviations(x, n, sums))), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([s.column(0), exact, values], ["id", "deviation", "w"])

    wide = settle(rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), w array<double>"), "whiten-rows")
    alive = [k for k, s in enumerate(spread) if s > 0]
    at = lambda k: F.get("w", F.lit(k))
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    sums_of = wide.agg(F.count("*").alias("n"), *(F.sum(at(k)).alias(f"m{k}") for k in alive), *(F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in pairs)).first()
    error = max((abs(sums_of[f"p{i}_{j}"] / n - sums_of[f"m{i}"] / n * sums_of[f"m{j}"] / n - (i == j)) for i, j in pairs), default=0.0)
    out = wide.select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    shares = F.array(*(F.lit(float(s)) for s in share))
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(float(error)).alias("identity_error"))
