"""Extremely randomised trees grown level by level, all trees of all settings and folds at once.

A *lane* is one tree with its settings and the fold that it must not see. Equal samples
of a class and fold are one row with their number, which knows its node in every lane.
A level takes two aggregations over the rows and one pass that moves them on:

1. least and greatest value of each feature in every open node; a few features are
   drawn among those that vary, each with one threshold between its ends;
2. how many samples of each class lie left of each threshold; the split of the least
   Gini impurity that leaves both sides enough samples is taken.

Nodes of at most ``OWN`` rows wait for the rest and are then finished all at once, each
by the task that its rows are dealt to, so passes are only those down to that size.

Draws follow from the seed, the tree and the place of the node in it, so a tree does
not depend on the lanes beside it or on how samples are dealt to tasks; counts are
whole numbers, so neither do ties. Only splits and class counts of nodes come to the
driver: the model, which is bounded by ``NODES`` nodes. What a node's sides hold is
known from its split, so samples leave as soon as they are in a leaf. Samples with a null in a feature or label are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.session import deleted, written

#: Nodes of a model at most, elements of the matrices that a task works on at a time, and rows of a node that one task finishes.
NODES, STEP, OWN = 4_000_000, 1 << 21, 1 << 17


class Lane(NamedTuple):
    """A tree's number, the share of features drawn at a node, samples of a leaf and of a split node at least, levels at most, its setting and its hidden fold."""

    tree: int
    features: float = 0.55
    leaf: int = 2
    split: int = 16
    depth: int = 64
    setting: int = 0
    fold: int = -1


class Forest(NamedTuple):
    """Nodes of all lanes; a lane's root has its number; ``left`` is -1 in leaves; ``weights`` has a row a node and a column a class."""

    classes: list
    lanes: list[Lane]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weights: np.ndarray


def _draw(*parts: Column) -> Column:
    """A number in (0, 1) that follows from a text, the same in any engine with CRC-32."""
    return (F.crc32(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")) + 0.5) / float(1 << 32)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def _complete(samples: DataFrame, label: str | None, features: Sequence[str]) -> DataFrame:
    full = F.lit(True)
    for c in [*features, *([label] if label else [])]:
        full = full & F.col(c).isNotNull()
    return samples.where(full)


def _counted(rows: DataFrame, features: Sequence[str], number: Column, fold: Column | None) -> DataFrame:
    """``(x, cls, fold, n)``: equal samples of a class and fold as one row."""
    each = rows.select(F.array(*(F.col(c).cast("double") for c in features)).alias("x"), number.alias("cls"), (fold if fold is not None else F.lit(-2)).cast("int").alias("fold"))
    return each.groupBy("x", "cls", "fold").agg(F.count("*").alias("n"))


def _open(rule: Lane, place: int, own: np.ndarray) -> bool:
    return int(own.sum()) >= rule.split and int((own > 0).sum()) > 1 and place.bit_length() <= rule.depth


def grow(samples: DataFrame, label: str, features: Sequence[str], lanes: Sequence[Lane], seed: int = 101, fold: Column | None = None, balanced: bool = True, own: int = OWN) -> Forest:
    """A forest of ``lanes``; ``fold`` gives each sample's fold. ``balanced`` weighs classes so that all weigh the same; ``own`` does not change the trees."""
    rows = _complete(samples, label, features)
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(label).collect()}
    classes = list(sizes)
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1 if classes else F.lit(0)
    total = sum(sizes.values())
    scale = np.array([total / (len(sizes) * n) if balanced else 1.0 for n in sizes.values()])
    hidden = F.array(*(F.lit(x.fold) for x in lanes))
    at = F.transform(hidden, lambda f, k: F.when(f == F.col("fold"), -1).otherwise(k))
    made: list[str] = []
    state = written(_counted(rows, features, number, fold).withColumn("at", at), "trees", made)
    folds = max([0, *(x.fold + 1 for x in lanes)])
    per_fold, rows_of, everything, every = np.zeros((folds, len(classes)), np.int64), np.zeros(folds, np.int64), np.array(list(sizes.values()), np.int64), 0
    for r in state.groupBy(F.when(F.col("fold").between(0, folds - 1), F.col("fold")).otherwise(-1).alias("fold"), "cls").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():
        every += r["rows"]
        if r["fold"] >= 0:
            per_fold[r["fold"], r["cls"]] = r["n"]
            rows_of[r["fold"]] += r["rows"]
    counts = [everything - per_fold[x.fold] if x.fold >= 0 else everything for x in lanes]
    feature, threshold, left, right = ([x] * len(lanes) for x in (-1, 0.0, -1, -1))
    # Of a level: name, lane, place in the tree (children of p are 2 p and 2 p + 1) and rows; samples have the place in this list.
    nodes = [(k, k, 1, int(every - (rows_of[x.fold] if x.fold >= 0 else 0))) for k, x in enumerate(lanes)]
    while True:
        open_ = [_open(lanes[lane], place, counts[name]) for name, lane, place, _ in nodes]
        tried = [(k, lane, place, counts[name].tolist()) for k, (name, lane, place, n) in enumerate(nodes) if open_[k] and n > own]
        if not tried:
            break
        splits = _splits(state, tried, lanes, len(features), scale, seed)
        after, go, by, bar = [], np.full((len(nodes), 2), -1, np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))
        for k, (name, lane, place, n) in enumerate(nodes):
            if k in splits:
                f, cut, lefts, rows_left = splits[k]
                by[k], bar[k] = f, cut
                feature[name], threshold[name], left[name], right[name] = f, cut, len(left), len(left) + 1
                for side, (of, m) in enumerate(((np.array(lefts), rows_left), (counts[name] - np.array(lefts), n - rows_left))):
                    if _open(lanes[lane], 2 * place + side, of):
                        go[k, side] = len(after)
                        after.append((len(left), lane, 2 * place + side, m))
                    for table, value in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (counts, of)):
                        table.append(value)
            elif open_[k] and n <= own:  # waits
                go[k] = len(after)
                after.append((name, lane, place, n))
        _bounded(len(left))
        nodes = after
        old = list(made)
        made.clear()
        state = written(_moved(state, by, bar, go), "trees", made, old)
    tables = [np.array(feature, np.int64), np.array(threshold, np.float64), np.array(left, np.int64), np.array(right, np.int64), np.array(counts, np.int64).reshape(len(left), len(classes))]
    waiting = {k: (lanes[lane], place) for k, ((name, lane, place, _), o) in enumerate(zip(nodes, open_)) if o}
    if waiting:
        tables = _joined(tables, {k: nodes[k][0] for k in waiting}, _finished(state, waiting, len(features), scale, seed))
    deleted(samples.sparkSession, made)
    return Forest(classes, list(lanes), *tables[:4], tables[4] * scale)


def _bounded(nodes: int) -> None:
    if nodes > NODES:
        raise ValueError(f"more than {NODES} nodes: draw fewer samples, or ask for larger leaves")


def _finished(state: DataFrame, waiting: dict[int, tuple[Lane, int]], width: int, scale: np.ndarray, seed: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each of the ``waiting`` nodes with the tables of its tree: feature, threshold, left and class counts; its rows meet in one task."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        node = key[0].as_py()
        lane, place = waiting[node]
        x = _matrix(t.column("x").combine_chunks(), np.float64)
        own = _subtree(x, t.column("cls").to_numpy().astype(np.int64), t.column("n").to_numpy(), lane, place, scale, seed)
        return pa.table({"node": pa.array([node], pa.int32()), **{f"t{k}": pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()) for k, a in enumerate(own)}})

    on = state.select("x", "cls", "n", F.explode("at").alias("node")).where("node >= 0")
    dealt = on.repartition(min(2000, 2 * len(waiting)), "node")  # a number of its own, so tasks of much work are not put together by their bytes
    kinds = (np.int16, np.float64, np.int32, np.int64)
    made: list[str] = []
    # Written first: an iterator runs the tasks of its table one after the other.
    grown = written(dealt.groupBy("node").applyInArrow(run, "node int, t0 binary, t1 binary, t2 binary, t3 binary"), "trees-grown", made)
    for r in grown.toLocalIterator():
        feature, threshold, left, counts = (np.frombuffer(zlib.decompress(bytes(b)), kind) for b, kind in zip(r[1:], kinds))
        yield r["node"], [feature, threshold, left, counts.reshape(len(feature), -1)]
    deleted(state.sparkSession, made)


def _joined(tables: list[np.ndarray], names: dict[int, int], trees: Iterator[tuple[int, list[np.ndarray]]]) -> list[np.ndarray]:
    """``tables`` of nodes with those of finished ``trees`` in the place of their roots ``names``."""
    parts, size = [[t] for t in tables], len(tables[0])
    for k, (feature, threshold, left, counts) in sorted(trees, key=lambda t: t[0]):
        inner = left >= 0
        left = np.where(inner, left + size - 1, -1).astype(np.int64)
        own = [feature.astype(np.int64), threshold, left, np.where(inner, left + 1, -1), counts]
        for part, a in zip(parts, own):
            part[0][names[k]] = a[0]
            part.append(a[1:])
        size += len(feature) - 1
        _bounded(size)
    return [np.concatenate(p) for p in parts]


def _subtree(x: np.ndarray, cls: np.ndarray, n: np.ndarray, rule: Lane, place: int, scale: np.ndarray, seed: int) -> list[np.ndarray]:
    """The tree under one node, level by level as by Spark: feature (-1 in leaves), threshold, left (the right one follows) and class counts."""
    width, kinds = x.shape[1], len(scale)
    draw = lambda name, f, what: (zlib.crc32(f"{name}:{f}:{what}".encode()) + 0.5) / float(1 << 32)
    of = lambda a: sum(a[:, c] for c in range(kinds))

    def pure(a: np.ndarray) -> np.ndarray:
        w = a * scale
        with np.errstate(invalid="ignore"):
            return of(w * w) / of(w)

    places, own, at, size = [place], np.bincount(cls, n, kinds)[None].astype(np.int64), np.zeros(len(x), np.int64), 1
    out: list[list[np.ndarray]] = [[], [], [], []]
    while places:
        open_ = np.array([_open(rule, p, c) for p, c in zip(places, own)])
        m, number = int(open_.sum()), np.cumsum(open_) - 1
        feature, bar, left = np.full(len(places), -1, np.int16), np.zeros(len(places)), np.full(len(places), -1, np.int32)
        after, lefts = [], np.zeros((0, kinds), np.int64)
        if m:
            stay = open_[at]
            x, cls, n, at = x[stay], cls[stay], n[stay], number[at[stay]]
            order = np.argsort(at, kind="stable")
            x, cls, n, at = x[order], cls[order], n[order], at[order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            low, high = np.fmin.reduceat(x, starts), np.maximum.reduceat(x, starts)
            vary = (low < high) | (np.isnan(high) & ~np.isnan(low))  # NaN is the greatest
            names = [f"{seed}:{rule.tree}:{p}" for p, o in zip(places, open_) if o]
            turns = [sorted((draw(name, f, "order"), f) for f in np.flatnonzero(v)) for name, v in zip(names, vary)]
            best, by, cut, taken = np.full(m, -np.inf), np.full(m, -1), np.zeros(m), np.zeros((m, kinds), np.int64)
            for k in range(max(1, round(rule.features * width))):
                some = np.array([len(t) > k for t in turns])
                f = np.array([t[k][1] if len(t) > k else 0 for t in turns])
                at_f = np.arange(m), f
                own_bar = low[at_f] + (high[at_f] - low[at_f]) * np.array([draw(name, t[k][1], "bar") if len(t) > k else 0.0 for name, t in zip(names, turns)])
                below = x[np.arange(len(x)), f[at]] <= own_bar[at]
                less = np.bincount(at[below] * kinds + cls[below], n[below], m * kinds).reshape(m, kinds).astype(np.int64)
                more = own[open_] - less
                score = np.round(pure(less) + pure(more), 9)
                better = some & (less.sum(1) >= rule.leaf) & (more.sum(1) >= rule.leaf) & (score > best)
                best, by, cut, taken = np.where(better, score, best), np.where(better, f, by), np.where(better, own_bar, cut), np.where(better[:, None], less, taken)
            split = by >= 0
            rank = np.cumsum(split) - 1
            which = np.flatnonzero(open_)
            feature[which], bar[which] = by, cut
            left[which[split]] = size + 2 * rank[split]
            after = [2 * places[p] + side for p in which[split] for side in (0, 1)]
            lefts = np.stack([taken[split], own[which[split]] - taken[split]], 1).reshape(-1, kinds)
            stay = split[at]
            x, cls, n, at = x[stay], cls[stay], n[stay], at[stay]
            at = 2 * rank[at] + (x[np.arange(len(x)), by[at]] > cut[at])
        for part, a in zip(out, (feature, bar, left, own)):
            part.append(a)
        size += len(after)
        places, own = after, lefts
    return [np.concatenate(p) for p in out]


def _splits(state: DataFrame, nodes: list[tuple[int, int, int, list[int]]], lanes: Sequence[Lane], width: int, scale: np.ndarray, seed: int) -> dict[int, tuple[int, float, list[int], int]]:
    """Feature, threshold, counts and rows to the left of those open ``nodes`` (number, lane, place, counts) that split."""
    rules = [(k, f"{seed}:{lanes[lane].tree}:{place}", max(1, round(lanes[lane].features * width)), lanes[lane].leaf, own) for k, lane, place, own in nodes]
    rules = state.sparkSession.createDataFrame(rules, "node int, name string, most int, leaf int, own array<long>")
    made: list[str] = []
    on = state.select("x", "cls", "n", F.explode("at").alias("node")).join(F.broadcast(rules.select("node")), "node", "left_semi")
    ends = on.select("node", F.posexplode("x").alias("f", "v")).groupBy("node", "f").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").join(rules, "node")
    order = F.struct(_draw(F.col("name"), F.col("f"), F.lit("order")).alias("o"), "f", (F.col("low") + (F.col("high") - F.col("low")) * _draw(F.col("name"), F.col("f"), F.lit("bar"))).alias("bar"))
    tried = ends.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(order)), 1, F.first("most")).alias("bars"))
    tried = written(tried, "trees-tried", made)
    bars = on.join(tried, "node").select("node", "x", "cls", "n", F.explode("bars").alias("b")).where(F.get("x", F.col("b.f")) <= F.col("b.bar"))
    lefts = bars.groupBy("node", "b.o", "b.f", "b.bar", "cls").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).groupBy("node", "o", "f", "bar").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("m"), F.sum("rows").alias("rows"))
    lefts = lefts.select("node", "o", "f", "bar", "rows", F.transform(F.sequence(F.lit(0), F.lit(len(scale) - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0))).alias("l")).join(rules, "node")
    weigh = F.array(*(F.lit(float(x)) for x in scale))
    add = lambda a, zero: F.aggregate(a, F.lit(zero), lambda s, v: s + v)
    rest = F.zip_with("own", "l", lambda a, b: a - b)
    pure = lambda a: F.try_divide(add(F.zip_with(a, weigh, lambda n, w: (n * w) * (n * w)), 0.0), add(F.zip_with(a, weigh, lambda n, w: n * w), 0.0))
    total = lambda a: add(F.transform(a, lambda v: v.cast("double")), 0.0)
    fits = (total(F.col("l")) >= F.col("leaf")) & (total(rest) >= F.col("leaf"))
    best = F.max_by(F.struct("f", "bar", "l", "rows"), F.struct(F.round(pure(F.col("l")) + pure(rest), 9).alias("pure"), (-F.col("o")).alias("o")))
    chosen = lefts.where(fits).groupBy("node").agg(best.alias("b")).select("node", "b.*").collect()
    deleted(state.sparkSession, made)
    return {r["node"]: (r["f"], r["bar"], r["l"], r["rows"]) for r in chosen}


def _moved(state: DataFrame, by: np.ndarray, bar: np.ndarray, go: np.ndarray) -> DataFrame:
    """Samples at their nodes of the next level, -1 where they have come to a leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                lanes = len(b.column(3)[lo])
                s = b.slice(lo, max(1, STEP // max(1, lanes)))
                x, at = _matrix(s.column(0), np.float64), _matrix(s.column(3), np.int64)
                right = x[np.arange(len(x))[:, None], by[at]] > bar[at]
                after = np.where(at >= 0, go[at, right.astype(np.int64)], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*s.columns[:3], _lists(after)], ["x", "cls", "n", "at"])
                lo += s.num_rows

    return state.select("x", "cls", "n", "at").mapInArrow(run, "x array<double>, cls int, n long, at array<int>")


def shares(forest: Forest) -> np.ndarray:
    return forest.weights / np.maximum(forest.weights.sum(1, keepdims=True), 1e-300)


def votes(forest: Forest, share: np.ndarray, x: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The mean of the class shares in the leaves that rows of ``x`` come to in ``lanes``."""
    at = np.tile(lanes, len(x))
    on = np.flatnonzero(forest.left[at] >= 0)
    while len(on):
        node = at[on]
        right = x[on // len(lanes), forest.feature[node]] > forest.threshold[node]
        at[on] = node = np.where(right, forest.right[node], forest.left[node])
        on = on[forest.left[node] >= 0]
    return share[at.reshape(len(x), len(lanes))].mean(1)


def predict(image: DataFrame, forest: Forest, features: Sequence[str], nodata: float | None = None) -> DataFrame:
    """``image`` with ``prediction`` (the first of the likeliest classes) and ``probabilities``; both null where a feature is null or ``nodata``."""
    missing = F.lit(False)
    for c in features:
        missing = missing | F.col(c).isNull() | (F.col(c) == nodata if nodata is not None else F.lit(False))
    lanes = np.arange(len(forest.lanes))
    model = image.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = model.value, max(1, STEP // max(1, len(lanes)))
        share_of = shares(own)
        for b in batches:
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                known = np.flatnonzero(s.column(1).is_valid().to_numpy(zero_copy_only=False))
                which, share = np.full(s.num_rows, -1, np.int32), [None] * s.num_rows
                if len(known) and own.classes:
                    got = votes(own, share_of, _matrix(s.column(1).take(pa.array(known)), np.float64), lanes)
                    which[known] = got.argmax(1)
                    for k, v in zip(known.tolist(), got.tolist()):
                        share[k] = v
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(which), pa.array(share, pa.list_(pa.float64()))], ["row", "which", "probabilities"])

    whole = image.select(F.struct(*(F.col(f"`{c}`") for c in image.columns)).alias("row"), F.when(~missing, F.array(*(F.col(c).cast("double") for c in features))).alias("x"))
    scored = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}, which int, probabilities array<double>")
    known = F.array(*map(F.lit, forest.classes)) if forest.classes else F.array().cast("array<int>")
    return scored.select("row.*", F.when(F.col("which") >= 0, F.get(known, F.col("which"))).alias("prediction"), "probabilities")


def extra_trees(samples: DataFrame, label: str, features: Sequence[str], trees: int = 100, seed: int = 101, **settings) -> Forest:
    return grow(samples, label, features, [Lane(k, **settings) for k in range(trees)], seed)


def drawn_settings(n: int, seed: int = 101) -> list[dict]:
    """``n`` settings drawn at random: share of features, least leaf and split."""
    rng = np.random.default_rng(seed)
    return [{"features": float(rng.choice([0.2, 0.35, 0.55, 0.8, 1.0])), "leaf": int(rng.integers(1, 5)), "split": int(rng.integers(2, 17)), "depth": int(rng.choice([8, 16, 32, 64]))} for _ in range(n)]


def search(samples: DataFrame, label: str, features: Sequence[str], settings: Sequence[dict], fold: Column, folds: int = 5, trees: int = 20, seed: int = 101) -> DataFrame:
    """``(setting, accuracy, deviation)`` over the folds of each of ``settings``, the best first.

    All folds of all settings grow in the same few passes; each sample is then
    classified by the trees that have not seen its fold.
    """
    lanes = [Lane(t, **s, setting=k, fold=f) for k, s in enumerate(settings) for f in range(folds) for t in range(trees)]
    rows = _complete(samples, label, features)
    forest = grow(rows, label, features, lanes, seed, fold)
    model = samples.sparkSession.sparkContext.broadcast(forest)
    number = F.array_position(F.array(*map(F.lit, forest.classes)), F.col(label)).cast("int") - 1 if forest.classes else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step = model.value, max(1, STEP // trees)
        share = shares(own)
        of = {(k, f): np.array([n for n, x in enumerate(own.lanes) if (x.setting, x.fold) == (k, f)]) for k in range(len(settings)) for f in range(folds)}
        for b in batches:
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                x, cls, part, n = _matrix(s.column(0), np.float64), *(s.column(k).to_numpy() for k in (1, 2, 3))
                out = []
                for (k, f), ids in of.items():
                    if (part == f).any():
                        right = votes(own, share, x[part == f], ids).argmax(1) == cls[part == f]
                        out.append((k, f, int(n[part == f][right].sum()), int(n[part == f].sum())))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["setting", "fold", "hits", "n"])

    scored = _counted(rows, features, number, fold).mapInArrow(run, "setting int, fold int, hits long, n long")
    per = scored.groupBy("setting", "fold").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))
    return per.groupBy("setting").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("deviation")).orderBy(F.desc("accuracy"), "setting")
