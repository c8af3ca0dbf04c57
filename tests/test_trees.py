"""Trees grown by Spark against trees grown node by node in plain Python, for the same draws."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from landtide.operators import trees

FEATURES = ["a", "b", "c", "d"]


def draw(*parts):
    return (zlib.crc32(":".join(map(str, parts)).encode()) + 0.5) / (1 << 32)


def plain(rows, classes, weight, lane, seed, place=1):
    """A tree as nested tuples (feature, threshold, left, right) or class counts."""
    own = [sum(1 for _, c in rows if c == k) for k in classes]
    if len(rows) < lane.split or sum(n > 0 for n in own) < 2 or place.bit_length() > lane.depth:
        return own
    ends = {f: (min(x[f] for x, _ in rows), max(x[f] for x, _ in rows)) for f in range(len(FEATURES))}
    vary = sorted((draw(f"{seed}:{lane.tree}:{place}", f, "order"), f) for f, (lo, hi) in ends.items() if lo < hi)
    best = None
    for o, f in vary[: max(1, round(lane.features * len(FEATURES)))]:
        bar = ends[f][0] + (ends[f][1] - ends[f][0]) * draw(f"{seed}:{lane.tree}:{place}", f, "bar")
        sides = [[r for r in rows if r[0][f] <= bar], [r for r in rows if r[0][f] > bar]]
        if min(map(len, sides)) < lane.leaf:
            continue
        pure = 0
        for s in sides:
            w = [weight[k] * n for k, n in Counter(c for _, c in s).items()]
            pure += sum(v * v for v in w) / sum(w)
        if best is None or (round(pure, 9), -o) > best[0]:
            best = (round(pure, 9), -o), f, bar, sides
    if best is None:
        return own
    _, f, bar, sides = best
    return f, bar, plain(sides[0], classes, weight, lane, seed, 2 * place), plain(sides[1], classes, weight, lane, seed, 2 * place + 1)


def nested(forest, node, weight):
    if forest.left[node] < 0:
        return [round(w / weight[k]) for w, k in zip(forest.weights[node].tolist(), forest.classes)]
    return int(forest.feature[node]), float(forest.threshold[node]), nested(forest, forest.left[node], weight), nested(forest, forest.right[node], weight)


def same(a, b):
    if isinstance(a, list) or isinstance(b, list):
        return a == b
    return a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and same(a[2], b[2]) and same(a[3], b[3])


def vote(tree, x, classes, weight):
    while not isinstance(tree, list):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    w = np.array([n * weight[k] for n, k in zip(tree, classes)])
    return w / w.sum()


def samples(n=240):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, 4)), 3)
    label = np.where(x[:, 0] + x[:, 1] > 0.4, "wood", np.where(x[:, 2] > 0, "field", "water"))
    label[:5] = "rare"
    x[:, 3] = 1.5  # never varies
    return [(k, *map(float, v), str(c)) for k, (v, c) in enumerate(zip(x, label))]


def test_trees_are_those_grown_node_by_node(spark):
    rows = samples()
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0, "wood"), (901, 1.0, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, d double, label string").repartition(3)
    lanes = [trees.Lane(0), trees.Lane(1, features=1.0, leaf=5), trees.Lane(2, features=0.3, split=2, leaf=1), trees.Lane(3, depth=2), trees.Lane(4, fold=1)]
    forest = trees.grow(df, "label", FEATURES, lanes, 7, F.pmod("id", F.lit(3)))
    classes = sorted({r[-1] for r in rows})
    assert forest.classes == classes
    sizes = Counter(r[-1] for r in rows)
    weight = {k: len(rows) / (len(classes) * sizes[k]) for k in classes}
    for k, lane in enumerate(lanes):
        seen = [(r[1:5], r[5]) for r in rows if lane.fold < 0 or r[0] % 3 != lane.fold]
        assert same(nested(forest, k, weight), plain(seen, classes, weight, lane, 7)), lane
    image = df.withColumns({"row": F.lit(1), "which": F.lit(2), "x": F.lit(3)})
    got = trees.predict(image, forest, FEATURES).collect()
    assert len(got) == 242 and next(r for r in got if r["id"] == 900)["prediction"] is None
    assert np.mean([r["prediction"] == r["label"] for r in got if r["id"] < 240]) > 0.9 and got[0]["which"] == 2


def test_search_in_one_job(spark):
    df = spark.createDataFrame(samples(), "id long, a double, b double, c double, d double, label string")
    settings = [{"depth": 1, "features": 0.3}, {"leaf": 2, "split": 4, "features": 1.0}]
    got = trees.search(df, "label", FEATURES, settings, F.pmod("id", F.lit(3)), 3, 3, seed=5).collect()
    rows = samples()
    classes = sorted({r[-1] for r in rows})
    sizes = Counter(r[-1] for r in rows)
    weight = {k: len(rows) / (len(classes) * sizes[k]) for k in classes}
    for k, setting in enumerate(settings):
        right = []
        for f in range(3):
            grown = [plain([(r[1:5], r[5]) for r in rows if r[0] % 3 != f], classes, weight, trees.Lane(t, **setting), 5) for t in range(3)]
            hidden = [r for r in rows if r[0] % 3 == f]
            right.append(np.mean([classes[np.mean([vote(t, r[1:5], classes, weight) for t in grown], 0).argmax()] == r[5] for r in hidden]))
        own = next(r for r in got if r["setting"] == k)
        assert abs(own["accuracy"] - np.mean(right)) < 1e-9 and abs(own["deviation"] - np.std(right)) < 1e-9
    assert got[0]["accuracy"] > got[1]["accuracy"] and trees.drawn_settings(4) == trees.drawn_settings(4) and len(trees.drawn_settings(4)) == 4


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "a double, b double, label int")
    forest = trees.extra_trees(empty, "label", ["a", "b"], trees=2)
    one = spark.createDataFrame([(1.0, 2.0, 5)], "a double, b double, label int")
    assert trees.predict(one, forest, ["a", "b"]).first()["prediction"] is None
    assert trees.predict(one, trees.extra_trees(one, "label", ["a", "b"], trees=2), ["a", "b"]).first()["prediction"] == 5


def test_trees_are_the_same_by_passes_and_by_tasks(spark):
    rows = [r for r in samples() for _ in range(2)]  # equal samples are one row
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label string")
    lanes = [trees.Lane(0), trees.Lane(1, features=1.0, leaf=5), trees.Lane(2, split=2, leaf=1, fold=1), trees.Lane(3, depth=3)]
    classes = sorted({r[-1] for r in rows})
    weight = {k: len(rows) / (len(classes) * sum(r[-1] == k for r in rows)) for k in classes}
    by = {own: trees.grow(df, "label", FEATURES, lanes, 7, F.pmod("id", F.lit(3)), own=own) for own in (0, 60, trees.OWN)}
    for k, lane in enumerate(lanes):
        seen = [(r[1:5], r[5]) for r in rows if lane.fold < 0 or r[0] % 3 != lane.fold]
        expected = plain(seen, classes, weight, lane, 7)
        assert all(same(nested(forest, k, weight), expected) for forest in by.values()), lane


def test_passes_do_not_follow_the_levels(spark):
    df = spark.createDataFrame(samples(), "id long, a double, b double, c double, d double, label string")
    spark.sparkContext.setJobGroup("levels", "levels")
    try:
        forest = trees.grow(df, "label", FEATURES, [trees.Lane(k, features=0.3, leaf=1, split=2) for k in range(3)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(forest.left) > 60
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels")) < 20
