"""Packing, centroid clustering and whitening: against brute force, on odd rows, on empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landtide.llm import packing, whitening, yinyang
from landtide.llm import queries as Q

PATH = Q.tokenizer_path("word_bpe_49k.json")
CLASHING = ("id", "x", "n", "w", "piece", "lot", "start", "length", "crc", "offset", "sequence_id", "group", "cluster", "distance", "component", "deviation", "was", "lower", "of")


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(e.ids + [0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})


# Packing.

ODD_TEXTS = [
    None, "", "   \n\t", "Hello, WORLD's 2nd don't can't'll I'D", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul Straße ÀÉÎ", "é ́x   y z　w", "a\0b \0", "漢字かな🙂👩‍👩‍👧 ﬁ ①Ａ x²½",
    "__init__ a_b --- ... '' 's 'S ’s", "</w> w</w>", "x" * 5000, "word " * 9000, "ÿ×÷ªºµ", "tab\tline\r\nfeed\x0bvt\x0cff\x1cfs\x85nel", "1234567 3.14 1,000",
]


@pytest.fixture(scope="module")
def coder():
    return packing.Coder(open(PATH, "rb").read())


def test_ids_are_the_library_s(coder, monkeypatch):
    raw = [(t or "").encode() for t in ODD_TEXTS]
    for got, own in zip(coder.encode(raw), library_ids(ODD_TEXTS)):
        assert got.tolist() == own[:-1].tolist()
    monkeypatch.setattr(packing, "WINDOW", 7)
    for t, own in zip(raw, library_ids(ODD_TEXTS)):
        assert coder.long(t).tolist() == own[:-1].tolist()


def test_a_difference_from_the_library_ends_the_job(coder):
    with pytest.raises(RuntimeError):
        coder.check([b"some text"], [np.array([1, 2], "<u4")])


def test_rule_of_squares_against_all_choices():
    rng = np.random.default_rng(3)
    for limit in (1, 7, 30):
        sizes = rng.integers(1, limit + 1, 300)
        which, offset = packing.places(sizes, limit)
        fill = {}
        for s, b, at in zip(sizes.tolist(), which.tolist(), offset.tolist()):
            assert fill.get(b, 0) == at
            options = {}
            for own, used in fill.items():
                if used + s <= limit:
                    after = {**fill, own: used + s}
                    gaps = np.bincount([limit - u for u in after.values()], minlength=limit + 1)
                    options[limit - used] = int((gaps[1:] ** 2).sum())
            if b in fill:
                best = min(options.values())
                assert limit - at == min(g for g, v in options.items() if v == best)
            else:
                assert not options
            fill[b] = at + s
        assert max(fill.values()) <= limit


def test_few_sequences(spark):
    rng = np.random.default_rng(1)
    sizes = -np.sort(-np.minimum(2048, rng.lognormal(6, 1, 6000).astype(int) + 1))
    which, _ = packing.places(sizes)
    assert which.max() + 1 <= 1.002 * -(-sizes.sum() // 2048)


def packed_rows(df):
    rows = df.collect()
    for seq in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == seq)
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    return rows


def test_pieces_of_odd_rows_in_small_groups(spark):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3])] * 40
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packed_rows(packing.pack(packing.pieces(df, PATH), group=16))
    expected = []
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        expected += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["id"], r["piece"], r["start"], r["length"], r["crc"]) for r in got), key=repr) == sorted(expected, key=repr)
    assert packing.pack(packing.pieces(df.limit(0), PATH)).count() == 0
    assert packing.pieces(df.withColumn("doc_id", F.lit("a")), PATH).schema["id"].dataType.simpleString() == "string"


def test_packing_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packed_rows(Q.op11_sum_of_squares_packing(spark, sf_dir))
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = {(i, k): (a, zlib.crc32(ids[a : a + 2048].tobytes())) for (i, _), ids in zip(given, library_ids([t for _, t in given])) for k, a in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids_crc32"]) for r in rows} == expected
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_ids_of_sequences(spark):
    texts = [(k, f"text number {k} " * (k * 40)) for k in range(12)]
    packed = packing.pack(packing.pieces(spark.createDataFrame(texts, "doc_id long, text string"), PATH, with_ids=True))
    whole = {}
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == sum(s["length"] for s in r["spans"])
        for s in r["spans"]:
            whole.setdefault(s["id"], {})[s["piece"]] = r["ids"][s["offset"] : s["offset"] + s["length"]]
    for (k, _), ids in zip(texts, library_ids([t for _, t in texts])):
        assert sum((whole[k][p] for p in sorted(whole[k])), []) == ids.tolist()


# Clustering.

def plain_clusters(rows, dim, scale, centres, rounds, seed):
    """The rounds by definition, in Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    middle = [x for _, x in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:centres]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for k in range(rounds + 1):
        found = [min((dist(x, c), n) for n, c in enumerate(middle)) for _, x in kept]
        if k == rounds:
            return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, found)), key=repr), middle
        for n in range(len(middle)):
            own = [x for (_, x), (_, m) in zip(kept, found) if m == n]
            if own:
                middle[n] = [sum(c) // len(own) for c in zip(*own)]


def test_bounds_change_nothing():
    rng = np.random.default_rng(5)
    for trial in range(12):
        dim, k = int(rng.integers(1, 5)), int(rng.integers(1, 60))
        x = rng.integers(-6, 7, (700, dim)) * (1 if trial % 2 else 1 << 22)
        middle = x[:k].copy()
        groups = yinyang.grouped(middle)
        assert sorted(np.concatenate(groups).tolist()) == list(range(k))
        model = yinyang.Model(middle, groups, np.zeros(k), np.zeros(len(groups)))
        best, upper, lower = yinyang.first(x, model)
        for _ in range(6):
            d = ((x[:, None] - middle[None]) ** 2).sum(2)
            assert (best == d.argmin(1)).all()
            assert (upper >= np.sqrt(d.min(1)) * (1 - 1e-12)).all()
            d = d.astype(float)
            d[np.arange(len(x)), best] = np.inf
            assert all((lower[:, g] <= np.sqrt(d[:, m].min(1)) * (1 + 1e-9) + 1e-9).all() for g, m in enumerate(groups))
            after = np.array([x[best == c].sum(0) // max(1, (best == c).sum()) if (best == c).any() else middle[c] for c in range(k)])
            moved = np.sqrt(((after - middle) ** 2).sum(1).astype(float)) * (1 + 1e-9)
            middle = after
            best, upper, lower = yinyang.again(x, best, upper, lower, yinyang.Model(middle, groups, moved, np.array([moved[g].max() for g in groups])))


def test_bounds_prune():
    rng = np.random.default_rng(2)
    middle = rng.integers(-1000, 1000, (40, 8))
    x = middle[rng.integers(0, 40, 5000)] + rng.integers(-20, 21, (5000, 8))
    groups = yinyang.grouped(middle)
    best, upper, lower = yinyang.first(x, yinyang.Model(middle, groups, np.zeros(40), np.zeros(len(groups))))
    seen = []
    real = yinyang.distances
    try:
        yinyang.distances = lambda a, b: seen.append(len(a) * len(b)) or real(a, b)
        yinyang.again(x, best, upper, lower, yinyang.Model(middle, groups, np.ones(40), np.ones(len(groups))))
    finally:
        yinyang.distances = real
    assert sum(seen) < 0.1 * len(x) * 40


def test_clusters_by_definition(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-4, 5, 4) / 8).tolist()) for i in range(400)] + [(7, [0.25] * 4)] * 30 + [(None, [0.5] * 4), (None, [-0.5, 0.0, 0.0, 0.1])]
    odd = [(901, None), (902, []), (903, [1.0] * 3), (904, [1.0, None, 1.0, 1.0]), (905, [float("nan")] * 4), (906, [1.0, float("inf"), 0.0, 0.0])]
    df = clash(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).repartition(5)
    for centres in (3, 25):
        expected, middle = plain_clusters(rows, 4, 256, centres, 4, 2)
        found, got = yinyang.cluster(df, dim=4, centres=centres, rounds=4)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == expected and got.tolist() == middle
    out = yinyang.summary(found, got).collect()
    assert all(r["inertia"] == sum(d for _, _, d in expected) and r["cluster_inertia"] == sum(d for _, n, d in expected if n == r["cluster"]) for r in out)
    few, got = yinyang.cluster(df.where("vec_id < 3"), dim=4, centres=25)
    assert len(got) == 3 and few.count() == 3
    none, got = yinyang.cluster(df.limit(0), dim=4)
    assert none.count() == 0 and yinyang.summary(none, got).count() == 0
    assert yinyang.scaled(spark.createDataFrame([(1, [2.0**19] * 4), (2, [2.0**19 - 1] * 4)], "vec_id long, embedding array<double>"), dim=4).count() == 1


# Whitening.

def whole_numbers(vectors):
    return np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], np.int64)


def test_parts_merge_without_loss():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (900, 6)) @ rng.integers(-9, 9, (6, 12)) + 1_000_000
    part = None
    for a, b in ((0, 1), (1, 3), (3, 500), (500, 505), (505, 900)):
        own = whitening.part_of(x[a:b])
        part = whitening.merged(part, own) if part else own
        assert part.vectors.shape == (12, 12)
    centred = (len(x) * x - x.sum(0)) / len(x)
    assert part.n == 900 and part.sums == x.sum(0).tolist()
    assert np.allclose((part.values[:, None] * part.vectors).T @ (part.values[:, None] * part.vectors), centred.T @ centred, rtol=1e-12, atol=1e-6)


def test_exact_deviations():
    rng = np.random.default_rng(6)
    for high, n in ((200, 50), (1 << 44, 7), (1 << 20, 10**10)):
        x = rng.integers(0, high, (40, 5))
        sums = [int(s) * (n // 40 + 1) + 3 for s in x.sum(0)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(v, sums)) for v in x]


def test_whitening_by_definition(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLICE", 37)
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(8)
    data = rng.normal(size=(500, 10)) * np.arange(10, 0, -1) + 5
    rows = [(i if i % 50 else None, v.tolist()) for i, v in enumerate(data)] + [(3, data[3].tolist())] * 20
    odd = [(901, None), (902, []), (903, [1.0] * 3), (904, [None] * 10), (905, [float("nan")] * 10), (906, [float("-inf")] * 10), (907, [2.0**34] * 10)]
    df = clash(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).repartition(11)
    got = whitening.whiten(df).collect()
    x = whole_numbers([v for _, v in rows])
    n = len(x)
    centred = (n * x - x.sum(0)) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    own = {k: np.array([r["whitened"] for r in sorted((r for r in got if r["component"] == k), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]))]) for k in range(1, 9)}
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    order = sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, deviation[k]))
    for k in range(8):
        expected = (centred @ u[:, k] / np.sqrt(e[k]))[order]
        assert np.allclose(own[k + 1] * np.sign(own[k + 1] @ expected), expected, atol=1e-9)
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-12 for r in got if r["component"] == k + 1)
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation.tolist())


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(k, [0.5, float(k), -1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows) and all(r["identity_error"] < 1e-9 for r in rows)
    one = whitening.whiten(flat.limit(1)).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in one)
    assert whitening.whiten(flat.limit(0)).count() == 0 and whitening.whiten(flat.limit(0)).columns[0] == "vec_id"


def test_whitening_of_a_table(spark, sf_dir):
    rows = Q.op13_svd_whitening(spark, sf_dir).toPandas()
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = whole_numbers([r["embedding"] for r in v])
    centred = (len(x) * x - x.sum(0)) / len(x)
    e, u = np.linalg.eigh(centred.T @ centred / len(x))
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in v]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(centred @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])), atol=1e-8)
