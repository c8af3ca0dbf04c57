"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints that differ in at most ``RADIUS`` of 64 bits are linked. The 64 bits
are cut into blocks, more of them the more fingerprints there are; such fingerprints agree on at least
all but ``RADIUS`` whole blocks, so a table keyed on each choice of that many
blocks meets every link. Within a bucket of a table, bit planes are stored
vertically and many distances are updated at once by carry-save counters; blocks
of 64 pairs leave as soon as all of them exceed the radius.

A bucket emits at most one edge a fingerprint (to the root of its group in the
bucket), which keeps every group connected without listing the pairs. Equal
fingerprints are one row from the start. Buckets above ``CELL`` rows are cut into
chunks, and every two chunks meet in a cell of their own, so no task gathers more
than two chunks of a bucket.

``groups`` links fingerprints alone. ``similar`` uses the same comparison, with a
wider reach, to find candidates that are then held against their texts' shingles.

Defined results: a null text is empty; a text without words has fingerprint zero
and is linked like any other; rows with equal texts have equal fingerprints; a
row whose id is null links like any other but never names a group, and a group of
such rows alone has no name; an empty table gives no rows. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.graph import components
from landtide.llm.store import settle

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Rows of a bucket that are compared in one piece; rows of a bucket on average, at most, were fingerprints even.
CELL, BUCKET = 2048, 512


def fingerprints(column: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The unsigned fingerprint of every text of an Arrow column."""
    out = []
    digest = xxhash.xxh64_intdigest
    for _, _, buf, texts in W.slices(column):
        raw = buf.tobytes().lower()  # bytes: A-Z only
        hashed: list[int] = []
        counts = np.zeros(len(texts) - 1, np.int64)
        for k in range(len(texts) - 1):
            ws = raw[texts[k] : texts[k + 1]].split()
            n = len(ws)
            if not n:
                continue
            joined = b" ".join(ws)
            starts = [0]
            at = 0
            for x in ws:
                at += len(x) + 1
                starts.append(at)
            if n <= width:
                hashed.append(digest(joined, SEED))
            else:
                hashed += [digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[width:])]
            counts[k] = max(1, n - width + 1)
        bits = np.unpackbits(np.array(hashed, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        filled = np.flatnonzero(counts)
        sums = np.zeros((len(counts), 64), np.int64)
        if len(filled):
            first = (np.cumsum(counts) - counts)[filled]
            sums[filled] = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for every row; ``fp`` holds the 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.string_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), width).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """``planes[b]``: bit ``b`` of every fingerprint, 64 fingerprints a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _shifted(planes: np.ndarray, d: int, words: np.ndarray) -> np.ndarray:
    """The words ``words`` of the planes of fingerprints ``d`` further on."""
    at, low = words + d // 64, np.uint64(d % 64)
    last = planes.shape[1] - 1
    out = planes[:, np.minimum(at, last)] >> low
    if low:
        out |= planes[:, np.minimum(at + 1, last)] << (np.uint64(64) - low)
    return out


def within(planes: np.ndarray, d: int, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes ``i`` of ``lanes`` whose fingerprints ``i`` and ``i + d`` differ in at most ``radius`` bits.

    Counter planes and a sticky plane are updated a bit position at a time;
    a word leaves once each lane of it that counts has passed the radius.
    """
    words, inverse = np.unique(lanes >> 6, return_inverse=True)
    over = np.full(len(words), ~np.uint64(0))
    np.bitwise_and.at(over, inverse, ~(np.uint64(1) << (lanes & 63).astype(np.uint64)))  # lanes that don't count are over from the start
    diff = planes[:, words] ^ _shifted(planes, d, words)
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius  # counting from here, the radius is passed when the counter overflows
    count = [np.full(len(words), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(size)]
    live = np.arange(len(words))
    for b in range(64):
        carry = diff[b, live]
        for plane in count:
            up = plane & carry
            plane ^= carry
            carry = up
        over[live] |= carry
        if b % 8 == 7:
            stay = over[live] != ~np.uint64(0)
            if not stay.any():
                return lanes[:0]
            if not stay.all():
                live, count = live[stay], [plane[stay] for plane in count]
    return lanes[(over[inverse] >> (lanes & 63).astype(np.uint64)) & np.uint64(1) == 0]


def star_edges(key: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket ``key``: edges that join each row to the root of its group within the bucket.

    Every two rows of a bucket are compared unless the bucket is one group already.
    """
    n = len(key)
    root = np.arange(n)
    planes = bit_planes(fps)
    first = np.r_[True, key[1:] != key[:-1]]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.diff(np.r_[np.flatnonzero(first), n])
    stop = begin + np.repeat(size, size)
    lanes, d = np.arange(n), 0

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while True:
        d += 1
        lanes = lanes[lanes + d < stop[lanes]]
        if not len(lanes):
            break
        hit = within(planes, d, lanes, radius)
        hit = hit[root[hit] != root[hit + d]]
        for i in hit.tolist():
            a, b = top(i), top(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(hit):
            while True:  # flatten, then let go of the buckets that are one group
                up = root[root]
                if (up == root).all():
                    break
                root = up
            whole = np.bincount(begin, root != begin, n) == 0
            lanes = lanes[~whole[begin[lanes]]]
    a = np.flatnonzero(root != np.arange(n))
    return nodes[a], nodes[root[a]]


def near_pairs(key: np.ndarray, fps: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket ``key``: each row with up to ``most`` of the nearest later rows of its bucket within ``radius``."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    stop = np.repeat(first + size, size)
    planes, lanes, d = bit_planes(fps), np.arange(n), 0
    best, whom = np.full((n, most), 65), np.full((n, most), -1)
    while True:
        d += 1
        lanes = lanes[lanes + d < stop[lanes]]
        if not len(lanes):
            break
        hit = within(planes, d, lanes, radius)
        away = np.bitwise_count(fps[hit] ^ fps[hit + d]).astype(np.int64)
        worst = best[hit].argmax(1)
        better = away < best[hit, worst]
        hit, worst, away = hit[better], worst[better], away[better]
        best[hit, worst], whom[hit, worst] = away, hit + d
    i, k = np.nonzero(whom >= 0)
    return i, whom[i, k]


def _tables(blocks: int, radius: int) -> list[int]:
    """A bit mask for each choice of the blocks that two linked fingerprints may agree on."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Blocks to cut fingerprints into: ``radius + 2`` (a key of two blocks), and more where buckets of such keys would be large."""
    blocks = radius + 2
    while blocks < 2 * radius and count > BUCKET << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def links(reps: DataFrame, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` between the nodes of ``reps (node, fp)`` that keep all groups within ``radius`` connected."""
    tables = _tables(blocks or blocks_for(reps.count(), radius), radius)
    keyed = reps.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in tables])).alias("t", "part"))
    keyed = keyed.select("node", "fp", F.xxhash64("t", "part").alias("key"))
    return _compared(keyed, cell, lambda key, fps, nodes: star_edges(key, fps, nodes, radius))


def _dealt(keyed: DataFrame, cell: int) -> DataFrame:
    """``keyed (key, node, ...)`` with large buckets cut into cells that have keys of their own.

    A bucket above the limit has a cell for every two of its chunks; each row goes to
    the cells of its own chunk. The large buckets are written, so Spark knows their size.
    """
    others = [c for c in keyed.columns if c != "key"]
    large = keyed.groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") / (cell // 2)).cast("int").alias("chunks"))
    every = keyed.join(settle(large, "large-buckets"), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    every = every.withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return every.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), *others)


def _compared(keyed: DataFrame, cell: int, compare: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges ``(a, b)`` that ``compare`` finds in the buckets of ``keyed (key, fp, node)``, or in the cells of large ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(rows[0], kind="stable")
            a, b = compare(rows[0, order], rows[1, order].view(np.uint64), rows[2, order])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on in the next batch
            if cut:
                yield emit(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = [rows[:, cut:]]
            else:
                held.append(rows)
        if held:
            yield emit(np.concatenate(held, axis=1))

    return _dealt(keyed.select("key", "fp", "node"), cell).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def joining_pairs(group: np.ndarray, offs: np.ndarray, flat: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of one bucket that are alike and join different groups; row ``i`` has the distinct shingles ``flat[offs[i]:offs[i + 1]]``.

    Every two rows of groups that are not joined yet are compared, but for those
    that cannot be alike: with the shingles of a row in one order, rare ones first,
    two rows that are alike share one among the first of each.
    """
    sizes = np.diff(offs)
    _, root = np.unique(group, return_inverse=True)
    left = int(root.max(initial=-1))  # joins until all is one group
    _, flat, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, count[flat], row))
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    head = (np.arange(len(flat)) - offs[row] < first[row]) & (count[flat[order]] > 1)
    shingle, owner = flat[order][head], row[head]
    by = np.argsort(shingle, kind="stable")
    owners, begin = owner[by], np.searchsorted(shingle[by], np.arange(len(count) + 1))
    mine = np.searchsorted(owner, np.arange(len(sizes) + 1))
    marked, out = np.zeros(len(count), bool), []
    for i in range(len(sizes)):
        if left <= 0:
            break
        seen = [owners[begin[s] : begin[s + 1]] for s in shingle[mine[i] : mine[i + 1]].tolist()]
        if not seen:
            continue
        with_ = np.unique(np.concatenate(seen))
        with_ = with_[(with_ > i) & (root[with_] != root[i])]
        with_ = with_[np.minimum(sizes[with_], sizes[i]) >= similarity * np.maximum(sizes[with_], sizes[i]) - 1e-9]
        if not len(with_):
            continue
        marked[flat[offs[i] : offs[i + 1]]] = True
        for j in with_.tolist():
            if root[j] == root[i]:
                continue
            common = int(np.count_nonzero(marked[flat[offs[j] : offs[j + 1]]]))
            if common >= similarity * (int(sizes[i]) + int(sizes[j]) - common):
                out.append((i, j))
                root[root == root[j]] = root[i]
                left -= 1
        marked[flat[offs[i] : offs[i + 1]]] = False
    return out


def _mixed(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose bucket has several groups."""
    several = keyed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    return keyed.join(several, "key", "left_semi")


def remaining(keyed: DataFrame, sets: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` that join all groups of ``keyed (key, node, group)`` that have rows of a shared bucket alike by their ``sets (node, shingles)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            key, node, group = (table.column(k).to_numpy() for k in range(3))
            lists = table.column(3).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offs, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            got = [(lo + i, lo + j) for lo, hi in zip(cuts, cuts[1:]) if hi > lo + 1
                   for i, j in joining_pairs(group[lo:hi], offs[lo : hi + 1] - offs[lo], flat[offs[lo] : offs[hi]], similarity)]
            at = np.array(got, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if cut or held and held[0].column(0)[-1].as_py() != keys[0]:
                held.append(b.slice(0, cut))
                yield emit()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield emit()

    dealt = _mixed(_dealt(_mixed(keyed).select("key", "node", "group"), cell))
    rows = dealt.join(sets, "node").select("key", "node", "group", "shingles")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``; the component is the smallest id that links reach."""
    rows = settle(fingerprint_rows(docs, id_col, text_col), "simhash")
    reps = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-reps")
    # A fingerprint is a node of its own; a component is named by the smallest id of its rows.
    linked = components(links(reps.select(F.col("fp").alias("node"), "fp"), radius), "simhash-links")
    linked = settle(linked.join(reps, F.col("node") == F.col("fp")).select("fp", "component", "least"), "simhash-linked")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "component").select("fp", "component_id")
    named = reps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id"), "fp", "component_id")


#: Word shingles and similarity of near duplicates that are held against their texts; bits that such fingerprints differ in at most; keys of two least hashes each; nearest rows of a bucket that are looked at first.
WORDS, SIMILARITY, REACH, KEYS, NEAREST = 5, 0.8, 18, 8, 4
_TIMES = np.random.default_rng(8).integers(1, 1 << 63, 2 * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(raw: bytes, width: int) -> tuple[int, list[int]]:
    """A hash of a text's words in lower case, and those of its shingles."""
    ws = raw.lower().split()
    joined = b" ".join(ws)
    node = xxhash.xxh64_intdigest(joined, SEED + 1)
    if not ws:
        return node, []
    if len(ws) <= width:
        return node, [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return node, [digest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[width:])]


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _first() -> Column:
    """Of rows ``(id, h)``, the one of the smallest id; rows without one come last."""
    return F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "h"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """``(id, h, node, fp, keys)``: ``h`` is a hash of the text, ``node`` one of the words; ``fp`` counts each distinct shingle once; each key is one of the two least shingles under two orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.sized_batches(batches, 2):
            got = [_sketch((t or "").encode(), width) for t in b.column(2).to_pylist()]
            fps, keys = np.zeros(len(got), np.uint64), []
            for k, (_, h) in enumerate(got):
                if not h:
                    keys.append(np.zeros(0, np.int64))
                    continue
                x = np.unique(np.array(h, np.uint64))  # repeats weigh nothing in the similarity either
                bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                fps[k] = np.packbits(2 * bits > len(x)).view(">u8")[0]
                least = x[np.array([(x * m).argmin() for m in _TIMES])].reshape(KEYS, 2)
                keys.append(W.mix(least[:, 0] ^ W.mix(least[:, 1] + np.arange(KEYS, dtype=np.uint64))).view(np.int64))
            nodes = np.array([n for n, _ in got], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "node", "fp", "keys"])

    rows = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, node long, fp long, keys array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int = WORDS) -> DataFrame:
    """``(node, shingles)``: the distinct shingles of each text, as 32 bits of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.sized_batches(batches, 0):
            got = [_sketch((t or "").encode(), width) for t in b.column(0).to_pylist()]
            sets = [np.unique(np.array(h, np.uint64).astype(np.uint32)).view(np.int32) for _, h in got]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in got], np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, shingles array<int>")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """``(id, node, component_id)`` for every row: groups of texts whose shingle sets are alike by ``similarity`` (Jaccard) or more.

    Texts of the same words in any case are one node. Buckets of equal least
    shingles are compared bit-sliced within ``REACH`` bits; each node goes on with
    its nearest ones of each bucket, and these pairs are held against the shingle
    sets of their texts. That is the first round; then all rows of a bucket that
    are not of one group yet are held against each other, whatever their distance. A text without words is like others of its kind only;
    a group whose rows all have no id has a null id.
    """
    rows, reps, grouped = _grouped(docs, id_col, text_col, similarity, width)
    names = settle(grouped.groupBy("component").agg(F.min("first.id").alias("component_id")), "similar-names")
    names = grouped.select("node", "component").join(names, "component").select(F.col("node").alias("of"), "component_id")
    return rows.select("id", "node").join(names, F.col("node") == F.col("of")).select("id", "node", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows, those of each node, and ``(node, first, component)`` with the first row of each node."""
    rows = settle(sketches(docs, id_col, text_col, width), "similar")
    reps = settle(rows.groupBy("node").agg(_first().alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "similar-reps")
    keyed = reps.select(F.explode("keys").alias("key"), "fp", "node")

    def compare(key: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = near_pairs(key, fps, REACH, NEAREST)
        return np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])

    pairs = settle(_compared(keyed, CELL, compare).where("a <> b").distinct(), "similar-pairs")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    nodes = settle(keyed.join(shared, "key", "left_semi").select("node").distinct(), "similar-nodes")
    ids = reps.join(nodes, "node", "left_semi").select(F.col("first.id").alias("__first"), F.col("first.h").alias("__of"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _text_hash(text_col).alias("__h"))
    texts = texts.join(ids, F.col("__id").eqNullSafe(F.col("__first")) & (F.col("__h") == F.col("__of")), "left_semi")
    sets = settle(shingle_sets(texts, "__id", "__text", width).join(nodes, "node", "left_semi").dropDuplicates(["node"]), "similar-sets")
    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    found = settle(components(alike, "similar-links"), "similar-found")
    own = keyed.join(nodes, "node", "left_semi").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    more = settle(remaining(settle(own, "similar-keys"), sets, similarity), "similar-more")
    if not more.isEmpty():
        found = settle(components(found.toDF("a", "b").union(more), "similar-links"), "similar-all")
    grouped = reps.select("node", "first").join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    return rows, reps, grouped


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """One row of each group of similar texts, that of the smallest id; rows without an id come last.

    Rows that repeat an id are told apart by their texts, as are those without one.
    """
    grouped = _grouped(docs, id_col, text_col, similarity, width)[2]
    first = F.min(F.struct("first.nameless", "first.id", "node", "first.h"))
    kept = grouped.groupBy("component").agg(first.alias("first")).select(F.col("first.id").alias("__keep"), F.col("first.h").alias("__of"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # so no name of the table's own is in the way
    rows = docs.select(whole.alias("row"), F.col(id_col).alias("id"), _text_hash(text_col).alias("h"))
    same = F.col("id").eqNullSafe(F.col("__keep")) & (F.col("h") == F.col("__of"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "h"]).select("row.*")
