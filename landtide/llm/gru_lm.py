"""Language-model scoring: a gated recurrent model over words, and add-one unigrams.

Counts: every training token is counted; up to ``HEAD`` of the most frequent words are known
to all tasks, the counts of the others are joined to the documents that have them.

Model: a gated recurrent unit reads the words; the output softmax is factored by
classes. The ``OUT`` most frequent words are in classes whose words have a softmax
of their own; the other known words are in classes of equal mass and the rest in
one more, within which a word's chance follows from its count. Output biases start
from the counts. Training is by truncated backpropagation in NumPy, state carried
from window to window. Every training text, copies included, is dealt by a hash of
its id and words to one of ``ROUNDS`` rounds and to a stream of that round, about
``STREAM`` tokens each, read in the order of the hash. All streams of a round start
from the same weights; their results are averaged by tokens. So neither the number
of partitions nor their order changes the weights. Scoring carries the state
through the whole document.

Words are coded once, for training and scoring, and the codes written. They are told apart by 64-bit hashes. Defined results: a null text is empty and
has the end token only; without training texts every token has chance 1 under the
base and the model knows only the unknown word; repeated rows and ids are scored
row by row; a row without an id trains; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.store import drop, settle

#: Words that all tasks know the counts of; of these, words with their own output; words of an output class; classes of the other known words.
HEAD, OUT, WIDE, STATIC = 1 << 18, 2048, 64, 16
HIDDEN, WINDOW = 24, 16
#: Rounds at least, tokens of a stream on average; a stream is read in up to ``LANES`` lanes, for about ``UPDATES`` updates.
ROUNDS, STREAM, LANES, UPDATES, RATE = 2, 3_000_000, 512, 366, 0.03
#: Tokens that are scored in step, and those of them whose outputs are computed at once.
STEP_TOKENS, BLOCK = 1 << 20, 1 << 14
#: Weights of a row when networks are averaged; tasks of a round.
_BLOCK, MOST_TASKS = 4096, 20_000
#: Folders that the texts of the rounds are written to.
FOLDERS = 6


class Lexicon(NamedTuple):
    """Counts of the training tokens. Classes: the output classes, the static ones, the rest, the end."""

    keys: np.ndarray  # sorted hashes of the known words
    rank: np.ndarray
    count: np.ndarray  # by rank
    tokens: int
    kinds: int
    rest_tokens: int
    rest_kinds: int
    ends: int
    group: np.ndarray  # class by rank
    inside: np.ndarray  # log10 of a static word's share of its class, by rank
    mass: np.ndarray  # tokens by class


def classes() -> int:
    return OUT // WIDE + STATIC + 2


def lexicon(hashes: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, ends: int) -> Lexicon:
    """From the known words by rank, and all training tokens and kinds, ends counted in both."""
    first = OUT // WIDE
    group = np.minimum(np.arange(len(hashes)) // WIDE, first)
    later = counts[OUT:].astype(float)
    upto = np.cumsum(later)
    if len(later):
        group[OUT:] = first + np.minimum(STATIC - 1, ((upto - later / 2) / upto[-1] * STATIC).astype(np.int64))
    mass = np.zeros(classes())
    np.add.at(mass, group, counts)
    rest = tokens - ends - int(counts.sum())
    mass[-2], mass[-1] = rest, ends
    inside = np.zeros(len(hashes))
    inside[OUT:] = np.log10(later / mass[group[OUT:]])
    order = np.argsort(hashes)
    return Lexicon(hashes[order], order, counts, tokens, kinds, rest, kinds - len(hashes) - (ends > 0), ends, group, inside, mass)


def _codes(lex: Lexicon, buf: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts: the rank of a known word, -1 of another, -2 of the end; bounds; hashes of the words in order."""
    w = W.words(buf, texts)
    h = W.hashes(w).view(np.int64)
    if len(lex.keys):
        at = np.minimum(np.searchsorted(lex.keys, h), len(lex.keys) - 1)
        ranks = np.where(lex.keys[at] == h, lex.rank[at], -1)
    else:
        ranks = np.full(len(h), -1)
    offs = w.offs + np.arange(len(texts))
    codes = np.full(offs[-1], -2, np.int64)
    keep = np.ones(len(codes), bool)
    keep[offs[1:] - 1] = False
    codes[keep] = ranks
    return codes, offs, h


def _classes_of(lex: Lexicon, codes: np.ndarray) -> np.ndarray:
    if not len(lex.group):
        return np.where(codes == -2, classes() - 1, classes() - 2)
    return np.where(codes >= 0, lex.group[np.maximum(codes, 0)], np.where(codes == -2, classes() - 1, classes() - 2))


def _inputs(lex: Lexicon, codes: np.ndarray) -> np.ndarray:
    """Rows of the input table: a word with its own output has its own, others share their class's."""
    return np.where((codes >= 0) & (codes < OUT), codes, OUT + _classes_of(lex, codes))


# ---------------------------------------------------------------------------------------------- the network

Net = dict[str, np.ndarray]


def fresh(lex: Lexicon, seed: int = 3) -> Net:
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, classes()
    bias = np.full(OUT, -30.0)
    own = lex.count[:OUT]
    if len(own):
        bias[: len(own)] = np.log(own / lex.mass[lex.group[: len(own)]])
    net = {
        "x": rng.normal(0, 0.1, (OUT + n, 3 * h)),
        "u": rng.normal(0, h**-0.5, (h, 3 * h)),
        "c": np.zeros((h, n)),
        "cb": np.log((lex.mass + 0.5) / (lex.mass.sum() + 0.5 * n)),
        "w": np.zeros((OUT, h)),
        "wb": bias,
    }
    return {k: v.astype(np.float32) for k, v in net.items()}


def _logistic(x: np.ndarray) -> np.ndarray:
    """In place; far below zero the exponential is infinite and the result 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(net: Net, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit: new state, gates, candidate, and what the reset gate scales."""
    n = HIDDEN
    hu = h @ net["u"]
    gates = _logistic(x[:, : 2 * n] + hu[:, : 2 * n])
    cand = np.tanh(x[:, 2 * n :] + gates[:, n:] * hu[:, 2 * n :])
    return cand + gates[:, :n] * (h - cand), gates, cand, hu[:, 2 * n :]


def _chances(logits: np.ndarray, place: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of logits (first axis: choices; changed in place), the log chance of the choice at ``place``, and the slopes of its negative if asked for."""
    at = np.arange(len(place))
    logits -= logits.max(0)
    own = logits[place, at]
    total = np.exp(logits, out=logits).sum(0)
    if slope:
        logits /= total
        logits[place, at] -= 1
    return own - np.log(total), logits


def _outputs(net: Net, lex: Lexicon, h: np.ndarray, codes: np.ndarray, slopes: Net | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log chance of each token (of a token of the rest: of that class), and the slope to ``h``."""
    slope = slopes is not None
    group = _classes_of(lex, codes)
    logits = net["c"].T @ h.T
    logits += net["cb"][:, None]
    logp, d = _chances(logits, group, slope)
    out, back = logp.astype(np.float64), None
    if slope:
        slopes["c"] += (d @ h).T
        slopes["cb"] += d.sum(1)
        back = d.T @ net["c"].T
    own = np.flatnonzero((codes >= 0) & (codes < OUT))
    own = own[np.argsort(group[own].astype(np.int16), kind="stable")]
    cuts = np.searchsorted(group[own], np.arange(OUT // WIDE + 1))
    place, states, logs = codes[own] % WIDE, h[own], np.empty(len(own), h.dtype)
    more = np.empty_like(states) if slope else None
    for g, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        words = slice(g * WIDE, (g + 1) * WIDE)
        logits = net["w"][words] @ states[a:b].T
        logits += net["wb"][words, None]
        logs[a:b], d = _chances(logits, place[a:b], slope)
        if slope:
            slopes["w"][words] += d @ states[a:b]
            slopes["wb"][words] += d.sum(1)
            np.matmul(d.T, net["w"][words], out=more[a:b])
    out[own] += logs
    if slope:
        back[own] += more
    elif len(lex.inside):
        out += np.log(10) * np.where(codes >= 0, lex.inside[np.maximum(codes, 0)], 0)
    return out, back


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray, often: int = 12) -> None:
    """``table[rows] += values`` where rows repeat: frequent rows are summed one by one, the others turn by turn, each once a turn."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # there are fewer rows than that
    r, values = rows[order], values.take(order, axis=0)
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    sizes = np.diff(np.r_[first, len(r)])
    for a, n in zip(first[sizes > often], sizes[sizes > often]):
        table[r[a]] += values[a : a + n].sum(0)
    rare, sizes = first[sizes <= often], sizes[sizes <= often]
    for turn in range(sizes.max(initial=0)):
        at = rare[sizes > turn] + turn
        table[r[at]] += values.take(at, axis=0)


def slopes_of(net: Net, lex: Lexicon, rows: np.ndarray, reset: np.ndarray, target: np.ndarray, h: np.ndarray) -> tuple[float, Net, np.ndarray]:
    """Of a window of steps (first axis) in many lanes: log-likelihood, slopes of its negative, and the state after it.

    ``rows``: input rows; ``reset``: 0 where the state is cleared before a step; ``h``: the state carried in.
    """
    size, lanes = rows.shape
    n, kind = HIDDEN, net["u"].dtype
    before, cand, hu, state = (np.empty((size, lanes, n), kind) for _ in range(4))
    gates, x, u = np.empty((size, lanes, 2 * n), kind), net["x"].take(rows, axis=0), net["u"]
    for t in range(size):
        h = np.multiply(h, reset[t], out=before[t])
        a = h @ u
        g = _logistic(np.add(x[t, :, : 2 * n], a[:, : 2 * n], out=gates[t]))
        hu[t] = a[:, 2 * n :]
        c = np.multiply(g[:, n:], hu[t], out=cand[t])
        c += x[t, :, 2 * n :]
        np.tanh(c, out=c)
        s = np.subtract(h, c, out=state[t])
        s *= g[:, :n]
        s += c
        h = s
    slopes = {k: np.zeros_like(v) for k, v in net.items()}
    logp, back = _outputs(net, lex, state.reshape(-1, n), target.ravel(), slopes)
    back = back.reshape(size, lanes, n)
    z, r = gates[:, :, :n], gates[:, :, n:]
    of_cand, of_z, of_r = (1 - z) * (1 - cand * cand), (before - cand) * z * (1 - z), hu * r * (1 - r)
    dx, du = np.empty((size, lanes, 3 * n), kind), np.empty((size, lanes, 3 * n), kind)
    dh, across = np.zeros((lanes, n), kind), np.ascontiguousarray(u.T)
    for t in range(size - 1, -1, -1):
        dh += back[t]
        d = dx[t]
        dc = np.multiply(dh, of_cand[t], out=d[:, 2 * n :])
        np.multiply(dh, of_z[t], out=d[:, :n])
        np.multiply(dc, of_r[t], out=d[:, n : 2 * n])
        du[t, :, : 2 * n] = d[:, : 2 * n]
        np.multiply(dc, r[t], out=du[t, :, 2 * n :])
        dh *= z[t]
        dh += du[t] @ across
        dh *= reset[t]
    slopes["u"] += before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
    _add_rows(slopes["x"], rows.ravel(), dx.reshape(-1, 3 * n))
    return float(logp.sum()), slopes, h


def train(net: Net, lex: Lexicon, codes: np.ndarray, rate: float = RATE) -> Net:
    """One pass over a stream of documents by truncated backpropagation (Adam); the state is carried, and cleared after an end.

    The stream is laid in lanes of one length, the last of which goes on with the stream's first tokens.
    """
    if not len(codes):
        return net
    lanes = int(np.clip(len(codes) // (UPDATES * WINDOW), 1, LANES))
    steps = -(-len(codes) // lanes)
    target = np.ascontiguousarray(np.resize(codes, lanes * steps).reshape(lanes, steps).T)
    source = np.concatenate([np.full((1, lanes), -2), target[:-1]])
    rows = _inputs(lex, source.ravel()).reshape(source.shape)
    reset = (source != -2).astype(np.float32)[:, :, None]
    net = {k: v.copy() for k, v in net.items()}
    one, two = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    h, windows = np.zeros((lanes, HIDDEN), np.float32), range(0, steps, WINDOW)
    for k, lo in enumerate(windows, 1):
        part = slice(lo, lo + WINDOW)
        _, slopes, h = slopes_of(net, lex, rows[part], reset[part], target[part], h)
        scale = np.float32(1 / target[part].size)
        step = rate * (1 - 0.9 * k / (len(windows) + 1))
        for name, g in slopes.items():
            g *= scale
            one[name] += 0.1 * (g - one[name])
            two[name] += 0.01 * (g * g - two[name])
            net[name] -= (step / (1 - 0.9**k)) * one[name] / (np.sqrt(two[name] / (1 - 0.99**k)) + 1e-6)
    return net


def score(net: Net, lex: Lexicon, codes: np.ndarray, offs: np.ndarray, window: int = 32) -> np.ndarray:
    """Natural log chance of each document, all in step from the longest to the shortest."""
    lens = np.diff(offs)
    order = np.argsort(-lens, kind="stable")
    begin, lens = offs[:-1][order], lens[order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), np.float32)
    inputs = np.empty(len(codes), np.int64)
    inputs[1:] = _inputs(lex, codes[:-1])
    inputs[offs[:-1]] = OUT + classes() - 1
    longest = int(lens[0]) if len(lens) else 0
    live = np.searchsorted(-lens, -np.arange(1, longest + 1), "right")
    for lo in range(0, longest, window):
        states, place, lane = [], [], []
        for t in range(lo, min(lo + window, longest)):
            n = live[t]
            at = begin[:n] + t
            h = _step(net, net["x"][inputs[at]], h[:n])[0]
            states.append(h)
            place.append(at)
            lane.append(np.arange(n))
        states, words = np.concatenate(states), codes[np.concatenate(place)]
        logp = np.concatenate([_outputs(net, lex, states[k : k + BLOCK], words[k : k + BLOCK])[0] for k in range(0, len(words), BLOCK)])
        total += np.bincount(np.concatenate(lane), logp, len(total))
    out = np.empty(len(order))
    out[order] = total
    return out


# ---------------------------------------------------------------------------------------------- the jobs

def _pack(net: Net) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def _unpack(flat: np.ndarray, like: Net) -> Net:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo, hi, buf, texts in W.slices(b.column(column)):
            yield b.slice(lo, hi - lo), W.lowered(buf), texts


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]], offs - offs[0]


def count(texts: DataFrame) -> DataFrame:
    """``(h, c)``: how often each word occurs in ``texts (text)``; summed in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        held, n = [], 0
        for _, buf, bounds in _slices(batches, 0):
            held.append(W.hashes(W.words(buf, bounds)))
            n += len(held[-1])
            if n > 3_000_000:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: whole classes of like counts, so that nothing need be sorted or sent but these."""
    like = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(like.alias("k")).count().collect()  # a few hundred classes at most
    left, bar = most, None
    for r in sorted(sizes, key=lambda r: -r["k"]):
        left -= r["count"]
        if left < 0:
            break
        bar = r["k"]
    return counts.where(like >= bar) if bar is not None else counts.limit(0)


def coded(rows: DataFrame, lex) -> DataFrame:
    """``rows (id, held_out, row, h, text)`` with ``codes`` and the hashes ``rest`` of unknown words in place of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, bounds in _slices(batches, 4):
            codes, offs, h = _codes(lex.value, buf, bounds)
            rest = codes[codes > -2] < 0
            where = np.concatenate([[0], np.cumsum(W.per_text(rest, offs - np.arange(len(offs))))])
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for o, v in ((offs, codes.astype(np.int32)), (where, h[rest]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *lists], ["id", "held_out", "row", "h", "codes", "rest"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, row long, h long, codes array<int>, rest array<long>")


def schedule(tokens: int) -> list[int]:
    """Streams of each round: about twice as many as in the one before, all of about as many tokens.

    So there are as many rounds as the number of streams has binary digits, and
    nearly all tokens are read from a network that was trained before.
    """
    streams = max(1, -(-tokens // STREAM))
    rounds = max(ROUNDS, streams.bit_length())
    return [max(1, round(streams * 2**k / (2**rounds - 1))) for k in range(rounds)]


def _dealt(texts: DataFrame, streams: Sequence[int]) -> DataFrame:
    """``(round, stream, h, codes)`` for each of ``texts (id, h, codes)``; rows of one id and text are spread like any others.

    ``streams`` has the streams of each round; a text goes to any of them with one chance.
    """
    again = settle(texts.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("of"), F.col("h").alias("has"), "n"), "lm-again")
    same = texts["id"].eqNullSafe(again["of"]) & (texts["h"] == again["has"])
    once = texts.join(again, same, "left_anti").select("id", "h", "codes", F.lit(1).alias("copy"))
    more = texts.join(again, same).groupBy("id", "h").agg(F.first("codes").alias("codes"), F.first("n").alias("n"))
    more = more.select("id", "h", "codes", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    place = F.pmod(F.xxhash64("id", "h", "copy", F.lit(1)), F.lit(sum(streams)))
    of, first = F.lit(0), F.lit(0)
    for k in range(1, len(streams)):
        begins = sum(streams[:k])
        of, first = F.when(F.col("place") >= begins, k).otherwise(of), F.when(F.col("place") >= begins, begins).otherwise(first)
    return once.union(more).select(place.alias("place"), "h", "codes").select(of.alias("round"), (F.col("place") - first).alias("stream"), "h", "codes")


def _round(texts: DataFrame, net: Net, lex, streams: int = 1) -> Net:
    """Weights trained on each of the ``streams`` of ``texts (stream, h, codes)`` from the same start, averaged by tokens in two steps."""
    start = texts.sparkSession.sparkContext.broadcast(net)

    def learn(table: pa.Table) -> pa.Table:
        codes, offs = _lists(table.column("codes"))
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        lens = np.diff(offs)[order]
        codes = codes[np.repeat(offs[:-1][order] - (np.cumsum(lens) - lens), lens) + np.arange(len(codes))]
        flat = _pack(train(start.value, lex.value, codes.astype(np.int64)))
        blocks = [flat[k : k + _BLOCK] for k in range(0, len(flat), _BLOCK)]
        n = len(blocks)
        own = int(table.column("stream")[0].as_py())
        return pa.table({"part": pa.array([own // 128] * n), "from": pa.array([own] * n), "block": pa.array(range(n), pa.int64()), "tokens": pa.array([len(codes)] * n), "values": pa.array(blocks, pa.list_(pa.float32()))})

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("from")
        n = table.column("tokens").to_numpy()
        v = np.array([x.values.to_numpy() for x in table.column("values")], np.float64)
        avg = (v * (n / n.sum())[:, None]).sum(0).astype(np.float32)
        first = lambda c: pa.array([table.column(c)[0].as_py()], pa.int64())
        return pa.table({"part": pa.array([0], pa.int64()), "from": first("part"), "block": first("block"), "tokens": pa.array([int(n.sum())], pa.int64()), "values": pa.array([avg], pa.list_(pa.float32()))})

    kinds = "part long, from long, block long, tokens long, values array<float>"
    # A stream is small for a shuffle and long for a task, so tasks are not to be joined by size.
    dealt = texts.repartition(min(streams, MOST_TASKS), "stream")
    got = dealt.groupBy("stream").applyInArrow(learn, kinds).groupBy("part", "block").applyInArrow(mean, kinds).groupBy("block").applyInArrow(mean, kinds)
    blocks = sorted(((r["block"], r["values"]) for r in got.collect()), key=lambda x: x[0])  # the size of one network
    return _unpack(np.concatenate([np.array(v, np.float32) for _, v in blocks]), net) if blocks else net


def fit(rows: DataFrame) -> tuple[Net, Lexicon, DataFrame, DataFrame]:
    """From ``rows (id, held_out, text)``: network and lexicon of those not held out, the settled counts of their words, and all rows as codes."""
    sc = rows.sparkSession.sparkContext
    train_rows = rows.where("not held_out")
    counts = settle(count(train_rows.select("text")), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train_rows.count()
    head = _head(counts, HEAD).toPandas().sort_values(["c", "h"], ascending=[False, True])
    lex = lexicon(head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64), int(total[0]) + ends, int(total[1]) + (ends > 0), ends)
    net, shared = fresh(lex), sc.broadcast(lex)
    numbered = rows.select("id", "held_out", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), "text")
    codes = settle(coded(numbered, shared), "lm-codes")
    streams = schedule(lex.tokens)
    # The last rounds have folders of their own, so that a round does not read the texts of all; the first share one, of a thirtieth or so.
    first = max(0, len(streams) - FOLDERS)
    dealt = _dealt(codes.where("not held_out").select("id", "h", "codes"), streams).withColumn("folder", F.greatest("round", F.lit(first)))
    dealt = settle(dealt, "lm-rounds", ["folder"])
    for k, n in enumerate(streams):
        own = dealt.where((F.col("folder") == max(k, first)) & (F.col("round") == k))
        net = _round(own.select("stream", "h", "codes"), net, shared, n)
    drop(dealt)
    return net, lex, counts, codes


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    """Whether a row is kept from learning; a row without an id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def score_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row, learning from those not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(id_col).alias("held_out"))
    net, lex, counts, codes = fit(rows)
    held = rows.sparkSession.sparkContext.broadcast((net, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, lex = held.value
        known = np.append(np.log10(lex.count + 1.0), [np.log10(lex.ends + 1.0), 0.0])  # by code: those of the end and of the rest come last
        for b in batches:
            all_codes, bounds = _lists(b.column(3))
            lo = 0
            while lo < b.num_rows:  # whole texts, about as many tokens as are scored in step
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP_TOKENS, "right")) - 1)
                codes, offs = all_codes[bounds[lo] : bounds[hi]].astype(np.int64), bounds[lo : hi + 1] - bounds[lo]
                base = np.add.reduceat(known[codes], offs[:-1])
                found = W.per_text(codes >= 0, offs) + (lex.ends > 0)
                arrays = [pa.array(np.diff(offs)), pa.array(found), pa.array(base), pa.array(score(net, lex, codes, offs) / np.log(10))]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:3], *arrays], ["id", "held_out", "row", "n_tokens", "n_known", "base", "model"])
                lo = hi

    kind = rows.schema["id"].dataType.simpleString()
    scored = codes.select("id", "held_out", "row", "codes").mapInArrow(run, f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, model double")
    # The other words: none of them is frequent, so the join has no hot key.
    tail = codes.select("row", F.explode("rest").alias("h")).join(counts, "h", "left")
    tail = tail.groupBy("row").agg(F.count("*").alias("n"), F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs"))
    out = scored.join(tail, "row", "left")
    known, logs, n = (F.coalesce(c, F.lit(0)) for c in ("known", "logs", "n"))
    base = F.col("base") + logs - F.col("n_tokens") * float(np.log10(lex.tokens + lex.kinds + 1.0))
    model = F.col("model") + logs - n * float(np.log10(lex.rest_tokens + lex.rest_kinds + 1.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
