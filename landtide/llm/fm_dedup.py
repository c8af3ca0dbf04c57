"""Removal of passages that repeat anywhere in the corpus, by an FM-index per shard.

A window is ``WINDOW`` consecutive words; each word of a window whose words also
start anywhere else, in any text, is removed.

1. Each window has an anchor: the leftmost smallest hash of its eight-word grams.
   Equal windows have equal anchors, so a run of windows with one anchor (a
   segment) can only repeat where that anchor occurs again. Anchors that occur
   once are done.
2. Texts that are equal as wholes are one text with a multiplicity; all their
   windows repeat.
3. Segments are dealt to shards by anchor. A shard's distinct segments, twice those
   that it holds more than once, form one sequence with an FM-index: suffix array,
   Burrows-Wheeler transform, wavelet matrix. Segments are streamed against it:
   backward search gives matching statistics, the longest stretch of words up to a
   place whose interval is two or more. A window whose statistic reaches its length
   repeats. From one word to the next a statistic grows by one at most, so those of
   some places rule out the windows that end soon after, and these aren't searched.
4. An anchor with very many segments is salted over several shards. Windows that
   stay alone in such a shard are counted across shards by digest.

Defined results: a null text is empty; texts under 35 words lose nothing; repeated
rows are repeats of each other; ids may be null or repeat; other columns are not
read. Whole texts are searched, and no group is cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.store import settle

WINDOW, GRAM = 35, 8
#: Segments of a shard, on average; an anchor with more of them is salted. Windows from one that is searched first to the next.
SHARD, STRIDE = 2000, 5

#: A spot is the first window of a segment times this, plus how many there are; a run of windows with one anchor has at most WINDOW - GRAM + 1.
_RUN = 64
_NO_WORDS = hashlib.sha256(b"").hexdigest()


def anchors(h: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of word hashes ``h``: text, first window (counted in the text), windows, anchor hash."""
    n, text = len(h), np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.flatnonzero(np.arange(n) + window <= offs[text + 1]) if n else np.zeros(0, np.int64)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g[: n - j] = g[: n - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
    g = W.mix(g)
    value, where, span, wide = g, np.arange(n), 1, window - gram + 1
    while span < wide:
        step = min(span, wide - span)
        first = value[:-step] <= value[step:]
        value, where = np.where(first, value[:-step], value[step:]), np.where(first, where[:-step], where[step:])
        span += step
    least = where[at]
    new = np.r_[True, (least[1:] != least[:-1])]
    start = np.flatnonzero(new)
    lo = at[start]
    return text[lo], lo - offs[text[lo]], np.diff(np.r_[start, len(at)]), g[least[start]].view(np.int64)


class FMIndex:
    """Occurrence counts of word sequences of up to ``depth`` words; symbol 0 separates."""

    def __init__(self, seq: np.ndarray, depth: int = WINDOW) -> None:
        n, symbols = len(seq), int(seq.max(initial=0)) + 1
        self.n = n
        bwt = seq[self._suffixes(seq, depth + 1) - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.bits, self.ranks, self.zeros = [], [], []
        self.levels = range(max(1, (symbols - 1).bit_length()) - 1, -1, -1)
        for level in self.levels:
            bit = (bwt >> level & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    @staticmethod
    def _suffixes(seq: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first ``depth`` symbols or more; only those that tie are sorted again."""
        n, length = len(seq), 1
        order = np.argsort(seq, kind="stable")
        new = np.r_[True, seq[order[1:]] != seq[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        active = order[~(new & np.r_[new[1:], True])]
        active = active[seq[active] > 0]
        while len(active) and length < depth:
            second = np.where(active + length < n, rank[np.minimum(active + length, n - 1)], -1)
            by = np.lexsort((second, rank[active]))
            active, second = active[by], second[by]
            own, index = rank[active], np.arange(len(active))
            group = np.r_[True, own[1:] != own[:-1]]
            part = group | np.r_[True, second[1:] != second[:-1]]
            rank[active] = own + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
            active = active[~(part & np.r_[part[1:], True])]
            length *= 2
        return np.argsort(rank, kind="stable")

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Offset of ``symbol``'s occurrences before ``at`` in the last level's order."""
        for level, bits, ranks, zeros in zip(self.levels, self.bits, self.ranks, self.zeros):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = ranks[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what ``lo:hi`` stand for."""
        zero = self._rank(symbol, np.zeros(len(symbol), np.int64))
        base = self.first[symbol] - zero
        return base + self._rank(symbol, lo), base + self._rank(symbol, hi)

    def statistics(self, seq: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """For each place, the words of the longest stretch that ends with it and occurs twice or more, up to ``most``."""
        out, live = np.full(len(ends), most), np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        for k in range(most):
            lo, hi = self.extend(seq[ends[live] - k], lo, hi)
            stay = hi - lo > 1
            if not stay.all():
                out[live[~stay]] = k
                live, lo, hi = live[stay], lo[stay], hi[stay]
        return out

    def repeated(self, seq: np.ndarray, starts: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
        """Whether the window at each start occurs twice or more; ``starts`` rise, and follow each other within a text."""
        out, first = np.zeros(len(starts), bool), np.r_[True, np.diff(starts) != 1]
        index = np.arange(len(starts))
        run = index - np.maximum.accumulate(np.where(first, index, 0))
        probe = np.flatnonzero(run % stride == 0)
        found = self.statistics(seq, starts[probe] + window - 1, window)
        out[probe] = found >= window
        # The next probe of a text is ``stride`` further on; windows until then can only repeat once the statistic may have grown to their length.
        last = np.maximum.accumulate(np.where(run % stride == 0, index, 0))
        of = np.searchsorted(probe, last)
        rest = np.flatnonzero((run % stride > 0) & (found[of] + index - last >= window))
        out[rest] = self.statistics(seq, starts[rest] + window - 1, window) >= window
        return out


def shard_repeats(segments: list[bytes], windows: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment a flag for each of its windows; segments not ``wanted`` are in the index but not streamed against it."""
    place: dict[bytes, int] = {}
    which = np.fromiter((place.setdefault(s, len(place)) for s in segments), np.int64, len(segments))
    often = np.bincount(which) > 1
    code: dict[bytes, int] = {}
    parts, at, begin = [], 0, []
    for k, s in enumerate(place):
        ids = [code.setdefault(x, len(code) + 1) for x in s.split(b" ")]
        begin.append(at)
        for _ in range(1 + int(often[k])):
            parts.append(ids + [0])
            at += len(ids) + 1
    seq = np.fromiter((x for p in parts for x in p), np.int64, at)
    found = [np.ones(n, bool) for n in windows]
    which_wanted, first = np.unique(which[wanted], return_index=True)  # each distinct segment once
    if len(which_wanted):
        counts = windows[np.flatnonzero(wanted)[first]]
        starts = np.repeat(np.array(begin)[which_wanted], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        flags = dict(zip(which_wanted.tolist(), np.split(FMIndex(seq, window).repeated(seq, starts, window), np.cumsum(counts)[:-1])))
        for k in np.flatnonzero(wanted).tolist():
            found[k] = flags[int(which[k])]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, the digest of the words, and the segments of each text."""
    for b in W.string_batches(batches):
        for lo, hi, buf, texts in W.slices(b.column(2)):
            w = W.words(buf, texts)
            text, first, count, anchor = anchors(W.hashes(w), w.offs)
            raw = buf.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[i:j].split())).hexdigest() for i, j in zip(texts, texts[1:])]
            offs = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offs, pa.array(x, t)) for x, t in ((anchor, pa.int64()), (first * _RUN + count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(w.offs)), pa.array(sha), *lists], ["id", "key", "n_words", "sha", "anchors", "spots"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment of each text, with its words."""
    for b in W.sized_batches(batches, 2):
        rows = []
        for key, alone, text, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            ws = (text or "").encode().split()
            for x in items:
                first, count = divmod(x["spot"], _RUN)
                rows.append((x["anchor"], x["salts"], key, alone, first, count, b" ".join(ws[first : first + count + WINDOW - 1])))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["anchor", "salts", "key", "alone", "first", "count", "words"])


def _search(table: pa.Table) -> pa.Table:
    """Spans that repeat (digest null) and, in salted shards, windows that other shards may hold (digest set)."""
    segments = table.column("words").to_pylist()
    windows = table.column("count").to_numpy().astype(np.int64)
    first = table.column("first").to_numpy().astype(np.int64)
    alone = table.column("alone").to_numpy(zero_copy_only=False)
    salted = table.column("salts").to_numpy() > 1
    keys = table.column("key").combine_chunks()
    found = shard_repeats(segments, windows, alone | salted)
    # Runs of windows that repeat, over all segments at once; a window that repeats nowhere stands between segments.
    begin = np.cumsum(windows + 1) - windows
    flags = np.zeros(int((windows + 1).sum()) + 1, np.int8)
    flags[np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))] = np.concatenate(found) & np.repeat(alone, windows)
    edge = np.flatnonzero(np.diff(flags)) + 1
    of = np.searchsorted(begin, edge[::2], "right") - 1
    start, stop = (first[of] + e - begin[of] for e in (edge[::2], edge[1::2]))
    parts = [pa.table({"key": keys.take(pa.array(of)), "start": pa.array(start, pa.int32()), "stop": pa.array(stop + WINDOW - 1, pa.int32()), "digest": pa.nulls(len(of), pa.binary())})]
    rows, told = [], set()
    for k in np.flatnonzero(salted).tolist():
        ws, key = segments[k].split(b" "), keys[k].as_py()
        for i, again in enumerate(found[k].tolist()):
            digest = hashlib.blake2b(b" ".join(ws[i : i + WINDOW]), digest_size=16).digest()
            if alone[k] and not again:
                at = int(first[k]) + i
                rows.append((key, at, at + WINDOW, digest))
            elif digest not in told:  # one for the shard is enough
                told.add(digest)
                rows.append((None, None, None, digest))
    kinds = (("key", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary()))
    parts.append(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)}))
    return pa.concat_tables(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for b in W.sized_batches(batches, 1):
        rows = []
        for key, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            ws = (text or "").encode().split()
            gone = np.zeros(len(ws) + 1, np.int64)
            for s in spans:
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            left = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([x for x, keep in zip(ws, left.tolist()) if keep])
            rows.append((key, int(len(ws) - left.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["key", "n_removed", "kept_sha256", "kept"])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` for every row, and with ``with_text`` the words kept where some but not all were removed."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = settle(rows.mapInArrow(_scan, f"id {kind}, key binary, n_words long, sha string, anchors array<long>, spots array<long>"), "fm-scan")
    texts = settle(scanned.groupBy("key").agg(F.count("*").alias("m"), F.first(F.struct("id", "n_words", "anchors", "spots")).alias("of")).select("key", "m", "of.*"), "fm-texts")
    each = texts.select("key", F.explode(F.arrays_zip("anchors", "spots")).alias("s")).select("key", F.col("s.anchors").alias("anchor"), F.col("s.spots").alias("spot"))
    often = settle(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "fm-anchors")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    item = F.struct("anchor", "spot", F.ceil(F.col("n") / shard).cast("int").alias("salts"))
    wanted = each.join(often, "anchor").groupBy("key").agg(F.collect_list(item).alias("items"))
    wanted = wanted.join(texts.select("key", "id", (F.col("m") == 1).alias("alone")), "key")
    wanted = wanted.withColumnRenamed("key", "of")
    held = settle(rows.join(wanted, (rows["key"] == wanted["of"]) & rows["id"].eqNullSafe(wanted["id"])).select(rows["key"], "alone", "text", "items"), "fm-held")
    segments = held.mapInArrow(_segments, "anchor long, salts int, key binary, alone boolean, first int, count int, words binary")
    shards = max(1, -(-total // shard))
    cell = F.when(F.col("salts") > 1, F.xxhash64("anchor", F.pmod(F.xxhash64("key", "first"), "salts"))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = settle(segments.withColumn("cell", cell).groupBy("cell").applyInArrow(_search, "key binary, start int, stop int, digest binary"), "fm-found")
    across = found.where("digest is not null")
    twice = across.groupBy("digest").count().where("count > 1").select("digest")
    spans = found.where("digest is null").unionByName(across.where("key is not null").join(twice, "digest", "left_semi").select(*found.columns))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = held.where("alone").select("key", "text").join(spans, "key").select("key", "text", "spans").mapInArrow(_cut, "key binary, n_removed long, kept_sha256 string, kept string")
    whole = texts.where(f"m > 1 and n_words >= {WINDOW}").select("key", F.col("n_words").alias("n_removed"), F.lit(_NO_WORDS).alias("kept_sha256"), F.lit("").alias("kept"))
    changed = cut.unionByName(whole)
    if not with_text:
        changed = changed.drop("kept")
    out = scanned.select("id", "key", "n_words", "sha").join(changed, "key", "left")
    return out.select(F.col("id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_text else [])).withColumnRenamed("id", id_col)
