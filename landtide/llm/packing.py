"""Packing documents into sequences of bounded length by the sum-of-squares rule.

1. Tokens: white space parts the words of a text, and no token of the vocabulary
   runs over it, so each distinct word is coded once by the tokenizers library and
   remembered by the worker; words of plain letters are lowered and cut into runs
   here, and the library merges runs that are new, many at a time. One text of
   every batch is also coded as a whole by the library; a difference ends the job.
2. Pieces: a text's ids with one more id behind them; only texts longer than a
   sequence are cut.
3. Places: pieces are dealt by a hash of their row to groups of about ``GROUP``, so
   no task holds more, whatever ids the rows have. Within a group the longest piece
   comes first; each goes where the sum over gaps of (open sequences with this gap)
   squared becomes smallest, to the smaller gap among equals. A sequence is
   opened only where no open one has room. As all groups have like lengths, each
   ends with about one sequence that is not full.

Defined results: a null text is empty and is one piece of the one id; rows of equal
ids are packed as rows; null ids go along; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.store import settle

LIMIT, END = 2048, 0
#: Pieces of a group on average; words and runs of letters that a worker remembers; bytes of a text coded at a time; runs merged by one call.
GROUP, REMEMBER, WINDOW, TOGETHER = 1 << 14, 500_000, 1 << 20, 200
#: Words of characters that the vocabulary's normalisation only lowers, one by one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: The parts that the vocabulary tells apart in such words.
_RUNS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall


class Coder:
    """Ids of texts under a word-end vocabulary; ``model`` holds the bytes of the tokenizer's file."""

    def __init__(self, model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_buffer(model)
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {"\n": b""}

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, fresh: list[str]) -> None:
        """Runs of letters, digits or signs that are new; the token that ends a run tells them apart."""
        lots = [fresh[k : k + TOGETHER] for k in range(0, len(fresh), TOGETHER)]
        for lot, e in zip(lots, self.merger.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(lot):
                raise RuntimeError("a run of this vocabulary has not just one token at its end")
            flat = ids.tobytes()
            self.runs.update(zip(lot, (flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist()))))

    def _learn(self, fresh: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in fresh]
        plain = [bool(_PLAIN(t)) and not any(s in t for s in self.special) for t in texts]
        runs = _RUNS("\n".join(t for t, p in zip(texts, plain) if p).lower()) + ["\n"]
        self._merge(list(set(runs).difference(self.runs)))
        got, ids = [], []
        for r in runs:
            if r == "\n":
                got.append(b"".join(ids))
                ids = []
            else:
                ids.append(self.runs[r])
        self.words.update(zip((w for w, p in zip(fresh, plain) if p), got))
        odd = [k for k, p in enumerate(plain) if not p]
        self.words.update(zip((fresh[k] for k in odd), self._coded([texts[k] for k in odd])))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > REMEMBER:
            self.words = {}
        if len(self.runs) > REMEMBER:
            self.runs = {"\n": b""}
        parts = [t.split() for t in texts]
        fresh = set().union(*parts).difference(self.words)
        if fresh:
            self._learn(list(fresh))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, p)), "<u4") for p in parts]

    def long(self, text: bytes) -> np.ndarray:
        """A text of any length, a window of whole words at a time."""
        ids, lo = [], 0
        while lo < len(text):
            gap = _GAP(text, lo + WINDOW)
            hi = gap.end() if gap else len(text)
            ids += self.encode([text[lo:hi]])
            lo = hi
        return np.concatenate(ids) if ids else np.zeros(0, "<u4")

    def check(self, texts: list[bytes], ids: list[np.ndarray]) -> None:
        """The text nearest to 3000 bytes, coded as a whole by the library."""
        k = min(range(len(texts)), key=lambda k: abs(len(texts[k]) - 3000))
        if len(texts[k]) <= WINDOW and self._coded([texts[k].decode(errors="replace")])[0] != ids[k].tobytes():
            raise RuntimeError(f"a text of {len(texts[k])} bytes is coded otherwise by the library")


_GAP = re.compile(rb"[ \t-\r]").search
_CODERS: dict[int, Coder] = {}


def _coder(model: bytes) -> Coder:
    """The coder of this worker: tasks that it runs one after another share what is remembered."""
    key = zlib.crc32(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, crc, lot)`` and, if asked for, the ``ids`` of each piece; ``lot`` numbers the rows.

    The tokenizer's file is read by the driver and broadcast; its size does not depend on the data.
    """
    with open(tokenizer_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["id", "piece", "start", "length", "crc", "lot", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lot = _coder(model.value), TaskContext.get().partitionId() << 33
        for b in batches:
            for lo, hi, buf, bounds in W.slices(b.column(1)):
                at = bounds.tolist()
                texts = [buf[x:y].tobytes() for x, y in zip(at, at[1:])]
                coded = [coder.long(texts[0])] if len(texts) == 1 else coder.encode(texts)
                coder.check(texts, coded)
                cut, row, piece = [], [], []
                for k, ids in enumerate(coded):
                    whole = np.append(ids, np.uint32(end)).astype("<u4")
                    own = [whole[x : x + limit] for x in range(0, len(whole), limit)]
                    cut += own
                    row += [k] * len(own)
                    piece += range(len(own))
                piece = np.array(piece, np.int32)
                lens = np.array([len(x) for x in cut], np.int64)
                columns = [b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * limit), pa.array(lens), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(lot + np.arange(len(cut)))]
                if with_ids:
                    flat = np.concatenate(cut).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(flat)))
                lot += len(cut)
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long, lot long" + (", ids array<int>" if with_ids else ""))


def places(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, in the order given, by the sum-of-squares rule.

    With N(g) open sequences of gap g, a piece of s moves one from gap g to g - s,
    which changes the sum of squares by 2 (N(g - s) - N(g) + 1), or by 1 - 2 N(g)
    where it closes the sequence; so the least N(g - s) - N(g) is sought, with N(0) = 0.
    """
    count, taken = np.zeros(limit + 1, np.int64), np.full(limit + 1, -(1 << 60), np.int64)  # taken: count, and far below it where there is none
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    which, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def change(gap: int, by: int) -> None:
        if gap:
            count[gap] += by
            taken[gap] = count[gap] or -(1 << 60)

    for k, s in enumerate(lengths.tolist()):
        gap = s + int((count[: limit + 1 - s] - taken[s:]).argmin())
        if taken[gap] < 0:
            gap, at = limit, opened
            opened += 1
        else:
            at = stacks[gap].pop()
            change(gap, -1)
        which[k], offset[k] = at, limit - gap
        stacks[gap - s].append(at)
        change(gap - s, 1)
    return which, offset


def pack(cut: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``lot``."""
    cut = settle(cut, "pack-pieces")
    groups = max(1, -(-cut.count() // group))

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("lot").to_numpy(), -table.column("length").to_numpy()))
        table = table.take(pa.array(order))
        which, offset = places(table.column("length").to_numpy(), limit)
        first = table.column("group")[0].as_py() << 24
        return table.drop_columns(["lot", "group"]).append_column("sequence_id", pa.array(first + which)).append_column("offset", pa.array(offset))

    fields = [f for f in cut.schema if f.name != "lot"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("lot"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, spans)``: the ids of each sequence and, in their order, which piece has which of them; ``packed`` has ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("spans"))
