"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols merge from an agenda of adjacent pairs: always the pair of the
best score, the leftmost among equals, until no pair is a piece. Merges never
cross from a word to the next one's leading ``U+2581`` as no piece does, so each
distinct word is merged once and remembered. Many words merge in step: one matrix
row a word, one merge a row and round. Very long words use a heap. What no piece
covers falls back to byte pieces, or the unknown piece where there are none.

Every word is held against the sentencepiece library in the Arrow batch that
first has it. Should they ever differ it counts as the library has it, and each
text tells how many of its words do (``n_overruled``). One text of every batch is
also held against the library as a whole; there a difference ends the job, as it
does from the start for a model that normalises its texts.

Defined results: a null text is empty and gives begin and end only; repeated rows
and ids are coded row by row; texts are coded whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W

SPACE = "▁"
#: Characters of a word that merges in a matrix row, and words that a task remembers.
ROW, REMEMBER = 64, 600_000
_NONE = np.iinfo(np.int32).max


class Pairs:
    """Adjacent symbol pairs that form a piece, in a table with a few levels of slots."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        self.tables = []
        bits = max(8, int(len(keys)).bit_length() + 3)
        while len(keys):
            slot = self._slot(keys, bits)
            _, first = np.unique(slot, return_index=True)
            size = 1 << bits
            held, rank, into = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
            held[slot[first]], rank[slot[first]], into[slot[first]] = keys[first], ranks[first], merged[first]
            self.tables.append((bits, held, rank, into))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, merged = keys[rest], ranks[rest], merged[rest]
            bits = max(8, int(len(keys)).bit_length() + 2)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (0 best) and merged symbol of each pair; a rank of ``_NONE`` where there is none."""
        out_rank, out_into = np.full(keys.shape, _NONE, np.int32), np.zeros(keys.shape, np.int32)
        flat, at = keys.ravel(), np.arange(keys.size)
        ranks, intos = out_rank.reshape(-1), out_into.reshape(-1)
        for bits, held, rank, into in self.tables:
            slot = self._slot(flat, bits)
            found = held[slot] == flat
            ranks[at[found]], intos[at[found]] = rank[slot[found]], into[slot[found]]
            more = ~found & (held[slot] >= 0)
            if not more.any():
                break
            flat, at = flat[more], at[more]
        return out_rank, out_into


class Codec:
    """Encoder over a model's pieces; ``model`` holds the bytes of the model file."""

    def __init__(self, model: bytes) -> None:
        sp = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if sp.normalize("\ufb01  \u2460\uff21") != "\u2581\ufb01\u2581\u2581\u2460\uff21":
            raise ValueError("the model normalises texts beyond a leading word start")
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces run over word starts: this vocabulary needs whole-text agendas")
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.has_bytes = all(sp.is_byte(int(i)) for i in self.bytes)
        symbols = dict(plain)  # also characters that only occur within longer pieces
        for p in plain:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.symbols, self.pieces, self.wide = symbols, n, n + len(symbols) + 1
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        joined = [(symbols[p[:k]] * self.wide + symbols[p[k:]], rank[i], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.pairs = Pairs(*np.array(joined, np.int64).reshape(-1, 3).T)
        self.joined = {k: (int(r), i) for k, r, i in joined}
        self.alone = "" if any("\n" in p and len(p) > 1 for p in plain) else "\n"
        self.split = re.compile(f"{SPACE}*[^{SPACE}{self.alone}]+|{SPACE}+" + ("|\n" if self.alone else "")).findall
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0
        self.overruled = np.zeros(1 << 14, bool)

    def _finish(self, word: str, ids: list[int]) -> list[int]:
        """Symbols without an id of their own become bytes."""
        if all(0 <= i < self.pieces for i in ids):
            return ids
        out, at = [], 0
        name = {v: k for k, v in self.symbols.items()} if not hasattr(self, "name") else self.name
        self.name = name
        for i in ids:
            text = name[i] if i >= 0 else word[at]
            at += len(text)
            if 0 <= i < self.pieces:
                out.append(i)
            elif self.has_bytes:
                out += [int(x) for x in self.bytes[list(text.encode())]]
            else:
                out.append(self.unk)
        return out

    def agenda(self, word: str) -> list[int]:
        """One word by a heap of its adjacent pairs."""
        ids = [self.symbols.get(c, -1) for c in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and ids[i] >= 0 and ids[j] >= 0 and (got := self.joined.get(ids[i] * self.wide + ids[j])):
                heapq.heappush(heap, (got[0], i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if gone[i] or gone[j] or ids[i] != a or ids[j] != b or right[i] != j:
                continue
            ids[i] = self.joined[a * self.wide + b][1]
            gone[j] = True
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return self._finish(word, [x for x, g in zip(ids, gone) if not g])

    def _in_step(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of similar length, one matrix row each: how many ids each has, and all ids."""
        lens = np.fromiter(map(len, batch), np.int64, len(batch))
        width = int(lens.max())
        seen, inverse = np.unique(np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32), return_inverse=True)
        ids = np.array([self.symbols.get(chr(c), -1) for c in seen.tolist()], np.int32)
        sym = np.full((len(batch), width + 1), -1, np.int32)
        sym[:, :width][np.arange(width) < lens[:, None]] = ids[inverse]

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self.pairs(np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.wide + b))

        rank, into = look(sym[:, :-1], sym[:, 1:])
        rows, last = np.arange(len(batch)), np.full(sym.shape, -1, np.int32)
        left = lens.copy()
        while len(rows):
            best = rank.argmin(1)
            lane = np.arange(len(rows))
            over = rank[lane, best] == _NONE
            if over.any():
                last[rows[over], : sym.shape[1]] = sym[over]
                stay = ~over
                rows, sym, rank, into, best = rows[stay], sym[stay], rank[stay], into[stay], best[stay]
                if not len(rows):
                    break
                lane = np.arange(len(rows))
            left[rows] -= 1
            sym[lane, best] = into[lane, best]
            most = int(left[rows].max()) + 1
            shift = np.arange(most)  # what follows the merged pair moves up
            shift = shift + (shift > best[:, None])
            sym = np.take_along_axis(sym, np.minimum(shift, sym.shape[1] - 1), 1)
            sym[lane, left[rows]] = -1
            shift = np.minimum(shift[:, : most - 1] if most > 1 else shift, rank.shape[1] - 1)
            rank, into = np.take_along_axis(rank, shift, 1), np.take_along_axis(into, shift, 1)
            for at in (np.minimum(best, rank.shape[1] - 1), np.clip(best - 1, 0, rank.shape[1] - 1)):
                after = np.minimum(at + 1, sym.shape[1] - 1)
                r, m = look(sym[lane, at], np.where(after > at, sym[lane, after], -1))
                rank[lane, at], into[lane, at] = r, m
            rank[np.arange(rank.shape[1]) >= left[rows][:, None] - 1] = _NONE
        filled = np.arange(last.shape[1]) < left[:, None]
        flat = last[filled]
        odd = np.unique(np.repeat(np.arange(len(batch)), left)[(flat < 0) | (flat >= self.pieces)])
        if len(odd):
            parts = np.split(flat, np.cumsum(left)[:-1])
            for k in odd.tolist():
                parts[k] = np.array(self._finish(batch[k], parts[k].tolist()), np.int32)
                left[k] = len(parts[k])
            flat = np.concatenate(parts)
        return left, flat

    def merge(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words in turn."""
        size = np.fromiter(map(len, batch), np.int64, len(batch))
        order = np.argsort(size, kind="stable")
        rows = order[size[order] <= ROW]
        done = []
        for lo in range(0, len(rows), 10_000):
            part = rows[lo : lo + 10_000]
            done.append((part, *self._in_step([batch[k] for k in part.tolist()])))
        for k in order[len(rows) :].tolist():
            ids = self.agenda(batch[k])
            done.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        lens = np.zeros(len(batch), np.int64)
        for part, n, _ in done:
            lens[part] = n
        begin, flat = np.cumsum(lens) - lens, np.zeros(int(lens.sum()), np.int32)
        for part, n, ids in done:
            flat[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return lens, flat

    def _checked(self, batch: list[str], lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, with the library's ids for words that it codes otherwise, and which these are.

        The library puts a word start before every text; a word that has none is
        coded behind a line feed, which never merges, and stripped of both.
        """
        inner = np.fromiter((w[0] != SPACE for w in batch), bool, len(batch))
        library = self.library.encode([w[1:] if w[0] == SPACE else "\n" + w for w in batch], num_threads=1)
        lead = len(self.library.encode("\n"))
        bare = len(self.library.encode(SPACE)) if SPACE in batch else 0
        expected = [x[lead:] if own else x for x, own in zip(library, inner.tolist())]
        if bare:  # the library takes an empty text as one without a word start
            expected[batch.index(SPACE)] = [self.symbols[SPACE]] if self.symbols.get(SPACE, -1) in range(self.pieces) else [self.unk]
        flat = np.fromiter((x for p in expected for x in p), np.int32, sum(map(len, expected)))
        if np.array_equal(flat, ids):
            return lens, ids, np.zeros(len(batch), bool)
        cuts = np.cumsum(lens)[:-1]
        differs = np.array([own.tolist() != theirs for own, theirs in zip(np.split(ids, cuts), expected)])
        return np.fromiter(map(len, expected), np.int64, len(expected)), flat, differs

    def _learn(self, fresh: list[str]) -> None:
        lens, ids, differs = self._checked(fresh, *self.merge(fresh))
        first, total = len(self.known), len(ids)
        while len(self.begin) < first + len(fresh):
            self.begin, self.length, self.overruled = (np.concatenate([x, x]) for x in (self.begin, self.length, self.overruled))
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = ids
        self.begin[first : first + len(fresh)] = self.used + np.cumsum(lens) - lens
        self.length[first : first + len(fresh)] = lens
        self.overruled[first : first + len(fresh)] = differs
        self.used += total
        self.known.update(zip(fresh, range(first, first + len(fresh))))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text with begin and end, and how many of its words the library has otherwise."""
        parts = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self._reset()
        fresh = list({w for p in parts for w in p if w not in self.known})
        if fresh:
            self._learn(fresh)
        out, overruled = [], []
        for p in parts:
            at = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            lens = self.length[at]
            total = int(lens.sum())
            ids = np.empty(total + 2, np.uint32)
            ids[0], ids[-1] = self.bos, self.eos
            ids[1:-1] = self.flat[np.repeat(self.begin[at] - (np.cumsum(lens) - lens), lens) + np.arange(total)]
            out.append(ids)
            overruled.append(int(self.overruled[at].sum()))
        if texts:
            k = min(range(len(texts)), key=lambda k: abs(len(texts[k]) - 3000))
            if out[k].tolist() != self.library.encode(texts[k], add_bos=True, add_eos=True, num_threads=1):
                raise RuntimeError(f"a text of {len(texts[k])} characters is coded otherwise by the library")
        return out, overruled

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row a text: ``(id, n_tokens, ids, decoded, n_overruled)``, with ``digests`` the SHA-256 of ids and decoded text in their place.

    The model file is read by the driver and broadcast; its size does not depend on the data.
    """
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for b in W.sized_batches(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            own, overruled = codec.encode(texts)
            ids = [x.tolist() for x in own]
            decoded = codec.decode(ids)
            first = [b.column(0), pa.array([len(x) for x in own], pa.int64())]
            if digests:
                last = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                last = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*first, *last, pa.array(overruled, pa.int64())], names)

    names = ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]), "n_overruled"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, {last}, n_overruled long").withColumnRenamed("id", id_col)
