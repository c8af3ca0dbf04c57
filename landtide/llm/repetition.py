"""Quality rules from repetition inside a text, by suffix arrays.

Every text's words are sorted as suffixes (prefix doubling from three-word
windows, carried on only where windows still tie). Longest common prefixes of
neighbours in that order bound the maximal repeated substrings; the union of the
spans of those of ``min_words`` words or more and the longest of them are
limited. Repeats may overlap themselves.

Defined results: a null text is an empty one; an empty text has zeros and fails
the base rule; repeated rows and ids are judged row by row; other columns of the
input are not read. A text is never cut: slices hold whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W

#: Words of the shortest repeat that counts, the covered share and the longest repeat that a kept text may have.
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 8, 0.4, 150

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"


def _windows(h: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all positions by their first three words, in word order, told apart by text; the positions that share theirs."""
    n = len(h)
    ids = np.zeros(n + 2, np.int64)
    distinct, ids[:n] = np.unique(h, return_inverse=True)
    ids[:n] += 1  # 0: past the end of the text
    second, third = ids[1 : n + 1].copy(), ids[2:].copy()
    at = np.arange(n)
    second[at + 1 >= stop] = 0
    third[at + 2 >= stop] = 0
    if len(distinct) < (1 << 21) - 1:
        key = ids[:n] << 42 | second << 21 | third
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    else:
        order = np.lexsort((third, second, ids[:n]))
        same = np.ones(n - 1, bool)
        for x in (ids[:n], second, third):
            same &= x[order[1:]] == x[order[:-1]]
    same &= (text[order[1:]] == text[order[:-1]]) & (third[order[1:]] > 0)
    again = np.zeros(n, bool)
    again[1:] = same
    again[:-1] |= same
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, ~same], at, 0))
    return rank, order[again]


def repeats(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(in_windows, longest)``: whether each word lies in a repeated three-word window; the words of the longest repeat that starts at it, if three or more."""
    n = len(h)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    longest, near = np.zeros(n, np.int64), np.zeros(n + 3, np.int64)
    stop = offs[text + 1]
    level, at = _windows(h, text, stop) if n > 2 else (longest, longest[:0])
    np.add.at(near, at, 1)
    np.add.at(near, at + 3, -1)
    inside = np.cumsum(near)[:n] > 0
    if not len(at):
        return inside, longest
    levels, length, active = [level], 3, at
    while len(active):
        own, beyond = level[active], active + length
        inner = beyond < stop[active]
        second = np.where(inner, level[np.where(inner, beyond, 0)], -1)
        order = np.lexsort((second, own))
        active, own, second = active[order], own[order], second[order]
        index = np.arange(len(active))
        group = np.r_[True, own[1:] != own[:-1]]
        part = group | np.r_[True, second[1:] != second[:-1]]
        lone = part & np.r_[part[1:], True]
        level = level.copy()
        level[active] = own + np.maximum.accumulate(np.where(part, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        levels.append(level)
        length, active = 2 * length, active[~lone]
    order = at[np.argsort(level[at])]
    a, b = order[:-1], order[1:]
    tie = levels[0][a] == levels[0][b]
    a, b = a[tie], b[tie]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        fits = (i < stop[a]) & (j < stop[b])
        common += (3 << k) * (fits & (levels[k][np.where(fits, i, 0)] == levels[k][np.where(fits, j, 0)]))
    for _ in range(2):
        i, j = a + common, b + common
        fits = (i < stop[a]) & (j < stop[b])
        common += fits & (h[np.where(fits, i, 0)] == h[np.where(fits, j, 0)])
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return inside, longest


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    filled = [x for x in lines if x.strip()]
    return len(filled) - len(set(filled))


def analyse(column: pa.Array, min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """The columns of ``COLUMNS`` for an Arrow column of texts."""
    out: dict[str, list[np.ndarray]] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
    for _, _, buf, texts in W.slices(column):
        w = W.words(buf, texts)
        inside, longest = repeats(W.hashes(w), w.offs)
        cover = np.zeros(len(longest) + 1, np.int64)
        at = np.flatnonzero(longest >= min_words)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + longest[at], -1)
        heads = (buf & 0xC0) != 0x80
        raw = buf.tobytes()
        top = np.zeros(len(texts) - 1, np.int64)
        np.maximum.at(top, np.repeat(np.arange(len(top)), np.diff(w.offs)), longest)
        space = W._SPACE[buf]
        for name, x in (
            ("n_words", np.diff(w.offs)),
            ("word_chars", W.per_text(heads & ~space, texts)),
            ("n_symbols", W.per_text(_SYMBOL[buf], texts)),
            ("n_dup_lines", np.fromiter((_dup_lines(raw[i:j]) for i, j in zip(texts, texts[1:])), np.int64)),
            ("n_repeat_words", W.per_text(inside, w.offs)),
            ("covered_words", W.per_text(np.cumsum(cover)[:-1] > 0, w.offs)),
            ("longest_repeat", top),
        ):
            out[name].append(x)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id_col`` and ``COLUMNS`` for every row of ``docs``: one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.string_batches(batches):
            got = analyse(b.column(1), min_words)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, got.values())], [b.schema.names[0], *got])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def base_failed():
    """Fewer than 50 words, or over half of them in three-word windows that repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT):
    """The method's own verdict on a measured row."""
    return (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass both rules, with its own columns and no others.

    The texts are measured in the batches that carry the rows, so no join is needed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.string_batches(batches):
            m = analyse(b.column(text_col).cast(pa.string()))
            good = (m["n_words"] >= 50) & (100 * m["n_repeat_words"] <= 50 * m["n_words"])
            good &= (m["covered_words"] <= MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
