"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed
into phrases, each the longest match in a language's automaton (or one character
where nothing matches), anew every ``WINDOW`` characters; the language with the
fewest phrases, weighed by the logarithm of its labelled text's length, wins.
Automata are dense transition tables, so that many windows of many texts are
parsed in step, for all languages at once.

Characters are letters in lower case, the ``LETTERS`` most frequent of the labelled
text each on their own and all others as one; a run of anything else is one
character. The labelled text is a bounded sample: per language the whole texts of
the smallest hash up to ``CHARS`` characters (fewer when there are many languages),
the last one cut there. Prediction reads whole texts.

Defined results: ``und`` with score 0 for a null text, one without letters, and
all texts where there is nothing to learn from; repeated rows and ids are judged
row by row; ties go to the first language in code point order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W

CHARS, ALL_CHARS, LETTERS, WINDOW = 40_000, 400_000, 62, 256
_FLAG = np.uint32(1 << 31)


class Model(NamedTuple):
    langs: list[str]
    classes: np.ndarray  # of each code point: 0 no letter, 1 another letter, 2.. a letter of the table
    table: np.ndarray  # next state times the width, flagged where this character begins a phrase
    roots: np.ndarray
    cost: np.ndarray  # of a phrase


def automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes``: a row a state, -1 for none; row 0 is the root."""
    goes: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in goes[at]:
            goes[at][c] = now
            at = link[at]
        if at >= 0:
            to = goes[at][c]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                copy = len(goes)
                goes.append(dict(goes[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[now] = copy
                while at >= 0 and goes[at].get(c) == to:
                    goes[at][c] = copy
                    at = link[at]
        last = now
    table = np.full((len(goes), width), -1, np.int64)
    for s, g in enumerate(goes):
        table[s, list(g)] = list(g.values())
    return table


def _classes(texts: list[str]) -> tuple[np.ndarray, int]:
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    top = {c: k + 2 for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])}
    out = np.zeros(0x110000, np.uint8)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if c.isalpha():
            low = c.lower()
            out[ord(c)] = top.get(low if len(low) == 1 else low[0], 1)
    return out, len(top) + 2


def characters(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class codes of all texts, runs of no letters as one; their bounds; whether each has a letter."""
    codes = classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    keep[offs[:-1][offs[:-1] < len(codes)]] = True
    letters = W.per_text(codes > 0, offs) > 0
    total = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], total[offs], letters


def phrases(model: Model, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Phrases of each text (row) in each language (column)."""
    lens = np.diff(offs)
    count = -(-lens // WINDOW)
    text = np.repeat(np.arange(len(lens)), count)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = offs[:-1][text] + within * WINDOW
    size = np.minimum(WINDOW, offs[1:][text] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, WINDOW + 1), "right")  # windows of t characters or more
    state = np.repeat(model.roots[:, None], len(size), 1)
    found = np.zeros(state.shape, np.int64)
    for t in range(WINDOW):
        n = live[t]
        if not n:
            break
        got = model.table[state[:, :n] + codes[begin[:n] + t]]
        found[:, :n] += got >> np.uint32(31)
        state[:, :n] = got & ~_FLAG
    out = np.zeros((len(lens), len(model.langs)), np.int64)
    np.add.at(out, text[order], found.T)
    return out


def build(samples: dict[str, str]) -> Model:
    langs = sorted(samples)
    classes, width = _classes(list(samples.values()))
    tables, roots, cost, base = [], [], [], 0
    for lang in langs:
        codes, _, _ = characters([samples[lang]], classes)
        table = automaton(codes.tolist(), width)
        start = np.where(table[0] >= 0, table[0], 0)
        goes = np.where(table >= 0, (base + table) * width, 0).astype(np.uint32)
        ends = ((base + start) * width).astype(np.uint32) | _FLAG
        goes = np.where(table >= 0, goes, ends[None])
        goes[0] |= _FLAG  # at the root every character begins a phrase
        tables.append(goes)
        roots.append(base * width)
        cost.append(np.log2(max(2, len(codes))))
        base += len(table)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.uint32)
    return Model(langs, classes, table, np.array(roots, np.uint32), np.array(cost))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chars: int = CHARS) -> Model:
    """The automata of a bounded sample of ``docs``; rows whose text or language is null teach nothing."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = rows.select("lang", "h", F.length("text").alias("chars")).groupBy("lang", "h").agg(F.min("chars").alias("chars"))
    sizes = {r["lang"]: (r["n"], r["chars"]) for r in distinct.groupBy("lang").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if not sizes:
        return build({})
    chars = max(2000, min(chars, ALL_CHARS // len(sizes)))
    # Distinct texts of small hashes, about three times the characters that are needed and a score of texts at least.
    share = {k: min(1.0, max(3 * chars / total, 20 / n)) for k, (n, total) in sizes.items()}
    low = F.pmod("h", F.lit(1 << 32))
    samples: dict[str, str] = {}
    while share:
        chance = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))[F.col("lang")]
        draw = rows.where(low < chance * float(1 << 32)).groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
        drawn: dict[str, str] = {}
        for r in sorted(draw.select("lang", low.alias("h"), "text").collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
            had = drawn.get(r["lang"], "")
            if len(had) < chars:
                drawn[r["lang"]] = (had + "\n" + r["text"])[:chars]
        samples |= drawn
        # Where a draw came short it is made anew with more, up to all distinct texts.
        share = {k: min(1.0, 8 * s) for k, s in share.items() if s < 1.0 and len(drawn.get(k, "")) < chars}
    return build(samples)


def judge(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text and the margin to the next one, as a share of it."""
    codes, offs, letters = characters(texts, model.classes)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    cost = phrases(model, codes, offs) * model.cost
    best = cost.argmin(1)
    least = cost[np.arange(len(texts)), best]
    cost[np.arange(len(texts)), best] = np.inf
    second = cost.min(1) if len(model.langs) > 1 else np.diff(offs) * model.cost[0]
    score = np.where(letters, 1 - least / np.maximum(second, 1e-9), 0.0)
    return [model.langs[k] if has else "und" for k, has in zip(best, letters)], np.clip(score, 0, 1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row. The model's size is bounded by ``ALL_CHARS``."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in W.string_batches(batches, 4096):
            for lo, hi, _, _ in W.slices(b.column(1)):
                langs, score = judge(own, [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether a row is kept from learning; a row without an id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
