"""Secret scans: fixed patterns and a linear-chain conditional random field.

Words of a text are tagged as secret begin, inside or outside. Features of a word
are its shape (kinds of characters, length, how mixed they are), the kinds of the
two words before and of the one after (credential names, assignment signs), whether
it opens or closes a quotation, and one of the whole text (whether it has
credential names, and how many signs). The weights are fitted by gradient ascent on
the likelihood of a bounded sample of texts, in which what the patterns find are the
labels, at most ``PLACES`` of a text; each such place, and one more of every text,
is also given made-up secrets: of mixed letters and digits, with and without the
name before them; such secrets over several words, like keys in lines; and phrases
in quotation marks behind a name and a sign, beside phrases without these, which are
none. Beside them stand words that look like secrets and are none: ids, times, numbers of
things, long names, and digests behind their names. A step looks at ``BATCH`` sequences. Viterbi decoding runs over many texts in
step. Words of a decoded span that touch no span of the patterns are kept.

Defined results: a null text is empty and has no spans; repeated rows and ids are
scanned row by row; whole texts are scanned; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm import words as W
from landtide.llm.samples import smallest

#: Texts with and without pattern spans that the model is fitted on.
SAMPLE_WITH, SAMPLE_WITHOUT = 400, 200
#: Labelled places of a sampled text that are learned from, words on each side of a place, sequences of a step, steps.
PLACES, AROUND, BATCH, STEPS = 8, 12, 200, 120
#: Bytes of text whose words are tagged in step.
STEP_BYTES = 3 << 20
KINDS = ("assign", "access", "hex", "crf")
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs of 24 or more are the maximal ones
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX_BYTES = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the patterns in order, in code points."""
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(x in low for x in _NAMES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------------------------------------- features

_EDGE = b"\"'`.,;:!?()[]{}<>|#*$%&"
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+[.,;:!?]*")
_KEY = re.compile(rb"(?i)(pass|pwd|secret|token|key|credential|auth|bearer)")
_SIGN = re.compile(rb"[^A-Za-z0-9\x80-\xff]*[:=][^A-Za-z0-9\x80-\xff]*")
_QUOTES = b"\"'`"
#: Names of what looks like a secret and is none: digests, ids, numbers of things.
_LABEL = re.compile(rb"(?i)^[^a-z]*(commit|sha\d*|md5|crc\d*|checksum|digest|hash|etag|revision|uuid|guid|ids?|isbn|iban|serial|order|invoice|build|version|release|part|model|ref|integrity|nonce)[^a-z]*$")
_GROUPS = re.compile(rb"[-_:./+]+")
_LOGIN = re.compile(rb"://[^/\s:@]*:[^/\s@]{4,}@")
_KIND = bytes(1 if 48 <= c < 58 else 2 if 97 <= c < 123 else 3 if 65 <= c < 91 else 4 for c in range(256))
#: Shape classes: 0 plain word, 1 sign, 2 number-like, 3 short mixed, 4 long hex, 5 long mixed of three kinds, 6 long mixed of two kinds, 7 long of one kind, 8 address-like,
#: 9 in three or more short groups, 10 long and orderly (its kinds of characters seldom change), 11 address with a login, 12 short of three kinds.
#: Roles for neighbours: 0 none, 1 credential name, 2 sign, 3 ends with a sign, 4 name of something harmless. Marks: opens a quotation (1), closes one (2).
SHAPES, ROLES, MARKS, FILES = 13, 5, 4, 6


def code(word: bytes) -> int:
    """Shape class, role and marks of a word as one number."""
    core = word.rstrip(b".,;:!?)]}")
    return shape(word) * MARKS + (word.lstrip(b"([{")[:1] in _QUOTES and len(core) > 1) + 2 * (core[-1:] in _QUOTES and len(core) > 1)


def shape(word: bytes) -> int:
    """The shape class of a word, and its role for its neighbours, as ``shape * ROLES + role``."""
    role = 2 if _SIGN.fullmatch(word) else 1 if _KEY.search(word) else 4 if _LABEL.match(word) else 3 if word[-1:] in b":=" else 0
    core = word.strip(_EDGE)
    if _WORD.fullmatch(word) and len(core) < 24:
        return role
    if not any(c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" or c > 127 for c in core):
        return ROLES + role
    digits, lower, upper = (sum(a <= c <= b for c in core) for a, b in ((48, 57), (97, 122), (65, 90)))
    if _LOGIN.search(core):
        return 11 * ROLES + role
    if b"@" in core or b"/" in core and b"." in core or core.startswith(b"http"):
        return 8 * ROLES + role
    if digits >= len(core) - 4 and lower + upper <= 1:
        return 2 * ROLES + role
    if len(core) < 16 or any(c > 127 for c in core):
        return (12 if len(core) >= 8 and digits and lower and upper and not _GROUPS.search(core) else 3) * ROLES + role
    groups = _GROUPS.split(core)
    if len(groups) > 2 and max(map(len, groups)) <= 12:
        return 9 * ROLES + role
    if len(core) >= 24 and not core.translate(None, b"0123456789abcdefABCDEF-") and digits >= 4 and lower + upper >= 2:
        return 4 * ROLES + role
    kinds = core.translate(_KIND)
    if 4 * sum(a != b for a, b in zip(kinds, kinds[1:])) < len(core):
        return 10 * ROLES + role
    kinds = (digits > 1) + (lower > 1) + (upper > 1)
    return {3: 5, 2: 6}.get(kinds, 7) * ROLES + role


class Shapes(dict):
    """Word to code; forgets all once it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = code(word)
        return got


#: Feature blocks: own shape, roles of the two words before and of the next, the text, own shape with the roles before, own marks with the role before, own shape with the marks of the word before.
SIZES = (SHAPES, ROLES, ROLES, ROLES, FILES, SHAPES * ROLES * ROLES, MARKS * ROLES, SHAPES * MARKS)
OFFSETS = np.cumsum((0, *SIZES))


def of_files(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The feature of each text: no signs, few, or over one in fifty words, without and with credential names."""
    role = codes // MARKS % ROLES
    signs, names, n = W.per_text((role == 2) | (role == 3), offs), W.per_text(role == 1, offs), np.diff(offs)
    return (signs > 0).astype(np.int64) + (50 * signs > n) + 3 * (names > 0)


def features(codes: np.ndarray, offs: np.ndarray, files: np.ndarray | None = None) -> np.ndarray:
    """Eight feature numbers for each word of texts bounded by ``offs``; ``files`` are features of texts that these are parts of."""
    n = len(codes)
    own, role, mark = codes // (MARKS * ROLES), codes // MARKS % ROLES, codes % MARKS
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    before, before2, after, marked = np.zeros((4, n), np.int64)
    same = text[1:] == text[:-1]
    before[1:], marked[1:], after[:-1] = role[:-1] * same, mark[:-1] * same, role[1:] * same
    before2[2:] = role[:-2] * (text[2:] == text[:-2])
    files = of_files(codes, offs) if files is None else files
    blocks = (own, before, before2, after, files[text], (own * ROLES + before) * ROLES + before2, mark * ROLES + before, own * MARKS + marked)
    return np.stack([o + x for o, x in zip(OFFSETS, blocks)], 1)


# ---------------------------------------------------------------------------------------------- the field

#: Tags: 0 outside, 1 begin, 2 inside; inside follows begin or inside only.
_FORBID = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def _padded(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling length, and their lengths."""
    lens = np.diff(offs)
    order = np.argsort(-lens, kind="stable")
    return order, lens[order]


def viterbi(emit: np.ndarray, moves: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The best tags of every text, all texts in step. ``emit``: a score for each word and tag."""
    order, lens = _padded(offs)
    tags = np.zeros(len(emit), np.int8)
    if not len(emit):
        return tags
    moves = moves + _FORBID
    back = np.zeros((len(emit), 3), np.int8)
    begin = offs[:-1][order]
    live = int((lens > 0).sum())
    score = emit[begin[:live]] + np.array([0.0, 0.0, -1e4])
    final = np.zeros(len(order), np.int64)
    for t in range(1, int(lens[0]) + 1):
        now = int(np.searchsorted(-lens, -t, "left"))  # texts longer than t words
        now = int((lens[:live] > t).sum()) if live < 64 else now
        final[now:live] = score[now:].argmax(1)
        live, score = now, score[:now]
        if not live:
            break
        step = score[:, :, None] + moves
        best = step.argmax(1)
        at = begin[:live] + t
        back[at] = best
        score = step.max(1) + emit[at]
    filled = lens > 0
    last, tag = (begin + lens - 1)[filled], final[filled]
    left = lens[filled].copy()
    while len(last):
        tags[last] = tag
        tag = back[last, tag]
        left -= 1
        stay = left > 0
        last, tag, left = last[stay] - 1, tag[stay], left[stay]
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(x - top).sum(axis))


def gradient(weights: np.ndarray, moves: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the tags of all ``parts (features, tags)``, and its slopes; forward and backward run over all parts in step."""
    lens = np.array([len(t) for _, t in parts])
    inside = np.arange(lens.max()) < lens[:, None]
    feats, tags = np.zeros((*inside.shape, len(SIZES)), np.int64), np.zeros(inside.shape, np.int64)
    feats[inside], tags[inside] = np.concatenate([f for f, _ in parts]), np.concatenate([t for _, t in parts])
    emit, full = weights[feats].sum(2), moves + _FORBID
    emit[:, 0, 2] -= 1e4
    alpha, beta = np.empty(emit.shape), np.zeros(emit.shape)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, emit.shape[1]):
        alpha[:, t] = np.where(inside[:, t, None], _lse(alpha[:, t - 1, :, None] + full, 1) + emit[:, t], alpha[:, t - 1])
    for t in range(emit.shape[1] - 2, -1, -1):
        beta[:, t] = np.where(inside[:, t + 1, None], _lse(full + (emit[:, t + 1] + beta[:, t + 1])[:, None], 2), 0)
    total = _lse(alpha[:, -1], 1)
    own = np.exp(alpha + beta - total[:, None, None])[inside]
    follow = inside[:, 1:]
    pair = np.exp(alpha[:, :-1, :, None] + full + (emit + beta)[:, 1:, None] - total[:, None, None, None])[follow]
    slope, move = np.zeros_like(weights), -pair.sum(0)
    np.add.at(slope, feats[inside].ravel(), np.repeat(np.eye(3)[tags[inside]] - own, len(SIZES), axis=0))
    before, after = tags[:, :-1][follow], tags[:, 1:][follow]
    np.add.at(move, (before, after), 1.0)
    value = np.take_along_axis(emit, tags[:, :, None], 2)[inside].sum() + full[before, after].sum() - total.sum()
    return float(value), slope, move


def _labels(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and their tags by the patterns' values: 1 for the first word of a value, 2 for its others."""
    ws, tags = [], []
    values = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, b, k in base_spans(text) if k]
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        ws.append(m[0].encode())
        touched = [a for a, b in values if a < m.end() and b > m.start()]
        tags.append(0 if not touched else 1 if any(a >= m.start() for a in touched) else 2)
    return ws, np.array(tags, np.int64)


_LETTERS = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "0123456789")
_CREDENTIALS = [b"passphrase", b"password", b"secret", b"api_key", b"token", b"credentials", b"PASSWORD", b"auth_key"]
Sequence = tuple[list[bytes], list[int]]


_LABELS = [b"commit", b"sha256", b"checksum", b"uuid", b"id", b"etag", b"revision", b"build", b"serial", b"order", b"version", b"part"]


def harmless(rng: np.random.Generator, plain: list[bytes]) -> list[bytes]:
    """Words that look like a secret and are none: ids, times, numbers of things, long names, digests behind their names."""
    draw = lambda letters, lo, hi: "".join(rng.choice(list(letters), int(rng.integers(lo, hi)))).encode()
    upper, digits, low = "ABCDEFGHJKLMNPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    label = [_LABELS[int(rng.integers(len(_LABELS)))]]
    lead = [label, [label[0] + b":"], []][int(rng.integers(3))]
    kind = int(rng.integers(8))
    if kind == 0:
        word = b"-".join(draw(low.upper() if rng.integers(2) else low, n, n + 1) for n in (8, 4, 4, 4, 12))
    elif kind == 1:
        two = lambda hi: f"{int(rng.integers(hi)):02}"
        word = f"20{two(40)}-{two(13)}-{two(29)}T{two(24)}:{two(60)}:{two(60)}.{draw(digits, 3, 7).decode()}{('Z', '+01:00')[int(rng.integers(2))]}".encode()
    elif kind == 2:
        word = b"-".join(draw(upper if rng.integers(2) else digits, 2, 6) for _ in range(int(rng.integers(4, 7))))
    elif kind == 3:
        parts = [plain[int(k)].strip(_EDGE)[:14].decode(errors="ignore").capitalize().encode() for k in rng.integers(len(plain), size=int(rng.integers(3, 6)))]
        word = b"".join(parts) + (draw(digits, 2, 5) if rng.integers(2) else b"") + (b"Edition" if rng.integers(2) else b"")
    elif kind == 4:
        word = draw(upper, 2, 3) + draw(digits, 2, 3) + (draw(upper, 4, 5) if rng.integers(2) else b"") + draw(digits, 14, 19)
    elif kind == 5:
        lead, word = (label, [label[0] + b":"])[int(rng.integers(2))], "".join(rng.choice(_LETTERS, int(rng.integers(20, 65)))).encode()
    elif kind == 6:
        word = b"-".join([b"release", draw(digits, 1, 3) + b"." + draw(digits, 1, 3) + b"." + draw(digits, 1, 3), b"rc" + draw(digits, 1, 2), b"build" + draw(digits, 6, 9)])
    else:
        word = b"/" + b"/".join(plain[int(k)].strip(_EDGE) or b"x" for k in rng.integers(len(plain), size=int(rng.integers(4, 7))))
    return [*lead, word]


def made_up(rng: np.random.Generator, plain: list[bytes]) -> tuple[list[Sequence], list[Sequence]]:
    """Secrets of several makes, as words with tags, and quoted words that are none; ``plain`` are words to make phrases of."""
    token = lambda lo, hi: "".join(rng.choice(_LETTERS, int(rng.integers(lo, hi)))).encode()
    some = lambda lo, hi: [plain[int(k)] for k in rng.integers(len(plain), size=int(rng.integers(lo, hi)))]
    quote = (b'"', b"'")[int(rng.integers(2))]
    name = _CREDENTIALS[int(rng.integers(len(_CREDENTIALS)))]
    lead = [name + b":"] if rng.integers(2) else [name, b"="]
    one, many = [token(18, 44)], [token(20, 65) for _ in range(int(rng.integers(2, 6)))]
    phrase = some(3, 7)
    quoted = [quote + phrase[0], *phrase[1:-1], phrase[-1] + quote]
    other = some(1, 3) + [quote + phrase[0], *phrase[1:-1], phrase[-1] + quote]
    tagged = lambda ws: [1] + [2] * (len(ws) - 1)
    mixed = [b"".join((token(4, 8), "aZ7".encode()[int(rng.integers(3)) :][:1], token(4, 8)))]
    login = [b"://".join((rng.choice([b"postgres", b"mysql", b"amqp", b"https", b"redis"]), plain[0].strip(_EDGE)[:8] + b":" + token(8, 20) + b"@host" + str(int(rng.integers(90))).encode() + b".example:5432/base"))]
    told = [name, b"is"] if rng.integers(2) else lead
    secrets = [(head + ws, [0] * len(head) + tagged(ws)) for head, ws in ((lead, one), ([], one), (lead, many), ([], many), (lead, quoted), (told, mixed), ([], login))]
    return secrets, [(ws, [0] * len(ws)) for ws in (other, *(harmless(rng, plain) for _ in range(5)))]


def examples(text: str, rng: np.random.Generator) -> list[tuple[list[bytes], np.ndarray, int]]:
    """Windows of a text, as it is and with made-up secrets, with their tags and the feature of the text."""
    ws, tags = _labels(text)
    if not ws:
        return []
    codes = np.array([code(x) for x in ws], np.int64)
    file = int(of_files(codes, np.array([0, len(ws)]))[0])
    plain = [x for x, c in zip(ws, codes.tolist()) if c == 0] or [b"word"]
    out = []
    for at in [*np.flatnonzero(tags)[:PLACES].tolist(), int(rng.integers(len(ws)))]:
        lo, hi = max(0, at - AROUND), at + AROUND + 1
        part, own = ws[lo:hi], tags[lo:hi].tolist()
        out.append((part, own, file))
        secrets, others = made_up(rng, plain)
        k = at - lo
        named = any(c // MARKS % ROLES == 1 for c in codes[lo:hi])
        for words, marks in [*secrets, *others]:
            before, after = (part[:k], own[:k]), (part[k + 1 :], own[k + 1 :])
            if named and not any(t == 0 for t in marks[:1]):  # without a name: the one that stands there goes as well
                keep = [i for i in range(k) if own[i] or codes[lo + i] // MARKS % ROLES == 0]
                before = [part[i] for i in keep], [own[i] for i in keep]
            out.append((before[0] + words + after[0], before[1] + marks + after[1], file))
    return [(p, np.array(t, np.int64), f) for p, t, f in out]


def fit(texts: list[str], rounds: int = STEPS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row a feature, a column a tag) and moves, fitted on windows of the texts round labelled words and elsewhere."""
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((int(OFFSETS[-1]), 3)), np.zeros((3, 3))
    ready = []
    for text in texts:
        for part, own, file in examples(text, rng):
            codes = np.array([code(x) for x in part], np.int64)
            ready.append((features(codes, np.array([0, len(codes)]), np.array([file])), own))
    seen_w, seen_m = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    for _ in range(rounds if ready else 0):
        slope_w, slope_m = -1e-2 * weights, -1e-2 * moves
        _, w, m = gradient(weights, moves, [ready[k] for k in rng.permutation(len(ready))[:BATCH]])
        slope_w, slope_m = slope_w + w, slope_m + m
        seen_w += slope_w**2
        seen_m += slope_m**2
        weights += 0.5 * slope_w / np.sqrt(seen_w)
        moves += 0.5 * slope_m / np.sqrt(seen_m)
    if not ready:  # nothing to learn from: all is outside
        weights[:, 0] = 1.0
    return weights, moves


# ---------------------------------------------------------------------------------------------- the scan

def scan(texts: list[bytes], weights: np.ndarray, moves: np.ndarray, shapes: Shapes) -> list[list[tuple[int, int, int]]]:
    """Spans of every text: the patterns', then those of the field that touch none of them."""
    split = [t.split() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    look = shapes.__getitem__
    codes = np.fromiter((look(w) for x in split for w in x), np.int64, int(offs[-1]))
    feats = features(codes, offs) if len(codes) else np.zeros((0, len(SIZES)), np.int64)
    emit = np.zeros((len(codes), 3))
    for k in range(feats.shape[1]):
        emit += weights[feats[:, k]]
    tags = viterbi(emit, moves, offs)
    marked = np.flatnonzero(tags)
    by = np.searchsorted(offs, marked, "right") - 1
    told: dict[int, list[int]] = {}
    for k, at in zip(by.tolist(), marked.tolist()):
        told.setdefault(k, []).append(at - int(offs[k]))
    out = []
    for k, raw in enumerate(texts):
        text = raw.decode()
        spans = base_spans(text)
        if k in told:
            bounds = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            run: list[tuple[int, int]] = []
            last = -2
            for at in told[k]:
                a, b = bounds[at]
                if any(a < y and x < b for x, y, _ in spans):
                    continue  # the patterns have this word; what follows it stands alone
                if tags[offs[k] + at] == 2 and run and last == at - 1:
                    run[-1] = (run[-1][0], b)
                else:
                    run.append((a, b))
                last = at
            edge = _EDGE.decode()
            found = []
            for a, b in run:
                a += len(text[a:b]) - len(text[a:b].lstrip(edge))
                b -= len(text[a:b]) - len(text[a:b].rstrip(edge))
                if a < b:
                    found.append((a, b, 3))
            spans += found
            spans.sort(key=lambda s: (s[0], s[2]))
        out.append(spans)
    return out


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by ``MASK``."""
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join(parts) + text[at:]


def train(docs: DataFrame, text_col: str = "text", with_secrets: int = SAMPLE_WITH, without: int = SAMPLE_WITHOUT) -> tuple[np.ndarray, np.ndarray]:
    """The field fitted on a bounded sample: of the texts that a cheap test says may have a secret, and of all, those of the smallest hash."""
    text = F.col(text_col).cast("string")
    # A long text is as many texts, cut before white space where there is any.
    parts = F.when(F.length(text) <= 20_000, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(r"(?s).{1,20000}(?!\S)|.{1,20000}"), F.lit(0)))
    rows = docs.select(F.explode(parts).alias("text")).where("length(text) > 0").select("text", F.xxhash64("text").alias("h"))
    maybe = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}")
    total, likely = rows.agg(F.approx_count_distinct("h"), F.approx_count_distinct(F.when(maybe, F.col("h")))).first()
    return fit(smallest(rows, with_secrets, likely, maybe) + smallest(rows, without, total))


def _spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_crf, base_spans, spans)`` for every row; the model has a fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in W.sized_batches(batches, 1, STEP_BYTES):
            found = scan([(t or "").encode() for t in b.column(1).to_pylist()], *held.value, shapes)
            counts = [pa.array([sum(k == n for _, _, k in s) for s in found], pa.int64()) for n in range(4)]
            texts = [pa.array([_spans_text([x for x in s if x[2] < 3]) for s in found], pa.string()), pa.array([_spans_text(s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *texts], ["id", "n_assign", "n_access", "n_hex", "n_crf", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_spans string, spans string").withColumnRenamed("id", id_col)


def mask(docs: DataFrame, text_col: str = "text", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with the spans of its texts masked; a null text stays null, other columns are as they were."""
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for b in W.sized_batches(batches, at, STEP_BYTES):
            texts = b.column(at).to_pylist()
            found = scan([(t or "").encode() for t in texts], *held.value, shapes)
            new = pa.array([t and masked(t, s) for t, s in zip(texts, found)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
