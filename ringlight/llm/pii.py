"""Operator 8: personal data by fixed patterns and a linear-chain conditional random field.

Four kinds have fixed patterns: email, ip, card and phone; a match that fails its kind's check is dropped and
not tried again shorter. A conditional random field over word-shape features, trained on a small labelled
table that this module makes, adds spans that overlap none of these: numbers and addresses in other forms, and
secrets. It reads the neighbourhoods (``REACH`` words to each side) of all words with a digit or an at sign;
neighbourhoods that meet are one sequence. Viterbi decodes the sequences of a block together, by length.

Null and empty texts have no spans. Repeated rows each give a row. Offsets count code points of the whole text,
ends are exclusive; scans take time in proportion to the text, however long its runs of digits or letters."""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, map_texts, read_table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
REACH = 3

#: Fixed patterns. A look-behind keeps a failed run of digits from being tried again from its inside.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of a local part before each at sign, leftmost first: a local part can only end at its at sign."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := AT_DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


# ---- the model -----------------------------------------------------------------------------------------

LABELS = ("none", *KINDS)
#: Words whose presence next to a value tells its kind.
CUES = frozenset("phone tel call fax mobile card visa ip host server email mail contact token key secret password api from at version copyright".split())
RUNS = (0, 1, 2, 3, 4, 6, 9, 12, 15, 19)


def shape(word: str) -> str:
    s = re.sub(r"[A-ZÀ-Þ]+", "A", word)
    s = re.sub(r"[^\W\d_A]+", "a", s)
    return re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", s)


def features(word: str) -> list[str]:
    """What one word says of itself: its shape, its amounts of digits and letters, its marks."""
    core = word.strip("\"'.,;:!?()[]{}<>*#$%&|")
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    out = [f"s={shape(core)}", f"d={sum(digits > x for x in RUNS)}", f"l={sum(letters > x for x in RUNS)}"]
    out += [f"c={c}" for c in "@.-+()=:_/" if c in word]
    if digits and letters and len(core) >= 16 and core.isalnum():
        out.append("mixed")
    if core.count(".") == 3 and digits == len(core) - 3:
        out.append("quad")
    if "@" in core and "." in core.partition("@")[2]:
        out.append("address")
    if core.lower() in CUES:
        out.append(f"w={core.lower()}")
    return out


def window(words: list[str]) -> list[list[str]]:
    """Features of each word of a sequence, with its neighbours'."""
    own = [features(w) for w in words]
    n = len(own)
    return [own[i] + [f"-1{x}" for x in (own[i - 1] if i else ["edge"])] + [f"+1{x}" for x in (own[i + 1] if i + 1 < n else ["edge"])] + [f"-2{x}" for x in (own[i - 2] if i > 1 else ()) if x[0] == "w"] for i in range(n)]


def labelled_table(rows: int = 450, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The training table: invented sentences with the label of each word."""
    r = random.Random(seed)
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9)))
    wrap = lambda w: r.choice(["{}", "{}", "{}", "{}.", "{},", "{}!!", "{}###", "({})", "{}%%%"]).format(w)

    def card_number():
        body = dig(15)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def value(kind: int) -> list[str]:
        if kind == 1:
            return [r.choice([f"{name()}.{dig(2)}@{name()}{dig(1)}.example.com", f"{name()}@{name()}.org", f"{name()}_{name()}@{name()}.{name()}.net", f"<{name()}@{name()}.com>", f"{name()}'{name()}@{name()}.com"])]
        if kind == 2:
            return [".".join(str(r.randint(1, 255)) for _ in range(4))]
        if kind == 3:
            c = card_number()
            return r.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join((c[:4], c[4:8], c[8:12], c[12:]))]])
        if kind == 4:
            a, b, c = dig(3), dig(3), dig(4)
            return r.choice([[f"+{dig(1)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{dig(2)}", dig(3), dig(3), dig(4)], [f"{a}.{b}.{c}"]])
        return [r.choice(['"{}"', "{}", "'{}'"]).format(r.choice([hexa(40), hexa(32), "sk_" + hexa(24), hexa(20).upper() + dig(4)]))]

    cue = {1: ["email", "contact", "mail", ""], 2: ["ip", "from", "host", "server", ""], 3: ["card", "visa", ""], 4: ["phone", "call", "tel", "mobile", ""], 5: ["token =", "key:", "secret =", "password:", "api key ="]}
    plain = lambda: r.choice([
        dig(r.randint(1, 4)), f"{dig(1)}.{dig(1)}", f"{dig(2)}:{dig(2)}", f"{r.randint(1900, 2030)}", f"{dig(2)}%", f"${dig(2)}.{dig(2)}", f"v{dig(1)}.{dig(1)}.{dig(1)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{dig(1)}th", f"[{dig(2)}]", "@", f"@{name()}", f"{name()}{dig(2)}", f"{dig(3)},{dig(3)}", f"{dig(1)}.", f"{dig(2)}/{dig(2)}/{r.randint(1900, 2030)}", f"{dig(6)}", f"{dig(8)}"])
    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                words.append(r.choice([name(), name().capitalize(), name().upper(), wrap(name()), "|", "version", "copyright"]))
                labels.append(0)
            kind = r.randint(0, 9)
            if 1 <= kind <= 5:
                for w in r.choice(cue[kind]).split():
                    words.append(w)
                    labels.append(0)
                v = value(kind)
                if r.random() < 0.3:
                    v[-1] = wrap(v[-1])
                words += v
                labels += [kind] * len(v)
            else:
                words.append(plain())
                labels.append(0)
        for _ in range(r.randint(0, 3)):
            words.append(wrap(name()))
            labels.append(0)
        out.append((words, labels))
    return out


class Field:
    """Weights of the features and of the transitions between labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        return np.array([self.emit[[i for x in fs if (i := get(x)) is not None]].sum(axis=0) for fs in window(words)])

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence, of equals the first by ``LABELS``; sequences of one length go step by step
        together."""
        out: list = [None] * len(sequences)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            by_length.setdefault(len(s), []).append(i)
        for n, which in by_length.items():
            e = np.stack([self.scores(sequences[i]) for i in which])
            best, back = e[:, 0], []
            for t in range(1, n):
                step = best[:, :, None] + self.move
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + e[:, t]
            path = np.empty((len(which), n), np.int64)
            path[:, -1] = best.argmax(axis=1)
            rows = np.arange(len(which))
            for t in range(n - 2, -1, -1):
                path[:, t] = back[t][rows, path[:, t + 1]]
            for k, i in enumerate(which):
                out[i] = path[k]
        return out


def train(table: list[tuple[list[str], list[int]]], rounds: int = 60, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Penalised maximum likelihood: gradients by forward and backward sums, steps by Adam."""
    feats = [window(w) for w, _ in table]
    index = {f: i for i, f in enumerate(sorted({x for s in feats for fs in s for x in fs}))}
    n, steps, count = len(table), max(len(w) for w, _ in table), len(LABELS)
    row, col, fid, lengths = [], [], [], np.array([len(w) for w, _ in table])
    for i, s in enumerate(feats):
        for t, fs in enumerate(s):
            for x in fs:
                row.append(i), col.append(t), fid.append(index[x])
    cell, fid = np.array(row) * steps + np.array(col), np.array(fid)
    inside = np.arange(steps) < lengths[:, None]
    gold = np.zeros((n, steps), np.int64)
    for i, (_, y) in enumerate(table):
        gold[i, : len(y)] = y
    truth = np.zeros((n, steps, count))
    truth[inside, gold[inside]] = 1
    both = inside[:, 1:] & inside[:, :-1]
    moved = np.zeros((count, count))
    np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    emit, move = np.zeros((len(index), count)), np.zeros((count, count))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for k in range(1, rounds + 1):
        e = np.stack([np.bincount(cell, emit[fid, j], n * steps) for j in range(count)], axis=1).reshape(n, steps, count)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, steps):
            a[:, t] = np.where(inside[:, t, None], lse(a[:, t - 1, :, None] + move, 1) + e[:, t], a[:, t - 1])
        total = lse(a[:, -1], 1)
        for t in range(steps - 2, -1, -1):
            b[:, t] = np.where(inside[:, t + 1, None], lse(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
        p = np.exp(a + b - total[:, None, None]) * inside[:, :, None]
        pair = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        diff = (truth - p).reshape(-1, count)
        g_emit = np.stack([np.bincount(fid, diff[cell, j], len(index)) for j in range(count)], axis=1) / n - ridge * emit
        g_move = (moved - pair.sum(axis=(0, 1))) / n - ridge * move
        for w, g, m, v in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(index, emit, move)


@functools.cache
def trained() -> Field:
    return train(labelled_table())


def plausible(kind: str, text: str) -> bool:
    """Least contents of a span that the model adds."""
    digits, letters = sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    if kind == "email":
        return "." in text.partition("@")[2] and bool(text.partition("@")[0])
    if kind == "ip":
        return text.count(".") == 3 and digits >= 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= digits <= 19 and not letters
    if kind == "phone":
        return 7 <= digits <= 15 and not letters
    return len(text) >= 16 and digits >= 4 and letters >= 4


EDGES = "\"'.,;:!?[]{}<>*#$%&|="


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Neighbourhoods of words with a digit or an at sign, as places of their words."""
    places = [m.span() for m in WORD.finditer(text)]
    out, upto = [], -1
    marks = iter(MARKED.finditer(text))
    at = next(marks, None)
    i, n = 0, len(places)
    while at is not None and i < n:
        lo, hi = 0, n
        lo = i
        while lo < hi:
            mid = (lo + hi) // 2
            if places[mid][1] <= at.start():
                lo = mid + 1
            else:
                hi = mid
        i = lo
        first, last = max(i - REACH, 0), min(i + REACH, n - 1)
        if out and first <= upto + 1:
            out[-1] += places[upto + 1 : last + 1]
        else:
            out.append(places[first : last + 1])
        upto = max(upto, last)
        end = places[i][1]
        while at is not None and at.start() < end:
            at = next(marks, None)
        i += 1
    return out


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Field) -> list[list[tuple[int, int, int]]]:
    """What the model adds to the spans of the patterns, for each text."""
    where = [(d, s) for d, t in enumerate(texts) if MARKED.search(t) for s in sequences(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (d, places), labels in zip(where, model.decode([[texts[d][a:b] for a, b in s] for d, s in where]), strict=True):
        t, k = texts[d], 0
        while k < len(labels):
            j = k
            while j + 1 < len(labels) and labels[j + 1] == labels[k] and labels[k] in (3, 4):
                j += 1
            if labels[k]:
                a, b = places[k][0], places[j][1]
                kind = KINDS[labels[k] - 1]
                edges = EDGES + ("" if kind == "phone" else "()")
                a += len(t[a:b]) - len(t[a:b].lstrip(edges))
                b = a + len(t[a:b].rstrip(edges))
                if plausible(kind, t[a:b]) and not any(a < y and x < b for _, x, y in base[d]):
                    out[d].append((labels[k] - 1, a, b))
            k = j + 1
    return out


def find(texts: list[str], model: Field) -> list[tuple[list, list]]:
    """Of each text: the spans of the patterns, and all spans."""
    base = [base_spans(t) if MARKED.search(t) else [] for t in texts]
    added = added_spans(texts, base, model)
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the patterns' spans and all spans, each as ``kind:start:end`` joined by commas, by kind and start."""
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def make():
        def f(texts, _):
            found = find(texts, shared.value)
            return {"base": [listed(b) for b, _ in found], "spans": [listed(a) for _, a in found]}

        return f

    return map_texts(df, make, "base string, spans string", text, keys, as_bytes=False)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with ``<kind>`` in place of each span; of spans that overlap, one for all, named for the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with the personal data of ``text`` replaced; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def make():
        def f(texts, block):
            at = block.schema.get_field_index(text)
            old = block.column(at)
            new = pa.array([redacted(t, a) for t, (_, a) in zip(texts, find(texts, shared.value), strict=True)], old.type, mask=old.is_null().to_numpy(zero_copy_only=False))
            return block.set_column(at, block.schema.field(at), new)

        return f

    return map_rows(df, make, text)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(read_table(spark, sf_dir, "documents"))
    number: Column = lambda k: (F.regexp_count("base", F.lit(f"(?:^|,){k}:"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
