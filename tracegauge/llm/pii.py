"""Personal data: four exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments (their shape, digits, checks and surroundings); a dynamic program
over entities of at most ``MAX_TOKENS`` tokens chooses boundaries and kinds together. It is trained here on
seeded sentences (``train``), never on the corpus, so a text is judged alike in every run and at every size.
Pattern matches always stay; segments that overlap none of them are added.

The program runs over the neighbourhoods of digits, ``@`` and bracketed "at" only: no segment without one of
these can be an entity. Null text counts as empty. Offsets are code points, ends exclusive. Ids may be null or repeated.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracegauge.llm.common import map_batches, with_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# The base patterns of each kind.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match starts inside a run of digits: the whole run would match too.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS = 14
#: Characters of context on either side of a trigger, and the longest token kept whole.
REACH = 40
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
HINTS = {
    "email": ("mail", "email", "contact", "write", "reach"), "ip": ("ip", "host", "address", "server", "from"),
    "card": ("card", "visa", "credit", "account", "paid"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their signs: a search from every start would be quadratic in unbroken text."""
    free = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (domain := DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield lo, free
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern; matches that fail their check are dropped."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# --- whole-span features -------------------------------------------------------------------------

FEATURES = (
    "bias", "length", "full_email", "spelled_email", "full_ip", "spaced_ip", "card_ok", "card_bad", "card_groups", "card_solid",
    "phone_digits", "few_digits", "many_digits", "area_code", "dashed_groups", "plus", "hint", "other_hint", "letters", "edge_touches",
    "open_bracket", "dotted", "date_like", "odd_mark", "joined_left", "joined_right", "starts_digit",
)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]+(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[A-Za-z0-9-]+)+")
_SPACED_IP = re.compile(r"[0-9]{1,3}(?: ?[.] ?| ?[\[(]\.[\])] ?)[0-9]{1,3}(?:(?: ?[.] ?| ?[\[(]\.[\])] ?)[0-9]{1,3}){2}")
_AREA = re.compile(r"(?:[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}")
_GROUPS = re.compile(r"(?:[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
_CARD_GROUPS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
_DATE = re.compile(r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Features of one candidate segment, all of them about the span as a whole or its surroundings."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    letters = sum(c.isalpha() for c in span)
    before, after = text[max(0, start - 24):start].lower(), text[end:end + 1]
    last = re.findall(r"[a-z]+", before)[-3:]
    hints = {k for k, words in HINTS.items() if any(w in words for w in last)}
    solid = n == len(span)
    plain = all(c in "0123456789 -." for c in span)
    checks = {
        "bias": 1.0, "length": math.log1p(end - start) / 3,
        "full_email": EMAIL.fullmatch(span) is not None, "spelled_email": _SPELLED.fullmatch(span) is not None,
        "full_ip": (m := IP.fullmatch(span)) is not None and all(int(p[:6]) <= 255 for p in m.groups()),
        "spaced_ip": m is None and _SPACED_IP.fullmatch(span) is not None,
        "card_ok": plain and 12 <= n <= 19 and luhn(digits), "card_bad": plain and 12 <= n <= 19 and not luhn(digits),
        "card_groups": _CARD_GROUPS.fullmatch(span) is not None, "card_solid": solid and 12 <= n <= 19,
        "phone_digits": 9 <= n <= 15, "few_digits": n < 7, "many_digits": n > 19,
        "area_code": _AREA.fullmatch(span) is not None, "dashed_groups": _GROUPS.fullmatch(span) is not None,
        "plus": span[0] == "+", "hint": kind in hints, "other_hint": bool(hints - {kind}), "letters": letters > 0 and kind != "email",
        "edge_touches": bool((start and text[start - 1].isalnum()) or after.isalnum()),
        "open_bracket": span.count("(") != span.count(")") or span.count("[") != span.count("]"), "dotted": "." in span,
        "date_like": _DATE.fullmatch(span) is not None, "odd_mark": any(c in span for c in "$%#\"'=,;:/|*&!?"),
        "joined_left": before[-1:] in tuple("._%+-@/"), "joined_right": re.match(r"[._%+@/-]\w", text[end:end + 2]) is not None,
        "starts_digit": span[0].isdigit(),
    }
    return [float(checks[f]) for f in FEATURES]


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Token ranges of at most MAX_TOKENS, with the kinds whose least needs they meet: digits, or one "at" sign."""
    digits, letters, signs = [0], [0], [0]
    for a, b in tokens:
        sign = text[a] == "@" or text[a:b].lower() == "at"
        digits.append(digits[-1] + (b - a if "0" <= text[a] <= "9" else 0))
        letters.append(letters[-1] + text[a].isalpha())
        signs.append(signs[-1] + sign)
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+(") or (a and text[a].isalnum() and text[a - 1].isalnum()):
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            end = text[tokens[j - 1][1] - 1]
            n = digits[j] - digits[i]
            if n > 19 and signs[j] == signs[i]:
                break
            if not end.isalnum() or text[tokens[j - 1][1]:tokens[j - 1][1] + 1].isalnum():
                continue  # an entity begins and ends with whole words and numbers
            if signs[j] - signs[i] == 1 and j - i > 2 and text[a] not in "+(":
                yield i, j, 0
            elif letters[j] == letters[i]:
                if 4 <= n <= 12 and text[a].isdigit():
                    yield i, j, 1
                if 12 <= n <= 19 and text[a].isdigit():
                    yield i, j, 2
                if 7 <= n <= 15:
                    yield i, j, 3


class SemiCRF:
    """Segment scores ``w[kind] . features``; label "outside" takes one token at a time at score zero."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), len(FEATURES))) if weights is None else weights

    def segments(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], np.ndarray]:
        """Tokens, candidate segments (first token, end token, kind), and a row of features for each."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segs = list(candidates(text, tokens))
        rows = [features(text, tokens[i][0], tokens[j - 1][1], KINDS[k]) for i, j, k in segs]
        return tokens, segs, np.array(rows, float).reshape(len(segs), len(FEATURES))

    def scores(self, segs: list[tuple[int, int, int]], x: np.ndarray) -> np.ndarray:
        return (x * self.w[[k for _, _, k in segs]]).sum(axis=1) if segs else np.zeros(0)

    def best(self, text: str) -> list[Span]:
        """The highest-scoring segmentation."""
        tokens, segs, x = self.segments(text)
        if not segs:
            return []
        ending: dict[int, list[tuple[int, int, float]]] = {}
        for (i, j, k), s in zip(segs, self.scores(segs, x).tolist(), strict=True):
            if s > 0:
                ending.setdefault(j, []).append((i, k, s))
        top, back = [0.0], [(-1, -1)]
        for j in range(1, len(tokens) + 1):
            best, how = top[j - 1], (j - 1, -1)
            for i, k, s in ending.get(j, ()):
                if top[i] + s > best:
                    best, how = top[i] + s, (i, k)
            top.append(best)
            back.append(how)
        out, j = [], len(tokens)
        while j > 0:
            i, k = back[j]
            if k >= 0:
                out.append((tokens[i][0], tokens[j - 1][1], KINDS[k]))
            j = i
        return out[::-1]

    def gradient(self, n: int, segs: list[tuple[int, int, int]], x: np.ndarray, true: np.ndarray) -> np.ndarray:
        """Of the log likelihood: features of the true segments less their expectation over all segmentations of ``n`` tokens."""
        s = self.scores(segs, x)
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        outof: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for (i, j, _), v in zip(segs, s.tolist(), strict=True):
            into[j].append((i, v))
            outof[i].append((j, v))
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            alpha[j] = _log_sum([alpha[j - 1], *(alpha[i] + v for i, v in into[j])])
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([beta[i + 1], *(beta[j] + v for j, v in outof[i])])
        left, right = np.array(alpha), np.array(beta)
        first, last = np.array([i for i, _, _ in segs]), np.array([j for _, j, _ in segs])
        weight = true - np.exp(left[first] + s + right[last] - alpha[n])
        g = np.zeros_like(self.w)
        np.add.at(g, [k for _, _, k in segs], weight[:, None] * x)
        return g


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


# --- training ------------------------------------------------------------------------------------

TRAIN_SENTENCES = 220
EPOCHS = 12


def sentences(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Seeded sentences with entities written plainly and otherwise, and with numbers that are none."""
    rng = random.Random(seed)
    syllables = "an el tor is me ra vi on du pel est ing o kal".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while luhn(d := rng.choice("3456") + number(rng.choice((14, 15, 15, 15)))) != valid:
            pass
        return d

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4))

    def octets() -> list[str]:
        return [str(rng.randint(0, 255)) for _ in range(4)]

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            name, host, end = word() + rng.choice(("", ".", "_")) + rng.choice((word(), number(2))), word(), rng.choice(("com", "org", "net"))
            return rng.choice((f"{name}@{host}.{end}", f"{name}@mail{number(1)}.{host}.{end}", f"{name} [at] {host} [dot] {end}",
                               f"{name}(at){host}.{end}", f"{name} (at) {host} (dot) {end}", f"{name}[at]{host}.{end}")), kind
        if kind == "ip":
            o = octets()
            return rng.choice((".".join(o), ".".join(o), "[.]".join(o), " . ".join(o))), kind
        if kind == "card":
            d = card(True)
            return rng.choice((d, grouped(d, " "), grouped(d, "-"), grouped(d, "."))), kind
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}")), kind

    def decoy() -> str:
        return rng.choice((
            lambda: f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", lambda: f"{rng.randint(1900, 2030)}", lambda: f"version {number(1)}.{number(1)}",
            lambda: f"{number(1)}.{number(2)}.{number(1)}", lambda: f"${number(3)}.{number(2)}", lambda: card(False), lambda: number(rng.randint(1, 8)),
            lambda: f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(2)} %",
            lambda: f"{number(3)} {number(2)} {number(3)}", lambda: f"@{word()}", lambda: f"ISBN {number(13)}", lambda: number(20), lambda: f"{number(2)} {number(4)}",
        ))()

    out = []
    for _ in range(n):
        text, gold = word().capitalize(), []
        for _ in range(rng.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(rng.randint(1, 3))) + " "
            if rng.random() < 0.55:
                value, kind = entity()
                if rng.random() < 0.3:
                    text += rng.choice(HINTS[kind]) + rng.choice((" ", ": "))
                gold.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += decoy()
        out.append((text + rng.choice((".", "", " " + word() + ".")), gold))
    return out


@lru_cache(maxsize=1)
def train(n: int = TRAIN_SENTENCES, epochs: int = EPOCHS, seed: int = 7) -> SemiCRF:
    """Gradient ascent on the regularized log likelihood of ``n`` seeded sentences."""
    crf, data = SemiCRF(), []
    for text, gold in sentences(n, seed):
        tokens, segs, x = crf.segments(text)
        if segs:
            true = np.array([(tokens[i][0], tokens[j - 1][1], KINDS[k]) in gold for i, j, k in segs], float)
            data.append((len(tokens), segs, x, true))
    scale = np.full_like(crf.w, 1e-2)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for example in data:
            g = crf.gradient(*example) - 0.002 * crf.w
            scale += g * g
            crf.w += 0.5 * g / np.sqrt(scale)
    return crf


# --- the operator --------------------------------------------------------------------------------


def neighbourhoods(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, cut at white space where there is any."""
    lo = hi = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if hi >= 0 and a <= hi:
            hi = b
            continue
        if hi >= 0:
            yield _whole(text, lo, hi)
        lo, hi = a, b
    if hi >= 0:
        yield _whole(text, lo, hi)


def _whole(text: str, lo: int, hi: int) -> tuple[int, int]:
    """Move the ends inwards past a cut word."""
    while 0 < lo < hi and text[lo - 1].isalnum() and text[lo].isalnum():
        lo += 1
    while lo < hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum():
        hi -= 1
    return lo, hi


def find(text: str | None, crf: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    more = []
    done = 0
    for lo, hi in neighbourhoods(text):
        lo = max(lo, done)
        done = hi
        for a, b, kind in crf.best(text[lo:hi]):
            a, b = a + lo, b + lo
            before = bisect_left(starts, b)  # base spans that begin before this one ends; does one of them end in it?
            if not before or ends[before - 1] <= a:
                more.append((a, b, kind))
    return base, sorted(base + more, key=order)


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = "array<struct<start: bigint, end: bigint, kind: string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base spans, all spans."""
    weights = train().w
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        crf = SemiCRF(weights)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, full = zip(*(find(t, crf) for t in batch.column(1).to_pylist()), strict=True)
            cells = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in side], span) for side in (base, full)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cells], names=[batch.schema.names[0], "base", "spans"])

        return step

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_batches(docs.select(id_col, text), make, f"`{id_col}` {kind}, base {SPAN}, spans {SPAN}")


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All documents, with every span replaced by its kind; texts without spans stay as they are (null too)."""
    weights = train().w
    counted = n_chars in docs.columns

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        crf = SemiCRF(weights)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            new = [redact(t, s) if t and (s := find(t, crf)[1]) else t for t in texts]
            batch = with_text(batch, text, new)
            if counted:
                i = batch.schema.get_field_index(n_chars)
                old = batch.column(i).to_pylist()
                sizes = [len(n) if n != t else o for n, t, o in zip(new, texts, old, strict=True)]
                batch = pa.RecordBatch.from_arrays([*batch.columns[:i], pa.array(sizes, batch.schema[i].type), *batch.columns[i + 1:]], schema=batch.schema)
            return batch

        return step

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return docs.mapInArrow(run, docs.schema)
