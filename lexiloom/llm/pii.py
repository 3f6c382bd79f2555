"""Personal data: base spans by pattern, and spans that a character-level BiLSTM with CRF transitions adds.

The tagger is trained in numpy from labelled spans; by default these are invented lines with e-mail addresses, IP
addresses, card and phone numbers in several ways of writing, also in those that the patterns miss (addresses spelled out or
in brackets, phones without a plus, cards with dots), and with numbers that are none of these. A text is cut into overlapping
windows over its whole length, and every window is decoded. Decoded spans are checked (digits, parts, Luhn, once marks in
words or brackets are put back) and reconciled over the whole text: base spans stay; of the others, those found far from a
window's edge go first, and none may touch a span that stands.

Null and empty texts have no spans; repeated rows are searched each. Empty tables give empty results; other columns and
their names don't matter."""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bilstm
from .bilstm import KINDS, PAD
from .common import blocks, fresh, text_or_empty

# The base patterns. What follows an address's @ is looked for first, and its part before the @ by going back
# from there; an IP address starts after no digit. So neither looks at a long run from each of its characters.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
# Ways to write the marks of addresses out.
AT = re.compile(r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+", re.IGNORECASE)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+", re.IGNORECASE)
SAMPLE, WINDOW, STRIDE = 128, 512, 448
AT_ONCE = 768  # windows of one call of the decoder

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    given = s
    if kind in ("email", "ip"):
        s = DOT.sub(".", AT.sub("@", s) if kind == "email" else s)
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    # Addresses in plain signs may hold any letters; those spelled out must give what the base pattern takes.
    return bool(EMAIL.fullmatch(s)) or s == given and bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", s))


def emails(text: str) -> list[Span]:
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            done = found.end()
        at = max(at + 1, done)
    return out


def base_spans(text: str) -> list[Span]:
    """By start, then kind in the order of KINDS."""
    out: list[Span] = []
    out += emails(text)
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def windows_of(length: int) -> range:
    """Starts of a text's windows; the last one reaches its end."""
    return range(0, max(0, -(-(length - WINDOW) // STRIDE)) * STRIDE + 1, STRIDE) if length else range(0)


def spans_of(labels: np.ndarray) -> list[Span]:
    out: list[Span] = []
    start = -1
    for i, y in enumerate([*labels.tolist(), 0]):
        if start >= 0 and not (y and y % 2 == 0):
            out.append((start, i, KINDS[(labels[start] - 1) // 2]))
            start = -1
        if y % 2 == 1:
            start = i
    return out


def reconcile(text: str, base: list[Span], found: list[tuple[int, Span]]) -> list[Span]:
    """base and those of found (with the distance from their window's edge) that are valid and free of other spans."""
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = list(base)
    best: dict[Span, int] = {}
    for far, span in found:
        best[span] = max(far, best.get(span, 0))
    for (a, b, kind), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        at = bisect.bisect_left(taken, (a, a))
        free = (at == len(taken) or b <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= a)
        if whole and free and valid(kind, text[a:b]):
            taken.insert(at, (a, b))
            out.append((a, b, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def tag(texts: list[str], tagger: bilstm.Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[int, Span]]] = [[] for _ in texts]
    points = [bilstm.codes(t) for t in texts]
    places = [(i, a) for i, c in enumerate(points) for a in windows_of(len(c))]
    places.sort(key=lambda p: -min(WINDOW, len(points[p[0]]) - p[1]))  # windows of one length go together, with little to fill
    for low in range(0, len(places), AT_ONCE):
        part = places[low : low + AT_ONCE]
        x = np.full((len(part), min(WINDOW, len(points[part[0][0]]) - part[0][1])), PAD, np.uint8)
        for row, (i, a) in enumerate(part):
            c = points[i][a : a + WINDOW]
            x[row, : len(c)] = c
        y = tagger.decode(x)
        for row in np.flatnonzero(y.any(axis=1)):
            i, a = part[row]
            for s, e, kind in spans_of(y[row]):
                e = min(e, len(texts[i]) - a)
                if s < e:
                    left = s if a else WINDOW
                    right = WINDOW - e if a + WINDOW < len(texts[i]) else WINDOW
                    found[i].append((min(left, right), (a + s, a + e, kind)))
    return [(b, reconcile(t, b, f)) for t, b, f in zip(texts, base, found, strict=True)]


def labelled_samples(n: int = 2500, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Invented lines and their spans. Half of the numbers in them are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a=2, b=9: "".join(pick(letters + "éüñ" if rng.random() < 0.1 else letters) for _ in range(int(rng.integers(a, b))))
    plain = lambda a=2, b=9: "".join(pick(letters) for _ in range(int(rng.integers(a, b))))

    def card() -> str:
        body = pick("3456") + digits(14)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        mark = pick(["", "", " ", "-", "."])
        return mark.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{pick('123456789')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{pick(['44', '49', '33', '34'])} {a} {b} {c}", f"{a}.{b}.{c}"])

    def spelled() -> str:
        at = pick([" at ", " AT ", " [at] ", "[at]", " (at) ", "(at)", " {at} "])
        dot = pick([" dot ", " DOT "] if at.strip().isalpha() else [" dot ", " [dot] ", "[dot]", " (dot) ", "(dot)", "."])
        names = [plain(3, 9), *([plain(3, 7)] if rng.random() < 0.3 else [])]
        return pick([".", "_", dot]).join(names) + pick(["", "", digits(2)]) + at + plain(3, 9) + dot + pick(["com", "org", "net", "de", f"co{dot}uk", "edu", "io"])

    def address() -> str:
        return pick([".", ".", ".", "[.]", "(.)", " dot "]).join(str(x) for x in rng.integers(0, 256, 4))

    make = {
        "email": lambda: spelled() if rng.random() < 0.5 else f"{plain()}{pick(['', '.', '_', '+'])}{plain(1, 6)}{pick(['', '.' + digits(2), digits(2)])}@{plain(3, 9)}{pick(['', digits(1)])}.{pick(['com', 'org', 'net', 'example.com', 'de'])}",
        "ip": address,
        "card": card,
        "phone": phone,
    }
    none = [lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: "AKIA" + "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), lambda: "password=" + "".join(pick("0123456789abcdef") for _ in range(18)), lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"version {digits(1)}", lambda: f"CC BY-NC {digits(1)}.0.", lambda: digits(int(rng.integers(1, 7))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)} %", lambda: f"page={digits(3)}", lambda: f"@{plain()}", lambda: f"{digits(3)},{digits(3)}", lambda: f"at {word()}", lambda: f"a dot {word()}", lambda: f"{word()} at {word()}.\n{word().capitalize()}", lambda: f"({word()})", lambda: f"[{word()}]"]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < SAMPLE - 30:
            r = rng.random()
            if r < 0.12:
                kind = pick(KINDS)
                s = make[kind]()
                spans.append((len(text), len(text) + len(s), kind))
                text += s
            elif r < 0.22:
                text += pick(none)()
            else:
                w = word()
                text += w.capitalize() if rng.random() < 0.15 else w
            text += pick([" ", " ", " ", " ", ", ", ". ", ".\n"])
        spans = [s for s in spans if s[1] <= SAMPLE]
        out.append((text[:SAMPLE], spans))
    return out


def train(samples: list[tuple[str, list[Span]]], **options: float) -> bilstm.Tagger:
    """A tagger from texts and their labelled spans, in pieces of SAMPLE characters."""
    xs, ys = [], []
    for text, spans in samples:
        y = np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            k = KINDS.index(kind)
            y[a], y[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        c = bilstm.codes(text)
        for a in range(0, len(text), SAMPLE):
            part = y[a : a + SAMPLE]
            if part[0] and part[0] % 2 == 0:  # a span that began before the piece is not its own
                part = part.copy()
                part[: int(np.argmax(np.concatenate([part % 2 == 1, [True]]) | np.concatenate([part == 0, [True]])))] = 0
            fill = (0, SAMPLE - len(part))
            xs.append(np.pad(c[a : a + SAMPLE], fill, constant_values=PAD))
            ys.append(np.pad(part, fill))
    return bilstm.train(np.stack(xs), np.stack(ys), **options)


@functools.lru_cache(maxsize=1)
def default_tagger() -> bilstm.Tagger:
    return train(labelled_samples())


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: bilstm.Tagger | None = None) -> DataFrame:
    """One row a document: doc_id, base and spans (arrays of start, end, kind by start and kind)."""
    tagger = tagger or default_tagger()
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            got = tag(batch.column("text").to_pylist(), tagger)
            as_rows = lambda k: pa.array([[{"start": a, "end": b, "kind": c} for a, b, c in x[k]] for x in got], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_rows(0), as_rows(1)], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return docs.mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and all spans as a string."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: bilstm.Tagger | None = None) -> DataFrame:
    """df with every span of its texts replaced by its kind in angle brackets; null texts stay null."""
    tagger = tagger or default_tagger()

    @F.pandas_udf("string")
    def masked(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text in texts:
            if text:
                parts, at = [], 0
                for a, b, kind in tag([text], tagger)[0][1]:
                    if b > at:
                        parts += [text[at:a], f"<{kind}>"] if a >= at else []
                        at = b
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    # The columns' type hints are given by the call, so the function above needs none.
    return df.withColumn(text_col, masked(F.col(f"`{text_col}`")))
