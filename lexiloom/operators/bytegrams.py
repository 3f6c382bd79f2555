"""Byte n-grams in bulk: integer codes in numpy over Arrow batches, folded by block before anything is shuffled, and scoring
by an automaton. The columns that name an n-gram show it as upper-case hexadecimal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, StringType

from . import scanner

#: Codes that a task holds before it folds them, and bytes of text that are scanned together.
FOLD, SCAN = 4 << 20, 1 << 20
#: Of a model that goes to all executors: strings looked for, and bytes of its tables.
MAX_STRINGS, MAX_BYTES = 1_000_000, 1 << 29


@dataclass(frozen=True)
class ByteGrams:
    """All n-grams of these orders (lengths in bytes, up to 7). Texts shorter than `least` bytes have none."""

    orders: tuple[int, ...]
    least: int

    def __post_init__(self) -> None:
        if not self.orders or min(self.orders) < 1 or max(self.orders) > 7:
            raise ValueError("orders are lengths of 1 to 7 bytes")

    def __call__(self, text: Column) -> Column:
        """The n-grams of one text as an array, by order and place. The text is encoded outside the steps over its places."""
        n = F.octet_length(text)

        def order(raw: Column, k: int) -> Column:
            found = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.hex(F.substring(raw, i + 1, F.lit(k))))  # of bytes, whose places cost alike
            return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))

        grams = F.transform(F.array(F.encode(text, "UTF-8")), lambda raw: F.concat(*[order(raw, k) for k in self.orders]))[0]
        return F.when(n >= self.least, grams).otherwise(F.array().cast("array<string>"))

    def codes(self, raw: bytes) -> np.ndarray:
        """The n-grams of one text as numbers: the bytes' value, and the order above it."""
        if len(raw) < self.least:
            return np.zeros(0, np.int64)
        byte = np.frombuffer(raw, np.uint8).astype(np.int64)
        out, value = [], np.zeros(len(byte), np.int64)
        for k in range(1, max(self.orders) + 1):
            if k > len(byte):
                break
            value = (value[: len(byte) - k + 1] << 8) | byte[k - 1 :]
            if k in self.orders:
                out.append(value | (k << 56))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def term(code: Column) -> Column:
    """A code's n-gram in hexadecimal."""
    return F.lpad(F.hex(code.bitwiseAND(F.lit((1 << 56) - 1))), 2 * F.shiftright(code, 56).cast("int"), F.lit("0"))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def totals(docs: DataFrame, grams: ByteGrams, by: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(by, term, n): occurrences of each n-gram, or with distinct the number of documents that have it. A block is folded
    to one row an n-gram and group."""
    fields = [StructField(c, docs.schema[c].dataType) for c in by]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for group, codes in held.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                names = [pa.array([x], to_arrow_type(f.dataType)).take(pa.array(np.zeros(len(code), np.int64))) for x, f in zip(group, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(code), pa.array(n.astype(np.int64))], names=[*by, "code", "n"])

        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in by), strict=True) if by else [()] * batch.num_rows
            for group, raw in zip(groups, _bytes(batch), strict=True):
                codes = grams.codes(raw)
                if distinct:
                    codes = np.unique(codes)
                held.setdefault(group, []).append(codes)
                size += len(codes)
                if size >= FOLD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "code long", "n long"])
    folded = docs.select(*by, "text").mapInArrow(fold, schema).groupBy(*by, "code").agg(F.sum("n").alias("n"))
    return folded.select(*by, term(F.col("code")).alias("term"), "n")


def _listed(features: DataFrame) -> list[str]:
    found = [r[0] for r in features.select("term").distinct().limit(MAX_STRINGS + 1).collect()]
    if len(found) > MAX_STRINGS:
        raise ValueError(f"over {MAX_STRINGS} strings to look for")
    return sorted(found)


def _sent(docs: DataFrame, found: scanner.Scanner, *more):  # noqa: ANN002, ANN202
    size = sum(x.nbytes for x in (found.moves, found.first, found.output, *(m for m in more if isinstance(m, np.ndarray))))
    if size > MAX_BYTES:
        raise ValueError(f"a model of {size} bytes is too large for every executor")
    return docs.sparkSession.sparkContext.broadcast((found, *more))


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SCAN bytes, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SCAN:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def scan(docs: DataFrame, features: DataFrame, grams: ByteGrams) -> DataFrame:
    """(doc_id, term, n): how often each feature is in each document. No n-gram leaves the task that reads the text."""
    terms = _listed(features)
    model = _sent(docs, scanner.build([bytes.fromhex(t) for t in terms]))
    kind, least = docs.schema["doc_id"].dataType.simpleString(), grams.least

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(terms, pa.string())
        for batch in batches:
            texts = [t if len(t) >= least else b"" for t in _bytes(batch)]
            for p, q in _parts(texts):
                doc, string, n = scanner.search(model.value[0], texts[p:q])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc + p)), names.take(pa.array(string)), pa.array(n)], names=["doc_id", "term", "n"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, term string, n long")


def scan_totals(docs: DataFrame, features: DataFrame, grams: ByteGrams, by: str) -> DataFrame:
    """(term, by, n): occurrences of features in each group, folded by block."""
    terms = _listed(features)
    model = _sent(docs, scanner.build([bytes.fromhex(t) for t in terms]))
    kind, least = docs.schema[by].dataType.simpleString(), grams.least

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = batch.column(by).type
            texts, groups = [t if len(t) >= least else b"" for t in _bytes(batch)], batch.column(by).to_pylist()
            for p, q in _parts(texts):
                doc, string, n = scanner.search(model.value[0], texts[p:q])
                of = [groups[p + i] for i in range(q - p)]
                names = list(dict.fromkeys(of))
                place = np.array([names.index(x) for x in of])[doc]
                for i, g in enumerate(names):
                    total = held.setdefault(g, np.zeros(len(terms), np.int64))
                    np.add.at(total, string[place == i], n[place == i])
        names = pa.array(terms, pa.string())
        for g, total in held.items():
            at = pa.array(np.flatnonzero(total))
            yield pa.RecordBatch.from_arrays([names.take(at), pa.array([g], kinds).take(pa.array(np.zeros(len(at), np.int64))), pa.array(total).take(at)], names=["term", by, "n"])

    return docs.select(by, "text").mapInArrow(search, f"term string, `{by}` {kind}, n long").groupBy("term", by).agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Weights:
    """A linear model on the driver: classes in order, their constants, features, and (features, classes) weights."""

    classes: list[str]
    constant: np.ndarray
    terms: list[str]
    weight: np.ndarray


def weights(log_pc: DataFrame, log_ptc: DataFrame) -> Weights:
    """Of a model's tables: a row a class, and a row a feature and class, both of chosen sizes, which are checked."""
    pc = sorted((r["lang"], r["log_pc"]) for r in log_pc.select("lang", "log_pc").limit(100_001).collect())
    if len(pc) > 100_000 or log_ptc.count() * 8 > MAX_BYTES:
        raise ValueError("a model of so many classes or features is too large for every executor")
    rows = log_ptc.select("term", "lang", "log_ptc").toArrow()
    classes = [c for c, _ in pc]
    terms = sorted(set(rows.column("term").to_pylist()))
    of_term, of_class = {t: i for i, t in enumerate(terms)}, {c: i for i, c in enumerate(classes)}
    weight = np.zeros((len(terms), len(classes)))
    for t, c, w in zip(*(rows.column(x).to_pylist() for x in ("term", "lang", "log_ptc")), strict=True):
        weight[of_term[t], of_class[c]] = w
    return Weights(classes, np.array([p for _, p in pc]), terms, weight)


def with_scores(df: DataFrame, model: Weights, tokenizer: ByteGrams | None, text: str = "text", best: str | None = "lang", scores: str | None = None) -> DataFrame:
    """df with the best class (the first among equals) and, if asked for, all scores in order of the classes. It is one step
    over Arrow batches without a shuffle, so it stands in streams as well. Without a tokenizer features are words."""
    of_class = np.array(model.classes, dtype=object)
    if tokenizer is not None:
        found = scanner.build([bytes.fromhex(t) for t in model.terms])
        by_state = np.zeros((found.states, len(model.classes)))
        np.add.at(by_state, np.repeat(np.arange(found.states), np.diff(found.first)), model.weight[found.output])
        sent = _sent(df, found, by_state, model.constant)
    else:
        sent = _sent(df, scanner.build([]), model.weight, model.constant, {t.encode(): i for i, t in enumerate(model.terms)})
    least = tokenizer.least if tokenizer else 0
    extra = [*([StructField(best, StringType())] if best else []), *([StructField(scores, _doubles())] if scores else [])]
    schema = StructType([*df.schema.fields, *extra])
    name = next(f.name for f in df.schema.fields if f.name.lower() == text.lower())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, by_state, constant, *words = sent.value
        for batch in batches:
            texts = [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
            total = np.tile(constant, (len(texts), 1))
            if words:
                for i, t in enumerate(texts):
                    at = [words[0][w] for w in t.replace(b"\v", b" ").split() if w in words[0]]
                    total[i] += by_state[at].sum(0)
            else:
                texts = [t if len(t) >= least else b"" for t in texts]
                for p, q in _parts(texts):
                    doc, state, n = scanner.state_counts(found, texts[p:q])
                    for lo in range(0, len(doc), 1 << 15):
                        part = slice(lo, lo + (1 << 15))
                        np.add.at(total, doc[part] + p, by_state[state[part]] * n[part, None])
            columns = list(batch.columns)
            if best:
                columns.append(pa.array(of_class[total.argmax(1)] if len(of_class) else [None] * len(texts), pa.string()))
            if scores:
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(of_class)), pa.array(total.reshape(-1))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(score, schema)


def _doubles():  # noqa: ANN202
    from pyspark.sql.types import ArrayType, DoubleType

    return ArrayType(DoubleType())
