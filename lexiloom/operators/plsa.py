"""Probabilistic latent semantic analysis by EM. A model is two tables: p_wz (term, p) and p_zd (doc_id, p), with p an array
over topics, and p_z, a list. A word or document is one row whatever the number of topics. Counts are packed once into blocks
of documents, from texts or from rows of counts; an iteration sends each block the rows of both tables that it needs and takes
both aggregates in one pass. Terms travel in lists, one a block and part of the terms, so no exchange has a row a count or term."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import dropped, written


@dataclass(frozen=True)
class Options:
    topics: int = 50
    alpha: float = 0.001
    beta: float = 0.001
    max_iter: int = 500
    tolerance: float = 0.001
    #: An iteration below the tolerance counts up, any other counts down to 0; at this count EM stops.
    patience: int = 10


@dataclass(frozen=True)
class Model:
    p_wz: DataFrame
    p_zd: DataFrame
    p_z: list[float]
    options: Options
    likelihoods: tuple[float, ...] = ()


def _sums(k: int, value: Column | None = None, of=None) -> list[Column]:  # noqa: ANN001
    return [F.sum(of(i) if of else value).alias(f"s{i}") for i in range(k)]


def _array(k: int, add: float = 0.0) -> Column:
    return F.array(*[F.col(f"s{i}") + F.lit(add) for i in range(k)])


def _normalized(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.transform(p, lambda x: x / total)


def normalized_by_topic(p_wz: DataFrame, k: int) -> DataFrame:
    """Rows divided by each topic's total; the totals are one row."""
    totals = p_wz.agg(*[F.sum(F.col("p")[i]).alias(f"t{i}") for i in range(k)])
    return p_wz.crossJoin(F.broadcast(totals)).select("term", F.array(*[F.col("p")[i] / F.col(f"t{i}") for i in range(k)]).alias("p"))


def initialize(counts: DataFrame, labels: DataFrame, options: Options, hard: bool = False, blocks: DataFrame | None = None) -> Model:
    """A model from labels (doc_id, z); labels outside the topics are an error. Documents without counts are uniform. Blocks
    of counts meet the labels of their documents, then the rows of P(w|z) that they need; counts are not dealt again."""
    k = options.topics
    own = blocks if blocks is not None else packed(counts)
    z = F.when((F.col("z") < 0) | (F.col("z") >= k) | F.col("z").isNull(), F.raise_error(F.lit("label outside the topics")).cast("int")).otherwise(F.col("z"))
    labels = labels.select("doc_id", z.alias("z"))
    raw = written(label_sums(own, labels, k), "plsa-terms")
    by_z = raw.agg(*[F.sum(F.col("p")[i]) for i in range(k)]).first()
    p_wz = written(normalized_by_topic(raw.select("term", F.transform("p", lambda x: x + F.lit(options.beta)).alias("p")), k), "plsa-pwz")
    dropped(raw)
    mass = [(by_z[i] or 0.0) + options.alpha for i in range(k)]
    p_z = [m / sum(mass) for m in mass]

    kind = _id_type(own)

    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, k):
            q, known = np.zeros((len(x.docs), k)), x.pw.any(1)
            for a, b in _slices(x.first):
                at, starts = x.place[x.first[a] : x.first[b]], x.first[a:b] - x.first[a]
                q[a:b] = np.add.reduceat(x.pw[at] * x.cnt[x.first[a] : x.first[b], None] * np.array(p_z), starts, axis=0)
                q[a:b][np.add.reduceat(known[at].astype(np.int64), starts) == 0] = 0.0
            docs = np.flatnonzero(q.any(1))
            yield pa.RecordBatch.from_arrays([x.docs.take(pa.array(docs)), _lists(q[docs] / q[docs].sum(1, keepdims=True))], names=["doc_id", "q"])

    if hard:
        one = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("z"), 1.0).otherwise(0.0))
        p_zd = labels.select("doc_id", one.alias("p"))
    else:
        found = _rows(own, p_wz, None).mapInArrow(soft, f"doc_id {kind}, q array<double>")
        p_zd = labels.join(found, "doc_id", "left").select("doc_id", F.coalesce("q", F.array(*[F.lit(1.0 / k)] * k)).alias("p"))
    p_zd = written(p_zd, "plsa-pzd")
    if blocks is None:
        dropped(own)
    return Model(p_wz, p_zd, p_z, options)


def posteriors(counts: DataFrame, model: Model) -> DataFrame:
    """counts with `joint` (P(w|z) P(z|d) by topic) and `mix`, its sum."""
    wz, zd = model.p_wz.withColumnRenamed("p", "pw"), model.p_zd.withColumnRenamed("p", "pd")
    joined = counts.join(wz, "term").join(zd, "doc_id").withColumn("joint", F.zip_with("pw", "pd", lambda a, b: a * b))
    return joined.withColumn("mix", F.aggregate("joint", F.lit(0.0), lambda s, x: s + x)).select("doc_id", "term", "cnt", "joint", "mix")


def log_likelihood(counts: DataFrame, model: Model, blocks: DataFrame | None = None) -> float:
    """A word's mean log likelihood; blocks of counts meet the model's rows. Counts of unknown terms or documents take no part."""
    k = model.options.topics
    own = blocks if blocks is not None else packed(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, k):
            ll = n = 0.0
            for a, b in _slices(x.first):
                at, c, lengths = x.place[x.first[a] : x.first[b]], x.cnt[x.first[a] : x.first[b]], np.diff(x.first[a : b + 1])
                mix = (x.pw[at] * np.repeat(x.pd[a:b], lengths, axis=0)).sum(1)
                used = x.pw.any(1)[at] & np.repeat(x.pd[a:b].any(1), lengths)
                ll += float((c[used & (mix > 0)] * np.log(mix[used & (mix > 0)])).sum())
                n += float(c[used].sum())
            yield pa.RecordBatch.from_arrays([pa.array([ll]), pa.array([n])], names=["ll", "n"])

    found = _meeting(own, model, model.p_zd).mapInArrow(add, "ll double, n double").agg(F.sum("ll"), F.sum("n")).first()
    if blocks is None:
        dropped(own)
    return float(found[0]) / float(found[1]) if found[1] else float("nan")


#: Counts of a block of documents, and counts whose posteriors are in memory at once; one longer document is a block and a
#: slice of its own. A block asks once for a term's row, so larger blocks ask for fewer.
BLOCK_COUNTS, SLICE_COUNTS = 1_000_000, 100_000
#: Bytes of text that are split at once, if they are not one document.
TEXT_BYTES = 2 << 20
#: Parts that terms are dealt by; a block's terms are in order of parts.
TERM_PARTS = 128


class Block(NamedTuple):
    """Counts of whole documents, in order: document i has those from first[i] on; place is the term's. Terms of part i are
    those from ends[i] on. pw and pd are the rows that the block met, zero where it met none."""

    block: int
    pw: np.ndarray
    pd: np.ndarray
    docs: pa.Array
    first: np.ndarray
    terms: pa.Array
    ends: np.ndarray
    place: np.ndarray
    cnt: np.ndarray


def _id_type(blocks: DataFrame) -> str:
    return blocks.schema["docs"].dataType.elementType.simpleString()


def _schema(kind: str) -> str:
    return f"block long, cnt array<double>, place array<int>, first array<int>, ends array<int>, docs array<{kind}>, terms array<string>"


def _packed(number: int, docs: pa.Array, first: np.ndarray, terms: pa.Array, place: np.ndarray, cnt: np.ndarray) -> pa.RecordBatch:
    """A block as a row, its terms put in order of their parts."""
    part = np.fromiter((zlib.crc32(t) % TERM_PARTS for t in terms.cast(pa.binary()).to_pylist()), np.int64, len(terms))
    order = np.argsort(part, kind="stable")
    moved = np.empty(len(terms), np.int32)
    moved[order] = np.arange(len(terms), dtype=np.int32)
    ends = np.searchsorted(part[order], np.arange(TERM_PARTS + 1)).astype(np.int32)
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(cnt.astype(np.float64)), one(moved[place]), one(first.astype(np.int32)), one(ends), one(docs), one(terms.take(pa.array(order)))], names=["block", "cnt", "place", "first", "ends", "docs", "terms"])


def _numbers() -> Iterator[int]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    while True:
        number += 1
        yield number


def _runs(batches: Iterator[pa.RecordBatch], most: int, size: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.Table]:
    """Rows sorted by doc_id as tables of whole documents, of `most` at most by the rows' sizes, or one document."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        while len(total := np.cumsum(size(held))) and total[-1] > most:
            ids = held.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1  # the last document may go on in the next batch
            if not len(ends):
                break
            cut = int(ends[max(0, int(np.searchsorted(total[ends - 1], most, side="right")) - 1)])
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _split(run: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Documents, first, terms, place and counts of lower-cased texts; a term is a run of a to z."""
    of = run.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
    text = pa.array(run.column("text").combine_chunks(), pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = (data - np.uint8(97)) < 26
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    begin[edge] = letter[edge]
    begin = np.flatnonzero(begin)
    offsets = np.append(np.cumsum(letter)[begin] - 1, letter.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[letter])).dictionary_encode()
    doc = of.indices.to_numpy()[np.searchsorted(at, begin, side="right") - 1]
    key, cnt = np.unique(doc.astype(np.int64) * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
    doc, place = np.divmod(key, max(1, len(words.dictionary)))
    seen, first = np.unique(doc, return_index=True)  # documents without a word are left out
    return of.dictionary.take(pa.array(seen)), np.append(first, len(doc)), words.dictionary.cast(pa.string()), place, cnt


def packed(counts: DataFrame, value: str = "cnt", text: str | None = None, most: int | None = None) -> DataFrame:
    """counts as a written table of blocks of documents: docs, where each one's counts start (first), the block's terms, and
    for each count the term's place and the number. The only time that counts are dealt by document. With `text`, the rows
    are documents whose lower-cased text is split into runs of a to z and counted where the block is packed. A block has
    `most` counts, BLOCK_COUNTS if it is not given."""
    kind = counts.schema["doc_id"].dataType
    most, at_once = most or BLOCK_COUNTS, TEXT_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in zip(_numbers(), _runs(batches, most, lambda t: np.ones(t.num_rows, np.int64))):
            doc, term = (t.column(c).combine_chunks().dictionary_encode() for c in ("doc_id", "term"))
            first = np.searchsorted(doc.indices.to_numpy(), np.arange(len(doc.dictionary) + 1))
            yield _packed(number, doc.dictionary, first, term.dictionary, term.indices.to_numpy(), t.column("cnt").to_numpy())

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        numbers = _numbers()

        def block() -> pa.RecordBatch:
            docs, firsts, terms, places, cnts = zip(*held, strict=True)
            all_terms = pa.concat_arrays(terms).dictionary_encode()
            new, moved, n = all_terms.indices.to_numpy(), np.cumsum([0, *map(len, terms)]), np.cumsum([0, *map(len, places)])
            place = np.concatenate([new[m : m + len(t)][p] for m, t, p in zip(moved, terms, places)])
            first = np.concatenate([*[f[:-1] + m for f, m in zip(firsts, n)], [n[-1]]])
            held.clear()
            return _packed(next(numbers), pa.concat_arrays(docs), first, all_terms.dictionary, place, np.concatenate(cnts))

        for run in _runs(batches, at_once, lambda t: pc.binary_length(t.column("text")).to_numpy().astype(np.int64)):
            found = _split(run)
            if held and sum(len(x[3]) for x in held) + len(found[3]) > most:
                yield block()
            if len(found[3]):
                held.append(found)
        if held:
            yield block()

    if text is not None:
        rows, by = counts.select("doc_id", F.lower(text).alias("text")).where("text IS NOT NULL"), pack_texts
    else:
        rows, by = counts.select("doc_id", "term", F.col(value).cast("double").alias("cnt")).where("doc_id IS NOT NULL AND term IS NOT NULL"), pack
    return written(rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(by, _schema(kind.simpleString())), "plsa-blocks")


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(term, tf, df) of blocks, df as the expected document frequency."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends, place, cnt = (batch.column(c)[i].values for c in ("terms", "ends", "place", "cnt"))
                place, cnt = place.to_numpy(), cnt.to_numpy()
                both = [np.bincount(place, weights=w, minlength=len(terms)) for w in (cnt, np.minimum(cnt, 1.0))]
                yield pa.RecordBatch.from_arrays(list(_by_part(terms, ends.to_numpy(), np.stack(both, 1))), names=["term", "terms", "p"])

    found = blocks.select("terms", "ends", "place", "cnt").mapInArrow(add, "term int, terms array<string>, p array<double>")
    return summed(found, 2).select("term", F.col("p")[0].alias("tf"), F.col("p")[1].alias("df"))


def pruned(blocks: DataFrame, terms: DataFrame, weighted: bool = False) -> DataFrame:
    """blocks with the counts of terms (column term) only, written; documents without counts drop out. Weighted ones are
    multiplied by the terms' positive weights (column weight)."""
    kind = _id_type(blocks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, 1):
            known = x.pw[:, 0] > 0
            used = known[x.place]
            before = np.concatenate([[0], np.cumsum(used)])[x.first]
            docs = np.flatnonzero(np.diff(before))
            if len(docs):
                place = (np.cumsum(known) - 1)[x.place[used]]
                cnt = x.cnt[used] * x.pw[x.place[used], 0] if weighted else x.cnt[used]
                yield _packed(x.block, x.docs.take(pa.array(docs)), np.append(before[docs], before[-1]), x.terms.filter(pa.array(known)), place, cnt)

    own = terms.select("term", F.array(F.col("weight") if weighted else F.lit(1.0)).alias("p"))
    return written(_rows(blocks, own, None).mapInArrow(keep, _schema(kind)), "plsa-blocks")


def unpacked(blocks: DataFrame) -> DataFrame:
    """Blocks as rows (doc_id, term, cnt)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, first, terms, place, cnt = (batch.column(c)[i].values for c in ("docs", "first", "terms", "place", "cnt"))
                at = pa.array(np.repeat(np.arange(len(docs)), np.diff(first.to_numpy())))
                for a in range(0, len(at), SLICE_COUNTS):
                    n = min(SLICE_COUNTS, len(at) - a)
                    yield pa.RecordBatch.from_arrays([docs.take(at.slice(a, n)), terms.take(place.slice(a, n)), cnt.slice(a, n)], names=["doc_id", "term", "cnt"])

    return blocks.select("docs", "first", "terms", "place", "cnt").mapInArrow(rows, f"doc_id {_id_type(blocks)}, term string, cnt double")


def lengths(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_words) of the documents of blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, first, cnt = (batch.column(c)[i].values for c in ("docs", "first", "cnt"))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.add.reduceat(cnt.to_numpy(), first.to_numpy()[:-1]))], names=["doc_id", "n_words"])

    return blocks.select("docs", "first", "cnt").mapInArrow(add, f"doc_id {_id_type(blocks)}, n_words double")


def label_sums(blocks: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(term, p): each term's counts by the labels (doc_id, z) of their documents. Terms without a labelled document drop out."""
    by_doc = labels.groupBy("doc_id").agg(*_sums(k, of=lambda i: F.when(F.col("z") == i, 1.0).otherwise(0.0))).select("doc_id", _array(k).alias("p"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, k):
            by_term, n = np.zeros((len(x.terms), k)), np.zeros(len(x.terms))
            for a, b in _slices(x.first):
                at, c = x.place[x.first[a] : x.first[b]], x.cnt[x.first[a] : x.first[b]]
                of = np.repeat(x.pd[a:b], np.diff(x.first[a : b + 1]), axis=0)
                by_term += _by_place(at, of * c[:, None], len(x.terms))
                n += np.bincount(at, weights=of.sum(1), minlength=len(x.terms))
            known = n > 0
            ends = np.concatenate([[0], np.cumsum(known)])[x.ends]
            yield pa.RecordBatch.from_arrays(list(_by_part(x.terms.filter(pa.array(known)), ends, by_term[known])), names=["term", "terms", "p"])

    return summed(_rows(blocks, None, by_doc).mapInArrow(add, "term int, terms array<string>, p array<double>"), k)


def _by_part(terms: pa.Array, ends: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A row a part that has terms: its number, its terms and their rows."""
    part = np.flatnonzero(np.diff(ends))
    at = np.append(ends[part], len(terms)).astype(np.int32)
    return pa.array(part.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), terms), pa.ListArray.from_arrays(pa.array(at * rows.shape[1]), pa.array(rows.reshape(-1), pa.float64()))


def summed(found: DataFrame, k: int) -> DataFrame:
    """(term, p): rows of lists (term: their part, terms, p) added up by term. A task has a part's terms at once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, rows, n = None, [], [], 0

        def fold() -> None:
            nonlocal names, rows, n
            own = pa.concat_arrays(names).dictionary_encode()
            names, rows, n = [own.dictionary], [_by_place(own.indices.to_numpy(), np.concatenate(rows), len(own.dictionary))], len(own.dictionary)

        for batch in batches:
            part = batch.column("term").to_numpy()
            for i in range(batch.num_rows):
                if part[i] != last:
                    if names:
                        fold()
                        yield pa.RecordBatch.from_arrays([names[0], _lists(rows[0])], names=["term", "p"])
                    last, names, rows, n = part[i], [], [], 0
                names.append(batch.column("terms")[i].values)
                rows.append(batch.column("p")[i].values.to_numpy().reshape(-1, k))
                n += len(names[-1])
                if n > max(500_000, 2 * len(names[0])):
                    fold()
        if names:
            fold()
            yield pa.RecordBatch.from_arrays([names[0], _lists(rows[0])], names=["term", "p"])

    return found.repartition("term").sortWithinPartitions("term").mapInArrow(add, "term string, p array<double>")


def _asked(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """(block, at, p): the rows of table (term, p) for the terms of each block, a list a block and part of the terms, from
    place `at` on. Both sides are dealt by part; terms that the table does not have get rows of zeros."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends = batch.column("ends")[i].values.to_numpy()
                part = np.flatnonzero(np.diff(ends))
                at = pa.array(np.append(ends[part], ends[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.ones(len(part), np.int32)), pa.array(np.full(len(part), batch.column("block")[i].as_py())), at.slice(0, len(part)), pa.ListArray.from_arrays(at, batch.column("terms")[i].values), pa.array([[]] * len(part), pa.list_(pa.float64()))], names=["term", "kind", "block", "at", "terms", "p"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, rows, k = None, [], [], 1
        for batch in batches:
            part, kind = batch.column("term").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
                if part[a] != last:
                    last, names, rows = part[a], [], []
                terms, p = batch.column("terms").slice(a, b - a), batch.column("p").slice(a, b - a)
                if kind[a] == 0:
                    names.append(terms.flatten())
                    k = len(p[0].values)
                    rows.append(p.flatten().to_numpy().reshape(-1, k))
                    continue
                if not names:
                    continue
                names, rows = [pa.concat_arrays(names)], [np.concatenate(rows)]
                place = pc.index_in(terms.flatten(), value_set=names[0]).fill_null(len(names[0])).to_numpy()
                if len(rows[0]) == len(names[0]):
                    rows = [np.concatenate([rows[0], np.zeros((1, k))])]
                n = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
                lists = pa.ListArray.from_arrays(pa.array((n * k).astype(np.int32)), pa.array(rows[0][place].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(a, b - a), batch.column("at").slice(a, b - a), lists], names=["block", "at", "p"])

    part = F.pmod(F.crc32("term"), F.lit(TERM_PARTS)).cast("int")
    have = table.select(part.alias("term"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("at"), F.array("term").alias("terms"), "p")
    need = blocks.select("block", "terms", "ends").mapInArrow(ask, "term int, kind int, block long, at int, terms array<string>, p array<double>")
    return have.unionByName(need).repartition("term").sortWithinPartitions("term", "kind").mapInArrow(answer, "block long, at int, p array<double>")


def _rows(blocks: DataFrame, p_wz: DataFrame | None, p_zd: DataFrame | None, state: DataFrame | None = None) -> DataFrame:
    """What a step needs of each block, in order: rows of P(w|z) for its terms, its documents' P(z|d) or what a step before has
    said of the block (state: block, at, p), and the block itself. Counts go through one exchange, by block. No list is null:
    Spark's Arrow writer fills the nulls at the end of a list column again for each row that follows, which took most of a step."""
    lists = ["cnt", "place", "first", "ends", "docs", "terms"]
    none = [F.array().cast(blocks.schema[c].dataType).alias(c) for c in lists]
    out = blocks.select("block", F.lit(2).alias("kind"), F.lit(-1).alias("at"), F.array().cast("array<double>").alias("p"), *lists)
    if p_wz is not None:
        out = out.unionByName(_asked(blocks, p_wz).select("block", F.lit(0).alias("kind"), "at", "p", *none))
    if p_zd is not None:
        state = blocks.select("block", F.posexplode("docs").alias("at", "doc_id")).join(p_zd.select("doc_id", "p"), "doc_id").select("block", "at", "p")
    if state is not None:
        out = out.unionByName(state.select("block", F.lit(1).alias("kind"), "at", "p", *none))
    return out.repartition("block").sortWithinPartitions("block", "kind")


def _meeting(blocks: DataFrame, model: Model, p_zd: DataFrame) -> DataFrame:
    return _rows(blocks, model.p_wz, p_zd)


def _slices(first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of a block, from and up to, of SLICE_COUNTS counts at most or one document each."""
    a, n = 0, len(first) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE_COUNTS, side="right")) - 1)
        yield a, b
        a = b


def _by_place(place: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, weights=rows[:, z], minlength=n) for z in range(rows.shape[1])], 1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1), pa.float64()))


def _blocks(batches: Iterator[pa.RecordBatch], k: int, of_docs: int | None = None) -> Iterator[Block]:
    """Blocks of sorted rows of _rows, with k numbers a term, and as many or of_docs a document; missing rows are zero."""
    last: int | None = None
    width = (k, of_docs or k)
    got: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for batch in batches:
        block, kind, at = (batch.column(c).fill_null(-1).to_numpy() for c in ("block", "kind", "at"))
        change = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]]))
        for p, q in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            if block[p] != last:
                last, got = int(block[p]), [[], []]
            if kind[p] < 2:
                rows = batch.column("p").slice(p, q - p)
                n = rows.value_lengths().to_numpy() // width[kind[p]]
                place = np.repeat(at[p:q] - np.cumsum(n) + n, n) + np.arange(n.sum())
                got[kind[p]].append((place, rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width[kind[p]])))
                continue
            docs, first, terms, ends, place, cnt = (batch.column(c)[p].values for c in ("docs", "first", "terms", "ends", "place", "cnt"))
            tables = []
            for n, w, found in zip((len(terms), len(docs)), width, got, strict=True):
                x = np.zeros((n, w))
                for i, rows in found:
                    x[i] = rows
                tables.append(x)
            yield Block(last, *tables, docs, first.to_numpy(), terms, ends.to_numpy(), place.to_numpy(), cnt.to_numpy())


def em_step(counts: DataFrame, model: Model, blocks: DataFrame | None = None) -> Model:
    """One iteration. Blocks of counts meet the rows of P(w|z) and P(z|d) that they need, and one pass over them gives both
    aggregates: a row a document, and a row a block and term, which are added up by term. The likelihood it adds is that of
    the parameters it came from. Documents without counts stay or become uniform by smoothing."""
    k, o = model.options.topics, model.options
    own = blocks if blocks is not None else packed(counts)
    kind = _id_type(own)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, k):
            by_doc, by_term, ll, total, known = np.zeros((len(x.docs), k)), np.zeros((len(x.terms), k)), 0.0, 0.0, x.pw.any(1)
            for a, b in _slices(x.first):
                at, c, lengths = x.place[x.first[a] : x.first[b]], x.cnt[x.first[a] : x.first[b]], np.diff(x.first[a : b + 1])
                post = x.pw[at] * np.repeat(x.pd[a:b], lengths, axis=0)
                mix = post.sum(1)
                used = known[at] & np.repeat(x.pd[a:b].any(1), lengths)  # counts of unknown terms or documents take no part
                with np.errstate(divide="ignore", invalid="ignore"):
                    post *= np.where(used, c / mix, 0.0)[:, None]
                    ll += float(np.where(used, c * np.log(mix), 0.0).sum())
                total += float(c[used].sum())
                by_doc[a:b] = np.add.reduceat(post, x.first[a:b] - x.first[a], axis=0) + o.alpha
                by_term += _by_place(at, post, len(x.terms))
            by_doc /= by_doc.sum(1, keepdims=True)
            part, terms, sums = _by_part(x.terms, x.ends, by_term)
            n, m = len(x.docs), len(part)
            one = lambda v: pa.array([v] + [None] * (n + m - 1), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x.docs, pa.nulls(m, x.docs.type)]), pa.concat_arrays([pa.nulls(n, pa.int32()), part]), pa.concat_arrays([pa.nulls(n, terms.type), terms]), pa.concat_arrays([_lists(by_doc), sums]), one(ll), one(total)], names=["doc_id", "term", "terms", "p", "ll", "n"])

    found = written(_meeting(own, model, model.p_zd).mapInArrow(step, f"doc_id {kind}, term int, terms array<string>, p array<double>, ll double, n double"), "plsa-step")
    by_term = summed(found.where("term IS NOT NULL").select("term", "terms", "p"), k).select("term", F.transform("p", lambda x: x + F.lit(o.beta)).alias("p"))
    by_term = written(by_term, "plsa-terms")
    p_wz = written(normalized_by_topic(by_term, k), "plsa-pwz")
    dropped(by_term)
    by_doc = found.where("term IS NULL").select("doc_id", F.col("p").alias("q"))
    uniform = F.array(*[F.lit(1.0 / k)] * k)
    p_zd = written(model.p_zd.select(F.col("doc_id").cast(kind).alias("doc_id")).join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("q", uniform).alias("p")), "plsa-pzd")
    likelihood = found.agg(F.sum("ll") / F.sum("n")).first()[0]
    dropped(found, *([own] if blocks is None else []))
    return replace(model, p_wz=p_wz, p_zd=p_zd, likelihoods=(*model.likelihoods, float("nan") if likelihood is None else float(likelihood)))


def fit(counts: DataFrame, labels: DataFrame, options: Options, held_out: DataFrame | None = None) -> Model:
    """EM until the stop rule holds. Documents of held_out (doc_id) take no part."""
    if held_out is not None:
        counts = counts.join(held_out.select("doc_id"), "doc_id", "left_anti")
    counts = written(counts, "plsa-counts")
    blocks = packed(counts)
    model = _fitted(counts, labels, options, blocks)
    model = replace(model, p_z=topic_mass(counts, model, blocks))
    dropped(blocks)
    return model


def _fitted(counts: DataFrame, labels: DataFrame, options: Options, blocks: DataFrame) -> Model:
    model, slow = initialize(counts, labels, options, blocks=blocks), 0
    for _ in range(options.max_iter):
        before, model = model, em_step(counts, model, blocks)
        dropped(before.p_wz, before.p_zd)
        slow = patience(slow, model.likelihoods, options)
        if slow >= options.patience:
            break
    return model


def patience(slow: int, likelihoods: tuple[float, ...], options: Options) -> int:
    """The stop rule's count after an iteration: up for a gain below the tolerance, down to 0 for any other."""
    if len(likelihoods) < 2:
        return slow
    return slow + 1 if likelihoods[-1] - likelihoods[-2] < options.tolerance else max(0, slow - 1)


def topic_mass(counts: DataFrame, model: Model, blocks: DataFrame | None = None) -> list[float]:
    """P(z), smoothed, from words of documents and their posteriors."""
    k, alpha = model.options.topics, model.options.alpha
    words = lengths(blocks).withColumnRenamed("n_words", "n") if blocks is not None else counts.groupBy("doc_id").agg(F.sum("cnt").alias("n"))
    row = model.p_zd.join(words, "doc_id").agg(*[F.sum(F.col("n") * F.col("p")[i]) for i in range(k)], F.sum("n")).first()
    return [(alpha + (row[i] or 0.0)) / (k * alpha + (row[k] or 0.0)) for i in range(k)]


def p_w(model: Model) -> DataFrame:
    total = sum((F.col("p")[i] * F.lit(q) for i, q in enumerate(model.p_z)), F.lit(0.0))
    return model.p_wz.select("term", total.alias("p_w"))


def fold_in(counts: DataFrame, model: Model, iterations: int = 20) -> DataFrame:
    """(doc_id, p) of new documents: EM on P(z|d) alone, from uniform. A block's counts meet their rows of P(w|z) once, and all
    iterations run on them where they met. Words that the model does not know take no part."""
    k, alpha = model.options.topics, model.options.alpha
    blocks = packed(counts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, k):
            p = np.full((len(x.docs), k), 1.0 / k)
            for a, b in _slices(x.first):
                at, n = x.place[x.first[a] : x.first[b]], np.diff(x.first[a : b + 1])
                weight, row = np.where(x.pw.any(1)[at], x.cnt[x.first[a] : x.first[b]], 0.0), x.pw[at]
                for _ in range(iterations):
                    joint = row * np.repeat(p[a:b], n, axis=0)
                    mix = joint.sum(1)
                    joint *= np.divide(weight, mix, out=np.zeros_like(mix), where=weight > 0)[:, None]
                    p[a:b] = np.add.reduceat(joint, x.first[a:b] - x.first[a], axis=0) + alpha
                    p[a:b] /= p[a:b].sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([x.docs, _lists(p)], names=["doc_id", "p"])

    got = _rows(blocks, model.p_wz, None).mapInArrow(fold, f"doc_id {_id_type(blocks)}, p array<double>")
    out = written(got, "plsa-fold")
    dropped(blocks)
    return out


def jackknife(counts: DataFrame, labels: DataFrame, folds: DataFrame, n: int, options: Options) -> list[float]:
    """Final likelihood of each fold's model, on the documents that it was trained on."""
    out = []
    for i in range(n):
        own = counts.join(folds.where(F.col("fold") == i).select("doc_id"), "doc_id", "left_anti")
        blocks = packed(own)
        model = _fitted(own, labels, options, blocks)
        out.append(log_likelihood(own, model, blocks))
        dropped(blocks, model.p_wz, model.p_zd)
    return out


def long(table: DataFrame, key: str) -> DataFrame:
    return table.select(key, F.posexplode("p").alias("z", "p"))


def save(model: Model, path: str) -> None:
    """Writes the model's tables; P(z) and options are one row."""
    spark = model.p_wz.sparkSession
    model.p_wz.write.mode("overwrite").parquet(f"{path}/p_wz")
    model.p_zd.write.mode("overwrite").parquet(f"{path}/p_zd")
    o = model.options
    spark.createDataFrame([(model.p_z, o.topics, o.alpha, o.beta)], "p_z array<double>, topics int, alpha double, beta double").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> Model:  # noqa: ANN001
    p_z, topics, alpha, beta = spark.read.parquet(f"{path}/meta").first()
    return Model(spark.read.parquet(f"{path}/p_wz"), spark.read.parquet(f"{path}/p_zd"), list(p_z), Options(topics, alpha, beta))
