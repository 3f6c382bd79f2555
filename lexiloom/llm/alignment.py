"""Alignment of two tokenizers over the same bytes, and how common each linked pair of ids is in the corpus.

A text is cut where a space follows a character that is no white space: there both tokenizers have a token's end, whatever
stands around. A unit between such cuts is aligned once a block, and a document is the sum of its units. What a block has to
say of a pair of ids (documents and multiplicities, in order) is a postings list; lists are dealt by the first id. Sorted
streams bring a bucket's corpus-wide counts first and its lists after them, so a task holds the counts of one bucket and one
list at a time; the maximum of an id is taken there, and lists turn into contributions of documents, which are summed by
block. A bucket with more postings than a task should have is split by block, and its counts (at most the vocabularies'
product, of few pairs really) go to each part.

Null and empty texts, and texts whose tokens do not give their bytes back, have no tokens: zeros and an empty digest. Rows
are told apart by their place, so repeated ids count as documents each; null ids go through, an empty table gives an empty
result, other columns and their names don't matter."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_or_empty, written
from .tokenizer import byte_bpe, default_path

#: A block ends at so many bytes of text or rows, or after one longer row.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 8192
#: Postings (documents of pairs) of a bucket's part, on average at most.
PART_POSTINGS = 8 << 20
BUCKET_BYTES = 64 << 20
#: Characters of units that are encoded in one call.
TOGETHER = 1 << 15
UNIT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Ids and byte lengths by both tokenizers: byte-level BPE (A), and pieces that add a space in front (B)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = byte_bpe(path_a).encoding
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go on after a space are not supported")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_b = np.fromiter(map(len, self.bytes_b), np.int64, n)
        self.len_a = np.fromiter((len(x) for x in (self._bytes_a(i) for i in range(self.a.n_vocab))), np.int64, self.a.n_vocab)
        self.names = [str(i) for i in range(max(n, self.a.n_vocab))]

    def _bytes_a(self, i: int) -> bytes:
        try:
            return self.a.decode_single_token_bytes(i)
        except KeyError:  # an id that no token has
            return b""

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides' ids of a text that begins with a space; None if they don't give its bytes back."""
        raw = text.encode()
        a, b = self.a.encode_to_numpy(text, disallowed_special=()), self.b.encode(text[1:])
        same = b"".join(map(self.bytes_b.__getitem__, b)) == raw and self.a.decode_bytes(a.tolist()) == raw
        return (a.astype(np.int32), np.array(b, np.int32)) if same else None

    def encode_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both sides' ids of units, and which units come back whole; the others have no tokens. Units are encoded many at a
        time: where one ends without white space, both tokenizers have an end."""
        same = np.ones(len(units), bool)
        ids_a, ids_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        ends = [i + 1 for i, n in enumerate(accumulate(map(len, units))) if n // TOGETHER != (n - len(units[i])) // TOGETHER or units[i][-1].isspace()]
        todo = [(p, q) for p, q in zip([0, *ends], [*ends, len(units)], strict=True) if p < q][::-1]
        while todo:
            p, q = todo.pop()
            if got := self.encode("".join(units[p:q])):
                ids_a.append(got[0])
                ids_b.append(got[1])
            elif q - p == 1:
                same[p] = False
            else:
                todo += [((p + q) // 2, q), (p, (p + q) // 2)]
        return np.concatenate(ids_a), np.concatenate(ids_b), same

    def valid(self, parts: list[str]) -> bool:
        """Whether a text, given as its units, comes back whole from both sides' tokens."""
        return self.encode("".join(parts)) is not None


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


class Units:
    """Figures, links and digest parts of distinct units."""

    def __init__(self, known: Aligner, units: list[str]) -> None:
        a, b, self.same = known.encode_all(units)
        size = np.fromiter((len(u.encode()) for u in units), np.int64, len(units)) * self.same
        end_a, end_b, unit_end = np.cumsum(known.len_a[a]), np.cumsum(known.len_b[b]), np.cumsum(size)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.n_a, self.n_b, self.n_groups = (np.diff(np.searchsorted(ends, unit_end, side="right"), prepend=0) for ends in (end_a, end_b, cuts))
        low = np.searchsorted(end_b, end_a - known.len_a[a], side="right")  # the first B token that ends after A's start
        high = np.searchsorted(end_b - known.len_b[b], end_a, side="left")  # the first that starts at A's end or later
        n = high - low
        unit_a = np.repeat(np.arange(len(units), dtype=np.int32), self.n_a)
        self.n_links = np.bincount(unit_a, weights=n, minlength=len(units)).astype(np.int64)
        key = np.stack([np.repeat(unit_a, n), np.repeat(a, n), b[ranges(low, n)]])  # 32 bits each
        order = np.lexsort(key[::-1])
        key = key[:, order]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        at = np.flatnonzero(new)
        self.link_a, self.link_b = key[1, at].astype(np.int64), key[2, at].astype(np.int64)
        self.times = np.diff(np.append(at, key.shape[1])).astype(np.int32)
        self.first = np.searchsorted(key[0, at], np.arange(len(units) + 1))
        # Digest parts: A ids and B ids of a group, groups one after the other.
        cut_a, cut_b = (np.concatenate([[0], np.searchsorted(ends, cuts, side="right")]).tolist() for ends in (end_a, end_b))
        text_a, text_b = [known.names[i] for i in a.tolist()], [known.names[i] for i in b.tolist()]
        groups = [f"{text_a[p]}|{text_b[r]}" if q - p == 1 == s - r else f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:], strict=True)]
        ends = np.cumsum(self.n_groups).tolist()
        self.digest = [groups[e - 1] if k == 1 else ";".join(groups[e - k : e]) for e, k in zip(ends, self.n_groups.tolist(), strict=True)]


def postings_schema(kind: str) -> str:
    own = f"array<struct<doc_id:{kind},{','.join(f'{f}:bigint' for f in FIGURES)},groups_sha256:string>>"
    return f"block long, bucket int, a array<int>, b array<int>, n array<int>, docs array<smallint>, times array<int>, own {own}"


def postings(rows: DataFrame, path_a: str, path_b: str, buckets: int) -> DataFrame:
    """For each block of rows (doc_id, row, text) a row with its documents' figures, and a row for each bucket of first ids:
    pairs (a, b) with the number n of documents, then these documents' places in the block and multiplicities, flat."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(path_a, path_b)
        for batch in blocks(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            block = batch.column("row")[0].as_py()
            index: defaultdict[str, int] = defaultdict(count().__next__)  # refers to nothing of its own, so it goes at once
            of_docs: list[np.ndarray] = []
            for text in batch.column("text"):
                parts = UNIT.findall(" " + text.as_py()) if len(text.as_py()) else []
                of_docs.append(np.fromiter(map(index.__getitem__, parts), np.int32, len(parts)))
            names = list(index)
            units = Units(known, names)
            digests: list[str] = []
            for i, found in enumerate(of_docs):
                if not len(found):
                    digests.append("")
                elif not units.same[found].all() and not known.valid([names[u] for u in found]):
                    of_docs[i] = found[:0]
                    digests.append("")
                else:
                    digests.append(hashlib.sha256(";".join(map(units.digest.__getitem__, found.tolist())).encode()).hexdigest())
            n_docs = len(of_docs)
            doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(x) for x in of_docs])
            unit = np.concatenate(of_docs)
            figures = {f: np.bincount(doc, weights=getattr(units, f)[unit], minlength=n_docs).astype(np.int64) for f in FIGURES}
            own = pa.StructArray.from_arrays([batch.column("doc_id"), *(pa.array(figures[f]) for f in FIGURES), pa.array(digests, pa.string())], names=["doc_id", *FIGURES, "groups_sha256"])
            yield row_of([block], [None], None, own)
            if not len(unit):
                continue
            held, times = np.unique(doc * np.int64(len(names)) + unit, return_counts=True)  # a document's distinct units
            doc, unit = np.divmod(held, len(names))
            n = units.first[unit + 1] - units.first[unit]
            at = ranges(units.first[unit], n)
            times = np.repeat(times.astype(np.int32), n) * units.times[at]
            pair, place = np.unique((units.link_a % buckets << 48) | (units.link_a << 24) | units.link_b, return_inverse=True)
            key = place[at] * n_docs + np.repeat(doc, n)
            del held, doc, unit, at
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.add.reduceat(times, first)
            of_pair, docs = np.divmod(key[first], n_docs)
            bucket = pair >> 48
            n = np.bincount(of_pair, minlength=len(pair))
            ends = np.concatenate([[0], np.cumsum(n)])
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                lo, hi = ends[p], ends[q]
                yield row_of([block], [int(bucket[p])], [(pair[p:q] >> 24) & 0xFFFFFF, pair[p:q] & 0xFFFFFF, n[p:q], docs[lo:hi], times[lo:hi]], None)

    schema = postings_schema(kind)
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int16(), pa.int32()]
    own_type = pa.list_(pa.struct([("doc_id", to_arrow(rows, "doc_id")), *((f, pa.int64()) for f in FIGURES), ("groups_sha256", pa.string())]))
    names_out = ["block", "bucket", "a", "b", "n", "docs", "times", "own"]

    def row_of(block: list, bucket: list, flat: list[np.ndarray] | None, own: pa.StructArray | None) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(t.to_pandas_dtype()), t)) for x, t in zip(flat, types, strict=True)] if flat else [pa.nulls(1, pa.list_(t)) for t in types]
        last = pa.nulls(1, own_type) if own is None else pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), *lists, last], names=names_out)

    return rows.mapInArrow(lists, schema)


def to_arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def contributions(streams: DataFrame) -> DataFrame:
    """Of streams sorted by (bucket, part, kind): counts of pairs (kind 0: one first id a row) set what the lists after them
    (kind 1) are looked up in. Gives a list's documents with the links whose count is the first id's highest, and the sum of counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        pairs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        best: list[np.ndarray] = []
        table: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            for i, (bucket, part, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "kind")), strict=True)):
                if (bucket, part) != here:
                    here, pairs, counts, best, table = (bucket, part), [], [], [], None
                of = lambda c, i=i, batch=batch: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                if kind == 0:
                    df = of("dfs").astype(np.int64)
                    pairs.append((of("a").astype(np.int64) << 24) | of("b"))
                    counts.append(df)
                    best.append(df == df.max())
                    continue
                if table is None:
                    keys = np.concatenate(pairs)
                    order = np.argsort(keys)
                    table = keys[order], np.concatenate(counts)[order], np.concatenate(best)[order]
                    pairs, counts, best = [], [], []
                n, docs, times = of("n"), of("docs").astype(np.int64), of("times").astype(np.int64)
                at = np.repeat(np.searchsorted(table[0], (of("a").astype(np.int64) << 24) | of("b")), n)
                total, top = (np.zeros(int(docs.max()) + 1, np.int64) for _ in range(2))
                np.add.at(total, docs, times * table[1][at])
                np.add.at(top, docs, times * table[2][at])
                own = np.flatnonzero(total)
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), one(own.astype(np.int16), pa.int16()), one(top[own], pa.int64()), one(total[own], pa.int64())], names=["block", "docs", "n_best", "count_sum"])

    return streams.mapInArrow(add, "block long, docs array<smallint>, n_best array<bigint>, count_sum array<bigint>")


def totals(sums: DataFrame, kind: str) -> DataFrame:
    """One row a document from rows dealt and sorted by block: its contributions, and the row with its documents."""
    names = ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        own: pa.StructArray | None = None
        held = np.zeros((2, BLOCK_ROWS + 1), np.int64)

        def block() -> pa.RecordBatch:
            n = len(own)
            return pa.RecordBatch.from_arrays([own.field("doc_id"), *(own.field(f) for f in FIGURES), pa.array(held[0, :n]), pa.array(held[1, :n]), own.field("groups_sha256")], names=names)

        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                if number != last and last is not None:
                    yield block()
                    held[:] = 0
                last = number
                if batch.column("own")[i].is_valid:
                    own = batch.column("own").slice(i, 1).flatten()
                    continue
                docs = batch.column("docs")[i].values.to_numpy()
                for k, c in enumerate(("n_best", "count_sum")):
                    held[k, docs] += batch.column(c)[i].values.to_numpy()
        if last is not None:
            yield block()

    return sums.mapInArrow(add, f"doc_id {kind}, {', '.join(f'{f} long' for f in (*FIGURES, 'n_best', 'count_sum'))}, groups_sha256 string")


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def alignment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, buckets: int | None = None, part_postings: int = PART_POSTINGS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    path_a, path_b = path_a or default_path(), path_b or default_piece_path()
    text = text_or_empty(text_col)
    if not buckets:  # a task's share does not grow with the input, as far as there are ids
        n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES), 1 << 15)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = written(postings(rows, path_a, path_b, buckets), "alignment-postings")
    lists = made.where(F.col("bucket").isNotNull())
    counts = lists.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("df"))
    by_id = counts.groupBy("a").agg(F.collect_list(F.struct("b", "df")).alias("x"))  # at most a vocabulary
    parts = F.broadcast(lists.groupBy("bucket").agg(F.ceil(F.sum(F.size("docs")) / part_postings).cast("int").alias("parts")))  # at most 32,768 rows
    heads = by_id.withColumn("bucket", (F.col("a") % buckets).cast("int")).join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.array_repeat("a", F.size("x")).alias("a"), F.col("x.b").alias("b"), F.lit(None).cast("array<int>").alias("n"), F.lit(None).cast("array<smallint>").alias("docs"), F.lit(None).cast("array<int>").alias("times"), F.col("x.df").alias("dfs"))
    tails = lists.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "block", "a", "b", "n", "docs", "times", F.lit(None).cast("array<bigint>").alias("dfs"))
    streams = heads.unionByName(tails).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    found = contributions(streams).withColumn("own", F.lit(None).cast(made.schema["own"].dataType))
    ids = made.where(F.col("bucket").isNull()).select("block", F.lit(None).cast("array<smallint>").alias("docs"), F.lit(None).cast("array<bigint>").alias("n_best"), F.lit(None).cast("array<bigint>").alias("count_sum"), "own")
    return totals(found.unionByName(ids).repartition("block").sortWithinPartitions("block"), kind)
