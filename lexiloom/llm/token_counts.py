"""Token counts: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

A task reads documents in blocks and turns each into frequencies of pre-tokens. What a block has to say is dealt by the
pre-token's hash into buckets: a bucket's share of a block is one row that holds its distinct pre-tokens and, in three
flat arrays, (document, pre-token, frequency). All shares of a bucket meet in one task, which counts the pieces of each
distinct pre-token once for all blocks, multiplies and sends back one sum a document. Sums are added by block, with one
more row that holds the block's ids. Token ids of documents are never made; a very frequent pre-token is one entry a block.

Null and empty texts have no tokens and no bytes. Rows are told apart by their place, so repeated ids are counted each;
empty tables give empty results, other columns and their names don't matter."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_or_empty
from .tokenizer import byte_bpe, default_path

SHARES = "block long, bucket int, docs binary, tokens binary, counts binary, pre_tokens array<string>, ids array<{}>, sizes array<long>"
#: A block ends at so many bytes of text or rows, or after one longer row.
BLOCK_BYTES, BLOCK_ROWS = 12 << 20, 8192
#: Bytes of text whose pre-tokens meet in one bucket, on average.
BUCKET_BYTES = 64 << 20
#: Distinct pre-tokens whose counts a task remembers.
KNOWN = 1_000_000


def frequencies(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """Shares of rows (doc_id, n_bytes, row, text)."""
    schema = SHARES.format(rows.schema["doc_id"].dataType.simpleString())
    names_out = [x.split()[0] for x in schema.split(", ")]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        bpe = byte_bpe(path)
        for block, ids, sizes, texts in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([block % buckets], pa.int32()), *(pa.array([None], pa.binary()) for _ in range(3)), pa.array([None], pa.list_(pa.string())), one(ids), one(sizes)], names=names_out)
            kind = ids.type
            known: dict[str, int] = defaultdict()
            known.default_factory = known.__len__
            docs, tokens, counts = [], [], []
            for i, text in enumerate(texts):
                for part, special in bpe.parts(text) if bpe.has_special(text) else ((text, None),):
                    found = bpe.pre_tokens(part)
                    if found:
                        at, n = np.unique(np.fromiter(map(known.__getitem__, found), np.int32, len(found)), return_counts=True)
                        docs.append(np.full(len(at), i, np.int32))
                        tokens.append(at)
                        counts.append(n.astype(np.int32))
                    if special is not None:  # a special string is a pre-token of one piece, and goes by no name
                        docs.append(np.array([i], np.int32))
                        tokens.append(np.array([known[""]], np.int32))
                        counts.append(np.array([1], np.int32))
            if not known:
                continue
            names = np.array(list(known), dtype=object)
            of = np.fromiter((zlib.crc32(t.encode()) % buckets for t in names), np.int32, len(names))
            order = np.argsort(of, kind="stable")
            local = np.empty(len(names), np.int32)
            starts = np.searchsorted(of[order], np.arange(buckets + 1))
            local[order] = np.arange(len(names), dtype=np.int32) - starts[of[order]].astype(np.int32)
            docs, tokens, counts = np.concatenate(docs), np.concatenate(tokens), np.concatenate(counts)
            place = of[tokens]
            by = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[by], np.arange(buckets + 1))
            here = local[tokens]
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    own = by[cut[b] : cut[b + 1]]
                    flat = [pa.array([x[own].astype("<i4").tobytes()], pa.binary()) for x in (docs, here, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b], pa.int32()), *flat, pa.array([names[order[starts[b] : starts[b + 1]]].tolist()], pa.list_(pa.string())), pa.array([None], pa.list_(kind)), pa.array([None], pa.list_(pa.int64()))], names=names_out)

    return rows.mapInArrow(share, schema)


def one(values: pa.Array) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, list[str]]]:
    """Blocks of (number, ids, sizes, texts). The number is the first row's."""
    held: list[pa.RecordBatch] = []
    n = rows = 0

    def block() -> tuple[int, pa.Array, pa.Array, list[str]]:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: t.column(c).chunk(0)
        return t.column("row")[0].as_py(), flat("doc_id"), flat("n_bytes"), t.column("text").to_pylist()

    for batch in blocks(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
        more = pa.compute.sum(batch.column("n_bytes")).as_py()
        if held and (n + more > BLOCK_BYTES or rows + batch.num_rows > BLOCK_ROWS):
            yield block()
            held, n, rows = [], 0, 0
        held.append(batch)
        n, rows = n + more, rows + batch.num_rows
    if held:
        yield block()


def sums(shares: DataFrame, path: str) -> DataFrame:
    """For each share the partial sums of its block's documents, by place in the block; ids and sizes go through."""
    kind = shares.schema["ids"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pieces = byte_bpe(path), {"": 1}
        for batch in batches:
            if len(pieces) > KNOWN:  # counts of pre-tokens seen before; frequent ones soon return
                pieces = {"": 1}
            partial = []
            for docs, tokens, counts, names in zip(*(batch.column(c).to_pylist() for c in ("docs", "tokens", "counts", "pre_tokens")), strict=True):
                if names is None:
                    partial.append(None)
                    continue
                n = np.empty(len(names), np.int64)
                for i, name in enumerate(names):
                    if (k := pieces.get(name)) is None:
                        k = pieces[name] = bpe.n_pieces(name)
                    n[i] = k
                total = np.bincount(np.frombuffer(docs, "<i4"), weights=n[np.frombuffer(tokens, "<i4")] * np.frombuffer(counts, "<i4")).astype("<i8")
                at = np.flatnonzero(total)  # with many buckets a share has tokens of few documents
                partial.append(at.astype("<i8").tobytes() + total[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(partial, pa.binary()), batch.column("ids"), batch.column("sizes")], names=["block", "partial", "ids", "sizes"])

    return shares.mapInArrow(add, f"block long, partial binary, ids {kind}, sizes array<long>")


def totals(partials: DataFrame, kind: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens from partials dealt and sorted by block. A task holds one block at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        total = np.zeros(0, np.int64)
        own: pa.RecordBatch | None = None

        def block() -> pa.RecordBatch:
            names, sizes = own.column("ids").flatten(), own.column("sizes").flatten()
            return pa.RecordBatch.from_arrays([names, sizes, pa.array(np.concatenate([total, np.zeros(len(names), np.int64)])[: len(names)])], names=["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            for i, (number, partial) in enumerate(zip(batch.column("block").to_pylist(), batch.column("partial").to_pylist(), strict=True)):
                if number != last and last is not None:
                    yield block()
                    total, own = np.zeros(0, np.int64), None
                last = number
                if partial is None:
                    own = batch.slice(i, 1)
                    continue
                at, n = np.frombuffer(partial, "<i8").reshape(2, -1)
                if len(at) and at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(at[-1] + 1 - len(total), np.int64)])
                total[at] += n
        if last is not None:
            yield block()

    return partials.mapInArrow(add, f"doc_id {kind}, n_bytes long, n_tokens long")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512, buckets: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = df.sparkSession
    path = path or default_path()
    text = text_or_empty(text_col)
    if not buckets:  # a task's share does not grow with the input
        n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    shares = frequencies(rows, path, buckets).repartition(buckets, "bucket")
    out = totals(sums(shares, path).repartition("block").sortWithinPartitions("block"), rows.schema["doc_id"].dataType.simpleString())
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
