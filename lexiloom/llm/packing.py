"""Best-fit packing of documents into token sequences, online and in bounded space.

Documents become ids (the library's, then one end id) and are cut only if longer than a sequence: into whole sequences
from the end, so the first piece may be shorter. Pieces are dealt out to tasks at random. A task holds back `RUN` of them and
lets them arrive from the longest to the shortest; each then goes into the open sequence it fills best, at once and for
good. Open sequences are held in stacks by free space, and a bitset with a bit for each space that occurs, so the best fit
is one shift and one lowest-bit step. At most `open_bins` stay open; beyond that the fullest closes first. A task's state
does not grow with its input: it is one run and the open sequences.

A null text is empty: one piece with the end id alone. Rows are told apart by a row number, so repeated ids are packed
each; an empty table gives an empty result; other columns and their names don't matter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_or_empty, written
from .tokenizer import byte_bpe, default_path

#: Pieces that one task packs; what stays open at a task's end is at most open_bins sequences.
PIECES_A_TASK = 50_000
#: Pieces that a task holds back to let them arrive in order of length.
RUN = 8192


class OpenBins:
    """Online best fit with a bounded number of open sequences."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.next = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The sequence and offset of a piece of this length."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(sequence)
            self.n_open += 1
            if self.n_open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return sequence, self.capacity - free


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. The ids themselves are not kept."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), np.array([end_id], dtype="<u4")
        for batch in blocks(batches, "text", 8 << 20):
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([bpe.ids(text).astype("<u4", copy=False), end])
                for k, (a, b) in enumerate(piece_bounds(len(ids), capacity)):
                    at.append(i)
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    first = n % capacity or capacity
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = written(pieces(df, id_col, text_col, path or default_path(), capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    return place(slim, capacity, open_bins, pieces_a_task)


def place(slim: DataFrame, capacity: int, open_bins: int, pieces_a_task: int) -> DataFrame:
    """Packs pieces (length, row and other columns); the columns sequence_id and offset replace row."""
    tasks = max(1, -(-slim.count() // pieces_a_task))
    kept = [c for c in slim.columns if c != "row"]
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while held.num_rows >= RUN:
                yield from run(bins, held.slice(0, RUN), first)
                held = held.slice(RUN)
        if held is not None and held.num_rows:
            yield from run(bins, held, first)

    def run(bins: OpenBins, held: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        lengths = held.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        placed = [bins.put(n) for n in lengths[order].tolist()]
        t = held.take(pa.array(order))
        yield from pa.table([*(t.column(c) for c in kept), pa.array([first + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*kept, "sequence_id", "offset"]).combine_chunks().to_batches()

    dealt = slim.repartition(tasks, F.xxhash64("row", F.lit(7))).sortWithinPartitions(F.xxhash64("row"), "row")
    return dealt.mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def sequences(df: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id and its ids, from documents with distinct ids and their placement by `pack`."""
    path = path or default_path()
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in blocks(batches, "text", 4 << 20):
            at, number, out = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(bpe.ids(text), np.uint32(end_id))
                for k, (a, b) in enumerate(piece_bounds(len(ids), capacity)):
                    at.append(i)
                    number.append(k)
                    out.append(ids[a:b].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "piece", "ids"])

    ids = rows.mapInArrow(cut, f"doc_id {kind}, piece int, ids array<long>")
    found = placed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    # A sequence holds `capacity` ids at most, so its list is bounded.
    return found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
