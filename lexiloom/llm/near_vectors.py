"""Near copies of vectors by cosine, found by cross-polytope hashing.

A vector is rotated (three rounds of random signs and a fast Hadamard transform) and named by its largest coordinate and
that one's sign; a bucket of a table joins several such names, more of them for larger tables, so that a bucket stays small.
A vector lies in its own bucket of each table and also looks into the nearest others. All pairs that meet are verified in
double precision inside the bucket's task, and only sums leave it: a vector's links, and edges that join what is linked. A
pair that meets more than once counts where it meets first, which its vectors' codes tell. Equal vectors are one class
with a number of copies. A bucket with more members than a block is compared block by block in tasks of their own.

Vectors that are null, empty, zero or have a null or non-finite component link with nothing, and so do vectors of different
lengths. Repeated ids are vectors of their own; a null id is never the smallest, and rows of nulls alone have a null
component. An empty table gives an empty result, other columns and their names don't matter."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import connected

#: Names of a bucket: number of tables, buckets looked at in each. A pair at the threshold of 0.95 in 64 dimensions is found
#: with a probability over 0.99 in each case, a closer pair more surely (tests/llm measures it).
TABLES = {1: (4, 3), 2: (6, 3), 3: (8, 4), 4: (14, 5)}
#: Vectors that share a bucket on average, at most, were they spread evenly.
CROWD = 64
#: Members of a bucket that are compared in one piece.
BLOCK = 4096
#: Coordinates that stand for a vector's next best names.
NEXT = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@functools.lru_cache(maxsize=8)
def signs(width: int, names: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20250131).choice([-1.0, 1.0], (tables, names, 3, width))


def codes(unit: np.ndarray, names: int, tables: int, probes: int) -> np.ndarray:
    """(vectors, tables, probes): a vector's own bucket in each table, then the nearest others. Each row is computed alike
    whatever rows stand beside it."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    turn = signs(width, names, tables)
    out = np.empty((len(x), tables, probes), np.int64)
    next_best = min(NEXT, width)
    for t in range(tables):
        own, other, gap = np.zeros(len(x), np.int64), [], []
        for k in range(names):
            y = x
            for s in turn[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :next_best]
            value, side = np.take_along_axis(size, top, 1), np.take_along_axis(y, top, 1) < 0
            name, place = top * 2 + side, (2 * width) ** (names - 1 - k)
            own += name[:, 0] * place
            other.append((name[:, 1:] - name[:, :1]) * place)
            gap.append((value[:, :1] - value[:, 1:]) ** 2)
        other, gap = np.concatenate(other, 1), np.concatenate(gap, 1)
        nearest = np.argsort(gap, axis=1, kind="stable")[:, : probes - 1]
        out[:, t] = own[:, None] + np.concatenate([np.zeros((len(x), 1), np.int64), np.take_along_axis(other, nearest, 1)[:, : probes - 1]], 1)[:, np.minimum(np.arange(probes), nearest.shape[1])]
        out[:, t] += t * (2 * width) ** names
    return out


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def normalised(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component goes first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucketed(classes: DataFrame, names: int, tables: int, probes: int) -> DataFrame:
    """(bucket, at_home, class, n, v): a row for each bucket that a class lies in or looks into."""
    kind = classes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                width = pa.compute.list_value_length(part.column("v")).to_numpy()
                for d in np.unique(width):  # of one length as a rule
                    rows = part.filter(pa.array(width == d))
                    found = codes(normalised(vectors_of(rows.column("v"))), names, tables, probes).reshape(rows.num_rows, -1)
                    at_home = np.tile(np.arange(tables * probes) % probes == 0, rows.num_rows)
                    own = pa.array(np.repeat(np.arange(rows.num_rows), tables * probes))
                    for lo in range(0, len(own), 1 << 14):  # a batch with copies of vectors stays small
                        i = own.slice(lo, 1 << 14)
                        yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)[lo : lo + (1 << 14)]), pa.array(at_home[lo : lo + (1 << 14)]), *(rows.column(c).take(i) for c in ("class", "n", "v"))], names=["bucket", "at_home", "class", "n", "v"])


    return classes.select("class", "n", "v").mapInArrow(place, f"bucket long, at_home boolean, class long, n long, v {kind}")


def links_in(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, home: np.ndarray, side: np.ndarray | None, bucket: int, least: float, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a bucket's members: their links that count here, and a label that linked ones share. With side (0, 1, per member)
    only pairs of different sides are compared."""
    order = np.argsort(ids, kind="stable")
    x, ids, weight, home = normalised(x[order]), ids[order], weight[order], home[order]
    side = None if side is None else side[order]
    found = []
    for lo in range(0, len(x), 512):
        good = x[lo : lo + 512] @ x[lo:].T >= least
        a, b = np.nonzero(good)
        a, b = a + lo, b + lo
        fit = (a < b) & (home[a] | home[b])
        if side is not None:
            fit &= side[a] != side[b]
        found.append((a[fit], b[fit]))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if not len(a):
        return None
    some = np.unique(np.concatenate([a, b]))
    code = codes(x[some], *shape)
    table = bucket // (2 * (1 << max(1, (x.shape[1] - 1).bit_length()))) ** shape[0]
    counted = []
    for lo in range(0, len(a), 1 << 16):
        i, j = np.searchsorted(some, a[lo : lo + (1 << 16)]), np.searchsorted(some, b[lo : lo + (1 << 16)])
        open_ = np.ones(len(i), bool)
        for t in range(table):  # met before?
            k = np.flatnonzero(open_)
            open_[k] = ~((code[i[k], t, :1] == code[j[k], t]).any(1) | (code[j[k], t, :1] == code[i[k], t]).any(1))
        first = (code[i, table, :1] == code[j, table]).any(1)
        counted.append(open_ & (np.where(first, code[i, table, 0], code[j, table, 0]) == bucket))
    counted = np.concatenate(counted)
    a, b = a[counted], b[counted]
    if not len(a):
        return None
    links = np.zeros(len(x), np.int64)
    np.add.at(links, a, weight[b])
    np.add.at(links, b, weight[a])
    label = np.arange(len(x))
    while True:  # the smallest place spreads along links
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(links)
    return ids[own], links[own], ids[label[own]]


def compared(members: DataFrame, least: float, shape: tuple[int, int, int]) -> DataFrame:
    """(class, links, low): sums of links by bucket, and a class that it hangs together with. members are sorted by (bucket,
    width, i, j); block is the member's own, i and j the two blocks that are compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def result() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            home = t.column("at_home").to_numpy(zero_copy_only=False)
            if t.num_rows < 2 or not home.any():
                return
            bucket, _, i, j = last
            side = None if i == j else (t.column("own").to_numpy() == j).astype(np.int8)
            got = links_in(vectors_of(t.column("v").chunk(0)), t.column("class").to_numpy(), t.column("n").to_numpy(), home, side, bucket, least, shape)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["class", "links", "low"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "width", "i", "j")])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(keys[:, p].tolist())
                if key != last and held:
                    yield from result()
                    held = []
                last = key
                held.append(batch.slice(p, q - p))
        if held:
            yield from result()

    return members.mapInArrow(compare, "class long, links long, low long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, block: int = BLOCK, names: int | None = None) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    v = F.col(f"`{vector_col}`")
    number = v.cast("array<double>")
    fine = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(fine, v).alias("v"))
    classes = written(rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not names:
        base = 2 * (1 << max(1, ((width or 1) - 1).bit_length()))
        names = min(max(TABLES), max(2, math.ceil(math.log(max(n, 1) / CROWD, base))))
    shape = (names, *TABLES[names])
    placed = bucketed(classes, *shape).withColumn("width", F.size("v"))
    crowded = placed.groupBy("bucket", "width").agg(F.count("*").alias("m")).where(F.col("m") > block).select("bucket", "width", F.ceil(F.col("m") / block).cast("int").alias("g"))
    members = placed.join(written(crowded, "vector-crowds"), ["bucket", "width"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class"), F.col("g")).cast("int"))
    members = members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("bucket", "width", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "at_home", "class", "n", "v")
    found = written(compared(members.repartition("bucket", "width", "i", "j").sortWithinPartitions("bucket", "width", "i", "j"), least, shape), "vector-links")
    parts = connected(found.select(F.col("class").alias("a"), F.col("low").alias("b")))
    lowest = parts.join(classes.select(F.col("class").alias("node"), "low"), "node").groupBy("component").agg(F.min("low").alias("lowest"))
    named = parts.join(lowest, "component").select(F.col("node").alias("class"), "lowest")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    whole = classes.join(links, "class", "left").join(named, "class", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    out = rows.join(whole, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
