"""Similarities and distances of sparse documents, dense vectors and topics; matrices are long tables (i, j, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..sources.tables import written
from .plsa import packed

#: Cells of the products that are made at once, and pairs of a batch that goes back to Spark.
CELLS, BATCH_PAIRS = 1 << 17, 1 << 17
#: Terms that at least one document of a block in so many has are multiplied as a matrix, the others by their lists.
FREQUENT = 15
#: Counts of a block of documents whose pairs are made.
PAIR_COUNTS = 500_000

Finish = Callable[[np.ndarray], np.ndarray]


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """x to so many places, halves away from zero, without negative zeros; done where pairs are made, since Spark's round goes
    over a decimal number for each."""
    y = x * 10.0**places
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):
        whole += np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)
    return np.where(np.isfinite(y), whole / 10.0**places, x) + 0.0


def dot_products(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """(i, j, value) of all pairs with a common term, from vectors (doc_id, term, value)."""
    return block_products(packed(left, value, most=PAIR_COUNTS), packed(right, value, most=PAIR_COUNTS))


def cosine(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    return block_products(packed(left, value, most=PAIR_COUNTS), packed(right, value, most=PAIR_COUNTS), unit=True)


def _crossed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of right with every block of left. The smaller side, which tasks hold, is the second one. Blocks of right
    are dealt to all cores, since pairs are many more than what they are made of; no pair is shuffled."""
    dealt = right.repartition(max(4 * right.sparkSession.sparkContext.defaultParallelism, right.rdd.getNumPartitions()))
    return dealt.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).crossJoin(left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]))


def _pair_batches(ids: pa.Array, others: pa.Array, values: list[np.ndarray], kept: np.ndarray | None, names: list[str], finish: Finish | None = None) -> Iterator[pa.RecordBatch]:
    """Matrices of values (ids by others) as rows i, j, values, less those that kept leaves out. Masked cells are null."""
    step = max(1, BATCH_PAIRS // max(1, len(others)))
    for a in range(0, len(ids), step):
        b = min(len(ids), a + step)
        if kept is None:
            i, j = np.repeat(np.arange(a, b), len(others)), np.tile(np.arange(len(others)), b - a)
            cells = [v[a:b].reshape(-1) for v in values]
        else:
            i, j = np.nonzero(kept[a:b])
            cells, i = [v[a:b][kept[a:b]] for v in values], i + a
        columns = [pa.array(finish(v) if finish else v, pa.float64()) for v in cells]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), others.take(pa.array(j)), *columns], names=["i", "j", *names])


class _Terms:
    """A block's counts by term: lists of documents and values, and a matrix for terms that many documents have."""

    def __init__(self, n: int, first: np.ndarray, place: np.ndarray, value: np.ndarray, terms: int) -> None:
        order = np.argsort(place, kind="stable")
        docs = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))[order]
        value = value[order]
        at = np.searchsorted(place[order], np.arange(terms + 1))
        length = np.diff(at)
        frequent = length * FREQUENT >= n
        self.n, self.docs, self.value, self.at = n, docs, value, at[:-1]
        self.length = np.where(frequent, 0, length)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        used = np.repeat(frequent, length)
        self.matrix = np.zeros((int(frequent.sum()), n))
        self.matrix[np.repeat(self.row, length)[used], docs[used]] = value[used]

    def times(self, rows: int, who: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Products of so many vectors, whose values are given by vector and term, and all documents."""
        n, row = self.n, self.row[term]
        dense, at, length = row >= 0, self.at[term], self.length[term]
        ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + length, length)
        out = np.bincount(np.repeat(who * n, length) + self.docs[place], np.repeat(value, length) * self.value[place], rows * n).reshape(rows, n).astype(np.float64, copy=False)  # whole numbers if empty
        if dense.any():
            own = np.zeros((rows, len(self.matrix)))
            own[who[dense], row[dense]] = value[dense]
            out += own @ self.matrix
        return out


def block_products(left: DataFrame, right: DataFrame, unit: bool = False, finish: Finish | None = None) -> DataFrame:
    """(i, j, value) of pairs with a common term, of vectors of length one if `unit`, from two tables of blocks of documents
    (`plsa.packed`); finish is applied to the values. Every two blocks meet in one task, and a pair's sum is whole there: pairs
    go through no shuffle, and what is held is a block's, not a term's, size. Work is in proportion to the terms that pairs
    have in common."""
    kinds = [x.schema["docs"].dataType.elementType for x in (left, right)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c, row=row, batch=batch: batch.column(c)[row].values

                def values(side: str) -> np.ndarray:
                    first, val = of(f"{side}_first").to_numpy(), of(f"{side}_cnt").to_numpy()
                    if not unit:
                        return val
                    norm = np.sqrt(np.add.reduceat(val * val, first[:-1]))
                    if not norm.all():
                        raise ZeroDivisionError("a vector of length zero")
                    return val / np.repeat(norm, np.diff(first))

                if (number := batch.column("r_block")[row].as_py()) != last:  # it meets several blocks of the left side
                    last, others, names = number, of("r_docs"), of("r_terms")
                    r_first, r_place, r_val = of("r_first").to_numpy(), of("r_place").to_numpy(), values("r")
                    positive = bool((r_val > 0).all())
                    lists = _Terms(len(others), r_first, r_place, r_val, len(names))
                    held = None if positive else _Terms(len(others), r_first, r_place, np.ones_like(r_val), len(names))
                ids, l_first, l_val = of("l_docs"), of("l_first").to_numpy(), values("l")
                term = pa.compute.index_in(of("l_terms"), value_set=names).fill_null(-1).to_numpy()[of("l_place").to_numpy()]
                signs = not (positive and (l_val > 0).all())  # else a pair with a common term has a positive sum
                if signs and held is None:
                    held = _Terms(len(others), r_first, r_place, np.ones_like(r_val), len(names))
                step = max(1, CELLS // len(others))
                for a in range(0, len(ids), step):
                    b = min(len(ids), a + step)
                    own = slice(l_first[a], l_first[b])
                    known = term[own] >= 0
                    who = np.repeat(np.arange(b - a), np.diff(l_first[a : b + 1]))[known]
                    out = lists.times(b - a, who, term[own][known], l_val[own][known])
                    met = (held.times(b - a, who, term[own][known], np.ones(len(who))) if signs else out) > 0
                    yield from _pair_batches(ids.slice(a, b - a), others, [np.minimum(out, 1.0) if unit else out], met, ["value"], finish)

    return _crossed(left, right).mapInArrow(multiply, f"i {kinds[0].simpleString()}, j {kinds[1].simpleString()}, value double")


#: Vectors of a block that all pairs of two blocks are made of.
DENSE_BLOCK = 512


def _dense_blocks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """A written table of blocks of equally long vectors: ids, v (flat, with nulls) and size, which is -1 for null vectors."""
    kind = vectors.schema[key].dataType
    arrow = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, pa.Array]]] = {}
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        def block(size: int) -> pa.RecordBatch:
            parts = held.pop(size)
            ids, v = (pa.concat_arrays(list(x)) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([one(ids), one(v), pa.array([size], pa.int32())], names=["ids", "v", "size"])

        for batch in batches:
            lists = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for a in range(0, len(at), DENSE_BLOCK):
                    some = pa.array(at[a : a + DENSE_BLOCK])
                    held.setdefault(size, []).append((batch.column(0).take(some), lists.take(some).flatten()))
                    if sum(len(x[0]) for x in held[size]) >= DENSE_BLOCK:
                        yield block(size)
        for size in list(held):
            yield block(size)

    return written(vectors.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(pack, f"ids array<{kind.simpleString()}>, v array<double>, size int"), "vector-blocks")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all pairs, added up in order of the components, as a row by row sum is."""
    out, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += np.multiply(x[:, None], y[None, :], out=part)
    return out


def _square(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = _square(a)[:, None] * _square(b)[None, :]
    if not lengths.all():
        raise ZeroDivisionError("a vector of length zero")
    return _dot(a, b) / np.sqrt(lengths)


def _symmetric_kl(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, y in zip(a.T, b.T, strict=True):
            u, w = x[:, None], y[None, :]
            out += np.where((u > 0) & (w > 0), (u - w) * np.log(u / w), 0.0)
    return out / 2


#: Measures of all pairs of two blocks, by name.
DENSE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"inner": _dot, "cosine": _cosine, "symmetric_kl": _symmetric_kl}


def dense_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, *measures: str, finish: Finish | None = None) -> DataFrame:
    """(i, j, a column a measure) of all pairs of a vector of left and one of right. Blocks of vectors meet in tasks, as in
    block_products; finish is applied to the values. A pair with a null vector, a null component or different lengths has null measures."""
    blocks = [_dense_blocks(x, key, vector) for x in (left, right)]
    kinds = [x.schema[key].dataType.simpleString() for x in (left, right)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c, row=row, batch=batch: batch.column(c)[row]
                ids, sizes, vs, whole = [], [], [], []
                for side in "lr":
                    ids.append(of(f"{side}_ids").values)
                    sizes.append(of(f"{side}_size").as_py())
                    flat = of(f"{side}_v").values
                    shape = (len(ids[-1]), max(0, sizes[-1]))
                    none = pa.compute.is_null(flat).to_numpy(zero_copy_only=False).reshape(shape)
                    vs.append(pa.compute.fill_null(flat, 1.0).to_numpy(zero_copy_only=False).reshape(shape))
                    whole.append(~none.any(1))
                fits = sizes[0] == sizes[1] >= 0
                void = ~(whole[0][:, None] & whole[1][None, :]) if fits else np.ones((len(ids[0]), len(ids[1])), bool)
                values = [DENSE[m](*vs) if fits else np.zeros(void.shape) for m in measures]
                values = [np.ma.array(finish(v) if finish else v, mask=void) if void.any() else finish(v) if finish else v for v in values]
                yield from _pair_batches(*ids, values, None, list(measures))

    return _crossed(*blocks).mapInArrow(measure, f"i {kinds[0]}, j {kinds[1]}, " + ", ".join(f"{m} double" for m in measures))


def log_distance(pairs: DataFrame, ceiling: float = 1.25, positive: bool = False) -> DataFrame:
    """-ln of similarities; zeros get `ceiling` times that of the smallest positive one. Where all are known to be positive,
    pairs are not made twice to look for it."""
    if positive:
        return pairs.withColumn("value", -F.log("value"))
    low = pairs.where("value > 0").agg(F.min("value").alias("__low"))
    return pairs.crossJoin(F.broadcast(low)).withColumn("value", F.when(F.col("value") > 0, -F.log("value")).otherwise(F.lit(ceiling) * -F.log("__low"))).drop("__low")


def square(ids: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """All pairs i <= j of a small set of ids, with 0 where pairs has none. For topics and other sets of bounded size."""
    i, j = ids.select(F.col(id_col).alias("i")), ids.select(F.col(id_col).alias("j"))
    return i.join(j, F.col("i") <= F.col("j")).join(pairs, ["i", "j"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    return dense_dot(a, b) / F.sqrt(dense_dot(a, a) * dense_dot(b, b))


def dense_symmetric_kl(a: Column, b: Column) -> Column:
    """Half of both divergences; entries where either side is not positive add nothing."""
    term = lambda x, y: F.when((x > 0) & (y > 0), (x - y) * F.log(x / y)).otherwise(0.0)
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x) / 2


def dense_l1(a: Column) -> Column:
    total = F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: x.cast("double") / total)


def to_distance(similarity: Column, ceiling: float) -> Column:
    """-ln, at most ceiling; similarities outside 0 to 1 are an error."""
    bad = (similarity < 0) | (similarity > 1)
    return F.when(bad, F.raise_error(F.lit("similarity outside 0 to 1")).cast("double")).when(similarity == 0, F.lit(float(ceiling))).otherwise(F.least(-F.log(similarity), F.lit(float(ceiling))))


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["i", "j"]).select("i", "j", (F.col("va") + F.col("vb")).alias("value"))


def matrix_lerp(a: DataFrame, b: DataFrame, w: float) -> DataFrame:
    if not 0 <= w <= 1:
        raise ValueError("the weight is outside 0 to 1")
    return a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["i", "j"]).select("i", "j", (w * F.col("va") + (1 - w) * F.col("vb")).alias("value"))


#: Distances of two topics from sums over words of their probabilities p and q.
TOPIC_DISTANCES = {
    "bhattacharyya": lambda p, q: -F.log(F.sum(F.sqrt(p * q))),
    "inner": lambda p, q: -F.log(F.sum(p * q)),
    "intersection": lambda p, q: -F.log(F.sum(F.least(p, q))),
    "chebyshev": lambda p, q: F.max(F.abs(p - q)),
    "soergel": lambda p, q: F.sum(F.abs(p - q)) / F.sum(F.greatest(p, q)),
    "kulczynski": lambda p, q: F.sum(F.abs(p - q)) / F.sum(F.least(p, q)),
}


def topic_distances(p_wz: DataFrame, kind: str = "kulczynski") -> DataFrame:
    """(i, j, value) of all pairs of topics, both ways and with themselves, from (term, p: array by topic). A word meets its
    K * K pairs in its own row, so no row is joined."""
    both = p_wz.select(F.posexplode("p").alias("i", "pi"), "p").select("i", "pi", F.posexplode("p").alias("j", "pj"))
    return both.groupBy("i", "j").agg(TOPIC_DISTANCES[kind](F.col("pi"), F.col("pj")).alias("value"))


def topic_ranks(distances: DataFrame) -> DataFrame:
    """Each topic's ranks of all topics by distance, itself first among equals."""
    order = Window.partitionBy("i").orderBy("value", (F.col("i") != F.col("j")).cast("int"), "j")
    return distances.select("i", "j", F.row_number().over(order).cast("int").alias("rank"))


def save_distances(distances: DataFrame, labels: DataFrame, path: str) -> None:
    """Writes a complete matrix (i, j, value) and its items' labels (i, label)."""
    distances.select("i", "j", "value").write.mode("overwrite").parquet(f"{path}/matrix")
    labels.select("i", "label").write.mode("overwrite").parquet(f"{path}/labels")


def load_distances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables. A matrix that is not square, or labels that are not one for each of its items, are errors."""
    matrix, labels = spark.read.parquet(f"{path}/matrix"), spark.read.parquet(f"{path}/labels")
    sides = matrix.groupBy("i").agg(F.count("*").alias("n"), F.countDistinct("j").alias("others"))
    named = labels.groupBy("i").agg(F.count("*").alias("named"))
    met = sides.join(named, "i", "full").agg(F.count("n").alias("rows"), F.count("named").alias("labels"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("others").alias("others"), F.max("named").alias("twice"), F.sum((F.col("n").isNull() | F.col("named").isNull()).cast("int")).alias("lost")).first()
    columns = matrix.select("j").distinct().count()
    if met.rows and not (met.least == met.most == met.others == met.rows == columns):
        raise ValueError("the matrix is not square")
    if met.lost or (met.twice or 1) > 1:
        raise ValueError("labels and items of the matrix differ")
    return matrix, labels
