"""Products of all pairs by blocks against brute force, and counts lines of long documents."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import plsa, similarity
from lexiloom.sources import readers


@pytest.mark.parametrize(("block", "signed"), [(1, True), (9, False), (400_000, True)])
def test_products_of_sparse_vectors(spark, monkeypatch, block, signed):
    monkeypatch.setattr(plsa, "BLOCK_COUNTS", block)
    rng = random.Random(3)
    rows = [(d, f"t{t}", float(rng.choice([-2, -1, 1, 2, 3] if signed else [1, 2, 3]))) for d in range(40) for t in rng.sample(range(30), rng.randint(1, 6))]
    rows += [(100, "t1", 1.0), (100, "t2", 1.0), (101, "t1", 1.0), (101, "t2", -1.0)]  # a common term and a sum of zero
    v = spark.createDataFrame(rows, "doc_id long, term string, value double").repartition(3)
    of = {}
    for d, t, x in rows:
        of.setdefault(d, {})[t] = x
    want = {(i, j): sum(a[t] * b[t] for t in a if t in b) for i, a in of.items() if i % 5 == 0 for j, b in of.items() if a.keys() & b.keys()}
    ask = v.where("doc_id % 5 = 0")
    pairs = similarity.dot_products(ask, v)
    assert {(r.i, r.j): r.value for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan  # no pair is shuffled
    norm = {d: math.sqrt(sum(x * x for x in a.values())) for d, a in of.items()}
    got = {(r.i, r.j): r.value for r in similarity.cosine(ask, v).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(min(1.0, want[p] / norm[p[0]] / norm[p[1]])) for p in want)


def test_measures_of_dense_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "DENSE_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(20)] + [(20, None), (21, [1.0, None, 2.0, 3.0]), (22, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    pairs = similarity.dense_pairs(v.where("vec_id % 2 = 0"), v, "vec_id", "v", *similarity.DENSE)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # measured by block, not by row
    got = {(r.i, r.j): r for r in pairs.collect()}
    assert len(got) == 12 * 23
    a, b = F.col("a"), F.col("b")
    both = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("i"), F.col("v").alias("a")).crossJoin(v.select(F.col("vec_id").alias("j"), F.col("v").alias("b")))
    for r in both.select("i", "j", similarity.dense_dot(a, b).alias("inner"), similarity.dense_cosine(a, b).alias("cosine"), similarity.dense_symmetric_kl(a, b).alias("kl")).collect():
        assert got[r.i, r.j].inner == r.inner and got[r.i, r.j].cosine == r.cosine
        if r.inner is not None:
            assert got[r.i, r.j].symmetric_kl == pytest.approx(r.kl)


def test_a_long_counts_line_takes_time_in_proportion(spark):
    n = 30_000  # before, a line was split again for each of its pairs
    line = spark.range(1).select(F.concat(F.lit("7 "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), i.cast("string"), F.lit("|2.0"))), " ")).alias("value"))
    began = time.time()
    got = readers.parse_counts_lines(line).agg(F.count("*"), F.sum("cnt"), F.min("doc_id")).first()
    assert tuple(got) == (n, 2.0 * n, "7") and time.time() - began < 20
