"""EM and held-out inference over packed blocks against plain numpy."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import plsa

K = 3
OPTIONS = plsa.Options(K, 0.01, 0.02)


def corpus(seed=1, docs=30, terms=40):
    rng = random.Random(seed)
    return [(f"d{d}", f"t{t}", float(rng.randint(1, 4))) for d in range(docs) for t in sorted(rng.sample(range(terms), rng.randint(1, 9)))]


def model_of(spark, rows, extra=("none",), seed=2):
    rng = np.random.default_rng(seed)
    terms, docs = sorted({r[1] for r in rows}), [*sorted({r[0] for r in rows}), *extra]
    wz, zd = rng.random((len(terms), K)), rng.random((len(docs), K))
    wz, zd = wz / wz.sum(0), zd / zd.sum(1, keepdims=True)
    table = lambda names, x, key: spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, x, strict=True)], f"{key} string, p array<double>")
    return plsa.Model(table(terms, wz, "term"), table(docs, zd, "doc_id"), [1 / K] * K, OPTIONS), dict(zip(terms, wz, strict=True)), dict(zip(docs, zd, strict=True))


def step_by_hand(rows, wz, zd):
    by_term, by_doc, ll, n = {t: np.zeros(K) for t in wz}, {d: np.zeros(K) for d in zd}, 0.0, 0.0
    for d, t, c in rows:
        joint = wz[t] * zd[d]
        by_term[t] += c * joint / joint.sum()
        by_doc[d] += c * joint / joint.sum()
        ll, n = ll + c * math.log(joint.sum()), n + c
    total = sum(x + OPTIONS.beta for x in by_term.values())
    smooth = {d: x + OPTIONS.alpha for d, x in by_doc.items()}
    return {t: (x + OPTIONS.beta) / total for t, x in by_term.items()}, {d: x / x.sum() for d, x in smooth.items()}, ll / n


def tables(m):
    return {r.term: np.array(r.p) for r in m.p_wz.collect()}, {r.doc_id: np.array(r.p) for r in m.p_zd.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[x], b[x], atol=1e-12) for x in a)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_steps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(plsa, "BLOCK_COUNTS", block)
    rows = corpus()
    counts = spark.createDataFrame(rows, "doc_id string, term string, cnt double").repartition(4)
    m, wz, zd = model_of(spark, rows)
    blocks = plsa.packed(counts)
    assert sum(r.n for r in blocks.select(F.size("docs").alias("n")).collect()) == 30
    for i in range(2):
        m = plsa.em_step(counts, m, blocks if i else None)
        wz, zd, ll = step_by_hand(rows, wz, zd)
        got = tables(m)
        assert close(got[0], wz) and close(got[1], zd) and m.likelihoods[i] == pytest.approx(ll, abs=1e-12)
    assert np.allclose(zd["none"], 1 / K)


def test_counts_go_through_one_exchange(spark):
    rows = corpus()
    counts = spark.createDataFrame(rows, "doc_id string, term string, cnt double")
    m = model_of(spark, rows)[0]
    plan = plsa._meeting(plsa.packed(counts), m, m.p_zd)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert exchanges.count("block") == 1 and set(exchanges) <= {"block", "term", "doc_id"}
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert sum("cnt" in s for s in scans) == 1  # the counts themselves are read and dealt once


def test_counts_that_the_model_does_not_know(spark):
    rows = corpus(docs=4)
    m, wz, zd = model_of(spark, rows)
    more = [*rows, ("d0", "new", 5.0), ("new", "t1", 2.0)]
    got = plsa.em_step(spark.createDataFrame(more, "doc_id string, term string, cnt double"), m)
    want = step_by_hand(rows, wz, zd)
    terms, docs = tables(got)
    assert close(docs, want[1]) and got.likelihoods[0] == pytest.approx(want[2])
    assert terms.keys() - {"new"} == want[0].keys()


def rounds(rows, wz, n):
    out = {}
    for d in {r[0] for r in rows}:
        own, p = [(t, c) for x, t, c in rows if x == d], np.full(K, 1 / K)
        for _ in range(n):
            s = np.full(K, OPTIONS.alpha)
            for t, c in own:
                if t in wz:
                    s += c * wz[t] * p / (wz[t] * p).sum()
            p = s / s.sum()
        out[d] = p
    return out


@pytest.mark.parametrize("block", [5, 100_000])
def test_held_out_inference_equals_its_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(plsa, "BLOCK_COUNTS", block)
    m, wz, _ = model_of(spark, corpus())
    new = [*corpus(seed=9, docs=12), ("only", "unknown", 3.0), ("d0", "unknown", 1.0)]
    counts = spark.createDataFrame(new, "doc_id string, term string, cnt double").repartition(3)
    for n in (1, 20):
        got = {r.doc_id: np.array(r.p) for r in plsa.fold_in(counts, m, n).collect()}
        want = rounds(new, wz, n)
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-9) for d in want)


def test_no_counts(spark):
    none = spark.createDataFrame([], "doc_id string, term string, cnt double")
    m = model_of(spark, corpus(docs=2))[0]
    assert plsa.fold_in(none, m).count() == 0
    got = plsa.em_step(none, m)
    assert math.isnan(got.likelihoods[0]) and all(np.allclose(r.p, 1 / K) for r in got.p_zd.collect())


def test_stop_rule_counts_down_too():
    """Three slow iterations, a fast one, and slow ones again: the count goes 1, 2, 3, 2, 3, ..."""
    o, slow, seen = plsa.Options(2, tolerance=0.1, patience=5), 0, []
    likelihoods = [-9.0, -8.95, -8.9, -8.85, -7.0, -6.95, -6.9, -7.5, -6.0, -5.0, -4.0]
    for i in range(1, len(likelihoods) + 1):
        slow = plsa.patience(slow, tuple(likelihoods[:i]), o)
        seen.append(slow)
    assert seen == [0, 1, 2, 3, 2, 3, 4, 5, 4, 3, 2]


def test_rows_of_a_step_have_no_null_lists(spark):
    rows = corpus()
    counts = spark.createDataFrame(rows, "doc_id string, term string, cnt double")
    m, _, _ = model_of(spark, rows)
    met = plsa._meeting(plsa.packed(counts), m, m.p_zd)
    assert met.where("p IS NULL OR first IS NULL OR terms IS NULL OR place IS NULL OR cnt IS NULL").isEmpty()


def test_counts_are_packed_once_for_a_model_and_its_likelihood(spark, monkeypatch, tmp_path):
    from lexiloom.plans import catalogue

    texts = [(i, " ".join(f"word{'abcdefgh'[(i * j) % 7]}{'uvwxyz'[i % 6]}" for j in range(30)), "en", "s", 1) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    calls = []
    packed = plsa.packed
    monkeypatch.setattr(plsa, "packed", lambda *a, **b: calls.append(1) or packed(*a, **b))
    assert len(catalogue.model(spark, str(tmp_path), 3)[1].likelihoods) == 3 and len(calls) == 1
    catalogue.QUERIES["plsa_loglik"](spark, str(tmp_path)).collect()
    assert len(calls) == 2


@pytest.mark.parametrize("most", [1, 5, 100_000])
def test_slices_of_a_block_change_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(plsa, "SLICE_COUNTS", most)
    rows = corpus(4)
    counts = spark.createDataFrame(rows, "doc_id string, term string, cnt double")
    m, wz, zd = model_of(spark, rows)
    got = tables(plsa.em_step(counts, m))
    want = step_by_hand(rows, wz, zd)
    assert close(got[0], want[0]) and all(np.allclose(got[1][d], want[1][d]) for d in want[1] if d != "none")
    assert plsa.log_likelihood(counts, m) == pytest.approx(want[2])
    names = sorted({r[0] for r in rows})
    labels = spark.createDataFrame([(d, i % K) for i, d in enumerate(names)], "doc_id string, z int")
    first = plsa.initialize(counts, labels, OPTIONS)
    z, p_wz = {d: i % K for i, d in enumerate(names)}, {t: np.full(K, OPTIONS.beta) for t in wz}
    for d, t, c in rows:
        p_wz[t][z[d]] += c
    total = sum(p_wz.values())
    p_wz, q = {t: x / total for t, x in p_wz.items()}, {d: np.zeros(K) for d in names}
    for d, t, c in rows:
        q[d] += c * p_wz[t] * first.p_z
    assert close(tables(first)[0], p_wz) and close(tables(first)[1], {d: x / x.sum() for d, x in q.items()})
