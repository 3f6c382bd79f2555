"""Pairs of documents at the queries: whole tables, work by common terms, values rounded where pairs are made."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lexiloom.operators import plsa, similarity
from lexiloom.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of few words and of none, one id in two rows, and terms that many and that few of them have."""
    d, rng = tmp_path_factory.mktemp("pairs"), random.Random(7)
    rows = []
    for i in range(120):
        words = [rng.choice("abcdef") + "x" * rng.randrange(6) for _ in range(rng.randrange(12))]
        rows.append((i, " ".join([*words, *(["Zeta"] if i % 9 == 0 else [])]), "en", f"s{i % 3}", 0))
    rows += [(50, "zeta bxx", "en", "s0", 0), (500, None, "en", "s0", 0), (550, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("block", [7, 500_000])
@pytest.mark.parametrize("frequent", [1, 5, 10**9])
def test_products_by_lists_and_by_matrix(spark, monkeypatch, tables, block, frequent):
    import duckdb

    for name, value in (("PAIR_COUNTS", block), ("FREQUENT", frequent), ("CELLS", 50)):
        monkeypatch.setattr(similarity, name, value)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    for name in ("doc_dot", "cosine_sim", "cosine_logdist"):
        want = sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall())
        got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, tables).collect())
        assert len(want) > 100 and [r[:2] for r in got] == [r[:2] for r in want]
        assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) <= 1e-6


def test_log_distances_are_of_all_pairs(spark, tables):
    rows = catalogue.QUERIES["cosine_logdist"](spark, tables).collect()
    assert {r.i % 50 for r in rows} == {r.j % 50 for r in rows} and len({r.i % 50 for r in rows}) > 40  # before, only ids divisible by 50 asked
    by = {(r.i, r.j): r.value for r in rows}
    assert all(by[j, i] == v for (i, j), v in by.items()) and all(by[i, i] == 0 for i, _ in by)
    assert "%" not in catalogue.ORACLE_SQL["cosine_logdist"] and "% 50" in catalogue.ORACLE_SQL["cosine_sim"]


def test_searches_do_not_deal_counts_out_by_row(spark, tables, monkeypatch):
    def refused(*_):  # before, a row a count went through joins
        raise AssertionError

    monkeypatch.setattr(catalogue, "pc", refused)
    for name in ("doc_dot", "cosine_sim", "cosine_logdist"):
        assert catalogue.QUERIES[name](spark, tables).count()
    plan = catalogue.QUERIES["cosine_sim"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "Exchange hashpartitioning" not in plan and "RoundRobinPartitioning" in plan


def test_products_of_a_block_take_work_by_common_terms():
    n, terms = 2000, 5000
    first = np.arange(n + 1) * 3
    place = (np.arange(3 * n) * 7919) % terms
    lists = similarity._Terms(n, first, place, np.ones(3 * n), terms)
    out = lists.times(2, np.array([0, 0, 1]), place[[0, 1, 5]], np.array([2.0, 3.0, 4.0]))
    want = np.zeros((2, n))
    for q, t, v in ((0, place[0], 2.0), (0, place[1], 3.0), (1, place[5], 4.0)):
        np.add.at(want[q], np.flatnonzero(place == t) // 3, v)
    assert (out == want).all() and len(lists.matrix) == 0


def test_topics_of_documents_are_rounded_where_pairs_are_made(spark, tables):
    out = catalogue.QUERIES["plsa_doc_sim"](spark, tables)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "RoundRobinPartitioning" in plan  # before, a decimal number for each pair, and as few tasks as files
    rows = out.collect()
    assert {r.i for r in rows} == {0, 50, 100, 500, 550} and all(r.value == round(r.value, 6) for r in rows)


@pytest.mark.parametrize(("x", "want"), [(0.0000005, 0.000001), (-0.0000005, -0.000001), (2.0000004999, 2.0), (-1e-9, 0.0), (1e300, 1e300), (math.inf, math.inf), (12.0, 12.0)])
def test_rounding(x, want):
    got = similarity.rounded(np.array([x, 1.0]))
    assert got[0] == want and math.copysign(1, got[0]) == math.copysign(1, want) and got[1] == 1.0


def test_blocks_of_a_given_size(spark):
    counts = spark.createDataFrame([(i, f"t{j}", 1.0) for i in range(20) for j in range(5)], "doc_id long, term string, cnt double")
    assert plsa.packed(counts, most=5).count() == 20
