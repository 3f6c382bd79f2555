"""Blocks packed from texts, and terms dealt in lists: nothing has a row a count or a row a block and term."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import plsa

TEXTS = [
    (1, "The cat, the CAT; cat9dog--dog"), (1, "cat\nagain"), (2, None), (3, ""), (4, "12 -- 34 éé"), (None, "cat none"),
    (5, "Kelvin İstanbul naïve x中y"), (6, "z"), (7, "z" * 50 + " " + "ab " * 40), (8, "ends"), (9, "starts"),
]


def by_hand():
    out = defaultdict(Counter)
    for i, text in TEXTS:
        out[i].update(w for w in re.findall("[a-z]+", (text or "").lower()))
    return {(i, w): float(n) for i, c in out.items() for w, n in c.items()}


@pytest.mark.parametrize(("block", "size"), [(1_000_000, 2 << 20), (3, 2 << 20), (1_000_000, 1), (1, 1)])
def test_texts_are_counted_where_they_are_packed(spark, monkeypatch, block, size):
    monkeypatch.setattr(plsa, "BLOCK_COUNTS", block)
    monkeypatch.setattr(plsa, "TEXT_BYTES", size)
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    blocks = plsa.packed(texts, text="text")
    got = plsa.unpacked(blocks).collect()
    want = by_hand()
    assert len(got) == len(want) and {(r.doc_id, r.term): r.cnt for r in got} == want
    df, tf = Counter(w for _, w in want), Counter()
    for (_, w), n in want.items():
        tf[w] += n
    assert {r.term: (r.tf, r.df) for r in plsa.vocabulary(blocks).collect()} == {w: (tf[w], float(df[w])) for w in df}
    assert {r.doc_id: r.n_words for r in plsa.lengths(blocks).collect()} == {i: sum(n for (j, _), n in want.items() if j == i) for i in {i for i, _ in want}}
    some = spark.createDataFrame([("cat",), ("z",), ("other",)], "term string")
    got = plsa.unpacked(plsa.pruned(blocks, some)).collect()
    assert {(r.doc_id, r.term): r.cnt for r in got} == {x: n for x, n in want.items() if x[1] in ("cat", "z")} and len(got) == 3


def test_terms_are_dealt_in_lists(spark):
    rows = [(d, f"t{(d * 7 + i) % 900}", 1.0) for d in range(60) for i in range(90)]
    blocks = plsa.packed(spark.createDataFrame(rows, "doc_id long, term string, cnt double"))
    table = spark.createDataFrame([(f"t{i}", [float(i), 1.0]) for i in range(800)], "term string, p array<double>")
    asked = plsa._asked(blocks, table)
    n, terms = blocks.count(), blocks.agg(F.sum(F.size("terms"))).first()[0]
    assert asked.count() <= n * plsa.TERM_PARTS < terms  # a row a part, not a term
    got = defaultdict(dict)
    for r in asked.collect():
        for i in range(0, len(r.p), 2):
            got[r.block][r.at + i // 2] = r.p[i : i + 2]
    for r in blocks.collect():
        want = [[float(t[1:]), 1.0] if int(t[1:]) < 800 else [0.0, 0.0] for t in r.terms]
        assert [got[r.block].get(i, [0.0, 0.0]) for i in range(len(want))] == want
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, z int")
    sums = defaultdict(lambda: [0.0, 0.0])
    for d, t, c in rows:
        if d < 40:
            sums[t][d % 2] += c
    assert {r.term: r.p for r in plsa.label_sums(blocks, labels, 2).collect()} == dict(sums)


def kmeans_by_hand(rows, weight, docs, label, k, rounds):
    """label: (doc, z) rows; docs may repeat, and each row counts."""
    for _ in range(rounds):
        value = defaultdict(lambda: [0.0] * k)
        for d, z in label:
            for t, c in rows[d].items():
                value[t][z] += c * weight.get(t, 0.0)
        norm = [sum(v[z] ** 2 for v in value.values()) ** 0.5 for z in range(k)]
        new = []
        for d in docs:
            scores = [round(sum(c * value[t][z] / norm[z] * weight.get(t, 0.0) for t, c in rows[d].items()) if norm[z] else 0.0, 9) for z in range(k)]
            new.append((d, scores.index(max(scores))))
        if sorted(new) == sorted(label):
            break
        label = new
    return sorted(label)


@pytest.mark.parametrize("rounds", [1, 2, 20])
def test_kmeans_runs_over_blocks_that_are_packed_once(spark, monkeypatch, rounds):
    import random

    from lexiloom.operators import cluster

    monkeypatch.setattr(plsa, "BLOCK_COUNTS", 20)
    rng = random.Random(3)
    rows = defaultdict(dict) | {d: {f"t{t}": float(rng.randint(1, 5)) for t in rng.sample(range(25), rng.randint(1, 6))} for d in range(40)}
    weight = {f"t{t}": 0.5 + t / 10 for t in range(22)}  # three terms have none
    docs = [*range(42), 7, 7, 8]  # two without counts, some more than once
    start = [(0, 0), (5, 1), (9, 3)]  # cluster 2 is empty
    calls, packed = [], plsa.packed
    monkeypatch.setattr(plsa, "packed", lambda *a, **b: calls.append(1) or packed(*a, **b))
    counts = spark.createDataFrame([(d, t, c) for d, r in rows.items() for t, c in r.items()], "doc_id long, term string, cnt double")
    got = cluster.kmeans(counts, spark.createDataFrame(list(weight.items()), "term string, weight double"), spark.createDataFrame([(d,) for d in docs], "doc_id long"), 4, rounds, start=spark.createDataFrame(start, "doc_id long, z int"))
    assert sorted((r.doc_id, r.z) for r in got.collect()) == kmeans_by_hand(rows, weight, docs, start, 4, rounds) and len(calls) == 1
