"""The n-gram join in steps that take little disk: shuffle files, look-ups of texts, pairs of blocks near each other first."""

from __future__ import annotations

import os
import random
import time

import pytest

from lexiloom.llm import ngram_join
from lexiloom.sources.tables import written


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frames = [spark.range(1000).repartition(3, "id") for _ in range(3)]  # before, these stayed as long as anything named them
    tables = [written(f, "shuffled") for f in frames]
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # executors delete them a little later
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [t.count() for t in tables] == [1000] * 3 and frames[0].count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_texts_are_looked_up_through_a_filter_of_bits(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 0)
    docs = spark.range(-500, 20_000).selectExpr("id AS doc_id", "'x' AS text")
    wanted = docs.where("doc_id % 97 = 3").selectExpr("doc_id AS rep")
    got = {r.doc_id for r in ngram_join.likely(docs, wanted).collect()}
    want = {r.rep for r in wanted.collect()}
    assert want <= got and len(got) < 0.1 * 20_500
    assert ngram_join.likely(docs, wanted).columns == docs.columns


@pytest.mark.parametrize("apart", [1, 2, 100])
def test_links_by_parts_of_sets_and_blocks_in_steps(spark, monkeypatch, apart):
    for name, value in (("FEW", 0), ("APART", apart), ("BLOCK", 5), ("HOT", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    texts = []
    for _ in range(6):  # groups that share most of a text, beyond what a list of two classes can hold
        base = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(9)):
                words[rng.randrange(60)] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=70).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(sets))}
