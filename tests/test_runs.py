"""Text rules on long runs, and on random texts against the patterns as they are stated."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import evaluate, plsa
from lexiloom.sources import readers

PLAIN = "ab1 \t,.;:!?'`_*()-/|\\"


@pytest.mark.parametrize("rules", [text.REMOVE_NONSENTENTIAL_PUNCT, text.REMOVE_WORD_PUNCT, text.REMOVE_MARKUP, text.REMOVE_ISOLATED_SYMBOLS, text.TIDY])
def test_rules_do_what_their_patterns_say(spark, rules):
    """Each rule alone against Python's engine and the pattern as stated; the texts have characters that both engines class alike."""
    rng = random.Random(len(rules))
    texts = ["".join(rng.choices(PLAIN, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["", " ", "a)b) c)", "''' x ,,,a", "!!! ", "x !?! ", "((a))", "a.! b?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    columns = [text.apply(F.col("t"), [rule]).alias(f"c{i}") for i, rule in enumerate(rules)]
    got = list(zip(*df.select(*columns).collect(), strict=True))
    for (pattern, replacement), found in zip(rules, got, strict=True):
        assert list(found) == [re.sub(pattern, replacement, t) for t in texts], pattern


@pytest.mark.parametrize("run", [" ", "a", ")", "!", "'", ",", "_", "*", "-", "a)", "\t ", ". "])
def test_runs_of_a_million(spark, run):
    long = "x" + run * (1_000_000 // len(run)) + "x"
    df = spark.createDataFrame([(long,)], "t string").cache()
    df.count()
    began = time.time()
    for rules in (text.REMOVE_NONSENTENTIAL_PUNCT, text.REMOVE_WORD_PUNCT, text.TIDY):
        df.select(F.length(text.apply(F.col("t"), rules))).collect()
    readers.parse_lines(df, value="t").select(F.size("fields")).collect()
    df.select(F.size(text.sentences(F.col("t")))).collect()
    assert time.time() - began < 30
    df.unpersist()


def test_the_last_message_of_an_id_stays(spark):
    lines = spark.createDataFrame([(1, "a\tone"), (2, "b\ttwo"), (3, "a\tthree \t "), (4, "c"), (5, "\tnone"), (6, "\tlast")], "line long, value string").repartition(3)
    got = readers.to_messages(lines, "default", "line")
    assert {(r.id, r.msg) for r in got.collect()} == {("a", "three"), ("b", "two"), ("", "last")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


@pytest.mark.parametrize(("kind", "first"), [("string", "10"), ("long", "8")])
def test_best_documents_of_any_kind_of_id(spark, kind, first):
    rows = [("10", [0.9, 0.1]), ("9", [0.2, 0.8]), ("11", [0.2, 0.8]), ("8", [0.9, 0.1])]
    p_zd = spark.createDataFrame(rows, "doc_id string, p array<double>").withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = p_zd.select("doc_id", F.lit("t").alias("label"))
    got = {r.z: str(r.doc_id) for r in evaluate.best_documents(plsa.Model(None, p_zd, [0.5, 0.5], plsa.Options(2)), labels).collect()}
    assert got == {0: first, 1: "11" if kind == "string" else "9"}
