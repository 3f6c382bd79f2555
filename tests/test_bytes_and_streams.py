"""Byte n-grams in bulk, the automaton, scoring and the streaming classifier."""

from __future__ import annotations

import collections
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import bytegrams, langid, scanner
from lexiloom.streaming import filters


def occurrences(strings, text):
    return collections.Counter({i: n for i, s in enumerate(strings) if (n := sum(text.startswith(s, p) for p in range(len(text))))})


@pytest.mark.parametrize("lane", [3, 7, 512])
def test_scanner_equals_brute_force(monkeypatch, lane):
    monkeypatch.setattr(scanner, "LANE", lane)
    rng = random.Random(lane)
    for trial in range(60):
        alphabet = b"ab\x00\xff" if trial % 2 else b"abc"
        some = lambda n: bytes(rng.choices(alphabet, k=n))
        strings = list({some(rng.randint(1, 6)) for _ in range(rng.randint(1, 25))})
        texts = [some(rng.choice([0, 1, 5, 40, 100])) for _ in range(6)]
        text, string, n = scanner.search(scanner.build(strings), texts)
        assert dict(zip(zip(text.tolist(), string.tolist(), strict=True), n.tolist(), strict=True)) == {(i, k): c for i, t in enumerate(texts) for k, c in occurrences(strings, t).items()}


def test_scanner_states():
    s = scanner.build([b"he", b"she", b"hers"])
    trace, ends = scanner.state_trace(s, [b"ushers", b"", b"h"])
    depth = {0: 0}
    for state in range(s.states):
        for byte in range(256):
            if s.moves[state, byte] > state:
                depth.setdefault(int(s.moves[state, byte]), depth[state] + 1)
    assert [depth[int(x)] for x in trace] == [0, 1, 2, 3, 3, 4, 1] and ends.tolist() == [6, 6, 7]
    assert scanner.build([]).states == 1 and len(scanner.search(scanner.build([]), [b"abc"])[0]) == 0
    with pytest.raises(ValueError, match="everywhere"):
        scanner.build([b""])
    with pytest.raises(ValueError, match="repeat"):
        scanner.build([b"a", b"a"])


ROWS = [(1, "abcab", "en", "x"), (2, "ab", "en", "y"), (3, "\x00aé\x00a", None, "x"), (4, None, "de", None), (5, "", "de", "x"), (6, "abcab", "en", "x"), (7, "aaaa", "de", "y")]
GRAMS = langid.byte_ngrams()


def grams_of(text):
    raw = (text or "").encode()
    return [raw[i : i + k].hex().upper() for k in (1, 2, 3, 4) for i in range(len(raw) - k + 1)] if len(raw) >= 3 else []


def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, domain string").repartition(3)


def test_bulk_counts_equal_the_column_expression(spark, monkeypatch):
    monkeypatch.setattr(bytegrams, "FOLD", 10)
    df = rows(spark)
    totals = collections.Counter(t for r in ROWS for t in grams_of(r[1]))
    assert {r.term: r.n for r in langid.term_totals(df, GRAMS).collect()} == totals
    shown = df.select(F.explode(GRAMS(F.col("text"))).alias("t")).groupBy("t").count().collect()
    assert {r.t: r["count"] for r in shown} == totals
    cells = collections.Counter((r[2], r[3], t) for r in ROWS for t in set(grams_of(r[1])))
    assert {(r.lang, r.domain, r.term): r.df for r in langid.cells(df, GRAMS).collect()} == cells
    assert {r.term: r.df for r in langid.term_df(df, GRAMS).collect()} == collections.Counter(t for r in ROWS for t in set(grams_of(r[1])))
    assert {(r.term, r.lang): r.df for r in langid.group_df(df, GRAMS, "lang").collect()} == collections.Counter((t, r[2]) for r in ROWS for t in set(grams_of(r[1])))


def test_scan_and_its_totals(spark, monkeypatch):
    monkeypatch.setattr(bytegrams, "SCAN", 4)
    df = rows(spark)
    features = spark.createDataFrame([("61",), ("6162",), ("00",), ("616263",), ("616263",), ("FF",)], "term string")
    wanted = {"61", "6162", "00", "616263", "FF"}
    assert {(r.doc_id, r.term): r.n for r in langid.scan(df, features, GRAMS).collect()} == collections.Counter((r[0], t) for r in ROWS for t in grams_of(r[1]) if t in wanted)
    assert {(r.term, r.lang): r.n for r in langid.feature_totals(df, features, GRAMS).collect()} == collections.Counter((t, r[2]) for r in ROWS for t in grams_of(r[1]) if t in wanted)


def test_other_orders_and_limits(spark, monkeypatch):
    five = langid.byte_ngrams((2, 5), least=0)
    df = spark.createDataFrame([("abcdef",), ("a",)], "text string")
    assert {r.term for r in langid.term_totals(df, five).collect()} == {b.hex().upper() for b in (b"ab", b"bc", b"cd", b"de", b"ef", b"abcde", b"bcdef")}
    for bad in ((), (0,), (8,)):
        with pytest.raises(ValueError):  # noqa: PT011
            langid.byte_ngrams(bad, 0)
    monkeypatch.setattr(bytegrams, "MAX_STRINGS", 2)
    with pytest.raises(ValueError, match="over 2 strings"):
        langid.scan(rows(spark), spark.createDataFrame([("61",), ("62",), ("63",)], "term string"), GRAMS)
    monkeypatch.undo()
    monkeypatch.setattr(bytegrams, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        langid.scan(rows(spark), spark.createDataFrame([("61",)], "term string"), GRAMS)


def test_one_long_text(spark):
    """A text of a million bytes is counted, scanned and classified in time that grows with it."""
    text = "".join(random.Random(4).choices("abcdefghij ", k=1_000_000))
    df = spark.createDataFrame([(1, text, "en", "x"), (2, "der hund und die katze", "de", "x"), (3, "the cat and the dog", "en", "y")], "doc_id long, text string, lang string, domain string")
    got = {r.term: r.n for r in langid.term_totals(df.where("doc_id = 1"), GRAMS).collect()}
    assert sum(got.values()) == 4 * len(text) - 6 and got["6120"] == sum(text.startswith("a ", i) for i in range(len(text)))
    model = langid.train(df)
    assert {r.doc_id: r.lang for r in langid.classify(df, model).collect()} == {1: "en", 2: "de", 3: "en"}
    part = df.where("doc_id = 1").select(F.substring("text", 1, 200_000).alias("text"))
    assert part.select(F.size(GRAMS(F.col("text")))).first()[0] == 800_000 - 6


def languages(spark):
    made = [(f"{w}{i} {w}n{i}", g, f"s{i % 2}") for i in range(4) for w, g in (("thew", "en"), ("schö", "de"), ("eaux", "fr"))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "doc_id long, text string, lang string, domain string")


@pytest.mark.parametrize("tokenizer", [None, langid.words])
def test_scores_are_sums_of_logarithms(spark, tokenizer):
    docs = languages(spark)
    model = langid.train(docs, tokenizer, per_lang=15)
    prior = {r.lang: r.log_pc for r in model.log_pc.collect()}
    weight = {(r.term, r.lang): r.log_ptc for r in model.log_ptc.collect()}
    new = [(1, "thew eaux1"), (2, None), (3, ""), (4, "schö schö2 x"), (5, "ab")]
    split = (lambda t: (t or "").split()) if tokenizer else grams_of
    want = {(i, g): prior[g] + sum(weight.get((t, g), 0.0) for t in split(s)) for i, s in new for g in prior}
    got = langid.rank(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.lang) for r in got} == set(want) and all(math.isclose(r.score, want[r.doc_id, r.lang], abs_tol=1e-9) for r in got)
    assert all([r.lang for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r["rank"])] == sorted(prior, key=lambda g: (-round(want[i, g], 9), g)) for i, _ in new)
    assert {(r.doc_id, r.lang): r.score for r in langid.scores(spark.createDataFrame(new, "doc_id long, text string"), model).collect()} == pytest.approx(want)


def test_classifier_keeps_other_columns_and_shuffles_nothing(spark):
    model = langid.train(languages(spark), per_lang=15)
    df = spark.createDataFrame([(None, "thew1", 1.5, [1]), ("b", None, None, None)], "a string, Text string, score double, l array<int>")
    out = langid.with_language(df, model, out="found")
    assert out.columns == ["a", "Text", "score", "l", "found"]
    assert [(r.a, r.l, r.found) for r in out.collect()] == [(None, [1], "en"), ("b", None, "de")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch_and_survives_a_stop(spark, tmp_path):
    """More files come between two runs, and the second run fails once halfway: each line is there once in the end."""
    langid.save(langid.train(languages(spark), per_lang=15), str(tmp_path / "model"))
    model = langid.load(spark, str(tmp_path / "model"))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def more(n, start):
        for i in range(start, start + n):
            lines = [json.dumps({"text": f"{w}{i}", "retweet_count": k}) for w in ("thew", "schö", "eaux") for k in (0, 1)]
            (tmp_path / "in" / f"{i}.json").write_text("\n".join([*lines, "no json", json.dumps({"retweet_count": 0})]))

    more(3, 0)
    filters.run_language_filter(spark, source, model, out, checkpoint, ["en", "fr"]).awaitTermination(120)
    more(3, 3)
    broken = filters.classified(spark.readStream.text(source), model, ["en", "fr"]).withColumn("line", F.when(F.col("text") == "thew4", F.raise_error(F.lit("stop"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        broken.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    for _ in range(2):
        filters.run_language_filter(spark, source, model, out, checkpoint, ["en", "fr"]).awaitTermination(120)
    batch = filters.classified(spark.read.text(source), model, ["en", "fr"]).collect()
    assert sorted(r.line for r in spark.read.parquet(out).collect()) == sorted(r.line for r in batch) == sorted(f"{g}: {w}{i}" for i in range(6) for w, g in (("thew", "en"), ("eaux", "fr")))


def test_gains_and_features_are_numbers_of_documents(spark):
    docs = languages(spark)
    cells = langid.cells(docs, GRAMS)
    assert cells.agg(F.max("df")).first()[0] <= 4
    assert np.isclose(cells.groupBy("term").agg(F.sum("df").alias("n")).where("term = '20'").first().n, docs.count())
