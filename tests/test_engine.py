"""Units of the engine against Python, numpy and DuckDB."""

from __future__ import annotations

import json
import math
import os
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import stem, text
from lexiloom.operators import cluster, counts, evaluate, langid, plsa, similarity, summary, weights
from lexiloom.plans import catalogue, pipeline
from lexiloom.sources import readers
from lexiloom.streaming import filters

SMALL = "/root/testdata/sf0.001"
SAMPLES = ["", " ", "<b>Bold</b> and <i>it", "see http://a.b/c?d=e now", "http://end.of/line", "(https:\\x\\y) www.foo.bar) [ID:12] (PDF) &mdash;&quot;&#39;", "--dash -x - y ~ \"q\" 'single' `tick` (par) a: b; c:", "_u_ __v a,b ,c, d,. e * f*. what?! no!? end... / x/ y !?", "Caps iPhone 3.5 1,000", "# a #tag @me RT now", "RT start . alone ! ? .", "$ . : x (=) / y <> @", "it's pipe|back\\slash end?"]


def rewritten(spark, f):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, s string").select("i", f(F.col("s")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


@pytest.mark.parametrize("name", ["NORMALIZE_TEXT", "REMOVE_MARKUP", "REMOVE_NUMBERS", "REMOVE_CAPS", "REMOVE_NONSENTENTIAL_PUNCT", "REMOVE_ISOLATED_SYMBOLS", "REMOVE_WORD_PUNCT", "REMOVE_TWITTER_META", "REMOVE_PUNCTUATION", "PUNCT_TO_SPACE"])
def test_rules_follow_python(spark, name):
    def python(s):
        for pattern, to in getattr(text, name):
            s = re.sub(pattern, to, s, flags=re.ASCII)
        return s

    assert rewritten(spark, text.rewriter(getattr(text, name))) == [python(s) for s in SAMPLES]


@pytest.mark.parametrize(("given", "want"), [("café naïve", "cafe naive"), ("5€ ½", "5 euros 1/2"), ("œuvre Æ ß ﬁn", "oeuvre AE ss fin"), ("‘a’ b‐c d—e", "'a' b-c d."), ("a漢b x\x7fyy", "a b x yy"), ("end z", "end."), ("abc", "abc")])
def test_ascii_fold(spark, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(text.ascii_fold(F.col("s"))).first()[0] == want


# Fixed values, written down apart from the table that the code builds.
FOLDED = {"Œ": "oe", "œ": "oe", "\u0184": "b", "\u0185": "b", "\u0189": "D", "\u018b": "d", "\u0196": "I", "\u203c": " ", "\u2047": " ", "\u2048": " ", "\u2049": " ", "é": "e", "Ø": "O", "ß": "ss", "Þ": "Th", "£": " pounds ", "¼": " 1/4 ", "’": "'", "漢": " ", "\u0180": "b", "\u00b2": " "}


def test_folding_by_character(spark):
    rows = spark.createDataFrame([(c, f"xx{c}yy zz") for c in FOLDED], "c string, s string").select("c", text.ascii_fold(F.col("s")).alias("o")).collect()
    assert {r.c: r.o for r in rows} == {c: " ".join(f"xx{to}yy zz".split()) for c, to in FOLDED.items()}


def test_rules_by_example(spark):
    """Expectations written by hand, not made from the lists of rules."""
    cases = [
        (text.normalize_text, r"a\r\nb<br/>c</p>d", "a b c d"), (text.remove_markup, "see http://a.b/c now <b> x", "see now x"), (text.remove_numbers, "in 1,234 days", "in   days"),
        (text.remove_caps, "the Big apple iPhone", "the   apple i "), (text.punct_to_space, "a,b;c", "a b c"), (text.remove_punctuation, "a,b;c", "abc"), (text.remove_twitter_meta, "hi #tag @me RT you", "hi you"),
        (text.remove_isolated_symbols, "a $ b", "a b"), (text.remove_word_punct, "end of it. really?", "end of it really"), (text.normalize_topic, "Ünder 5 größe, \"quoted\" words!", " grosse quoted words"), (text.normalize_topic, "A", ""),
    ]
    for f, given, want in cases:
        assert spark.createDataFrame([(given,)], "s string").select(f(F.col("s"))).first()[0] == want, given


def test_chain_names_each_step_once(spark):
    df = spark.createDataFrame([("x",)], "s string").select(text.normalize_topic(text.normalize_text(F.col("s"))).alias("o"))
    rules = sum(map(len, (text.NORMALIZE_TEXT, text.FOLD_TAIL, text.REMOVE_MARKUP, text.REMOVE_NUMBERS, text.REMOVE_NONSENTENTIAL_PUNCT, text.REMOVE_CAPS, text.REMOVE_ISOLATED_SYMBOLS))) + 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= rules


def test_tokens(spark):
    row = spark.createDataFrame([('one two. three! "four."five  six.', "a_b__c", "new_york_city", "york")], "s string, t string, a string, b string")
    got = row.select(text.tokens(F.col("s")), text.word_units(F.col("t")), text.unit_substring(F.col("a"), F.col("b")), text.split_string(F.col("s")), text.unit_substring(F.col("b"), F.col("a"))).first()
    assert got[0] == ["one", "two", "three", '"four', '"', "five", "six"]  # the break after ." leaves the quote a word
    assert got[1] == 3 and got[2] == 1 and got[4] == -1 and len(got[3]) == 5


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("possibly", "possibl"), ("apology", "apolog"), ("dogs'", "dog"), ("dog's", "dog"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("sky", "sky"), ("rate", "rate"), ("cease", "ceas")])
def test_stem(word, want):
    assert stem.stem(word) == want


# --- readers


def test_readers(spark):
    lines = spark.createDataFrame([(0, "1\ta\t\t"), (1, "2"), (2, "1\tb\textra"), (3, ""), (4, "3\té"), (5, "\t".join(map(str, range(18))))], "line long, value string")
    got = sorted((r.id, r.msg) for r in readers.to_messages(lines, "default", "line").collect())
    assert got == [("0", "1"), ("1", "b"), ("3", "é")]
    assert readers.kept_percent(lines).first()[0] == pytest.approx(4 / 6 * 100) and readers.kept_percent(lines.limit(0)).first()[0] is None
    assert readers.to_messages(lines, "loan").first().asDict() == {"id": "0", "date": "15", "msg": "17"}
    assert readers.to_messages(lines, "journal").count() == 1
    readers.register_reader("swapped", {"msg": 0, "id": 1}, 2)
    assert readers.to_messages(lines.where("line = 4"), "swapped").first().id == "é"


def test_files(spark, tmp_path):
    c = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "a|x", 3.0)], "doc_id long, term string, cnt double")
    lines = readers.counts_lines(c)
    assert sorted(r.line for r in lines.collect()) == ["1 a|1.0 b|2.0", "2 a|x|3.0"]
    assert sorted(map(tuple, readers.parse_counts_lines(lines.select(F.col("line").alias("value"))).collect())) == [("1", "a", 1.0), ("1", "b", 2.0), ("2", "a|x", 3.0)]
    with pytest.raises(Exception, match="not finite"):
        readers.parse_counts_lines(spark.createDataFrame([("1 a|NaN",)], "value string")).collect()
    with pytest.raises(Exception, match="weighted and unweighted"):
        readers.parse_feature_lines(spark.createDataFrame([("a 1",), ("b",)], "value string")).collect()
    assert readers.parse_feature_lines(spark.createDataFrame([("a",), ("b",)], "value string")).collect()[0].weight == 1.0
    with pytest.raises(Exception, match="repeated"):
        readers.parse_labelled_files(spark.createDataFrame([("p x x",)], "value string")).collect()
    assert readers.parse_dense_lines(spark.createDataFrame([(" 1 2.5 ",)], "value string")).first()[0] == [1.0, 2.5]
    raw = b"BINARY_VECTOR\n" + struct.pack("<i2f", 2, 1.5, 2.0) + b"".join(struct.pack("<i", len(t)) + t for t in (b"ab", b"c"))
    (tmp_path / "v.bin").write_bytes(raw)
    assert sorted((r.term, r.cnt) for r in readers.read_binary_vectors(spark, str(tmp_path)).collect()) == [("ab", 1.5), ("c", 2.0)]
    assert readers.display(c, "doc_id", "2").count() == 1 and readers.display(c, "none", "2").count() == 0
    assert json.loads(readers.display(c, "term", "b").first()[0]) == {"cnt": 2.0, "doc_id": 1, "term": "b"}


# --- counts, weights, similarity


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "c", 4.0), (3, "b", 0.5), (3, "c", 1.0), (3, "d", 6.0)]
    return spark.createDataFrame(rows, "doc_id long, term string, cnt double")


def test_vocabulary(spark, small):
    v = {r.term: (r.tf, r.df) for r in counts.vocabulary(small).collect()}
    assert v == {"a": (3.0, 2.0), "b": (1.5, 1.5), "c": (5.0, 2.0), "d": (6.0, 1.0)}
    assert [(r.term, r.idx) for r in counts.prune_min_count(small, 2).orderBy("idx").collect()] == [("<filler>", 0), ("a", 1), ("c", 2), ("d", 3)]
    old = counts.indexed(spark.createDataFrame([("b",), ("a",)], "term string"))
    more = spark.createDataFrame([("c",), ("a",), ("0",)], "term string")
    assert {r.term: r.idx for r in counts.augment(old, more).collect()} == {"a": 0, "b": 1, "0": 2, "c": 3}
    many = counts.indexed(spark.range(1000).selectExpr("cast(hash(id) as string) as term"))
    assert [r.idx for r in many.orderBy("term").collect()] == list(range(1000))


def test_weights(small):
    v = counts.vocabulary(small)
    got = {r.term: r.weight for r in weights.learn_weights(v, 3, 15.5, df_cutoff=0.6, tf_cutoff=1.0).collect()}
    assert got == pytest.approx({"a": 0.0, "b": -math.log(0.5), "c": 0.0, "d": -math.log(1 / 3)})
    smooth = {r.term: r.weight for r in weights.learn_weights(v, 3, 15.5, "llr", 0.5, 5.0, smooth=True).collect()}
    share = 2 / 3
    assert smooth["a"] == pytest.approx(-math.log(3 / 15.5) * (1 - math.exp(math.log(0.5) / 5 * 3)) * (1 - math.exp(math.log(0.5) / math.log(0.5) * math.log(share))))
    l2 = weights.l2_normalized(small, "cnt").where("doc_id = 1").orderBy("term").collect()
    assert [r.cnt for r in l2] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])
    with pytest.raises(Exception, match="zero probability"):
        weights.map_prior(v.withColumn("tf", F.lit(0.0)).withColumn("prior", F.lit(0.0)).withColumn("tf", F.when(F.col("term") == "a", 1.0).otherwise(0.0)), "tf", "prior", 1.0).collect()


def test_distances(spark):
    p = np.array([[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]])
    frame = spark.createDataFrame([(f"w{i}", row.tolist()) for i, row in enumerate(p)], "term string, p array<double>")
    a, b = p.T
    want = {"bhattacharyya": -math.log(np.sqrt(a * b).sum()), "inner": -math.log((a * b).sum()), "intersection": -math.log(np.minimum(a, b).sum()), "chebyshev": abs(a - b).max(), "soergel": abs(a - b).sum() / np.maximum(a, b).sum(), "kulczynski": abs(a - b).sum() / np.minimum(a, b).sum()}
    for kind, value in want.items():
        got = {(r.i, r.j): r.value for r in similarity.topic_distances(frame, kind).collect()}
        assert got[0, 1] == pytest.approx(value) == pytest.approx(got[1, 0])
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.5,)], "s double").select(similarity.to_distance(F.col("s"), 2)).collect()
    with pytest.raises(ValueError, match="outside"):
        similarity.matrix_lerp(frame, frame, 1.5)


# --- clustering


def test_trees():
    m = np.array([[0, 1, 4, 5], [1, 0, 4, 6], [4, 4, 0, 1], [5, 6, 1, 0]], float)
    heights = {k: [round(n.height, 6) for n in cluster.grow_tree(m, k)[4:]] for k in cluster.LINKAGES}
    assert heights["max"] == [1, 1, 6] and heights["min"] == [1, 1, 4]
    assert heights["avg"] == [1, 1, round((4 + 5 + 4 + 6 + 1 + 1) / 6, 6)] and heights["tot"] == [round(math.log(2), 6)] * 2 + [round(math.log(22), 6)]
    tree = cluster.grow_tree(m, "max")
    assert cluster.cut(tree, 2) == [0, 0, 1, 1] and cluster.cut(tree, 1) == [0] * 4 and cluster.cut(tree, 9) == [0, 1, 2, 3]
    assert cluster.cut(tree, 3) == [0, 1, 2, 3]  # equal heights at the cut
    assert cluster.top_nodes(tree, 1) == {6}


def test_kmeans(spark):
    rows = [(i, t, 3.0) for i in range(8) for t in (("a", "b") if i < 4 else ("x", "y"))]
    c = spark.createDataFrame(rows, "doc_id long, term string, cnt double")
    w = spark.createDataFrame([(t, 1.0) for t in "abxy"], "term string, weight double")
    docs = spark.range(9).withColumnRenamed("id", "doc_id")
    start = spark.createDataFrame([(0, 0), (4, 1)], "doc_id long, z int")
    got = {r.doc_id: r.z for r in cluster.kmeans(c, w, docs, 2, start=start).collect()}
    assert got == {i: int(4 <= i < 8) for i in range(9)}
    with pytest.raises(ValueError, match="fewer"):
        cluster.kmeans(c, w, docs, 20)


# --- pLSA


def test_em_follows_numpy(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(0, 4, (6, 5)).astype(float)
    n[:, 0] += 1
    z = np.arange(6) % 2
    rows = [(d, f"t{w}", float(n[d, w])) for d in range(6) for w in range(5) if n[d, w]]
    c = spark.createDataFrame(rows, "doc_id long, term string, cnt double")
    labels = spark.createDataFrame([*((d, int(z[d])) for d in range(6)), (6, 1)], "doc_id long, z int")
    o = plsa.Options(2, 0.01, 0.02)
    m = plsa.em_step(c, plsa.initialize(c, labels, o))
    wz = np.stack([n[z == k].sum(0) for k in range(2)], 1) + 0.02
    wz /= wz.sum(0)
    pz = np.array([n[z == k].sum() for k in range(2)]) + 0.01
    pz /= pz.sum()
    zd = (n @ wz) * pz
    zd /= zd.sum(1, keepdims=True)
    joint = wz[None] * zd[:, None]
    mix = joint.sum(2)
    post = n[:, :, None] * joint / mix[:, :, None]
    new_wz = post.sum(0) + 0.02
    new_wz /= new_wz.sum(0)
    new_zd = post.sum(1) + 0.01
    new_zd /= new_zd.sum(1, keepdims=True)
    got = {r.doc_id: r.p for r in m.p_zd.collect()}
    assert all(got[d] == pytest.approx(new_zd[d].tolist()) for d in range(6)) and got[6] == pytest.approx([0.5, 0.5])
    assert {r.term: r.p for r in m.p_wz.collect()}["t0"] == pytest.approx(new_wz[0].tolist())
    assert m.likelihoods[0] == pytest.approx((n * np.log(mix)).sum() / n.sum())
    with pytest.raises(Exception, match="outside the topics"):
        plsa.initialize(c, labels.withColumn("z", F.lit(5)), o)


def test_likelihood_rises_and_model_keeps(spark, small, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, z int")
    m = plsa.fit(small, labels, plsa.Options(2, 0.0, 1e-9, max_iter=6))
    assert all(b >= a - 1e-9 for a, b in zip(m.likelihoods, m.likelihoods[1:], strict=False)) and sum(m.p_z) == pytest.approx(1)
    plsa.save(m, str(tmp_path / "m"))
    again = plsa.load(spark, str(tmp_path / "m"))
    assert again.p_z == m.p_z and sorted(again.p_wz.collect()) == sorted(m.p_wz.collect())
    assert all(sum(r.p) == pytest.approx(1) for r in plsa.fold_in(small, m, 3).collect())
    held = plsa.fit(small, labels, plsa.Options(2, max_iter=1), held_out=spark.createDataFrame([(3,)], "doc_id long"))
    assert {r.term for r in held.p_wz.collect()} == {"a", "b", "c"}


def test_metrics(spark):
    joint = spark.createDataFrame([(0, "a", 30.0), (0, "b", 10.0), (1, "a", 5.0), (1, "b", 15.0)], "z int, label string, n double")
    r = evaluate.metrics(joint).first()
    h = lambda *p: -sum(x * math.log2(x) for x in p if x)
    ht, hz, hzt = h(35 / 60, 25 / 60), h(40 / 60, 20 / 60), h(0.5, 10 / 60, 5 / 60, 0.25)
    assert r.i == pytest.approx(ht + hz - hzt) and r.nmi == pytest.approx(2 * r.i / (ht + hz)) and r.eir == pytest.approx((r.h_t_given_z + r.h_z_given_t) / ht)
    assert evaluate.true_topics(joint).orderBy("z").first().line == "a:75.0 b:25.0"
    s = evaluate.compare_stems(spark.createDataFrame([("x",), ("y",)], "stem string"), spark.createDataFrame([("y",), ("z",), ("w",)], "stem string")).first()
    assert (s.hits, s.false_alarms, s.misses) == (1, 1, 2) and s.f == pytest.approx(2 / 5)


def test_substrings_go():
    assert summary.without_substrings(["york", "other", "new_york"]) == ["new_york", "other"]
    assert summary.without_substrings(["a_b", "b", "c"]) == ["a_b", "c"]


# --- language identification and streaming


def langs(spark):
    rows = [(i, {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chat et le chien"}[g] + f" {i}", g, f"d{i % 2}") for i, g in enumerate(["en", "de", "fr"] * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, domain string")


@pytest.mark.parametrize("tokenizer", [langid.words, langid.byte_ngrams((1, 2, 3))])
def test_langid(spark, tokenizer):
    docs = langs(spark)
    m = langid.train(docs, tokenizer, per_lang=20)
    new = spark.createDataFrame([(1, "the dog"), (2, "der katze und"), (3, "le chien"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang for r in langid.classify(new, m).collect()}
    assert (got[1], got[2], got[3]) == ("en", "de", "fr") and got[4] == "de"
    total = {r.lang: r.s for r in langid.softmax_ptc(m.log_ptc).groupBy("lang").agg(F.sum("p").alias("s")).collect()}
    assert all(v == pytest.approx(1) for v in total.values())


def test_ngrams_and_gain(spark):
    one = spark.createDataFrame([("aé",), ("a",), ("",)], "s string").select(langid.byte_ngrams((1, 2))(F.col("s")).alias("g")).collect()
    assert [r.g for r in one] == [["61", "C3", "A9", "61C3", "C3A9"], ["61"], []]
    docs = langs(spark)
    by = langid.group_df(docs, langid.words, "lang")
    dist = docs.groupBy("lang").agg(F.count("*").alias("n"))
    gain = {r.term: r.ig for r in langid.information_gain(by, dist, "lang").collect()}
    assert gain["cat"] == pytest.approx(math.log(3) - 12 / 18 * math.log(2))
    each = {(r.term, r.lang): r.ig for r in langid.information_gain_each(by, dist, "lang").collect()}
    assert each["cat", "en"] == pytest.approx(math.log(18) - (6 * math.log(6) + 12 * math.log(12)) / 18)


def test_stream_follows_batch(spark, tmp_path):
    lines = ['{"text": "hello", "retweet_count": 0}', '{"text": "again", "retweet_count": 2}', '{"text": null, "retweet_count": 0}', '{"retweet_count": 0}', '{"text": "hallo", "retweet_count": 0}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    batch = filters.posts(spark.read.text(str(tmp_path / "in")))
    q = filters.stream_posts(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("posts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.table("posts").collect()) == sorted(batch.collect()) and batch.count() == 2
    found = batch.withColumn("lang", F.when(F.col("text") == "hello", "en").otherwise("de"))
    assert [r.line for r in filters.by_language(found, ["de"]).collect()] == ["de: hallo"]


def test_stream_sink_takes_each_row_once(spark, tmp_path):
    m = langid.train(langs(spark), langid.words, per_lang=20)
    langid.save(m, str(tmp_path / "model"), None)
    again = langid.load(spark, str(tmp_path / "model"))
    (tmp_path / "in").mkdir()
    for i, t in enumerate(["the dog", "der hund", "the cat"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"text": t, "retweet_count": 0}))
    for _ in range(2):  # a second start finds nothing new
        q = filters.run_language_filter(spark, str(tmp_path / "in"), again, str(tmp_path / "out"), str(tmp_path / "ck"), ["en"])
        q.awaitTermination(120)
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["en: the cat", "en: the dog"]


def test_language_filter_by_model(spark):
    m = langid.train(langs(spark), langid.words, per_lang=20)
    messages = spark.createDataFrame([(1, "the dog and the cat"), (2, "der hund und die katze")], "doc_id long, msg string")
    assert [r.doc_id for r in pipeline.prepared(messages, "de", lang_model=m).collect()] == [2]
    with pytest.raises(ValueError, match="needs languages"):
        pipeline.prepared(messages, "de")


def test_lists_vectors_and_trees(spark, tmp_path):
    assert [r.path for r in readers.parse_file_list(spark.createDataFrame([("a/b x",), (" c",)], "value string")).collect()] == ["a/b", "c"]
    with pytest.raises(Exception, match="without a path"):
        readers.parse_file_list(spark.createDataFrame([(" ",)], "value string")).collect()
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "one.txt").write_text("a 2\nb 0.5\n\n")
    (tmp_path / "v" / "two.txt").write_text("a 1\n")
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.term, r.cnt) for r in readers.read_vectors(spark, str(tmp_path / "v")).collect())
    assert got == [("one.txt", "a", 2.0), ("one.txt", "b", 0.5), ("two.txt", "a", 1.0)]
    (tmp_path / "bad.txt").write_text("a x\n")
    with pytest.raises(Exception, match="not finite"):
        readers.read_vectors(spark, str(tmp_path / "bad.txt")).collect()
    tree = cluster.grow_tree(np.array([[0, 1, 4], [1, 0, 5], [4, 5, 0]], float), "avg")
    cluster.save_tree(spark, tree, str(tmp_path / "tree"))
    assert cluster.load_tree(spark, str(tmp_path / "tree")) == tree


def test_report_with_truth(spark):
    topics = spark.createDataFrame([(1, 0, 2.5, 0.5, 60.0, ["a", "b"]), (2, 1, 1.0, 0.25, 40.0, ["c"])], "rank int, z int, score double, purity double, pct_docs double, terms array<string>")
    joint = spark.createDataFrame([(0, "x", 4.0), (1, "y", 4.0)], "z int, label string, n double")
    got = summary.summary_lines(topics, joint).orderBy("rank").collect()
    assert [(r.line, r.true_topics) for r in got] == [("   0\t 2.50\t0.500\t60.00 1.000 \ta\tb", "x:100.0"), ("   1\t 1.00\t0.250\t40.00 1.000 \tc", "y:100.0")]
    assert "true_topics" not in summary.summary_lines(topics).columns
    model = plsa.Model(None, spark.createDataFrame([(1, [1.0])], "doc_id long, p array<double>"), [1.0], plsa.Options(1))
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, label string")
    assert evaluate.checked_labels(model, labels.limit(1)).count() == 1
    with pytest.raises(ValueError, match="differ"):
        evaluate.checked_labels(model, labels)


def test_whole_pipeline(spark):
    rows = [(i, ("the red apple tree grows tall near water. " if i % 2 else "a fast train line runs past stations. ") * (2 + i % 3)) for i in range(24)]
    got = pipeline.run(spark.createDataFrame(rows, "doc_id long, msg string"), plsa.Options(2, max_iter=4), df_cutoff=0.9, tf_cutoff=1)
    lines = [r.line for r in got.lines.orderBy("rank").collect()]
    # All words of a sentence are equally good, so they come in order of terms.
    assert {" ".join(line.split("\t")[4:11]) for line in lines} == {"apple grows near red tall the tree", "a fast line past runs stations train"}
    assert got.posteriors.count() == 24


# --- catalogue


CHECKED = ["normalize_text", "normalize_topic", "ascii_fold", "remove_markup", "sent_split", "term_counts", "counts_file_lines", "vocab_minus_stoplist", "filler_fallback", "weights_smooth", "l2_norm", "cosine_sim", "dense_sym_kl", "topic_dist_kulczynski", "kmeans_iter1", "plsa_em_iter1", "eval_metrics", "d2z", "ig_domain", "ig_lang_bin", "nb_log_ptc", "bl_weights", "stream_lang_filter"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
@pytest.mark.parametrize("name", CHECKED)
def test_catalogue_follows_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    df = catalogue.QUERIES[name](spark, SMALL)
    r = c.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    canon = lambda rows: sorted(tuple("%.9g" % x if isinstance(x, float) else repr(x) for x in row) for row in rows)
    assert canon(map(tuple, df.select(*[f"`{n}`" for n in names]).collect())) == canon(r.fetchall())


def byte_grams(t):
    raw = (t or "").encode()
    return [raw[i : i + k].hex().upper() for k in (1, 2, 3, 4) for i in range(len(raw) - k + 1)] if len(raw) >= 3 else []


def byte_chain(rows, per_order=15000, per_lang=300):
    """Features and scores of the whole chain by brute force; rows of doc_id, text, lang, source."""
    counter = lambda xs: {x: xs.count(x) for x in xs}
    h = lambda ns: -sum(n / sum(ns) * math.log(n / sum(ns)) for n in ns if n)
    present = [set(byte_grams(r[1])) for r in rows]
    df = {t: sum(t in p for p in present) for t in set().union(*present)}
    chosen = [t for k in (2, 4, 6, 8) for t in sorted((t for t in df if len(t) == k), key=lambda t: (-df[t], t))[:per_order]]

    def gain(t, groups):
        cells = [[sum(g == x and (t in p) == has for g, p in zip(groups, present, strict=True)) for x in sorted(set(groups))] for has in (True, False)]
        return h(list(counter(groups).values())) - sum(sum(c) / len(rows) * h(c) for c in cells if sum(c))

    langs, feats = sorted({r[2] for r in rows}), set()
    by_domain = {t: gain(t, [r[3] for r in rows]) for t in chosen}
    for x in langs:
        ld = {t: round(gain(t, [r[2] == x for r in rows]) - by_domain[t], 9) for t in chosen}
        feats |= set(sorted(ld, key=lambda t: (-ld[t], t))[:per_lang])
    n = {x: dict.fromkeys(feats, 0) for x in langs}
    for r in rows:
        for t in byte_grams(r[1]):
            if t in feats:
                n[r[2]][t] += 1
    ptc = {x: {t: math.log(1 + c) - math.log(len(feats) + sum(n[x].values())) for t, c in n[x].items()} for x in langs}
    prior = {x: math.log(sum(r[2] == x for r in rows)) for x in langs}
    return feats, ptc, {(r[0], x): prior[x] + sum(ptc[x][t] for t in byte_grams(r[1]) if t in feats) for r in rows for x in langs}


def tables(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


#: Texts of languages whose words never repeat; two are too short for any n-gram, one is missing.
SCARCE = [(i, f"{w}{i} {w}n{i * 7}x", g, f"src{i % 2}") for i, (w, g) in enumerate([("thew", "en"), ("schö", "de"), ("eaux", "fr")] * 3)] + [(20, "ab", "en", "src0"), (21, "", "de", "src1"), (22, None, "en", "src1")]


def test_langid_runs_the_whole_chain(spark, tmp_path):
    d = tables(spark, tmp_path, SCARCE)
    feats, ptc, scores = byte_chain(SCARCE)
    got = {(r.doc_id, r.lang): r.score for r in catalogue.QUERIES["langid_rank"](spark, d).collect()}
    assert got.keys() == scores.keys() and all(got[k] == pytest.approx(v, abs=1e-3) for k, v in scores.items())
    best = {i: min(sorted(ptc), key=lambda x: (-scores[i, x], x)) for i, *_ in SCARCE}
    assert {r.doc_id: r.lang for r in catalogue.QUERIES["langid_classify"](spark, d).collect()} == best
    assert {(r.term, r.lang): r.log_ptc for r in catalogue.QUERIES["byte_nb_log_ptc"](spark, d).collect()} == pytest.approx({(t, x): p for x in ptc for t, p in ptc[x].items()}, abs=1e-5)


def test_byte_steps(spark, tmp_path):
    d = tables(spark, tmp_path, SCARCE)
    feats, _, _ = byte_chain(SCARCE)
    run = lambda q: catalogue.QUERIES[q](spark, d).collect()
    every = [(i, t) for i, s, *_ in SCARCE for t in byte_grams(s)]
    df = {t: len({i for i, u in every if u == t}) for _, t in every}
    assert {r.term: r.n for r in run("byte_ngrams")} == {t: sum(u == t for _, u in every) for t in df}
    assert {r.term: r.df for r in run("byte_ngram_df")} == df == {r.term: r.df for r in run("byte_df_select")}
    assert {(r.doc_id, r.term): r.n for r in run("byte_scanner_counts")} == {k: every.count(k) for k in every if k[1] in feats}
    assert {r.term: (r.len, r.df) for r in run("byte_feat_weights_table")} == {t: (len(t) // 2, df[t]) for t in feats}


def test_ingest_takes_all(spark, tmp_path):
    d = tables(spark, tmp_path, SCARCE)
    texts = {str(i): t for i, t, *_ in SCARCE if t}
    assert "fr" in {r[2] for r in SCARCE} and {r.id: r.msg for r in catalogue.QUERIES["ingest_all_messages"](spark, d).collect()} == texts
    assert catalogue.QUERIES["ingest_all_kept_pct"](spark, d).collect()[0][0] == pytest.approx(100 * len(texts) / len(SCARCE), abs=1e-6)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
@pytest.mark.parametrize("name", ["ingest_all_messages", "ingest_all_kept_pct"])
def test_ingest_follows_sql(spark, name):
    test_catalogue_follows_sql(spark, name)


def test_stream_classifies_every_document(spark, tmp_path):
    rows = [(i, f"{w} {w}{i}", "fr" if i == 5 else g, f"src{i % 2}") for i, (w, g) in enumerate([("the cat", "en"), ("der hund", "de"), ("le chien", "fr")] * 4)] + [(20, None, "en", "src0"), (21, "", "en", "src0")]
    _, ptc, scores = byte_chain(rows)
    best = {i: min(sorted(ptc), key=lambda x: (-scores[i, x], x)) for i, *_ in rows}
    got = {(r.lang, r.text) for r in catalogue.QUERIES["stream_classified_filter"](spark, tables(spark, tmp_path, rows)).collect()}
    assert got == {(best[i], t) for i, t, *_ in rows if t and best[i] in ("en", "de")} and len(got) > 4


def test_feature_lines_are_not_gathered(spark):
    found = readers.parse_feature_lines(spark.range(100).selectExpr("concat('t', id, ' 2') AS value"))
    assert "Window" not in found._jdf.queryExecution().toString() and found.agg(F.sum("weight")).collect()[0][0] == 200
    assert readers.parse_feature_lines(spark.createDataFrame([], "value string")).count() == 0
