"""Folder trees, vector lists, line counts, and single files put together from parts."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import langid
from lexiloom.sources import files


def tree(root):
    made = {}
    for domain, lang, name, text in [("news", "en", "a.txt", "the cat\nsat"), ("news", "de", "b", "die Katze"), ("web", "en", "c d+e.txt", ""), ("deep/er/web", "fr", "f%20g", "le chat"), ("web", "en gb", "h", "colour"), ("news", "en", "b", "é\r\nü")]:
        place = root / domain / lang
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_bytes(text.encode())
        made[domain.rsplit("/")[-1], lang, name] = text
    return made


def files_read(df):
    """Files that the scan of an executed frame opened."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if plan.metrics().contains("numFiles"):
            n += plan.metrics().apply("numFiles").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return n


def test_corpus_of_a_folder_tree(spark, tmp_path):
    made = tree(tmp_path)
    got = files.read_corpus(spark, str(tmp_path))
    rows = got.collect()
    assert {(r.domain, r.lang, r.text) for r in rows if r.text} == {(d, g, t) for (d, g, _), t in made.items() if t}
    assert len({r.doc_id for r in rows}) == len(rows)
    some = files.read_corpus(spark, str(tmp_path), langs=["en", "en gb"], domains=["news", "web"])
    assert {(r.domain, r.lang, r.text) for r in some.collect() if r.text} == {("news", "en", "the cat\nsat"), ("news", "en", "é\r\nü"), ("web", "en gb", "colour")}
    assert files_read(files.read_corpus(spark, str(tmp_path), langs=["de"])) == 1 < files_read(files.read_corpus(spark, str(tmp_path))) == 5
    assert files.read_corpus(spark, str(tmp_path), langs=[]).count() == 0
    half = [sorted(r.doc_id for r in files.read_corpus(spark, str(tmp_path), proportion=0.5, seed=s).collect()) for s in (1, 1, 2, 3, 4)]
    assert half[0] == half[1] and len({tuple(h) for h in half}) > 1
    assert files.read_corpus(spark, str(tmp_path), proportion=0.0).count() == 0
    with pytest.raises(ValueError, match="between"):
        files.read_corpus(spark, str(tmp_path), proportion=1.5)
    model = langid.train(got.where("lang IN ('en', 'de', 'fr')"), per_lang=20)
    assert {r.lang for r in langid.classify(got, model).collect()} <= {"en", "de", "fr"}


def lines_by_hand(raw):
    parts = raw.split(b"\n")
    return len(parts) - 1, max([len(p) + 1 for p in parts[:-1]] + [len(parts[-1])])


@pytest.mark.parametrize("split", ["7", "128m"])
def test_line_counts_equal_brute_force(spark, tmp_path, split):
    rng = random.Random(1)
    raws = [b"", b"\n", b"abc", b"abc\n", b"a\nbb", b"aaaa\nbb\n", b"a\nbbbb", b"aaaa\nbbbb", b"aaaa\nbbbbb", b"\n\n\n", b"x\r\ny\rz\n", "é\nüü".encode(), b"\x00\n\xff\xfe"]
    raws += [bytes(rng.choices(b"ab\n", weights=[5, 5, 2], k=rng.randint(1, 60))) for _ in range(8)]
    for i, raw in enumerate(raws):
        (tmp_path / f"{i:02d}").write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {int(r.path.rsplit("/", 1)[1]): (r.lines, r.longest) for r in files.line_counts(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: lines_by_hand(raw) for i, raw in enumerate(raws)}


def binary(values):
    names = b"".join(struct.pack("<i", len(t.encode()) + 1) + t.encode() + b"\0" for t in values)
    return b"BINARY_VECTOR\n" + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}f", *values.values()) + names


def test_vector_list(spark, tmp_path):
    (tmp_path / "v/sub").mkdir(parents=True)
    (tmp_path / "v/one").write_text("cat 1.5\n\ndog 2 extra\nlone\n")
    (tmp_path / "v/sub/two").write_bytes(binary({"cat": 0.5, "été": 3.0}))
    (tmp_path / "v/empty").write_text("")
    (tmp_path / "v/unlisted").write_text("cat nan\n")
    listed = tmp_path / "list"
    listed.write_text("one en web\nsub/two fr\n\nempty en\n")
    counts, labels = files.read_vector_list(spark, str(listed), str(tmp_path / "v"))
    assert {tuple(r) for r in counts.collect()} == {("one", "cat", 1.5), ("one", "dog", 2.0), ("sub/two", "cat", 0.5), ("sub/two", "été", 3.0)}
    assert {r.doc_id: r.labels for r in labels.collect()} == {"one": ["en", "web"], "sub/two": ["fr"], "empty": ["en"]}
    named = lambda *x: spark.createDataFrame([(y,) for y in x], "term string")
    assert {tuple(r) for r in files.read_vector_list(spark, str(listed), str(tmp_path / "v"), named("cat"))[0].collect()} == {("one", "cat", 1.5), ("sub/two", "cat", 0.5)}
    filled = files.read_vector_list(spark, str(listed), str(tmp_path / "v"), named("dog", "<filler>"))[0].collect()
    assert {tuple(r) for r in filled} == {("one", "<filler>", 1.5), ("one", "dog", 2.0), ("sub/two", "<filler>", 3.5)}
    classes = spark.createDataFrame([("en",), ("web",), ("fr",)], "label string")
    assert files.read_vector_list(spark, str(listed), str(tmp_path / "v"), None, classes)[1].count() == 3
    with pytest.raises(Exception, match="unknown class web"):
        files.read_vector_list(spark, str(listed), str(tmp_path / "v"), None, classes.where("label <> 'web'"))[1].collect()
    for line, error in [("one en en", "repeated"), ("gone en", "no such file"), ("one en\none fr", "a path twice"), ("unlisted en", "not finite")]:
        listed.write_text(line)
        with pytest.raises(Exception, match=error):
            [x.collect() for x in files.read_vector_list(spark, str(listed), str(tmp_path / "v"))]


def documents(spark, n=400):
    topics = spark.createDataFrame([(i, json.dumps({"topic_num": i, "topic_score": i / 7, "doc_purity": 0.5, "fraction_of_docs": 0.25, "summary_words": f'w{i} "x" ,'})) for i in (2, 0, 1)], "topic_num int, json string")
    docs = spark.createDataFrame([(f'd{i} "\\é,', i % 3, [i / 3, 1e-9]) for i in range(n)], "doc_id string, top_topic int, topic_probabilities array<double>").repartition(7)
    return topics, docs


def test_topic_document_is_one_json_and_comes_back(spark, tmp_path):
    topics, docs = documents(spark)
    path = str(tmp_path / "out/topics.json")
    for _ in range(2):  # the second takes the first one's place
        files.write_topic_document(topics, docs, path)
    whole = json.loads((tmp_path / "out/topics.json").read_text())
    assert list(whole) == ["filename", "topics", "document_topics"] and whole["filename"] == path
    assert [t["topic_num"] for t in whole["topics"]] == [0, 1, 2] and whole["topics"][1]["summary_words"] == 'w1 "x" ,'
    assert whole["document_topics"] == {r.doc_id: {"top_topic": r.top_topic, "topic_probabilities": r.topic_probabilities} for r in docs.collect()}
    back_topics, back_docs = files.read_topic_document(spark, path)
    assert {tuple(map(str, r)) for r in back_docs.collect()} == {tuple(map(str, r)) for r in docs.collect()}
    assert {r.topic_num: r.summary_words for r in back_topics.collect()} == {i: f'w{i} "x" ,' for i in range(3)}
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["topics.json"]


def test_topic_document_of_nothing_and_failures(spark, tmp_path):
    topics, docs = documents(spark, 5)
    path = tmp_path / "t.json"
    files.write_topic_document(topics.limit(0), docs.limit(0), str(path))
    assert json.loads(path.read_text()) == {"filename": str(path), "topics": [], "document_topics": {}}
    broken = docs.withColumn("top_topic", F.when(F.col("top_topic") == 1, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("top_topic")))
    with pytest.raises(Exception, match="stop"):
        files.write_topic_document(topics, broken, str(path))
    assert json.loads(path.read_text())["topics"] == [] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.json"]


def test_lm_matrix_file(spark, tmp_path):
    rng = random.Random(2)
    p = {(z, f"w{i:03d}"): rng.random() / 1000 for z in range(3) for i in range(150)}
    values = spark.createDataFrame([(z, t, x) for (z, t), x in p.items()], "z int, term string, p double").repartition(5)
    path = str(tmp_path / "lm")
    files.write_lm_matrix(values, 3, path)
    text = (tmp_path / "lm").read_text()
    assert text == "".join(" ".join("%e" % p[z, f"w{i:03d}"] for i in range(150)) + "\n" for z in range(3))
    assert {(r.z, r.idx): r.p for r in files.read_lm_matrix(spark, path).collect()} == {(z, i): float("%e" % p[z, f"w{i:03d}"]) for z in range(3) for i in range(150)}


def test_language_training_command(spark, tmp_path):
    from lexiloom.operators import langid_train

    for i in range(6):
        for domain in ("news", "web"):
            for lang, word in (("en", "thew"), ("de", "schö"), ("fr", "eaux")):
                place = tmp_path / "corpus" / domain / lang
                place.mkdir(parents=True, exist_ok=True)
                (place / f"{i}").write_text(f"{word}{i} {word}, {word}'n\"\\{i}")
    out = str(tmp_path / "out")
    langid_train.main([str(tmp_path / "corpus"), out, "-ld_tokens", "30", "-langs", "en", "de"])
    model = langid.load(spark, f"{out}/model")
    assert {r.lang: r.n for r in langid_train.read_distribution(spark, f"{out}/languages").toDF("lang", "n").collect()} == {"en": 12, "de": 12}
    assert {r.name: r.n for r in langid_train.read_distribution(spark, f"{out}/domains").collect()} == {"news": 12, "web": 12}
    terms = {r.term for r in model.log_ptc.select("term").collect()}
    assert {r.term for r in langid_train.read_features(spark, f"{out}/features").collect()} == terms and any("2C" in t or "27" in t for t in terms)
    back = {r.term: (r.de, r.en) for r in langid_train.read_weights(spark, f"{out}/weights", ["de", "en"]).collect()}
    want = {(r.term, r.lang): r.log_ptc for r in model.log_ptc.collect()}
    assert back.keys() == terms and all(back[t] == (want[t, "de"], want[t, "en"]) for t in terms)
    langid_train.main([str(tmp_path / "corpus"), f"{out}2", "-ld_feats", f"{out}/features", "-langs", "en", "de"])
    again = {(r.term, r.lang): r.log_ptc for r in langid.load(spark, f"{out}2/model").log_ptc.collect()}
    assert again == want
    with pytest.raises(SystemExit, match="no files"):
        langid_train.main([str(tmp_path / "corpus"), f"{out}3", "-langs", "xx"])


def test_every_byte_has_a_literal(spark, tmp_path):
    from lexiloom.operators import langid_train

    terms = [f"{b:02X}" for b in range(256)] + ["2C2C2C", "272227", "5C6E"]
    df = spark.createDataFrame([(t, float(i), None if i % 2 else 1.5) for i, t in enumerate(terms)], "term string, a double, b double")
    langid_train.write_weights(df, str(tmp_path / "w"))
    assert sorted(map(tuple, langid_train.read_weights(spark, str(tmp_path / "w"), ["a", "b"]).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert all(line.isprintable() for p in (tmp_path / "w").glob("part-*") for line in p.read_text().splitlines())


def test_ingest_command(spark, tmp_path, capsys):
    from lexiloom.sources import ingest, readers

    (tmp_path / "in.txt").write_text("a\tone\nshort\nb\ttwo\na\tthree\n")
    ingest.main([str(tmp_path / "in.txt"), str(tmp_path / "out")])
    assert {tuple(r) for r in readers.load_messages(spark, str(tmp_path / "out")).collect()} == {("a", "three"), ("b", "two")}
    assert "kept 75.00 percent" in capsys.readouterr().out
    ingest.main([str(tmp_path / "in.txt"), str(tmp_path / "out"), "-debug", "1"])
    assert capsys.readouterr().out.count('"msg"') == 1


def test_analysis_command_with_truth(spark, tmp_path):
    from lexiloom.plans import pipeline

    lines = [f"d{i}\t" + ("the red apple tree grows tall near water. " if i % 2 else "some fast train line runs past stations. ") * (2 + i % 3) for i in range(16)]
    (tmp_path / "in.txt").write_text("\n".join([*lines, "quiet\t.,;"]) + "\n")
    (tmp_path / "truth.txt").write_text("".join(f"d{i} {'fruit' if i % 2 else 'rail'}\n" for i in range(16)) + "quiet none\n")
    out = tmp_path / "out"
    command = [str(tmp_path / "in.txt"), str(out), "-num_topics", "2", "-max_iter", "3", "-df_cutoff", "0.9", "-tf_cutoff", "1", "-truth", str(tmp_path / "truth.txt")]
    pipeline.main([*command, "-lm_out", "-json_out"])
    shown = [x for p in (out / "true_topics").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(s.split(":")[0] for s in shown) == ["fruit", "rail"]
    whole = json.loads((out / "topics.json").read_text())
    assert len(whole["topics"]) == 2 and set(whole["document_topics"]) >= {f"d{i}" for i in range(16)}
    assert len((out / "lm").read_text().splitlines()) == 2
    (tmp_path / "truth.txt").write_text("d0 rail\n")
    with pytest.raises(ValueError, match="differ"):
        pipeline.main(command)
