"""Files that are more than a table's parts: a corpus in a folder tree, vectors that a list names, line counts, and single
files put together from parts that tasks wrote."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import decode_binary_vector, parse_labelled_files

_PATH = "_metadata.file_path"


def _name(from_end: int):  # noqa: ANN202
    """A part of a file's path, counted from its end, as it is called on disk."""
    part = F.element_at(F.split(F.col(_PATH), "/"), -from_end)
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def read_corpus(spark: SparkSession, root: str, langs: list[str] | None = None, domains: list[str] | None = None, proportion: float = 1.0, seed: int = 1) -> DataFrame:
    """(doc_id, text, lang, domain) of the files below root, each a document in .../domain/lang/file at any depth. Allow-lists
    and the sample look at paths alone, so files outside them are never opened. The sample takes a file by a hash of its
    path and the seed: again the same files, whatever the order of the listing."""
    if not 0 <= proportion <= 1:
        raise ValueError("a proportion is between 0 and 1")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    if langs is not None:
        files = files.where(_name(2).isin(langs))
    if domains is not None:
        files = files.where(_name(3).isin(domains))
    if proportion < 1:
        files = files.where(F.pmod(F.xxhash64(F.col(_PATH), F.lit(seed)), F.lit(1_000_000)) < int(proportion * 1_000_000))
    return files.select(F.col(_PATH).alias("doc_id"), F.col("value").alias("text"), _name(2).alias("lang"), _name(3).alias("domain"))  # empty files are no documents


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, longest) of files: the number of line feeds, and the most bytes of a line with its line feed. What follows
    the last one is no line, but its length counts. Spark reads byte ranges, and a line belongs to the range that it starts
    in, so that a file of any size is counted by many tasks; its size tells whether the last line ends."""
    size = F.octet_length("value").cast("long")
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col(_PATH).alias("path"), F.col("_metadata.file_size").alias("bytes"), size.alias("n"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")).alias("place"))
    by_size = rows.groupBy("path", "n").agg(F.count("*").alias("m"), F.max("place").alias("place"), F.max("bytes").alias("bytes"))
    whole = by_size.groupBy("path").agg(F.sum("m").alias("m"), F.sum(F.col("m") * (F.col("n") + 1)).alias("read"), F.max("bytes").alias("bytes"), F.max(F.struct("n", "m")).alias("top"), F.max_by("n", "place").alias("last"))
    open_end = F.col("read") > F.col("bytes")
    only = open_end & (F.col("last") == F.col("top.n")) & (F.col("top.m") == 1)  # the longest is what follows the last line feed
    found = whole.select("path", (F.col("m") - open_end.cast("int")).alias("lines"), (F.col("top.n") + F.when(only, 0).otherwise(1)).alias("longest"))
    none = spark.createDataFrame([(p,) for p in _empty_files(spark, path, recursive=False)], "path string")  # scans pass over them
    return found.unionByName(none.select("path", F.lit(0).alias("lines"), F.lit(0).alias("longest"))).select("path", F.col("lines").cast("long").alias("lines"), F.col("longest").cast("long").alias("longest"))


def _empty_files(spark: SparkSession, path: str, recursive: bool, encoded: bool = True) -> list[str]:
    """Addresses of the empty files at or below a path, which Spark's scans leave out. The driver lists, as it does for any scan."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(place) or []), []
    first = {s.getPath().toString() for s in todo}
    while todo:
        s = todo.pop()
        if s.isDirectory():
            if recursive or s.getPath().toString() in first:
                todo += list(fs.listStatus(s.getPath()))
        elif s.getLen() == 0 and s.getPath().getName()[:1] not in "._":
            out.append(spark._jvm.org.apache.spark.paths.SparkPath.fromPath(s.getPath()).urlEncoded() if encoded else s.getPath().toString())
    return out


def read_vector_list(spark: SparkSession, list_path: str, root: str, terms: DataFrame | None = None, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a labelled list (a path below root and its labels on each line) names: long counts (doc_id, term, cnt) of the
    vectors, each file a text or a binary vector by its first bytes, and (doc_id, labels), the primary label first.

    With terms (term) others count as the filler, or not at all if the terms have none. A file that is not there, a path
    twice, a repeated label and, with classes (label), an unknown one are errors. List and files meet in a join."""
    listed = parse_labelled_files(spark.read.text(list_path)).select(F.col("path").alias("doc_id"), "labels")
    if classes is not None:
        known = classes.select("label").distinct().withColumn("known", F.lit(True))
        named = listed.select("doc_id", "labels", F.explode("labels").alias("label")).join(known, "label", "left")
        bad = F.max(F.when(F.col("known").isNull(), F.col("label")))
        listed = named.groupBy("doc_id").agg(F.first("labels").alias("labels"), bad.alias("bad")).select("doc_id", F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("unknown class "), "bad")).cast("array<string>")).otherwise(F.col("labels")).alias("labels"))
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    none = spark.createDataFrame([(p, bytearray()) for p in _empty_files(spark, root, recursive=True, encoded=False)], "path string, content binary")
    files = files.select("path", "content").unionByName(none)
    files = files.select(F.substring("path", len(base) + 1, 1 << 30).alias("doc_id"), "content")
    once = listed.groupBy("doc_id").agg(F.first("labels").alias("labels"), F.count("*").alias("times"))
    met = once.join(files, "doc_id", "left")
    wrong = F.when(F.col("times") > 1, F.lit("a path twice: ")).when(F.col("content").isNull(), F.lit("no such file: "))
    met = met.select("doc_id", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, "doc_id")).cast("binary")).otherwise(F.col("content")).alias("content"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, t, v) for d, c in zip(pdf["doc_id"], pdf["content"], strict=True) for t, v in decode_vector(bytes(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "cnt"])

    counts = met.mapInPandas(decode, "doc_id string, term string, cnt double")
    if terms is not None:
        known = terms.select("term").distinct().withColumn("known", F.lit(True))
        filler = terms.where("term = '<filler>'").agg((F.count("*") > 0).alias("filler"))  # one row
        counts = counts.join(known, "term", "left").crossJoin(F.broadcast(filler)).where(F.col("known") | F.col("filler"))
        counts = counts.groupBy("doc_id", F.when(F.col("known"), F.col("term")).otherwise("<filler>").alias("term")).agg(F.sum("cnt").alias("cnt"))
    return counts, listed


def decode_vector(content: bytes) -> list[tuple[str, float]]:
    """Terms and values of a vector file: binary if its first line says so, else a term and a value on each line."""
    if content.startswith(b"BINARY_VECTOR\n"):
        return decode_binary_vector(content)
    out = []
    for line in content.decode().split("\n"):
        parts = line.split()
        if len(parts) > 1:
            value = float(parts[1])
            if value - value != 0:
                raise ValueError("value is not finite")
            out.append((parts[0], value))
    return out


def put_together(spark: SparkSession, parts: list[tuple[str, DataFrame | None, str]], path: str, end: str = "") -> None:
    """One file from ordered frames of one string column: for each part its prefix and its rows, with the separator between
    them. Tasks write the rows in their order; the driver streams the bytes of their files into one, holds none of them, and
    renames it when it is whole. After a failure nothing is left, and what was at the path before stays."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = place(path)
    fs = target.getFileSystem(conf)
    work = f"{path}.{uuid.uuid4().hex}"
    try:
        for i, (_, rows, separator) in enumerate(parts):
            if rows is not None:
                rows.write.option("lineSep", separator).text(f"{work}/{i}")
        out = fs.create(place(f"{work}/whole"))
        try:
            for i, (prefix, rows, separator) in enumerate(parts):
                out.write(bytearray(prefix.encode()))
                if rows is None:
                    continue
                found = sorted(((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(place(f"{work}/{i}")) if s.getLen() and s.getPath().getName().startswith("part-")), key=lambda x: x[0])
                for k, (_, part, size) in enumerate(found):
                    source = fs.open(part)
                    jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - (len(separator.encode()) if k == len(found) - 1 else 0))
                    source.close()
            out.write(bytearray(end.encode()))
        finally:
            out.close()
        if target.getParent() is not None:
            fs.mkdirs(target.getParent())
        fs.delete(target, False)
        if not fs.rename(place(f"{work}/whole"), target):
            raise OSError(f"could not write {path}")
    finally:
        fs.delete(place(work), True)


def write_topic_document(topics: DataFrame, docs: DataFrame, path: str) -> None:
    """One JSON document of topics (topic_num, json) and documents (doc_id, top_topic, topic_probabilities), a topic or
    document a line: `filename`, the list `topics` in order, and `document_topics` by id in order of ids."""
    spark = topics.sparkSession
    key = F.regexp_replace(F.to_json(F.array(F.col("doc_id").cast("string"))), r"^\[|\]$", "")
    body = F.to_json(F.struct("top_topic", "topic_probabilities"))
    listed = topics.orderBy("topic_num").select(F.col("json").alias("value"))
    named = docs.orderBy(F.col("doc_id").cast("string")).select(F.concat(key, F.lit(": "), body).alias("value"))
    put_together(spark, [(f'{{"filename": {json.dumps(path)},\n"topics": [\n', listed, ",\n"), ('\n],\n"document_topics": {\n', named, ",\n")], path, "\n}}\n")


def read_topic_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a document that `write_topic_document` wrote, line by line in many tasks."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", ",$", "").alias("value"))
    topics = lines.where(F.col("value").startswith('{"topic_num"')).select(F.from_json("value", "topic_num int, topic_score double, doc_purity double, fraction_of_docs double, summary_words string").alias("t")).select("t.*")
    pattern = r'^("(?:[^"\\]|\\.)*"): (\{"top_topic".*\})$'
    found = lines.where(F.col("value").rlike(pattern))
    key = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", pattern, 1), F.lit("]")), "array<string>")[0]
    body = F.from_json(F.regexp_extract("value", pattern, 2), "top_topic int, topic_probabilities array<double>")
    return topics, found.select(key.alias("doc_id"), body.alias("d")).select("doc_id", "d.*")


def write_lm_matrix(values: DataFrame, n_topics: int, path: str) -> None:
    """One file with a line a topic: P(w|z) of all words in order of words, in scientific notation with spaces between. values
    are (z, term, p); a value is a row of its own until it is in the file."""
    ordered = lambda z: values.where(F.col("z") == z).orderBy("term").select(F.format_string("%e", "p").alias("value"))
    put_together(values.sparkSession, [("\n" if z else "", ordered(z), " ") for z in range(n_topics)], path, "\n")


def read_lm_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(z, idx, p) of such a file: the line's and the value's place. Lines are put in order by where they start."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")).alias("place"), "value")
    starts = [r[0] for r in rows.select("place").orderBy("place").collect()]  # a row a topic
    z = F.array_position(F.array(*[F.struct(F.lit(s[0]).alias("start"), F.lit(s[1]).alias("i")) for s in starts]), F.col("place")) - 1 if starts else F.lit(0)
    return rows.select(z.cast("int").alias("z"), F.posexplode(F.split("value", " ")).alias("idx", "p")).select("z", "idx", F.col("p").cast("double").alias("p"))
