"""Readers and writers of message and counts files. A reader is a name, its columns by field number and the fields it needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reader:
    columns: dict[str, int]
    needs: int


JOURNAL = ("id", "subject", "msg", "author", "image_id", "image_template_id", "comment_count", "recommendation_count", "date")
READERS: dict[str, Reader] = {
    "default": Reader({"id": 0, "msg": 1}, 2),
    "journal": Reader({name: i for i, name in enumerate(JOURNAL)}, 9),
    "loan": Reader({"id": 0, "date": 15, "msg": 17}, 18),
}


def register_reader(name: str, columns: dict[str, int], needs: int) -> None:
    READERS[name] = Reader(columns, needs)


def parse_lines(lines: DataFrame, reader: str | Reader = "default", value: str = "value") -> DataFrame:
    """`fields` and `ok` of tab-delimited lines, after trailing white space is dropped (which also drops empty last fields)."""
    r = READERS[reader] if isinstance(reader, str) else reader
    fields = F.split(F.rtrim(F.col(value), F.lit(" \t\n\x0b\f\r")), "\t")  # a pattern bound to the end takes quadratic time on long runs
    return lines.withColumn("fields", fields).withColumn("ok", F.size("fields") >= r.needs)


def to_messages(lines: DataFrame, reader: str | Reader = "default", order: str | None = None) -> DataFrame:
    """Messages of the lines that have enough fields. With `order` (a column of line numbers) the last of each id stays."""
    r = READERS[reader] if isinstance(reader, str) else reader
    kept = parse_lines(lines, r).where("ok").select(*([order] if order else []), *[F.get(F.col("fields"), F.lit(i)).alias(c) for c, i in r.columns.items()])
    if not order:
        return kept
    # An aggregate, so that rows of one id meet already before the shuffle; a lost id is an id like others.
    return kept.groupBy("id").agg(F.max_by(F.struct(*r.columns), order).alias("m")).select("m.*")


def read_messages(spark: SparkSession, path: str, reader: str = "default", debug_limit: int | None = None) -> DataFrame:
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    out = to_messages(lines, reader, "line")
    return out.limit(debug_limit) if debug_limit else out


def kept_percent(lines: DataFrame, reader: str = "default") -> DataFrame:
    """Share of lines with enough fields in percent; null for no lines."""
    return parse_lines(lines, reader).agg((F.avg(F.col("ok").cast("double")) * 100).alias("kept_pct"))


def save_messages(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def counts_lines(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One line a document: its id and term|count in order of terms; counts as floats."""
    parts = F.array_sort(F.collect_list(F.struct("term", "cnt")))
    text = F.transform(parts, lambda p: F.concat(p["term"], F.lit("|"), F.format_string("%.1f", p["cnt"])))
    return counts.groupBy(doc).agg(F.concat_ws(" ", F.first(F.col(doc)).cast("string"), F.array_join(text, " ")).alias("line"))


def parse_counts_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Long counts (doc_id string, term, cnt) of counts lines; a count that is not finite is an error."""
    # A line is split inside the generator, once. A column of its parts beside explode() is made again for each pair, and then
    # a line takes time quadratic in its length.
    parts = F.transform(F.array(F.split(F.trim(F.col(value)), r"\s+")), lambda p: F.struct(p[0].alias("doc_id"), F.slice(p, 2, F.size(p)).alias("pairs")))
    exploded = lines.select(F.explode(parts).alias("line")).select("line.doc_id", F.explode("line.pairs").alias("pair"))
    cnt = F.regexp_extract("pair", r"\|([^|]*)$", 1).cast("double")
    bad = F.isnan(cnt) | (F.abs(cnt) == float("inf")) | cnt.isNull()
    return exploded.select("doc_id", F.regexp_extract("pair", r"^(.*)\|[^|]*$", 1).alias("term"), F.when(bad, F.raise_error(F.lit("count is not finite"))).otherwise(cnt).alias("cnt"))


def parse_feature_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """term and weight of feature lines; weight 1 where none is given. Mixed lines and weights that are not finite are errors."""
    parts = F.filter(F.split(F.col(value), r"\s+"), lambda x: x != "")
    rows = lines.select(parts.alias("p")).where(F.size("p") > 0)
    weighted = F.size("p") > 1
    rows = rows.crossJoin(F.broadcast(rows.agg((F.min(weighted) != F.max(weighted)).alias("mixed"))))  # one row
    mixed = F.col("mixed")
    weight = F.get("p", F.lit(1)).try_cast("double") if hasattr(F.col("p"), "try_cast") else F.get("p", F.lit(1)).cast("double")
    bad = weighted & (weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf")))
    checked = F.when(mixed, F.raise_error(F.lit("weighted and unweighted lines"))).when(bad, F.raise_error(F.lit("weight is not finite"))).otherwise(F.coalesce(weight, F.lit(1.0)))
    return rows.select(F.col("p")[0].alias("term"), checked.cast("double").alias("weight"))


def feature_lines(features: DataFrame) -> DataFrame:
    return features.select(F.format_string("%s %f ", "term", "weight").alias("value"))


def parse_labelled_files(lines: DataFrame, value: str = "value") -> DataFrame:
    """path and labels of labelled file lists. No label, or a label twice, is an error."""
    parts = F.filter(F.split(F.col(value), r"\s+"), lambda x: x != "")
    labels = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = (F.size(parts) > 0) & ((F.size(labels) == 0) | (F.size(F.array_distinct(labels)) < F.size(labels)))
    return lines.where(F.size(parts) > 0).select(parts[0].alias("path"), F.when(bad, F.raise_error(F.lit("labels are missing or repeated"))).otherwise(labels).alias("labels"))


def parse_file_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """path, the first word of every line of a file list. A line without one is an error."""
    path = F.regexp_extract(F.col(value), r"^[ \t\r]*([^ \t\r]*)", 1)
    return lines.select(F.when(path == "", F.raise_error(F.lit("line without a path")).cast("string")).otherwise(path).alias("path"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Long counts of text files with a term and a value on each line, by path. A value that is no finite number is an error."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc_id"), parts.alias("p")).where("p[0] <> ''")
    cnt = F.get("p", F.lit(1)).try_cast("double")
    bad = cnt.isNull() | F.isnan(cnt) | (F.abs(cnt) == float("inf"))
    return rows.select("doc_id", F.col("p")[0].alias("term"), F.when(bad, F.raise_error(F.lit("value is not finite")).cast("double")).otherwise(cnt).alias("cnt"))


def parse_dense_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.select(F.transform(F.filter(F.split(F.col(value), r"\s+"), lambda x: x != ""), lambda x: x.cast("double")).alias("vector"))


def decode_binary_vector(content: bytes) -> list[tuple[str, float]]:
    """Terms and values of one binary vector: its mark, a count, that many floats, and strings with their lengths."""
    mark = b"BINARY_VECTOR\n"
    if not content.startswith(mark):
        raise ValueError("not a binary vector")
    at = len(mark)
    (n,) = struct.unpack_from("<i", content, at)
    values = struct.unpack_from(f"<{n}f", content, at + 4)
    at += 4 + 4 * n
    terms = []
    for _ in range(n):
        (size,) = struct.unpack_from("<i", content, at)
        terms.append(content[at + 4 : at + 4 + size].rstrip(b"\0").decode())
        at += 4 + size
    return list(zip(terms, values, strict=True))


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Long counts of a folder of binary vectors, by path."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, t, float(v)) for p, c in zip(pdf["path"], pdf["content"], strict=True) for t, v in decode_binary_vector(bytes(c))]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "cnt"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "doc_id string, term string, cnt double")


def display(df: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Rows as JSON with their fields in order; with a key only those that have the value, none if the key is unknown."""
    if key is not None:
        df = df.where(F.col(key).cast("string") == value) if key in df.columns else df.limit(0)
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("json"))


def validated(condition: Column, column: Column, message: str) -> Column:
    return F.when(condition, column).otherwise(F.raise_error(F.lit(message)).cast("double"))
