"""Exact dedup, native: group by a 128-bit content hash, compare bytes inside the groups, keep the smallest stable id.

Texts are equal when identical after each run of white space is replaced by one space; null counts as empty. The
aggregate groups by the hash and the text itself, so its byte comparison separates texts that share a hash, and its
map-side part folds the copies within a task: a group of any size sends one row a task. Rows find their group by the
hash and the SHA-256 of the text; two different texts with both alike stop the job rather than merge.

Null ids rank after all others; a group with null ids only keeps its rows in `exact_groups`, and one row in
`exact_dedup`. Rows that repeat an id and text are all marked kept; `exact_dedup` returns one of them. Empty tables give
empty results, other columns and their names don't matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, text_or_empty, written


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), WS, " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row a distinct text: h, text_sha256, keep_id, group_size."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), normalised(text_col).alias("norm")).withColumn("h", content_hash(F.col("norm")))
    groups = rows.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")


def proven(groups: DataFrame) -> DataFrame:
    """groups, with an error if hash and SHA-256 do not tell two texts apart."""
    once = groups.groupBy("h", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.count("*").alias("texts"))
    return once.where(F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("boolean")).otherwise(True)).drop("texts")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = written(proven(content_groups(df, id_col, text_col, content_hash)), "exact-proven")
    norm = F.col("norm")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(text_col).alias("norm")).select("doc_id", content_hash(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256"))
    # Both sides are plain scans, so AQE can split the partition of a hot group; it broadcasts groups only if they are small.
    return rows.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of df that stay, with all columns of df. The row with the smallest id goes through the aggregate by hash and
    text, so texts are shuffled once, and copies within a task fold before that. The text as it came goes along only where
    it differs from the normalised one. Among rows of the same id the one whose text as it came has the smallest hash stays."""
    text, norm = F.col(f"`{text_col}`"), F.col("__norm")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != text_col.lower()]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), text.alias("__text"), normalised(text_col).alias("__norm"))
    same = F.col("__text").eqNullSafe(norm)
    whole = F.struct(F.col("__row").alias("others"), same.alias("same"), F.when(~same, F.col("__text")).alias("text"))
    order = F.struct(F.col("__id").isNull(), F.col("__id"), F.xxhash64("__text"))
    stay = rows.withColumn("__h", content_hash(norm)).groupBy("__h", "__norm").agg(F.min_by(whole, order).alias("__stay"))
    came = F.when(F.col("__stay.same"), norm).otherwise(F.col("__stay.text"))
    return stay.select(*[came.alias(c) if c.lower() == text_col.lower() else F.col("__stay")["others"][c].alias(c) for c in df.columns])
