"""Streaming language filter: JSON lines with text that are no repeats, in chosen languages. It holds no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import langid

SCHEMA = "text string, retweet_count int"


def posts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Originals with a text, from JSON lines; works on batches and streams."""
    parsed = lines.select(F.from_json(F.col(value), SCHEMA).alias("j")).select("j.*")
    return parsed.where((F.col("retweet_count") == 0) & F.col("text").isNotNull() & (F.col("text") != ""))


def by_language(found: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """`lang: text` lines of rows (lang, text) in the chosen languages."""
    kept = found if langs is None else found.where(F.col("lang").isin(langs))
    return kept.select("lang", "text", F.concat_ws(": ", "lang", "text").alias("line"))


def stream_posts(spark: SparkSession, path: str) -> DataFrame:
    return posts(spark.readStream.text(path))


def classified(lines: DataFrame, model: langid.LangidModel, langs: list[str] | None = None) -> DataFrame:
    """`lang: text` lines of posts in the languages that the model finds. It works alike on batches and streams."""
    return by_language(langid.with_language(posts(lines), model), langs)


def run_language_filter(spark: SparkSession, path: str, model: langid.LangidModel, out: str, checkpoint: str, langs: list[str] | None = None) -> StreamingQuery:
    """Filters the JSON lines of a folder into Parquet under `out` and ends with what is there. The plan keeps no state; the
    checkpoint knows which files are read, and the sink's log which outputs count, so that a run after a stop or a failure
    neither loses nor repeats a line."""
    found = classified(spark.readStream.text(path), model, langs)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
