"""Long term counts (doc_id, term, cnt) and aggregates over them. Every aggregate combines before its shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.tables import written


def term_counts(df: DataFrame, tokenizer: Callable[[Column], Column] = text.tokens, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    exploded = df.select(F.col(id_col).alias("doc_id"), F.explode(tokenizer(F.col(text_col))).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("cnt"))


def corpus_tf(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("cnt").alias("tf"))


def corpus_df(counts: DataFrame) -> DataFrame:
    """Expected document frequency: counts below one add their fraction."""
    return counts.groupBy("term").agg(F.sum(F.least("cnt", F.lit(1.0))).alias("df"))


def doc_lengths(counts: DataFrame) -> DataFrame:
    return counts.groupBy("doc_id").agg(F.sum("cnt").alias("n_words"))


def class_priors(lengths: DataFrame, label: str = "label") -> DataFrame:
    """Shares of classes by documents and by words, from doc_id, label and n_words. Classes are few; totals are one row."""
    by = lengths.groupBy(label).agg(F.count("*").cast("double").alias("docs"), F.sum("n_words").alias("words"))
    whole = by.agg(F.sum("docs").alias("all_docs"), F.sum("words").alias("all_words"))
    return by.crossJoin(F.broadcast(whole)).select(label, (F.col("docs") / F.col("all_docs")).alias("p_docs"), (F.col("words") / F.col("all_words")).alias("p_words"))


def vocabulary(counts: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Terms with tf and df, less those of a stop list (column term)."""
    vocab = counts.groupBy("term").agg(F.sum("cnt").alias("tf"), F.sum(F.least("cnt", F.lit(1.0))).alias("df"))
    return vocab if stop is None else vocab.join(stop.select("term"), "term", "left_anti")


def indexed(terms: DataFrame, by: str = "term", start: int = 0) -> DataFrame:
    """terms with idx, dense in order of `by`: ranks inside range partitions, moved by the partitions' sizes, so no task
    sees all rows. The sizes are one number a partition."""
    n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = terms.repartitionByRange(n, by).withColumn("__part", F.spark_partition_id())
    parts = written(ranked.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(by))), "indexed")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return parts.join(F.broadcast(offsets), "__part").withColumn("idx", (F.col("__before") + F.col("__in") - 1 + start).cast("long")).drop("__part", "__in", "__before")


def augment(vocab: DataFrame, more: DataFrame) -> DataFrame:
    """vocab (term, idx) with new terms after the old ones; old terms keep their idx."""
    new = more.select("term").distinct().join(vocab, "term", "left_anti")
    high = vocab.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("start"))
    return vocab.select("term", "idx").unionByName(indexed(new).crossJoin(F.broadcast(high)).select("term", (F.col("idx") + F.col("start")).alias("idx")))


def prune_vocabulary(vocab: DataFrame, weight: str = "weight") -> DataFrame:
    """Terms of positive weight, with a dense new idx."""
    return indexed(vocab.where(F.col(weight) > 0).drop("idx"))


def prune_min_count(counts: DataFrame, min_count: float, filler: str = "<filler>") -> DataFrame:
    """Terms whose corpus count is above min_count, after a filler at index 0. With min_count 0 nothing is pruned or added."""
    kept = corpus_tf(counts)
    if min_count <= 0:
        return indexed(kept.select("term"))
    terms = indexed(kept.where(F.col("tf") > min_count).select("term"), start=1)
    return terms.unionByName(counts.sparkSession.createDataFrame([(filler, 0)], "term string, idx long"))


def against_vocabulary(counts: DataFrame, vocab: DataFrame, filler: str = "<filler>") -> DataFrame:
    """counts as (doc_id, idx, value); unknown terms count for the filler where the vocabulary has one, else they go."""
    slim = vocab.select("term", "idx")
    fill = vocab.where(F.col("term") == filler).agg(F.max("idx").alias("fill"))
    found = counts.join(slim, "term", "left").crossJoin(F.broadcast(fill)).withColumn("idx", F.coalesce("idx", "fill")).where("idx IS NOT NULL")
    return found.groupBy("doc_id", "idx").agg(F.sum("cnt").alias("value"))


def class_set(labels: DataFrame, label: str = "label") -> DataFrame:
    """Classes with ids in order of labels."""
    return indexed(labels.select(label).distinct(), by=label).withColumnRenamed("idx", "class_id")


def jackknife_folds(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Documents dealt out to n folds in turn, by id."""
    return indexed(df.select(id_col), by=id_col).select(id_col, (F.col("idx") % n).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, n: int, label: str, id_col: str = "doc_id") -> DataFrame:
    """Documents dealt out in turn by label, then id."""
    keyed = df.select(id_col, label).withColumn("__key", F.struct(F.col(label), F.col(id_col)))
    return indexed(keyed, by="__key").select(id_col, label, (F.col("idx") % n).cast("int").alias("fold"))
