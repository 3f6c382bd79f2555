"""Feature weights and normalisation of long counts and vocabularies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDF, LLR, NONE = "idf", "llr", "none"


def learn_weights(vocab: DataFrame, n_docs: float, total_tf: float | None = None, weighting: str = IDF, df_cutoff: float = 0.5, tf_cutoff: float = 5.0, smooth: bool = False, root: bool = False) -> DataFrame:
    """vocab (term, tf, df) with its weight. Hard cutoffs give 0; smooth ones scale the weight down; root takes the root."""
    share = F.greatest(F.col("df"), F.lit(0.01)) / F.lit(float(n_docs))
    weight: Column = {IDF: -F.log(share), LLR: -F.log(F.col("tf") / F.lit(float(total_tf or 1.0))), NONE: F.lit(1.0)}[weighting]
    if smooth:
        if tf_cutoff > 0:
            weight = weight * (1 - F.exp(F.lit(math.log(0.5) / tf_cutoff) * F.col("tf")))
        if 0 < df_cutoff < 1:
            weight = weight * (1 - F.exp(F.lit(math.log(0.5) / math.log(df_cutoff)) * F.log(share)))
    else:
        weight = F.when((share >= df_cutoff) | (F.col("tf") <= tf_cutoff), 0.0).otherwise(weight)
    return vocab.withColumn("weight", F.sqrt(weight) if root else weight)


def corpus_totals(counts: DataFrame) -> tuple[float, float]:
    """Number of documents and of words."""
    row = counts.agg(F.countDistinct("doc_id"), F.sum("cnt")).first()
    return float(row[0] or 0), float(row[1] or 0.0)


def apply_weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    return counts.join(vocab.select("term", "weight"), "term").select("doc_id", "term", (F.col("cnt") * F.col("weight")).alias("value"))


def _scaled(vectors: DataFrame, value: str, norm: Column) -> DataFrame:
    norms = vectors.groupBy("doc_id").agg(norm.alias("__norm"))
    return vectors.join(norms, "doc_id").withColumn(value, F.col(value) / F.col("__norm")).drop("__norm")


def l1_normalized(vectors: DataFrame, value: str = "value") -> DataFrame:
    return _scaled(vectors, value, F.sum(value))


def l2_normalized(vectors: DataFrame, value: str = "value") -> DataFrame:
    return _scaled(vectors, value, F.sqrt(F.sum(F.col(value) * F.col(value))))


def normalized_weights(vocab: DataFrame) -> DataFrame:
    """Weights scaled to a mean size of one."""
    mean = vocab.agg(F.avg(F.abs("weight")).alias("__mean"))
    return vocab.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("__mean")).drop("__mean")


def map_uniform(values: DataFrame, count: str, tau: float) -> DataFrame:
    """values with p, smoothed to a uniform prior that weighs tau a value."""
    total = values.agg(F.sum(count).alias("__sum"), F.count("*").alias("__n"))
    return values.crossJoin(F.broadcast(total)).withColumn("p", (F.col(count) + tau) / (F.col("__sum") + F.col("__n") * tau)).drop("__sum", "__n")


def map_prior(values: DataFrame, count: str, prior: str, tau: float) -> DataFrame:
    """values with p, interpolated with their prior; a zero probability is an error."""
    total = values.agg(F.sum(count).alias("__sum"), F.count("*").alias("__n"))
    lam = F.col("__sum") / (F.col("__sum") + F.col("__n") * tau)
    p = lam * F.col(count) / F.col("__sum") + (1 - lam) * F.col(prior)
    return values.crossJoin(F.broadcast(total)).withColumn("p", F.when(p == 0, F.raise_error(F.lit("zero probability")).cast("double")).otherwise(p)).drop("__sum", "__n")
