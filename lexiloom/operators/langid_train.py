"""Trains a language model on a folder tree: `python -m lexiloom.operators.langid_train CORPUS OUT`. Beside `model`, OUT gets
what a look at it needs: the feature list `features`, `weights` (a feature and its log-likelihoods in order of languages), and
the distributions `languages` and `domains`, all as lines of text. Feature lists go in again by -df_feats and -ld_feats."""

from __future__ import annotations

import argparse
import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources import files
from ..sources.tables import written
from . import langid


def literal(term: Column) -> Column:
    """Hexadecimal n-grams as literals of their bytes, which are lines of printable characters. Features are few."""

    @pandas_udf("string")
    def show(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: repr(bytes.fromhex(t)))

    return show(term)


def from_literal(text: Column) -> Column:
    @pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ast.literal_eval(t).hex().upper())

    return read(text)


def write_features(features: DataFrame, path: str) -> None:
    """A line a feature (term), in order of terms."""
    features.select("term").distinct().orderBy("term").select(literal(F.col("term")).alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(from_literal(F.col("value")).alias("term"))


def write_weights(weights: DataFrame, path: str) -> None:
    """A line a feature: its literal, and after commas its other columns, which are numbers or null."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in weights.columns if c != "term"]
    weights.orderBy("term").select(F.concat_ws(",", literal(F.col("term")), *values).alias("value")).write.mode("overwrite").text(path)


def read_weights(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(term, names): the literal may hold commas, so values are counted from a line's end."""
    pattern = "^(.*)" + ",([^,]*)" * len(names) + "$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).select(from_literal(part(1)).alias("term"), *[F.when(part(i + 2) != "", part(i + 2)).cast("double").alias(n) for i, n in enumerate(names)])


def write_distribution(dist: DataFrame, path: str) -> None:
    """A line a name: the name, a comma, and its number of documents; the number has no comma, so names may."""
    dist.toDF("name", "n").orderBy("name").select(F.concat_ws(",", F.coalesce("name", F.lit("")), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", "^(.*),([0-9]+)$", 1).alias("name"), F.regexp_extract("value", "^(.*),([0-9]+)$", 2).cast("long").alias("n"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="A language model from files in .../domain/language/file")
    p.add_argument("corpus")
    p.add_argument("output_dir")
    p.add_argument("-p", "--proportion", type=float, default=1.0, help="share of the files to take")
    p.add_argument("-seed", type=int, default=1)
    p.add_argument("-langs", nargs="*", help="languages to take")
    p.add_argument("-domains", nargs="*", help="domains to take")
    p.add_argument("-min_domain", type=int, default=1, help="domains that a language must be in")
    p.add_argument("-max_order", type=int, default=4, help="longest n-gram in bytes")
    p.add_argument("-word", action="store_true", help="features are words")
    p.add_argument("-df_tokens", type=int, default=15000, help="n-grams an order, by document frequency")
    p.add_argument("-ld_tokens", type=int, default=300, help="features a language")
    p.add_argument("-no_domain_ig", action="store_true", help="rank by the gain on languages alone")
    p.add_argument("-df_feats", help="feature list instead of the choice by document frequency")
    p.add_argument("-ld_feats", help="feature list instead of the choice by gain")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = written(files.read_corpus(spark, a.corpus, a.langs, a.domains, a.proportion, a.seed), "corpus")
    if docs.isEmpty():
        raise SystemExit("no files")
    tokenizer, unit = (langid.words, 1) if a.word else (langid.byte_ngrams(tuple(range(1, a.max_order + 1))), 2)
    given = lambda path: read_features(spark, path) if path else None
    model = langid.train(docs, tokenizer, unit, a.df_tokens, a.ld_tokens, not a.no_domain_ig, a.min_domain, given(a.df_feats), given(a.ld_feats))
    langid.save(model, f"{a.output_dir}/model", None if a.word else tokenizer.orders)
    for c, name in (("lang", "languages"), ("domain", "domains")):
        write_distribution(docs.groupBy(c).agg(F.count("*").alias("n")), f"{a.output_dir}/{name}")
    if not a.word:  # words are no bytes literals
        langs = [r[0] for r in model.log_pc.orderBy("lang").select("lang").collect()]  # a row a language
        write_features(model.log_ptc, f"{a.output_dir}/features")
        wide = model.log_ptc.groupBy("term").agg(*[F.max(F.when(F.col("lang") == g, F.col("log_ptc"))).alias(g) for g in langs])
        write_weights(wide, f"{a.output_dir}/weights")


if __name__ == "__main__":
    main()
