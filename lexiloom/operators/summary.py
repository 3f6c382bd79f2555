"""Reports on a model: purities, scores, signature words, ranked words and matrices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import with_stems
from .evaluate import label_purity, true_topics
from .plsa import Model, long, p_w


def topic_purity(model: Model) -> DataFrame:
    """(z, purity): two to the mean of log2 P(z|d), weighted by P(z|d)."""
    p = F.col("p")
    agg = long(model.p_zd, "doc_id").groupBy("z").agg(F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)).alias("num"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("den"))
    return agg.select("z", F.when(F.col("num") == 0, 1.0).otherwise(F.pow(F.lit(2.0), F.col("num") / F.col("den"))).alias("purity"))


def topic_scores(model: Model) -> DataFrame:
    """(z, p_z, purity, score, pct_docs, rank): score and share of words in percent; rank by score, then topic."""
    spark = model.p_zd.sparkSession
    mass = spark.createDataFrame(list(enumerate(map(float, model.p_z))), "z int, p_z double")
    out = topic_purity(model).join(F.broadcast(mass), "z").select("z", "p_z", "purity", (100 * F.col("p_z") * F.col("purity")).alias("score"), (100 * F.col("p_z")).alias("pct_docs"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "z")).cast("int"))  # a row a topic


def word_scores(model: Model) -> DataFrame:
    """(term, z, score): P(w|z) P(z) ln(P(w|z) / P(w)), 0 where the joint is 0."""
    mass = F.array(*map(F.lit, map(float, model.p_z)))
    joined = model.p_wz.join(p_w(model), "term").select("term", "p_w", F.posexplode("p").alias("z", "p")).withColumn("joint", F.col("p") * mass[F.col("z")])
    return joined.select("term", "z", F.when(F.col("joint") > 0, F.col("joint") * F.log(F.col("p") / F.col("p_w"))).otherwise(0.0).alias("score"))


def global_word_scores(model: Model) -> DataFrame:
    return word_scores(model).groupBy("term").agg(F.sum("score").alias("score"))


def ranked_words(model: Model, counts: DataFrame, n: int = 50) -> DataFrame:
    """The n words of highest global score, with their counts."""
    tf = counts.groupBy("term").agg(F.sum("cnt").alias("count"))
    return global_word_scores(model).join(tf, "term").orderBy(F.desc("score"), "term").limit(n)


def without_substrings(terms: list[str]) -> list[str]:
    """Terms in order without those inside another in whole units; the longer takes the place of the first of both. A term
    after one that went is passed over, so the sweep runs twice."""
    inside = lambda a, b: f"_{b}_" in f"_{a}_"
    for _ in range(2):
        i = 0
        while i < len(terms):
            j = i + 1
            while j < len(terms):
                a, b = terms[i], terms[j]
                if len(a) != len(b) and (inside(a, b) or inside(b, a)):
                    terms[i] = a if len(a) > len(b) else b
                    del terms[j]
                j += 1
            i += 1
    return terms


def signature_words(model: Model, top: int = 20, final: int = 10, stems: bool = True) -> DataFrame:
    """(z, terms): the best-scoring word of each stem, the best `top` of these, without substrings, the first `final`."""
    scored = word_scores(model)
    scored = scored.join(with_stems(model.p_wz), "term") if stems else scored.withColumn("stem", F.col("term"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("z", "stem").orderBy(F.desc("score"), "term"))).where("r = 1")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("z").orderBy(F.desc("score"), "term"))).where(F.col("r") <= top)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = without_substrings(pdf.sort_values("r")["term"].tolist())[:final]
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "terms": [terms]})

    return first.select("z", "term", "r").groupBy("z").applyInPandas(cut, "z int, terms array<string>")


def summary(model: Model) -> DataFrame:
    """One row a topic: rank, z, score, purity, pct_docs, terms."""
    return topic_scores(model).join(signature_words(model), "z", "left").select("rank", "z", "score", "purity", "pct_docs", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def summary_lines(topics: DataFrame, joint: DataFrame | None = None) -> DataFrame:
    """The report's lines by rank; its header is HEADER. With joint counts of topics and labels a line also has the topic's
    label purity, and its true topics are a column."""
    head = F.format_string("%4d\t%5.2f\t%5.3f\t%5.2f", F.col("rank") - 1, F.col("score"), F.col("purity"), F.col("pct_docs"))
    if joint is None:
        return topics.select("rank", F.concat_ws("\t", head, F.array_join("terms", "\t")).alias("line"))
    pure, true = label_purity(joint).withColumnRenamed("purity", "label_purity"), true_topics(joint).withColumnRenamed("line", "true_topics")
    head = F.concat(head, F.coalesce(F.format_string(" %5.3f ", F.col("label_purity")), F.lit("")))
    return topics.join(pure, "z", "left").join(true, "z", "left").select("rank", F.concat_ws("\t", head, F.array_join("terms", "\t")).alias("line"), "true_topics")


HEADER = "\t".join(["index", "topic_score", "doc_purity", "percent_docs", *(f"summary{i}" for i in range(10))])


def topic_labels(topics: DataFrame, n: int = 3) -> DataFrame:
    return topics.select("z", F.array_join(F.slice("terms", 1, n), ",").alias("label"))


def lm_matrix(model: Model) -> DataFrame:
    """One row a topic: P(w|z) of all words in order of words, in scientific notation. Its line is as long as the vocabulary."""
    return long(model.p_wz, "term").groupBy("z").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "p"))), lambda x: F.format_string("%e", x["p"])), " ").alias("line"))


def d2z(model: Model, ranks: DataFrame) -> DataFrame:
    """One row a document: its id and P(z|d) in order of ranks."""
    order = [r[0] for r in ranks.orderBy("rank").select("z").collect()]  # a row a topic
    return model.p_zd.select("doc_id", F.concat_ws("\t", *[F.format_string("%.6f", F.col("p")[z]) for z in order]).alias("line"))


def topic_entropy(model: Model) -> DataFrame:
    """H(Z) of the mean of P(z|d), in nats."""
    mean = long(model.p_zd, "doc_id").groupBy("z").agg(F.avg("p").alias("p"))
    return mean.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"))


def parse_topic_line(line: Column) -> Column:
    """Fields of a line of the older report: # (index) score purity pct words."""
    pattern = r"^#?\s*\(?\s*(\d+)\)?\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+(.*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return F.struct(part(1).cast("int").alias("topic_num"), part(2).cast("double").alias("topic_score"), part(3).cast("double").alias("doc_purity"), (part(4).cast("double") / 100).alias("fraction_of_docs"), part(5).alias("summary_words"))


def package_topics(topics: DataFrame) -> DataFrame:
    """Topics as JSON, numbered by rank from 0."""
    fields = F.struct((F.col("rank") - 1).alias("topic_num"), F.col("score").alias("topic_score"), F.col("purity").alias("doc_purity"), (F.col("pct_docs") / 100).alias("fraction_of_docs"), F.array_join("terms", " ").alias("summary_words"))
    return topics.select((F.col("rank") - 1).alias("topic_num"), F.to_json(fields).alias("json"))


def package_docs(model: Model, ranks: DataFrame) -> DataFrame:
    """(doc_id, top_topic, topic_probabilities) with topics in order of ranks; the first of equal tops."""
    order = [r[0] for r in ranks.orderBy("rank").select("z").collect()]  # a row a topic
    p = F.array(*[F.col("p")[z] for z in order])
    return model.p_zd.select("doc_id", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("top_topic"), p.alias("topic_probabilities"))
