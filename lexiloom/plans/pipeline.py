"""The whole analysis: messages in, topics out."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cluster, counts, evaluate, langid, plsa, summary, weights
from ..sources import files, readers
from ..sources.tables import written


@dataclass(frozen=True)
class Result:
    counts: DataFrame
    model: plsa.Model
    topics: DataFrame
    lines: DataFrame
    posteriors: DataFrame


def prepared(messages: DataFrame, lang_filter: str | None = None, lang: DataFrame | None = None, lang_model: langid.LangidModel | None = None) -> DataFrame:
    """Messages (doc_id, msg) with msg_norm and msg_topic; with a language filter only those that have that language by `lang`
    (doc_id, lang), or by the model where there is no such table."""
    out = messages.withColumn("msg_norm", text.normalize_text(F.col("msg")))
    if lang_filter and lang_filter != "none":
        if lang is None and lang_model is None:
            raise ValueError("a language filter needs languages, or a model that finds them")
        if lang is None:
            lang = langid.classify(out.select("doc_id", F.col("msg_norm").alias("text")), lang_model)
        out = out.join(lang.where(F.col("lang") == lang_filter).select("doc_id"), "doc_id", "left_semi")
    return out.withColumn("msg_topic", text.normalize_topic(F.col("msg_norm")))


def run(messages: DataFrame, options: plsa.Options | None = None, df_cutoff: float = 0.25, tf_cutoff: float = 3.0, seeds: str = "kmeans", seed: int = 1, stop: DataFrame | None = None, lang_filter: str | None = None, lang: DataFrame | None = None, lang_model: langid.LangidModel | None = None, truth: DataFrame | None = None) -> Result:
    """With truth (doc_id, label) the report's lines have label purities and true topics. Every document that has counts needs a
    label, and a label needs a message; otherwise it is an error."""
    options = options or plsa.Options()
    ready = prepared(messages, lang_filter, lang, lang_model)
    c = written(counts.term_counts(ready, text_col="msg_topic"), "counts")
    n, total = weights.corpus_totals(c)
    vocab = weights.learn_weights(counts.vocabulary(c, stop), n, total, df_cutoff=df_cutoff, tf_cutoff=tf_cutoff).where("weight > 0")
    kept = written(c.join(vocab.select("term", "weight"), "term"), "kept")
    docs = c.select("doc_id").distinct()
    rounds = {"kmeans": 20, "random": 1}[seeds]
    labels = cluster.kmeans(kept, kept.select("term", "weight").distinct(), docs, options.topics, rounds, seed)
    model = plsa.fit(kept.select("doc_id", "term", "cnt"), labels, options)
    topics = written(summary.summary(model), "topics")
    joint = None
    if truth is not None:
        silent = messages.select("doc_id").join(docs, "doc_id", "left_anti")  # messages without a word need no label
        joint = evaluate.joint_counts(model, counts.doc_lengths(c), evaluate.checked_labels(model, truth.join(silent, "doc_id", "left_anti")))
    return Result(c, model, topics, summary.summary_lines(topics, joint), summary.d2z(model, topics))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Topics of a file of tab-delimited messages")
    p.add_argument("input_file")
    p.add_argument("output_dir")
    p.add_argument("-r", "--reader", default="default", choices=sorted(readers.READERS))
    p.add_argument("-num_topics", type=int, default=50)
    p.add_argument("-tf_cutoff", type=float, default=3.0)
    p.add_argument("-df_cutoff", type=float, default=0.25)
    p.add_argument("-max_iter", type=int, default=500)
    p.add_argument("-alpha", type=float, default=0.001)
    p.add_argument("-beta", type=float, default=0.001)
    p.add_argument("-conv_threshold", type=float, default=0.001)
    p.add_argument("-seeds", default="kmeans", choices=["kmeans", "random"])
    p.add_argument("-seed", type=int, default=1)
    p.add_argument("-stop_list", help="file of words that are no features")
    p.add_argument("-lang_filter", default="none", help="language to keep")
    p.add_argument("-lang_model", help="folder of a saved language model, for -lang_filter")
    p.add_argument("-truth", help="file with an id and its label on each line, for label purities and true topics in the summary")
    p.add_argument("-lm_out", action="store_true", help="write the matrix of P(w|z) as one file")
    p.add_argument("-json_out", action="store_true", help="write topics and documents as one JSON document")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    messages = readers.read_messages(spark, a.input_file, a.reader).withColumnRenamed("id", "doc_id")
    options = plsa.Options(a.num_topics, a.alpha, a.beta, a.max_iter, a.conv_threshold)
    stop = readers.parse_feature_lines(spark.read.text(a.stop_list)).select("term") if a.stop_list else None
    model = langid.load(spark, a.lang_model) if a.lang_model else None
    truth = readers.parse_labelled_files(spark.read.text(a.truth)).select(F.col("path").alias("doc_id"), F.col("labels")[0].alias("label")) if a.truth else None
    got = run(messages, options, a.df_cutoff, a.tf_cutoff, a.seeds, a.seed, stop, a.lang_filter, lang_model=model, truth=truth)
    readers.counts_lines(got.counts).select("line").write.mode("overwrite").text(f"{a.output_dir}/counts")
    got.lines.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(f"{a.output_dir}/summary")
    if truth is not None:
        got.lines.orderBy("rank").select("true_topics").coalesce(1).write.mode("overwrite").text(f"{a.output_dir}/true_topics")
    if a.lm_out:
        files.write_lm_matrix(plsa.long(got.model.p_wz, "term"), a.num_topics, f"{a.output_dir}/lm")
    if a.json_out:
        files.write_topic_document(summary.package_topics(got.topics), summary.package_docs(got.model, got.topics), f"{a.output_dir}/topics.json")
    got.posteriors.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "line")).write.mode("overwrite").text(f"{a.output_dir}/d2z")
    plsa.save(got.model, f"{a.output_dir}/model")


if __name__ == "__main__":
    main()
