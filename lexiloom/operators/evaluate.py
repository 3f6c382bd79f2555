"""Agreement of topics with truth labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .plsa import Model, long


def checked_labels(model: Model, labels: DataFrame) -> DataFrame:
    """labels, if every document of the model has one and no other document has; else an error."""
    docs, named = model.p_zd.select("doc_id").withColumn("d", F.lit(1)), labels.select("doc_id").withColumn("l", F.lit(1))
    if not docs.join(named, "doc_id", "full").where("d IS NULL OR l IS NULL").isEmpty():
        raise ValueError("documents and labels differ")
    return labels


def joint_counts(model: Model, lengths: DataFrame, labels: DataFrame) -> DataFrame:
    """(z, label, n): words of documents by topic and label, from n_words and label by document."""
    docs = lengths.join(labels, "doc_id")
    return long(model.p_zd, "doc_id").join(docs, "doc_id").groupBy("z", "label").agg(F.sum(F.col("n_words") * F.col("p")).alias("n"))


def joint_docs(model: Model, labels: DataFrame) -> DataFrame:
    """(z, label, n) with every document weighing one."""
    return long(model.p_zd, "doc_id").join(labels, "doc_id").groupBy("z", "label").agg(F.sum("p").alias("n"))


def given(joint: DataFrame, by: str) -> DataFrame:
    """joint with p: shares among the rows of one value of `by`. A row a topic and label."""
    return joint.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def entropy(p):  # noqa: ANN001, ANN201
    """Sum of -p log2 p over positive p."""
    return F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def metrics(joint: DataFrame) -> DataFrame:
    """One row: entropies of labels and topics in bits, mutual information and what follows from them."""
    total = joint.agg(F.sum("n").alias("all"))
    p = joint.crossJoin(F.broadcast(total)).select("z", "label", (F.col("n") / F.col("all")).alias("p"))
    h = lambda cols, name: p.groupBy(*cols).agg(F.sum("p").alias("q")).agg(entropy(F.col("q")).alias(name))
    row = h(["z"], "h_z").crossJoin(h(["label"], "h_t")).crossJoin(h(["z", "label"], "h_zt")).withColumn("i", F.col("h_z") + F.col("h_t") - F.col("h_zt"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    i, hz, ht = F.col("i"), F.col("h_z"), F.col("h_t")
    return row.select("h_t", "h_z", "i", (ht - i).alias("h_t_given_z"), (hz - i).alias("h_z_given_t"), ratio(i, hz).alias("precision"), ratio(i, ht).alias("recall"), ratio(2 * i, hz + ht).alias("nmi"), ratio(2 * i - hz, ht).alias("ic"), ratio(ht + hz - 2 * i, ht).alias("eir"), F.sqrt(F.greatest(ratio(i, hz) * ratio(i, ht), F.lit(0.0))).alias("p_score"))


def label_purity(joint: DataFrame) -> DataFrame:
    """(z, purity): the share of the labels' entropy that knowing the topic takes away."""
    h_t = joint.groupBy("label").agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).agg(entropy(F.col("p")).alias("h_t"))
    h_tz = given(joint, "z").groupBy("z").agg(entropy(F.col("p")).alias("h"))
    return h_tz.crossJoin(F.broadcast(h_t)).select("z", ((F.col("h_t") - F.col("h")) / F.col("h_t")).alias("purity"))


def true_topics(joint: DataFrame, at_least: float = 0.075) -> DataFrame:
    """(z, line): a topic's best label and the others from at_least on, with shares in percent."""
    shares = given(joint, "z").withColumn("r", F.row_number().over(Window.partitionBy("z").orderBy(F.desc("p"), "label")))
    kept = shares.where((F.col("r") == 1) | (F.col("p") >= at_least))
    parts = F.array_sort(F.collect_list(F.struct("r", F.format_string("%s:%.1f", F.col("label").cast("string"), 100 * F.col("p")).alias("s"))))
    return kept.groupBy("z").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("line"))


def best_documents(model: Model, labels: DataFrame) -> DataFrame:
    """(label, z, doc_id): the document of highest P(z|d), the smallest id among equals."""
    return long(model.p_zd, "doc_id").join(labels, "doc_id").groupBy("label", "z").agg(F.min_by("doc_id", F.struct(-F.col("p"), F.col("doc_id"))).alias("doc_id"))


def compare_stems(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row on two sets of stems: hits, false alarms, misses, precision, recall, F and error ratio."""
    a, b = found.select("stem").distinct().withColumn("f", F.lit(1)), truth.select("stem").distinct().withColumn("t", F.lit(1))
    n = a.join(b, "stem", "full").agg(F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("hits"), F.sum(F.when(F.col("t").isNull(), 1).otherwise(0)).alias("false_alarms"), F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)).alias("misses"))
    h, fa, m = F.col("hits"), F.col("false_alarms"), F.col("misses")
    return n.select("hits", "false_alarms", "misses", (h / (h + fa)).alias("precision"), (h / (h + m)).alias("recall"), (2 * h / (2 * h + fa + m)).alias("f"), ((fa + m) / (h + m)).alias("error_ratio"))


def topic_naive_bayes(model: Model, counts: DataFrame, tau: float = 1.0) -> DataFrame:
    """(term, z, weight): ln P(w|z) / P(w|not z), from soft counts smoothed to each term's share of the corpus."""
    soft = counts.join(long(model.p_zd, "doc_id"), "doc_id").groupBy("term", "z").agg(F.sum(F.col("cnt") * F.col("p")).alias("c"), F.sum("cnt").alias("all"))
    totals = soft.groupBy("z").agg(F.sum("c").alias("cz"), F.sum("all").alias("n"), F.count("*").alias("v"))
    x = soft.join(F.broadcast(totals), "z")
    inside = (F.col("c") + tau) / (F.col("cz") + F.col("v") * tau)
    outside = (F.col("all") - F.col("c") + tau) / (F.col("n") - F.col("cz") + F.col("v") * tau)
    return x.select("term", "z", F.log(inside / outside).alias("weight"))


def linear_scores(vectors: DataFrame, weights: DataFrame, offsets: DataFrame | None = None, value: str = "cnt") -> DataFrame:
    """(doc_id, z, score): weighted sums of a document's values, plus the class's offset."""
    out = vectors.join(weights, "term").groupBy("doc_id", "z").agg(F.sum(F.col(value) * F.col("weight")).alias("score"))
    return out if offsets is None else out.join(F.broadcast(offsets), "z").withColumn("score", F.col("score") + F.col("offset")).drop("offset")
