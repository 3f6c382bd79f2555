"""Language identification: features chosen by document frequency and information gain, and a naive Bayes model on them.

Documents are (doc_id, text, lang, domain). A tokenizer is a function from a text column to an array column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import dropped, written
from . import bytegrams
from .bytegrams import ByteGrams

Tokenizer = Callable[[Column], Column]
#: Lengths of terms that are sorted one by one.
MAX_ORDERS = 16


def byte_ngrams(orders: tuple[int, ...] = (1, 2, 3, 4), least: int | None = None) -> ByteGrams:
    """All n-grams of bytes as upper-case hexadecimal; texts shorter than the largest order less one have none."""
    return ByteGrams(tuple(orders), (max(orders) - 1) if least is None else least)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def corpus(df: DataFrame, lang: str = "lang", domain: str = "source", proportion: float = 1.0, seed: int = 1, langs: list[str] | None = None, domains: list[str] | None = None) -> DataFrame:
    out = df.select("doc_id", "text", F.col(lang).alias("lang"), F.col(domain).alias("domain"))
    if langs:
        out = out.where(F.col("lang").isin(langs))
    if domains:
        out = out.where(F.col("domain").isin(domains))
    return out.sample(proportion, seed) if proportion < 1 else out


def min_domain_langs(docs: DataFrame, least: int = 1) -> DataFrame:
    """Languages found in at least so many domains."""
    return docs.groupBy("lang").agg(F.countDistinct("domain").alias("domains")).where(F.col("domains") >= least)


def presence(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, lang, domain, term), each term once a document; distinct in its own row, without a shuffle."""
    return docs.select("doc_id", "lang", "domain", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("term"))


def cells(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(lang, domain, term, df): documents with a term by language and domain. Everything that selection asks for is a sum of these."""
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.totals(docs, tokenizer, ("lang", "domain"), distinct=True).withColumnRenamed("n", "df")
    return presence(docs, tokenizer).groupBy("lang", "domain", "term").agg(F.count("*").alias("df"))


def group_df(docs: DataFrame, tokenizer: Tokenizer, by: str) -> DataFrame:
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.totals(docs, tokenizer, (by,), distinct=True).select("term", by, F.col("n").alias("df"))
    return presence(docs, tokenizer).groupBy("term", by).agg(F.count("*").alias("df"))


def term_df(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.totals(docs, tokenizer, distinct=True).withColumnRenamed("n", "df")
    return presence(docs, tokenizer).groupBy("term").agg(F.count("*").alias("df"))


def term_totals(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(term, n): all occurrences."""
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.totals(docs, tokenizer)
    return docs.select(F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def select_df(dfs: DataFrame, per_order: int = 15000, unit: int = 1) -> DataFrame:
    """The per_order terms of highest document frequency of each length (in `unit` characters). Each order is a sort with a
    limit, which every task cuts for itself; lengths beyond MAX_ORDERS, as words may have, are ranked by a window."""
    found = written(dfs.withColumn("order", (F.length("term") / unit).cast("int")), "df-orders")
    orders = [r[0] for r in found.select("order").distinct().limit(MAX_ORDERS + 1).collect()]
    if len(orders) > MAX_ORDERS:
        ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("order").orderBy(F.desc("df"), "term")))
        return ranked.where(F.col("r") <= per_order).select("order", "term", "df")
    out = found.limit(0)
    for k in orders:
        out = out.unionByName(found.where(F.col("order") == k).orderBy(F.desc("df"), "term").limit(per_order))
    return out.select("order", "term", "df")


def select_df_overall(dfs: DataFrame, n: int) -> DataFrame:
    return dfs.orderBy(F.desc("df"), "term").limit(n)


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def information_gain(by_group: DataFrame, dist: DataFrame, by: str) -> DataFrame:
    """(term, ig): entropy of the groups less what is left of it when a term's presence is known. by_group has (term, by,
    df), dist (by, n)."""
    total = dist.agg(F.sum("n").cast("double").alias("total"), (F.log(F.sum("n")) - F.sum(_plogp(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    x = by_group.join(dist, by)
    rest = F.col("n") - F.col("df")
    # Groups without the term add n ln n to the absent side: the whole sum less that of the groups that have it.
    agg = x.groupBy("term").agg(F.sum("df").cast("double").alias("s1"), F.sum(_plogp(F.col("df").cast("double"))).alias("e1"), F.sum(_plogp(rest.cast("double"))).alias("e0"), F.sum(_plogp(F.col("n").cast("double"))).alias("had"))
    whole = dist.agg(F.sum(_plogp(F.col("n").cast("double"))).alias("all_e"))
    y = agg.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(whole))
    s1, s0 = F.col("s1"), F.col("total") - F.col("s1")
    absent = F.col("all_e") - F.col("had") + F.col("e0")
    h1 = F.when(s1 > 0, F.log(s1) - F.col("e1") / s1).otherwise(0.0)
    h0 = F.when(s0 > 0, F.log(s0) - absent / s0).otherwise(0.0)
    return y.select("term", (F.col("h") - (s1 * h1 + s0 * h0) / F.col("total")).alias("ig"))


def information_gain_each(by_group: DataFrame, dist: DataFrame, by: str) -> DataFrame:
    """(term, by, ig) of each group against the rest; groups are few and meet every term."""
    total = dist.agg(F.sum("n").cast("double").alias("total"))
    terms = by_group.groupBy("term").agg(F.sum("df").cast("double").alias("s1"), F.map_from_entries(F.collect_list(F.struct(by, F.col("df").cast("double")))).alias("m"))
    x = terms.crossJoin(F.broadcast(dist)).crossJoin(F.broadcast(total))
    a = F.coalesce(F.col("m")[F.col(by)], F.lit(0.0))
    n, t, s1 = F.col("n").cast("double"), F.col("total"), F.col("s1")
    h = lambda p, q: F.when(p + q > 0, F.log(p + q) - (_plogp(p) + _plogp(q)) / (p + q)).otherwise(0.0)
    ig = h(n, t - n) - (s1 * h(a, s1 - a) + (t - s1) * h(n - a, t - s1 - n + a)) / t
    return x.select("term", by, ig.alias("ig"))


def select_ld(ig_lang: DataFrame, ig_domain: DataFrame | None, per_lang: int = 300) -> DataFrame:
    """(lang, term, ld): for each language the per_lang terms whose gain on it most exceeds that on domains."""
    x = ig_lang.withColumn("ld", F.col("ig")) if ig_domain is None else ig_lang.join(ig_domain.withColumnRenamed("ig", "ig_domain"), "term").withColumn("ld", F.col("ig") - F.col("ig_domain"))
    x = x.withColumn("ld", F.round("ld", 9))  # equal gains are equal in whatever order they were summed
    ranked = x.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("ld"), "term")))
    return ranked.where(F.col("r") <= per_lang).select("lang", "term", "ld")


def scan(docs: DataFrame, features: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, term, n): occurrences of the features in each document, overlapping ones included."""
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.scan(docs, features, tokenizer)
    return docs.select("doc_id", F.explode(tokenizer(F.col("text"))).alias("term")).join(features.select("term").distinct(), "term").groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def feature_totals(docs: DataFrame, features: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(term, lang, n): occurrences of the features in each language."""
    if isinstance(tokenizer, ByteGrams):
        return bytegrams.scan_totals(docs, features, tokenizer, "lang")
    return docs.select("lang", F.explode(tokenizer(F.col("text"))).alias("term")).join(features.select("term").distinct(), "term").groupBy("term", "lang").agg(F.count("*").alias("n"))


def log_priors(docs: DataFrame) -> DataFrame:
    """(lang, log_pc): logarithm of each language's number of documents."""
    return docs.groupBy("lang").agg(F.log(F.count("*").cast("double")).alias("log_pc"))


def log_likelihoods(seen: DataFrame, docs: DataFrame, features: DataFrame) -> DataFrame:
    """(term, lang, log_ptc): add-one estimates over all features and languages, from the features' totals; both sets are of
    a chosen size."""
    terms, langs = features.select("term").distinct(), docs.select("lang").distinct()
    full = terms.crossJoin(F.broadcast(langs)).join(seen, ["term", "lang"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    return full.join(F.broadcast(totals), "lang").select("term", "lang", (F.log(1.0 + F.col("n")) - F.log((F.col("v") + F.col("total")).cast("double"))).alias("log_ptc"))


@dataclass(frozen=True)
class LangidModel:
    log_pc: DataFrame
    log_ptc: DataFrame
    tokenizer: Tokenizer


def train(docs: DataFrame, tokenizer: Tokenizer | None = None, unit: int = 2, per_order: int = 15000, per_lang: int = 300, domain_ig: bool = True, least_domains: int = 1, df_feats: DataFrame | None = None, ld_feats: DataFrame | None = None) -> LangidModel:
    """The whole chain. Given features take the place of the selection by frequency or by gain; both at once are an error."""
    if df_feats is not None and ld_feats is not None:
        raise ValueError("give features of one kind only")
    tokenizer = tokenizer or byte_ngrams()
    docs = docs.join(min_domain_langs(docs, least_domains).select("lang"), "lang", "left_semi")
    if ld_feats is None:
        every = written(cells(docs, tokenizer), "langid-cells")
        chosen = df_feats if df_feats is not None else select_df(every.groupBy("term").agg(F.sum("df").alias("df")), per_order, unit)
        chosen = written(chosen.select("term"), "langid-df")
        seen = written(every.join(chosen, "term", "left_semi"), "langid-presence")
        dropped(every)
        by = lambda c: seen.groupBy("term", c).agg(F.sum("df").alias("df"))
        dist = lambda c: docs.groupBy(c).agg(F.count("*").alias("n"))
        ld_feats = select_ld(information_gain_each(by("lang"), dist("lang"), "lang"), information_gain(by("domain"), dist("domain"), "domain") if domain_ig else None, per_lang)
    features = written(ld_feats.select("term").distinct(), "langid-features")
    seen = written(feature_totals(docs, features, tokenizer), "langid-totals")
    return LangidModel(written(log_priors(docs), "langid-pc"), written(log_likelihoods(seen, docs, features), "langid-ptc"), tokenizer)


def save(model: LangidModel, path: str, orders: tuple[int, ...] | None = (1, 2, 3, 4)) -> None:
    """Writes a model's tables and what its tokenizer is: byte n-grams of these orders, or words (None)."""
    model.log_pc.write.mode("overwrite").parquet(f"{path}/log_pc")
    model.log_ptc.write.mode("overwrite").parquet(f"{path}/log_ptc")
    model.log_pc.sparkSession.createDataFrame([(list(orders or ()),)], "orders array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/tokenizer")


def load(spark: SparkSession, path: str) -> LangidModel:
    orders = tuple(spark.read.parquet(f"{path}/tokenizer").first()[0])
    return LangidModel(spark.read.parquet(f"{path}/log_pc"), spark.read.parquet(f"{path}/log_ptc"), byte_ngrams(orders) if orders else words)


def _grams(model: LangidModel) -> ByteGrams | None:
    if isinstance(model.tokenizer, ByteGrams) or model.tokenizer is words:
        return model.tokenizer if isinstance(model.tokenizer, ByteGrams) else None
    raise ValueError("a model scores with byte n-grams or with words")


def scores(docs: DataFrame, model: LangidModel) -> DataFrame:
    """(doc_id, lang, score) of every language, also for documents without features."""
    w = bytegrams.weights(model.log_pc, model.log_ptc)
    found = bytegrams.with_scores(docs.select("doc_id", "text"), w, _grams(model), best=None, scores="s")
    langs = F.array(*map(F.lit, w.classes)) if w.classes else F.lit(None).cast("array<string>")
    return found.select("doc_id", F.inline(F.arrays_zip(langs.alias("lang"), F.col("s").alias("score"))).alias("lang", "score"))


def with_language(df: DataFrame, model: LangidModel, text: str = "text", out: str = "lang") -> DataFrame:
    """df with the best language of each text, first in order among equals. One step without a shuffle, also on streams."""
    return bytegrams.with_scores(df, bytegrams.weights(model.log_pc, model.log_ptc), _grams(model), text, out)


def classify(docs: DataFrame, model: LangidModel) -> DataFrame:
    """(doc_id, lang): the best language, first in order among equals."""
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", "lang")


def rank(docs: DataFrame, model: LangidModel) -> DataFrame:
    """(doc_id, lang, score, rank): all languages of a document in order, sorted in its own row."""
    w = bytegrams.weights(model.log_pc, model.log_ptc)
    found = bytegrams.with_scores(docs.select("doc_id", "text"), w, _grams(model), best=None, scores="s")
    langs = F.array(*map(F.lit, w.classes)) if w.classes else F.lit(None).cast("array<string>")
    order = F.array_sort(F.zip_with(langs, "s", lambda lang, s: F.struct((-s).alias("less"), lang.alias("lang"))))
    return found.select("doc_id", F.posexplode(order).alias("i", "x")).select("doc_id", F.col("x.lang").alias("lang"), (-F.col("x.less")).alias("score"), (F.col("i") + 1).cast("int").alias("rank"))


def softmax_ptc(log_ptc: DataFrame) -> DataFrame:
    totals = log_ptc.groupBy("lang").agg(F.sum(F.exp("log_ptc")).alias("s"))
    return log_ptc.join(F.broadcast(totals), "lang").select("term", "lang", (F.exp("log_ptc") / F.col("s")).alias("p"))


def blacklist_weights(p: DataFrame, normalize: bool = True) -> DataFrame:
    """(term, lang_a, lang_b, weight): difference of two languages' probabilities, over the sum of all."""
    by_term = p.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("lang", "p"))).alias("all"), F.sum("p").alias("s"))  # a struct a language
    a = by_term.select("term", "all", "s", F.posexplode("all").alias("i", "a"))
    b = a.select("term", "s", "i", "a", F.posexplode("all").alias("j", "b")).where("i < j")
    diff = F.abs(F.col("a.p") - F.col("b.p"))
    return b.select("term", F.col("a.lang").alias("lang_a"), F.col("b.lang").alias("lang_b"), (diff / F.col("s") if normalize else diff).alias("weight"))


def feature_weights(features: DataFrame, tables: dict[str, DataFrame], unit: int = 1) -> DataFrame:
    """features (term) with one column a table (term, value) and their length; missing values stay null."""
    out = features.select("term", (F.length("term") / unit).cast("int").alias("len"))
    for name, t in tables.items():
        out = out.join(t.select("term", F.col("value").alias(name)), "term", "left")
    return out
