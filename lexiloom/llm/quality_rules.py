"""Quality rules, native: figures of each text, and lines that too many documents of a host share.

Lines are hashed after lower-casing, trimming and collapsing white space. For each host (source) the distinct documents
that hold a line are counted; copies of one text count as one document, so a copied clean text is left to deduplication.
A line is above the limits when it is in more than `min_docs` documents and in more than `max_share` of the host's
distinct documents, or in more than `max_docs` documents of a host of any size. Such lines are removed from the text, and a
document that keeps less than `min_left` of its words (half: most of it is boilerplate) is rejected; so is one that fails the base rules. Figures and base
rules are about the text as it came.

Null and empty texts: all figures 0, base_failed. Null hosts are one host of their own. Rows are told apart by a row
number of this operator's written table, so repeated ids and rows are each judged; empty tables give empty results.
`quality_filter` judges rows where they lie as long as the frequent lines are few, which is checked, and joins verdicts else."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, dropped, fresh, n_words_of, text_or_empty, trimmed, words_of, written

WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def figures(df: DataFrame, text: str) -> DataFrame:
    """df with FIGURES and with `lines`: hash and number of words of every line that has a word. Steps are columns of
    their own, so that no array is computed again for each element of another."""
    t = F.col(text)
    out = df.withColumns({"__words": words_of(t), "word_chars": F.length(F.regexp_replace(t, WS, "")).cast("long"), "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"), "__lines": lines_of(t)})
    out = out.withColumns({"n_words": F.coalesce(F.size("__words"), F.lit(0)).cast("long"), "__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    out = out.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    h = lambda i, k: F.col("__hashes")[i + k]
    out = out.withColumn("__windows", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[h(i, k) for k in range(WINDOW)]))))
    out = out.withColumn("__repeats", F.size("__windows") > F.size(F.array_distinct("__windows")))
    out = out.withColumn("__sorted", F.when(F.col("__repeats"), F.array_sort(F.arrays_zip(F.col("__windows").alias("h"), F.sequence(F.lit(0), F.size("__windows") - 1).alias("i")))))
    same = lambda i, j: F.coalesce(F.get(F.col("__sorted"), j)["h"] == F.get(F.col("__sorted"), i)["h"], F.lit(False))
    at = F.sequence(F.lit(0), F.size("__sorted") - 1)
    out = out.withColumn("__at", F.when(F.col("__repeats"), F.array_sort(F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.col("__sorted")[i]["i"]))))
    # A repeated window covers WINDOW words, less what the next one covers too.
    covered = F.aggregate(F.zip_with(F.col("__at"), F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.when(F.col("__repeats"), covered).otherwise(0).cast("long"))
    out = out.withColumn("lines", hashed("__lines"))
    return out.drop("__words", "__hashes", "__lines", "__windows", "__repeats", "__sorted", "__at")


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def hashed(lines: str) -> Column:
    return F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), n_words_of(x).cast("int").alias("w")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(trimmed(line), WS, " ")))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Limits:
    """Of lines: share of a host's distinct documents together with a number of them, and a number that is too many for a
    host of any size. Of documents: the share of words that must be left."""

    max_share: float = 0.1
    min_docs: int = 5
    max_docs: int = 10_000
    min_left: float = 0.5


def depleted(limits: Limits) -> Column:
    return F.col("n_words") - F.col("lost_words") < limits.min_left * F.col("n_words")


def frequent_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """host and h of the lines above the limits, from rows of host, text_hash and lines. Counts are folded before every
    shuffle, so a line that all documents hold sends one row a task."""
    hosts = rows.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = rows.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > limits.min_docs)
    above = (F.col("docs") > limits.max_share * F.col("host_docs")) | (F.col("docs") > limits.max_docs)
    return counts.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).where(above).select("host", "h")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row a document: doc_id, host, text_hash, FIGURES, lost_words, gone (hashes of its removed lines, null for none),
    base_failed, kept."""
    slim = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), text_or_empty(text_col).alias("__text"))
    rows = figures(slim.withColumn("text_hash", F.xxhash64("__text")), "__text").drop("__text").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "quality-figures")
    above = written(frequent_lines(rows, limits), "quality-lines").select(F.col("host").alias("__host"), F.col("h").alias("__h"))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    # A document's hashes are as many as its own lines at most.
    lost = lines.join(above, F.col("host").eqNullSafe(F.col("__host")) & (F.col("h") == F.col("__h"))).groupBy(F.col("row").alias("__row")).agg(F.sum("w").alias("lost_words"), F.collect_set("h").alias("gone"))
    judged = rows.drop("lines").join(lost, F.col("row") == F.col("__row"), "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted(limits)).select("doc_id", "host", "text_hash", *FIGURES, "lost_words", "gone", "base_failed", "kept")


#: Frequent lines of all hosts, and of one host, up to which executors hold them all (8 MB).
NEAR_LINES, NEAR_HOST = 1_000_000, 2_000


def quality_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: Limits = Limits(), near_lines: int = NEAR_LINES) -> DataFrame:
    """The rows of df that the rules keep, with all columns of df and texts without their removed lines. A host has few frequent
    lines: ten times the lines of its average document, and one for every `max_docs` lines. So all hosts' lines are counted
    first; up to `near_lines` (and `NEAR_HOST` of one host) they are broadcast and rows are judged where they lie. Beyond that,
    verdicts are made apart and joined with the rows."""
    text = text_or_empty(text_col)
    held = df.select(F.col(f"`{host_col}`").alias("host"), F.xxhash64(text).alias("text_hash"), lines_of(text).alias("__lines"))
    held = written(held.select("host", "text_hash", hashed("__lines").alias("lines")), "quality-held")
    above = written(frequent_lines(held, limits), "quality-lines")
    n, most = above.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    dropped(held)
    if n <= near_lines and most <= NEAR_HOST:
        return filtered_in_place(df, above, text_col, host_col, limits)
    dropped(above)
    return filtered_by_join(df, id_col, text_col, host_col, limits)


def without(text: Column, gone: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col(gone), line_hash(x))), "\n")


def filtered_in_place(df: DataFrame, above: DataFrame, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """quality_filter with the frequent lines (host, h) sent to executors; the caller has checked their number."""
    by_host = F.broadcast(above.groupBy(F.col("host").alias("__host")).agg(F.collect_set("h").alias("__above")))
    # A null text has no words and is never kept, so the text need not go along twice.
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != text_col.lower()])
    rows = df.select(others.alias("__row"), F.col(f"`{host_col}`").alias("__of"), text_or_empty(text_col).alias("__text"))
    rows = figures(rows.join(by_host, F.col("__of").eqNullSafe(F.col("__host")), "left"), "__text")
    hit = rows.withColumn("__hit", F.filter("lines", lambda x: F.coalesce(F.array_contains(F.col("__above"), x["h"]), F.lit(False))))
    hit = hit.withColumn("lost_words", F.aggregate("__hit", F.lit(0), lambda s, x: s + x["w"]))
    # A row number beside the figures keeps the filter above them; pushed down, it would hold every step's expression many times.
    kept = hit.withColumns({"__stays": ~base_failed() & ~depleted(limits), "__rid": F.monotonically_increasing_id()}).where("__stays AND __rid >= 0")
    left = F.when(F.size("__hit") > 0, without(F.col("__text"), "__above")).otherwise(F.col("__text"))
    return kept.select(*[left.alias(c) if c.lower() == text_col.lower() else F.col("__row")[c].alias(c) for c in df.columns])


def filtered_by_join(df: DataFrame, id_col: str, text_col: str, host_col: str, limits: Limits) -> DataFrame:
    """quality_filter for any number of frequent lines. What happens to a row hangs on host and text alone, so rows are matched
    by id, host and text."""
    a, b, c, stays, gone = (fresh(df, x) for x in ("__rid", "__rhost", "__rhash", "__stays", "__gone"))
    touched = quality_rules(df, id_col, text_col, host_col, limits).where(~F.col("kept") | F.col("gone").isNotNull())
    keyed = touched.groupBy(F.col("doc_id").alias(a), F.col("host").alias(b), F.col("text_hash").alias(c)).agg(F.first("kept").alias(stays), F.first("gone").alias(gone))
    keyed = written(keyed, "quality-touched")  # of known size: broadcast below Spark's threshold, else joined by a shuffle
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(a)) & F.col(f"`{host_col}`").eqNullSafe(F.col(b)) & (F.xxhash64(text_or_empty(text_col)) == F.col(c))
    text = F.col(f"`{text_col}`")
    out = df.join(keyed, same, "left").where(F.coalesce(F.col(stays), F.lit(True)))
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(without(text, gone))).select(*[F.col(f"`{x}`") for x in df.columns])
