"""Collocations by vertical positional inverted lists: a phrase's list holds the places where it starts.

A block of documents holds one list a word and language. Lists of words that are frequent in the whole corpus are joined
with the lists of the adjacent word, place by place: two lists of k words whose places follow each other give the list of
a phrase of k + 1 words, since they overlap in the words between. Only lists of frequent phrases are joined, as a phrase is
never more frequent than its parts. Lists stay with their block; what goes through a shuffle is a length for each list, and
the sum of a phrase's lengths is its exact frequency. Phrases of different pieces, documents and languages never touch,
since a gap lies between them.

Null and empty texts have no words, a null language is `und`, a table without words gives an empty result. Ids are not
looked at, and rows that repeat count as often as they are there. Other columns and their names don't matter."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, dropped, text_or_empty, written

#: Bytes of text in a block, and bytes whose lists meet in one bucket, on average.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_FROM, _TO = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"
#: A-Z to a-z, a tab to a space, what ends a piece to a line feed.
SIMPLER = bytes.maketrans(_FROM, _TO)
#: Rounded down, and exact where products pass 64 bits.
SCORE = "(cast(a AS decimal(19,0)) * 2000000) div (cast(l AS decimal(19,0)) + r)"
#: Stands for the end of a piece; no word can be it.
GAP = b"."


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def word_lists(rows: DataFrame) -> DataFrame:
    """For each block and language of rows (lang, row, text): its words, how long each one's list is, and the lists, flat."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            known: dict[str, defaultdict[bytes, int]] = {}
            found: dict[str, list[np.ndarray]] = {}
            number: dict[str, int] = {}
            for lang, row, text in zip(batch.column("lang").to_pylist(), batch.column("row").to_pylist(), (x.as_py() for x in batch.column("text").cast(pa.binary())), strict=True):  # one text at a time
                if lang not in known:
                    known[lang] = defaultdict(count().__next__, {GAP: -1})  # refers to nothing of its own, so it goes at once
                    found[lang], number[lang] = [], row
                words = text.translate(SIMPLER).replace(b"\n", b" . ").split()
                words.append(GAP)
                found[lang].append(np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words)))
            for lang in list(known):
                d, ids = known.pop(lang), np.concatenate(found.pop(lang))
                order = np.argsort(ids, kind="stable").astype(np.int32)
                n = np.bincount(ids + 1, minlength=len(d))
                words = [w.decode() for w in d if w != GAP]
                del d, ids  # nothing but the lists is held while Spark reads them
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([number[lang]], pa.int64()), pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.string())), one(n[1:]), one(order[n[0] :])], names=["block", "lang", "words", "n", "at"])

    return rows.mapInArrow(index, "block long, lang string, words array<string>, n array<int>, at array<int>")


def one(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list array of one row."""
    kind = kind or pa.int32()
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def joined(local: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Lists of the pairs of kept lists (their places among all, and their ids) where the second starts one place after the
    first: ids of both, length, and the lists, flat. None if there is none."""
    lengths = n[local]
    places = at[ranges((np.cumsum(n) - n)[local], lengths)]
    of = np.full(int(places.max(initial=0)) + 2, -1, np.int32)
    of[places] = np.repeat(np.arange(len(local), dtype=np.int32), lengths)
    start = np.flatnonzero((of[:-1] >= 0) & (of[1:] >= 0))
    if not len(start):
        return None
    key = of[start].astype(np.int64) * len(local) + of[start + 1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    p, q = np.divmod(key[first], len(local))
    return ids[p], ids[q], np.diff(np.append(first, len(key))), start[order]


def shares(lists: DataFrame, buckets: int) -> DataFrame:
    """What blocks say of their lists' lengths, dealt by the list's name: words of a language, or pairs (p, q) of lists. A row
    is one block's share of a bucket, with the places of its lists among the block's."""
    worded = "words" in lists.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = row.column("n").flatten()
                keys = [row.column(c).flatten() for c in (("words",) if worded else ("p", "q"))]
                if worded:
                    of = np.fromiter((zlib.crc32(w) % buckets for w in keys[0].cast(pa.binary()).to_pylist()), np.int32, len(n))
                else:
                    p, q = (k.to_numpy().view(np.uint64) for k in keys)
                    of = ((p * np.uint64(0x9E3779B97F4A7C15) ^ q) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    at = order[cut[b] : cut[b + 1]]
                    parts = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), k.take(pa.array(at))) for k in keys]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), row.column("block"), *([row.column("lang")] if worded else []), *parts, one(n.to_numpy()[at]), one(at)], names=names)

    names = ["bucket", "block", *(["lang", "words"] if worded else ["p", "q"]), "n", "local"]
    kinds = "lang string, words array<string>" if worded else "p array<bigint>, q array<bigint>"
    return lists.drop("at").mapInArrow(deal, f"bucket int, block long, {kinds}, n array<int>, local array<int>")


def counted(dealt: DataFrame, least: int) -> DataFrame:
    """Exact frequencies. For each bucket of shares, sorted by bucket, a row with its frequent phrases (block is null): their
    names, f and ids; and for each share that has some of them a row with their places in the block, and their ids."""
    worded = "words" in dealt.columns
    kinds = [("words", pa.string())] if worded else [("p", pa.int64()), ("q", pa.int64())]

    def row(block: int | None, lang: str | None, local: np.ndarray | None, ids: np.ndarray, keys: list[pa.Array] | None, f: np.ndarray | None) -> pa.RecordBatch:
        cells = [one(local) if local is not None else pa.nulls(1, pa.list_(pa.int32())), one(ids, pa.int64())]
        cells += [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k) for k in keys] if keys else [pa.nulls(1, pa.list_(t)) for _, t in kinds]
        cells.append(one(f, pa.int64()) if f is not None else pa.nulls(1, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang], pa.string()), *cells], names=["block", "lang", "local", "ids", *(c for c, _ in kinds), "f"])

    def result(bucket: int, lang: str | None, held: list[pa.RecordBatch], seen: int) -> Iterator[pa.RecordBatch]:
        flat = lambda c: pa.concat_arrays([x.column(c).flatten() for x in held])
        n = flat("n").to_numpy()
        keys = [flat(c) for c, _ in kinds]
        if worded:
            coded = keys[0].dictionary_encode()
            of, names = coded.indices.to_numpy(), [coded.dictionary]
        else:
            p, q = (k.to_numpy() for k in keys)
            order = np.lexsort((q, p))
            new = np.concatenate([[True], (p[order][1:] != p[order][:-1]) | (q[order][1:] != q[order][:-1])])
            of = np.empty(len(p), np.int64)
            of[order] = np.cumsum(new) - 1
            names = [k.take(pa.array(order[new])) for k in keys]
        f = np.bincount(of, weights=n).astype(np.int64)  # below 2**53
        often = f >= least
        ids = np.where(often, (bucket << 32) + seen + np.cumsum(often) - 1, -1)
        at = np.flatnonzero(often)
        if not len(at):
            return
        yield row(None, lang, None, ids[at], [x.take(pa.array(at)) for x in names], f[at])
        start = 0
        for x in held:
            local = x.column("local").flatten().to_numpy()
            own = ids[of[start : start + len(local)]]
            start += len(local)
            if (own >= 0).any():
                yield row(x.column("block")[0].as_py(), None, local[own >= 0], own[own >= 0], None, None)

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, str | None] | None = None
        seen = 0  # ids that the bucket's other languages have
        for batch in batches:
            groups = zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist() if worded else [None] * batch.num_rows, strict=True)
            for i, group in enumerate(groups):
                if last is not None and group != last:
                    for out in result(*last, held, seen):
                        seen += len(out.column("f")[0]) if out.column("block").null_count else 0
                        yield out
                    held = []
                    seen = seen if group[0] == last[0] else 0
                last = group
                held.append(batch.slice(i, 1))
        if last is not None:
            yield from result(*last, held, seen)

    order = ["bucket", "lang"] if worded else ["bucket"]
    names = "words array<string>" if worded else "p array<bigint>, q array<bigint>"
    return dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(count_up, f"block long, lang string, local array<int>, ids array<bigint>, {names}, f array<bigint>")


def longer_lists(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """Lists of phrases one word longer, by block. kept (block, local, ids) names the frequent ones of a block's lists."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: int | None = None
        local: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for i, (block, kind) in enumerate(zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if block != last:
                    last, local, ids = block, [], []
                of = lambda c, i=i, batch=batch: batch.column(c)[i].values.to_numpy()
                if kind == 0:
                    local.append(of("local").copy())
                    ids.append(of("ids").copy())
                elif local:
                    made = joined(np.concatenate(local), np.concatenate(ids), of("n"), of("at"))
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), one(made[0], pa.int64()), one(made[1], pa.int64()), one(made[2]), one(made[3])], names=["block", "p", "q", "n", "at"])

    none = F.lit(None)
    heads = kept.select("block", F.lit(0).alias("kind"), "local", "ids", none.cast("array<int>").alias("n"), none.cast("array<int>").alias("at"))
    tails = lists.select("block", F.lit(1).alias("kind"), none.cast("array<int>").alias("local"), none.cast("array<bigint>").alias("ids"), "n", "at")
    return heads.unionByName(tails).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(extend, "block long, p array<bigint>, q array<bigint>, n array<int>, at array<int>")


def frequent(lists: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Names, f and ids of the phrases found at least so often in all blocks, and (block, local, ids) of their lists."""
    found = written(counted(shares(lists, buckets), least), "phrase-counts")
    whole = found.where(F.col("block").isNull())
    if "words" in found.columns:
        terms = whole.select("lang", F.inline(F.arrays_zip("ids", "words", "f"))).toDF("lang", "id", "word", "f")
    else:
        terms = whole.select(F.inline(F.arrays_zip("ids", "p", "q", "f"))).toDF("id", "p", "q", "f")
    return terms, found.where(F.col("block").isNotNull()).select("block", "local", "ids")


def phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of 1 to longest words found at least so often (words is their number, phrase their
    text), and (lang, n) with the number of word occurrences."""
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)  # a task's share does not grow with the input
    lists = written(word_lists(rows), "phrase-lists")
    sizes = lists.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    sizes = written(sizes, "phrase-sizes")
    terms, kept = frequent(lists, least, buckets)
    texts = terms.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    levels = [texts.select("lang", F.lit(1).alias("words"), "phrase", "f")]
    for k in range(2, longest + 1):
        made = written(longer_lists(lists, kept), "phrase-lists")
        dropped(lists)
        lists = made
        terms, kept = frequent(lists, least, buckets)
        first = texts.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("head"))
        then = texts.select(F.col("id").alias("q"), F.col("last"))
        texts = written(terms.join(first, "p").join(then, "q").select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f"), "phrase-texts")
        levels.append(texts.select("lang", F.lit(k).alias("words"), "phrase", "f"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, sizes


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two words or more: the lowest score of
    a phrase's cuts in two counts, and phrases that go on into one longer phrase in `inside` percent of cases are left out."""
    found, sizes = phrases(df, lang_col, text_col, longest, least)
    candidates = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = found.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = candidates.where("words > 2").select("lang", "f", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.expr(f"cast(longer AS decimal(19,0)) * 100 < cast(a AS decimal(19,0)) * {inside}"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # cut to `top` before the shuffle
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
