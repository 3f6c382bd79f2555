"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its weight's share of all words, at most `max_repeat` times its own words; the excess is shared again
by weight until none is above. A document is taken floor(target / source's words) times, and once more with the remaining
fraction as inclusion probability. Fractions become 0 or 1 by the cube method, balancing the words and the number of
documents: within a block of one source, a step moves the fractions of three documents along the null space of the two
constraints until one of them is whole (flight). At most two fractions of a block stay; they form the blocks of the next
round, so a source of any size shrinks several hundredfold a round. The last block of a source ends with the landing: of
the four ways to round two fractions, the one with the least imbalance, then exchanges of a taken document for another one
of the block, each the best there is, until none brings the words nearer to the target. The last fractions may belong to
long documents; the exchanges make up for these.

Sources in order of code points, null last. Null and empty texts have size 0 and are taken 0 words. Draws come from a
generator seeded by source and block, over documents from the longest to the shortest and by a hash of id, size and text,
so reruns agree. Rows that repeat an id stay rows of their own; rows alike in id and text, of which it does not matter which
one is taken, are dealt to blocks by their row number too, so that many of them fill many blocks. Empty tables give empty results; other columns and their names don't matter. The table of sources is held by
the driver and sent to executors only up to `max_sources` rows; beyond that the operator stops with an error."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, n_words_of, text_or_empty, written

BLOCK = 4000
WEIGHTS = (5.0, 2.0, 1.0)
EDGE = 1e-9
#: Exchanges of two documents in a landing at most; each one brings the words nearer.
EXCHANGES = 100


def targets(sizes: list[tuple[str | None, int]], weights: Iterable[float] = WEIGHTS, max_repeat: float = 3.0) -> dict[str | None, float]:
    """Words wanted of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    given = list(weights)
    weight = {s: given[i % len(given)] for i, (s, _) in enumerate(order)}
    top = {s: max_repeat * n for s, n in order}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(n for _, n in order)), [s for s, _ in order]
    while open_:
        per = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if per * weight[s] > top[s]]
        if not above:
            return out | {s: per * weight[s] for s in open_}
        for s in above:
            out[s] = top[s]
            left -= top[s]
        open_ = [s for s in open_ if s not in out]
    return out


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves fractions through the null space of (1, size) until at most two are left."""
    p = p.copy()
    held: list[int] = []
    for i in range(len(p)):
        if not EDGE < p[i] < 1 - EDGE:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) == 3:
            a, b, c = held
            # Orthogonal to the ones and to the sizes of the three; equal sizes leave any exchange of two documents.
            u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
            if not u.any():
                u[:] = (1, -1, 0)
            u /= np.abs(u).max()
            q = p[held]
            with np.errstate(divide="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
                down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
            q = q + u * up if rng.random() < down / (up + down) else q - u * down
            q = np.clip(q, 0, 1)
            if not ((q <= EDGE) | (q >= 1 - EDGE)).any():
                k = int(np.argmin(np.minimum(q, 1 - q)))
                q[k] = round(q[k])
            whole = (q <= EDGE) | (q >= 1 - EDGE)
            p[held] = np.where(whole, np.round(q), q)
            held = [j for j, w in zip(held, whole, strict=True) if not w]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last fractions (two at most) so that words, then documents, stay nearest to their expectation, and then
    exchanges a chosen for an unchosen document as long as that brings the words nearer."""
    at = np.flatnonzero((p > EDGE) & (p < 1 - EDGE))
    ways = [np.array([(w >> k) & 1 for k in range(len(at))], float) for w in range(1 << len(at))]
    best = min(ways, key=lambda x: (abs(float(((x - p[at]) * size[at]).sum())), abs(float((x - p[at]).sum()))))
    out = np.round(p)
    out[at] = best
    over = float(((best - p[at]) * size[at]).sum())
    for _ in range(EXCHANGES):
        chosen, others = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not over or not len(chosen) or not len(others):
            break
        others = others[np.argsort(size[others], kind="stable")]
        want = size[chosen] - over
        near = np.searchsorted(size[others], want)
        at = np.clip(np.stack([near - 1, near]), 0, len(others) - 1)
        gap = np.abs(size[others][at] - want)
        side, i = divmod(int(np.argmin(gap)), len(chosen))
        if gap[side, i] >= abs(over):
            break
        gone, come = chosen[i], others[at[side, i]]
        out[gone], out[come] = 0, 1
        over += size[come] - size[gone]
    return out


def cube(units: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """units (source_no, size, p, row and others) with p whole. Each round is a written table."""
    columns = units.columns
    schema = units.schema
    decided: list[DataFrame] = []
    open_ = units
    while True:
        # One row a source: the table's size has been checked by the caller.
        counts = open_.groupBy("source_no").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
        rounds = open_.join(F.broadcast(counts.drop("n")), "source_no").withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed + len(decided))), F.col("blocks")))

        def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "row"], ascending=False, kind="stable")  # the last fractions are small documents
            rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
            size = pdf["size"].to_numpy(float)
            p = fly(pdf["p"].to_numpy(float), size, rng)
            if pdf["blocks"].iloc[0] == 1:
                p = land(p, size)
            return pdf[columns].assign(p=p)

        done = written(rounds.groupBy("source_no", "block").applyInPandas(solve, schema), f"cube-{len(decided)}")
        decided.append(done.where((F.col("p") == 0) | (F.col("p") == 1)))
        open_ = done.where((F.col("p") > 0) & (F.col("p") < 1))
        if open_.isEmpty():
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Iterable[float] = WEIGHTS, max_repeat: float = 3.0, block: int = BLOCK, max_sources: int = 100_000) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    sized = sizes(df, id_col, text_col, source_col, F.monotonically_increasing_id())
    return mixed(spread(sized), weights, max_repeat, block, max_sources)


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, rid: Column) -> DataFrame:
    """doc_id, source, size, rid (row number) and row (a hash of id and text) as a written table."""
    text, doc = text_or_empty(text_col), F.col(f"`{id_col}`")
    return written(df.select(doc.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words_of(text).alias("size"), rid.alias("rid"), F.xxhash64(doc, text).alias("row")), "mix-sizes")


def spread(sized: DataFrame) -> DataFrame:
    """sized with the row number in the hash of rows that repeat; these are few, or else copies of few."""
    several = sized.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1").select("__row")
    told = sized.join(several, F.col("row") == F.col("__row"), "left")
    return told.withColumn("row", F.when(F.col("__row").isNull(), F.col("row")).otherwise(F.xxhash64("row", "rid"))).drop("__row", "rid")


def mixed(sized: DataFrame, weights: Iterable[float], max_repeat: float, block: int, max_sources: int) -> DataFrame:
    spark = sized.sparkSession
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    want = targets([(r[0], r[1]) for r in sources], weights, max_repeat)
    plan = []
    for i, (source, n) in enumerate(sorted(((r[0], r[1]) for r in sources), key=lambda x: (x[0] is None, x[0] or ""))):
        times = want[source] / n if n else 0.0
        whole = round(times) if abs(times - round(times)) < EDGE else int(times)
        plan.append((source, i, n, float(want[source]), whole, max(0.0, times - whole)))
    table = spark.createDataFrame(plan, "__source string, source_no int, source_size long, target double, whole int, p double")
    units = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    fractional = cube(units.where((F.col("p") > EDGE) & (F.col("size") > 0)), block)
    rest = units.where((F.col("p") <= EDGE) | (F.col("size") == 0)).withColumn("p", F.lit(0.0))
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return fractional.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: rows of df, each as often as it is taken, with all columns of df."""
    row, rid, copies = (fresh(df, c) for c in ("__row", "__rid", "__copies"))
    keyed = written(df.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    sized = sizes(keyed, id_col, text_col, source_col, F.col(row)).withColumn("doc_id", F.col("rid"))
    chosen = mixed(spread(sized), *(options.get(k, v) for k, v in (("weights", WEIGHTS), ("max_repeat", 3.0), ("block", BLOCK), ("max_sources", 100_000))))
    taken = chosen.where("copies > 0").select(F.col("doc_id").alias(rid), F.col("copies").alias(copies))
    out = keyed.join(taken, F.col(row) == F.col(rid))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in df.columns])
