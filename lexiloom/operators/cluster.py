"""Clustering: spherical k-means over documents, and trees over small distance matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import dropped, written
from . import plsa


def seed_labels(docs: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k documents, the first by a seeded hash, as clusters 0 to k - 1: (doc_id, z). Fewer documents than k are an error."""
    first = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(k).withColumn("z", F.row_number().over(Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")) - 1)
    first = written(first, "seeds")
    if first.count() < k:
        raise ValueError("fewer documents than clusters")
    return first


def centroids(sums: DataFrame, weights: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(term, p) from label sums, written: counts times weight, of length one, times weight again, so counts need no weights; and
    one more than the last cluster that has any. Lengths are one row; terms without a weight take no part."""
    v = written(sums.join(weights.select("term", "weight"), "term").select("term", "weight", F.transform("p", lambda c: c * F.col("weight")).alias("v")), "kmeans-sums")
    norms = [math.sqrt(x or 0.0) for x in v.agg(*[F.sum(F.col("v")[i] * F.col("v")[i]) for i in range(k)]).first()]
    scale = [1.0 / x if x > 0 else 0.0 for x in norms]
    centres = written(v.select("term", F.array(*[F.col("v")[i] * F.lit(scale[i]) * F.col("weight") for i in range(k)]).alias("p")), "kmeans-centres")
    dropped(v)
    return centres, max((i + 1 for i in range(k) if norms[i] > 0), default=1)


def assign(blocks: DataFrame, centres: DataFrame, used: int, k: int, state: DataFrame) -> DataFrame:
    """One pass: each document's nearest cluster among the first `used` (scores to 9 places, the smallest among equals; without
    terms of any centre 0), and the label sums that this gives. A block is a row (docs, z, state for the next pass, documents
    that changed) and a row for each part of its terms. state: rows a document in `docs`, and its cluster before."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in plsa._blocks(batches, k, 2):
            z = np.zeros(len(x.docs), np.int64)
            sums = np.zeros(len(x.terms) * k)
            for a, b in plsa._slices(x.first):
                at, c = x.place[x.first[a] : x.first[b]], x.cnt[x.first[a] : x.first[b]]
                scores = np.add.reduceat(x.pw[at, :used] * c[:, None], x.first[a:b] - x.first[a], axis=0)
                z[a:b] = np.round(scores, 9).argmax(1)
                lengths = np.diff(x.first[a : b + 1])
                sums += np.bincount(at * k + np.repeat(z[a:b], lengths), weights=c * np.repeat(x.pd[a:b, 0], lengths), minlength=len(sums))
            sums = sums.reshape(-1, k)
            part, terms, p = plsa._by_part(x.terms, x.ends, sums)
            changed = int(((x.pd[:, 1] != z + 1) & (x.pd[:, 0] > 0)).sum())
            after = pa.array(np.stack([x.pd[:, 0], z + 1.0], 1).reshape(-1))
            m, list_of = len(part), lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            yield pa.RecordBatch.from_arrays([
                pa.array([x.block] + [None] * m, pa.int64()), pa.concat_arrays([pa.nulls(1, pa.int32()), part]), pa.concat_arrays([pa.nulls(1, terms.type), terms]), pa.concat_arrays([list_of(after), p]),
                pa.concat_arrays([list_of(x.docs), pa.nulls(m, pa.list_(x.docs.type))]), pa.concat_arrays([list_of(pa.array(z.astype(np.int32))), pa.nulls(m, pa.list_(pa.int32()))]), pa.array([changed] + [None] * m, pa.int64()),
            ], names=["block", "term", "terms", "p", "docs", "z", "changed"])

    rows = plsa._rows(blocks, centres, None, state)
    return written(rows.mapInArrow(step, f"block long, term int, terms array<string>, p array<double>, docs array<{kind}>, z array<int>, changed long"), "kmeans")


def kmeans(counts: DataFrame | None, weights: DataFrame, docs: DataFrame, k: int, max_iter: int = 20, seed: int = 1, start: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(doc_id, z) when no label changes any more, or after max_iter rounds. Empty clusters drop out. Counts are packed once, or
    come as blocks; a round is one pass over them, which labels their documents and adds up the sums of the next round."""
    own = blocks if blocks is not None else plsa.packed(counts)
    known = own.select(F.explode("docs").alias("doc_id"))
    labels = start if start is not None else seed_labels(docs.join(known, "doc_id", "left_semi"), k, seed)
    k = max(k, (labels.agg(F.max("z")).first()[0] or 0) + 1)
    sums = plsa.label_sums(own, labels, k)
    # Rows a document in docs, and no cluster yet (clusters count from 1 here).
    rows = docs.groupBy("doc_id").agg(F.count("*").cast("double").alias("n")).select("doc_id", F.array("n", F.lit(0.0)).alias("p"))
    state = own.select("block", F.posexplode("docs").alias("at", "doc_id")).join(rows, "doc_id").select("block", "at", "p")
    found = None
    for _ in range(max_iter):
        centres, used = centroids(sums, weights, k)
        before, found = found, assign(own, centres, used, k, state)
        dropped(centres, *([before] if before is not None else []))
        if found.agg(F.sum("changed")).first()[0] in (None, 0):
            break
        sums = plsa.summed(found.where("term IS NOT NULL").select("term", "terms", "p"), k)
        state = found.where("block IS NOT NULL").select("block", F.lit(0).alias("at"), "p")
    if found is not None:
        best = found.where("block IS NOT NULL").select(F.explode(F.arrays_zip("docs", "z")).alias("x")).select(F.col("x.docs").alias("doc_id"), F.col("x.z").alias("best"))
        labels = written(docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("best", F.lit(0)).cast("int").alias("z")), "kmeans-labels")
        dropped(found)
    dropped(*([own] if blocks is None else []))
    return labels


@dataclass
class Node:
    node: int
    left: int
    right: int
    height: float
    leaves: int


LINKAGES = ("max", "min", "avg", "tot")
#: Items that one tree is grown over at most; its matrix is held in memory.
MAX_ITEMS = 4000


def grow_tree(matrix: np.ndarray, linkage: str = "max") -> list[Node]:
    """Leaves 0 to n - 1, then one node a merge of the closest two clusters; ties go to the lowest numbers. `avg` and `tot`
    are the mean and sum over all pairs of the union, pairs inside either part included; a tot node's height is ln(1 + d)."""
    n = len(matrix)
    if n > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    nodes = [Node(i, -1, -1, 0.0, 1) for i in range(n)]
    between, inside = matrix.astype(float).copy(), np.zeros(n)
    at, size = list(range(n)), np.ones(n)
    near = matrix.astype(float).copy()
    np.fill_diagonal(near, np.inf)
    alive = np.ones(n, bool)
    for _ in range(n - 1):
        flat = int(np.argmin(near))
        i, j = sorted(divmod(flat, n))
        d = near[i, j]
        nodes.append(Node(len(nodes), at[i], at[j], math.log1p(d) if linkage == "tot" else float(d), nodes[at[i]].leaves + nodes[at[j]].leaves))
        at[i], alive[j] = len(nodes) - 1, False
        inside[i] += inside[j] + between[i, j]
        if linkage == "max":
            between[i] = np.maximum(between[i], between[j])
        elif linkage == "min":
            between[i] = np.minimum(between[i], between[j])
        else:
            between[i] = between[i] + between[j]
        between[:, i] = between[i]
        size[i] += size[j]
        others = np.flatnonzero(alive)
        others = others[others != i]
        if linkage in ("max", "min"):
            new = between[i, others]
        else:
            total = between[i, others] + inside[i] + inside[others]
            union = size[i] + size[others]
            new = total / (union * (union - 1) / 2) if linkage == "avg" else total
        near[j], near[:, j] = np.inf, np.inf
        near[i, others] = near[others, i] = new
    return nodes


def matrix_of(distances: DataFrame, n: int) -> np.ndarray:
    """A small distance table (i, j, value) as a matrix; its size is checked first. Trees are for the topics of a model."""
    if n > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    out = np.zeros((n, n))
    for i, j, v in distances.select("i", "j", "value").collect():
        out[i, j] = out[j, i] = v
    return out


def cut(nodes: list[Node], n_clusters: int) -> list[int]:
    """Cluster numbers of the leaves below the n-th largest height, in order from left to right. Equal heights at the cut
    give more clusters; as many clusters as leaves or more leave each its own, one or fewer give a single cluster."""
    leaves = (len(nodes) + 1) // 2
    if n_clusters >= leaves:
        return list(range(leaves))
    if n_clusters <= 1:
        return [0] * leaves
    heights = sorted((x.height for x in nodes[leaves:]), reverse=True)
    limit = heights[n_clusters - 2]
    out, label = [0] * leaves, 0
    todo = [len(nodes) - 1]
    while todo:
        node = nodes[todo.pop()]
        if node.leaves > 1 and node.height >= limit:
            todo += [node.right, node.left]
            continue
        for leaf in leaves_of(nodes, node.node):
            out[leaf] = label
        label += 1
    return out


def leaves_of(nodes: list[Node], node: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = nodes[todo.pop()]
        if x.left < 0:
            out.append(x.node)
        else:
            todo += [x.right, x.left]
    return out


def node_score(node: Node) -> float:
    return 0.0 if node.leaves == 1 else math.log(node.leaves) * (1 - node.height)


def best_nodes(nodes: list[Node], too_high: float = 0.9) -> set[int]:
    """From the top: a node above too_high gives way to its children; else it is taken if it scores above both of them."""
    out: set[int] = set()
    todo = [len(nodes) - 1]
    while todo:
        x = nodes[todo.pop()]
        if x.left < 0:
            out.add(x.node)
        elif x.height <= too_high and node_score(x) > max(node_score(nodes[x.left]), node_score(nodes[x.right])):
            out.add(x.node)
        else:
            todo += [x.left, x.right]
    return out


def top_nodes(nodes: list[Node], n: int) -> set[int]:
    """Inner nodes with a height above or at the n-th largest."""
    leaves = (len(nodes) + 1) // 2
    heights = sorted((x.height for x in nodes[leaves:]), reverse=True)
    return {x.node for x in nodes[leaves:] if heights and x.height >= heights[min(n, len(heights)) - 1]}


def layout(nodes: list[Node]) -> dict[int, float]:
    """Horizontal places: leaves from left to right, inner nodes between their children."""
    x = {leaf: float(i) for i, leaf in enumerate(leaves_of(nodes, len(nodes) - 1))}
    for n in nodes[(len(nodes) + 1) // 2 :]:
        x[n.node] = (x[n.left] + x[n.right]) / 2
    return x


def tree_table(spark: SparkSession, nodes: list[Node], n_marked: int = 0) -> DataFrame:
    best, top, x = best_nodes(nodes), top_nodes(nodes, n_marked) if n_marked else set(), layout(nodes)
    rows = [(n.node, n.left, n.right, float(n.height), n.leaves, node_score(n), n.node in best, n.node in top, x[n.node]) for n in nodes]
    return spark.createDataFrame(rows, "node int, left int, right int, height double, leaves int, score double, best boolean, marked boolean, x double")


NODES = "node int, left int, right int, height double, leaves int"


def save_tree(spark: SparkSession, nodes: list[Node], path: str) -> None:
    spark.createDataFrame([(n.node, n.left, n.right, float(n.height), n.leaves) for n in nodes], NODES).write.mode("overwrite").parquet(path)


def load_tree(spark: SparkSession, path: str) -> list[Node]:
    """The nodes of a saved tree, which has twice MAX_ITEMS at most."""
    return [Node(*r) for r in spark.read.parquet(path).select("node", "left", "right", "height", "leaves").orderBy("node").collect()]


def scaled(nodes: list[Node]) -> list[Node]:
    """The tree with heights as shares of the largest; a tree without height stays as it is."""
    top = max((n.height for n in nodes), default=0.0)
    return [replace(n, height=n.height / top) for n in nodes] if top > 0 else list(nodes)


def sorted_heights(nodes: list[Node]) -> list[float]:
    """Heights of the inner nodes, the largest first."""
    return sorted((n.height for n in nodes[(len(nodes) + 1) // 2 :]), reverse=True)


def printed(nodes: list[Node], labels: list[str]) -> list[str]:
    """A line a node from the root down, indented by depth: an inner node's height and number of leaves, or a leaf's label,
    padded to the longest one, and its number."""
    if len(labels) != (len(nodes) + 1) // 2:
        raise ValueError("labels and leaves differ")
    width, out = max(map(len, labels), default=0), []
    todo = [(len(nodes) - 1, 0)] if nodes else []
    while todo:
        i, depth = todo.pop()
        n = nodes[i]
        out.append("  " * depth + (f"{labels[i]:<{width}} {i}" if n.left < 0 else f"{n.height:.4f} ({n.leaves})"))
        if n.left >= 0:
            todo += [(n.right, depth + 1), (n.left, depth + 1)]
    return out
