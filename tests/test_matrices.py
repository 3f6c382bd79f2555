"""Saved distance matrices and the trees' small tools."""

from __future__ import annotations

import numpy as np
import pytest

from lexiloom.operators import cluster, similarity


def test_distances_round_trip(spark, tmp_path):
    rows = [(i, j, abs(i - j) / 7) for i in range(5) for j in range(5)]
    matrix, labels = spark.createDataFrame(rows, "i int, j int, value double"), spark.createDataFrame([(i, f"item {i}") for i in range(5)], "i int, label string")
    path = str(tmp_path / "m")
    similarity.save_distances(matrix, labels, path)
    m, n = similarity.load_distances(spark, path)
    assert sorted(map(tuple, m.collect())) == rows and {r.i: r.label for r in n.collect()} == {i: f"item {i}" for i in range(5)}
    for bad_matrix, bad_labels, error in [
        (matrix.where("NOT (i = 2 AND j = 3)"), labels, "square"),
        (matrix.where("i < 4"), labels.where("i < 4"), "square"),
        (matrix, labels.where("i > 0"), "differ"),
        (matrix, labels.union(labels.limit(1)), "differ"),
        (matrix, labels.union(spark.createDataFrame([(9, "more")], labels.schema)), "differ"),
    ]:
        similarity.save_distances(bad_matrix, bad_labels, path)
        with pytest.raises(ValueError, match=error):
            similarity.load_distances(spark, path)
    similarity.save_distances(matrix.limit(0), labels.limit(0), path)
    assert similarity.load_distances(spark, path)[0].count() == 0


def test_tree_tools():
    tree = cluster.grow_tree(np.array([[0, 1, 4], [1, 0, 5], [4, 5, 0]], float), "avg")
    assert cluster.sorted_heights(tree) == [10 / 3, 1.0]
    assert [round(n.height, 6) for n in cluster.scaled(tree)] == [0, 0, 0, 0.3, 1]
    assert cluster.printed(tree, ["a", "bcd", "e"]) == ["3.3333 (3)", "  1.0000 (2)", "    a   0", "    bcd 1", "  e   2"]
    assert cluster.scaled(cluster.grow_tree(np.zeros((1, 1)))) == cluster.grow_tree(np.zeros((1, 1))) and cluster.printed(cluster.grow_tree(np.zeros((1, 1))), ["x"]) == ["x 0"]
    with pytest.raises(ValueError, match="differ"):
        cluster.printed(tree, ["a"])
