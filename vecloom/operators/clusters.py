"""Single-linkage clusters at any threshold, from the minimum spanning tree.

Clusters at t are the components of the tree edges with weight < t (strictly, at every threshold); a cluster is named
by its smallest member. Larger thresholds coarsen smaller ones.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.blocks import labels
from vecloom.operators.graph import ONE_TASK, _one, components, spanning_forest
from vecloom.session import pin


def single_linkage(nodes: DataFrame, tree: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, cluster_id) for every node (column node)."""
    return components(nodes, tree.where(F.col("weight") < threshold)).select(F.col("node").alias("vec_id"), F.col("component").alias("cluster_id"))


def coarsen(clusters: DataFrame, tree: DataFrame, threshold: float) -> DataFrame:
    """Clusters at a larger threshold from those at a smaller one: components over the old clusters and the tree edges
    that cross them."""
    edges = crossing(clusters, tree).where(F.col("weight") < threshold)
    c = components(clusters.select(F.col("cluster_id").alias("node")), edges.select(F.col("src_cluster").alias("src"), F.col("dst_cluster").alias("dst")))
    return clusters.join(c, F.col("cluster_id") == F.col("node")).select("vec_id", F.col("component").alias("cluster_id"))


def crossing(clusters: DataFrame, tree: DataFrame) -> DataFrame:
    """Tree edges between clusters: (src, dst, weight, src_cluster, dst_cluster)."""
    a = clusters.select(F.col("vec_id").alias("src"), F.col("cluster_id").alias("src_cluster"))
    b = clusters.select(F.col("vec_id").alias("dst"), F.col("cluster_id").alias("dst_cluster"))
    return tree.select("src", "dst", "weight").join(a, "src").join(b, "dst").where("src_cluster <> dst_cluster")


def boundary(tree: DataFrame, threshold: float) -> DataFrame:
    """Edges that a cluster set keeps: tree edges with weight >= threshold."""
    return tree.where(F.col("weight") >= threshold).select("src", "dst", "weight")


def cluster_graph(clusters: DataFrame, tree: DataFrame) -> DataFrame:
    """(src_cluster, dst_cluster, weight): clusters joined by an edge, the lightest counts."""
    e = crossing(clusters, tree)
    return e.groupBy(F.least("src_cluster", "dst_cluster").alias("src_cluster"), F.greatest("src_cluster", "dst_cluster").alias("dst_cluster")).agg(F.min("weight").alias("weight"))


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def listing(clusters: DataFrame) -> DataFrame:
    """(cluster_id, members): sorted lists, for clusters small enough to show; read large ones as rows."""
    return clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def dendrogram(tree: DataFrame) -> DataFrame:
    """(step, weight, left, right, merged_into, size): every merge in order of weight; clusters are named by their
    smallest member. One pass over the tree's edges (n - 1 rows); the order of merges is inherently sequential."""

    def run(t: pa.Table) -> pa.Table:
        w, a, b = t["weight"].to_numpy(), t["src"].to_numpy(), t["dst"].to_numpy()
        o = np.lexsort((b, a, w))
        up: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(v: int) -> int:
            while up.setdefault(v, v) != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        rows = []
        for k, e in enumerate(o):
            x, y = sorted((root(int(a[e])), root(int(b[e]))))
            up[y] = x
            size[x] = size.get(x, 1) + size.get(y, 1)
            rows.append((k + 1, float(w[e]), x, y, x, size[x]))
        cols = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["step", "weight", "left", "right", "merged_into", "size"])

    return _one(tree.select("src", "dst", "weight")).groupBy("_g").applyInArrow(run, "step int, weight double, left long, right long, merged_into long, size long")


def hierarchy_counts(nodes: DataFrame, tree: DataFrame, thresholds: list[float], small: bool | None = None) -> DataFrame:
    """(threshold, n_clusters, largest) at each threshold. Up to ``ONE_TASK`` edges are read once, in the order of their
    weight; beyond that each threshold is built from the one before it."""
    cuts = sorted({float(t) for t in thresholds})
    if small is None:
        tree = pin(tree.select("src", "dst", "weight"))
        small = tree.count() <= ONE_TASK
    if small:
        n = nodes.select("node").distinct().count()

        def run(t: pa.Table) -> pa.Table:
            w = t["weight"].to_numpy()
            a, b = t["src"].to_numpy(), t["dst"].to_numpy()
            rows = []
            for c in cuts:
                m = w < c
                lab = labels(a[m], b[m])[1]
                size = np.unique(lab, return_counts=True)[1]
                rows.append((c, n - len(lab) + len(size), int(max(size.max(initial=0), min(n, 1)))))
            c, k, z = zip(*rows)
            return pa.table({"threshold": pa.array(c, pa.float64()), "n_clusters": pa.array(k, pa.int64()), "largest": pa.array(z, pa.int64())})

        none = tree.sparkSession.createDataFrame([(None, None, None)], "src long, dst long, weight double")  # a task even without edges
        every = tree.select("src", "dst", "weight").unionByName(none)
        return _one(every).groupBy("_g").applyInArrow(lambda t: run(t.drop_null()), "threshold double, n_clusters long, largest long")
    out, clusters = None, nodes.select(F.col("node").alias("vec_id"), F.col("node").alias("cluster_id"))
    for t in cuts:
        clusters = pin(coarsen(clusters, tree, t))
        row = sizes(clusters).agg(F.count(F.lit(1)).alias("n_clusters"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).select(F.lit(t).alias("threshold"), "n_clusters", "largest")
        out = row if out is None else out.unionByName(row)
    return out


def merge_step(clusters: DataFrame, a: int, b: int) -> DataFrame:
    """(vec_id, cluster_id) after the smaller of two clusters is absorbed by the larger (equal sizes: by the first).

    Unlike threshold clusters the result keeps the absorbing cluster's name. Raises when both are the same.
    """
    if a == b:
        raise ValueError("same cluster")
    n = {r[0]: r[1] for r in sizes(clusters.where(F.col("cluster_id").isin([a, b]))).collect()}
    into, gone = (a, b) if n.get(a, 0) >= n.get(b, 0) else (b, a)
    return clusters.select("vec_id", F.when(F.col("cluster_id") == gone, F.lit(into)).otherwise(F.col("cluster_id")).alias("cluster_id"))


class ClusterSets:
    """Cluster sets by threshold. A set that exists is kept; a new one is coarsened from the next smaller one."""

    def __init__(self, nodes: DataFrame, tree: DataFrame):
        self.nodes, self.tree = nodes, tree
        self.sets: dict[float, DataFrame] = {}

    def create(self, threshold: float) -> DataFrame:
        if threshold not in self.sets:
            below = [t for t in self.sets if t < threshold]
            c = coarsen(self.sets[max(below)], self.tree, threshold) if below else single_linkage(self.nodes, self.tree, threshold)
            self.sets[threshold] = pin(c)
        return self.sets[threshold]

    def get(self, threshold: float) -> DataFrame:
        if threshold not in self.sets:
            raise KeyError(threshold)
        return self.sets[threshold]

    def update(self, nodes: DataFrame, tree: DataFrame) -> None:
        """After inserts or deletes: every set follows from the current tree."""
        have = sorted(self.sets)
        self.nodes, self.tree, self.sets = nodes, tree, {}
        for t in have:
            self.create(t)


def nested(sets: list[DataFrame]) -> bool:
    """Whether each clustering (smaller thresholds first) refines the next one."""
    for a, b in pairwise(sets):
        j = a.select("vec_id", F.col("cluster_id").alias("x")).join(b.select("vec_id", F.col("cluster_id").alias("y")), "vec_id")
        if j.groupBy("x").agg(F.countDistinct("y").alias("n")).where("n > 1").limit(1).count():
            return False
    return True


def rebuild(edges: DataFrame) -> DataFrame:
    """The tree of any edge table, for clusters of graphs that are no tree."""
    return spanning_forest(edges)
