"""Pairwise matches to groups: peel the giant component by breadth-first search from the node of highest degree, label
the small components that are left by minimum propagation.

Up to ``ONE_TASK`` pairs (checked by a count) this is done on arrays in one task. Beyond that the waves of the search are
joins. Chains make it slow then (one round per step), so the graph is contracted first: each node hooks to its smallest
neighbour and the hooks are followed, which divides the length of every path. The search then runs on the contracted
graph; should it still not end within ``WAVES`` rounds, what it has reached becomes one node and the graph is contracted
again. Text ids take part as 64-bit hashes, if no two of them share one
(which is checked), else as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.skew import salted_join
from vecloom.session import drop, pin

ONE_TASK = 2_000_000
HOOKS = 3
WAVES = 12


def pairs_of_lists(df: DataFrame, members: Column) -> DataFrame:
    """(a, b) that connect the members of each list: all with the smallest, so a list of n gives n - 1 pairs."""
    m = df.select(F.array_distinct(F.filter(members, lambda x: x.isNotNull())).alias("m")).where(F.size("m") > 1)
    return m.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where(F.col("a") != F.col("b"))


def _simple(pairs: DataFrame) -> DataFrame:
    p = pairs.where(F.col("a") != F.col("b"))
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest neighbour or itself, followed four steps."""
    m = edges.select("b", "a").unionByName(edges.select(F.col("a").alias("b"), "a"))
    m = pin(m.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    two = _move(m, m)
    four = pin(_move(two, two))
    drop(m)
    return four


def _relabel(edges: DataFrame, m: DataFrame) -> DataFrame:
    x, y = m.select(F.col("node").alias("xn"), F.col("label").alias("xl")), m.select(F.col("node").alias("yn"), F.col("label").alias("yl"))
    e = edges.join(x, F.col("a") == F.col("xn"), "left").select(F.coalesce("xl", "a").alias("a"), "b")
    e = e.join(y, F.col("b") == F.col("yn"), "left").select("a", F.coalesce("yl", "b").alias("b"))
    return _simple(e)


def _move(labels: DataFrame, m: DataFrame) -> DataFrame:
    o = m.select(F.col("node").alias("on"), F.col("label").alias("ol"))
    return labels.join(o, F.col("label") == F.col("on"), "left").select("node", F.coalesce("ol", "label").alias("label"))


def match_groups(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) to (id, group_id): one row per id that is linked to another; group_id is the group's smallest id.

    Repeated and reversed pairs, loops and pairs with a null count for nothing more. An empty table gives no rows.
    Hot nodes are safe: every step groups by node with partial aggregation or joins pairs with one row per node; names
    are joined to the members of a hot group by salted keys.
    """
    p = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    nodes = None
    if dict(p.dtypes)["a"] == "string":
        p = pin(p.distinct())
        nodes = pin(p.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("v", F.xxhash64("id")))
        if nodes.groupBy("v").count().where("count > 1").limit(1).count():
            nodes = None
    if nodes is None:
        labels = _labels(p).withColumnRenamed("node", "id")
    else:
        labels = _labels(p.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
        labels = pin(labels.join(nodes, F.col("node") == F.col("v")).select("id", "label"))
    low = labels.groupBy(F.col("label").alias("low")).agg(F.min("id").alias("group_id"))
    return salted_join(labels, low, "label", "low", "id", "inner").select("id", "group_id")


def _peel(t: pa.Table) -> pa.Table:
    """(node, label) of the pairs (a, b) of one task."""
    nodes, pos = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    n, m = len(nodes), t.num_rows
    i, j = np.concatenate([pos[:m], pos[m:]]), np.concatenate([pos[m:], pos[:m]])
    i, j = i[o := np.argsort(i, kind="stable")], j[o]
    start = np.searchsorted(i, np.arange(n + 1))
    count = np.diff(start)
    label = np.arange(n)
    met = np.zeros(n, bool)
    hub = int(count.argmax())  # ties: the smallest
    met[hub], wave = True, np.array([hub])
    while len(wave):
        c = count[wave]
        to = j[np.repeat(start[wave] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        wave = np.unique(to[~met[to]])
        met[wave] = True
    label[met] = hub
    rest = ~met[i]
    i, j = i[rest], j[rest]
    while len(i):
        now = label.copy()
        np.minimum.at(now, i, label[j])
        now = now[now]  # a label's own label may be smaller already
        if (now == label).all():
            break
        label = now
    return pa.table({"node": nodes, "label": nodes[label]})


def _labels(pairs: DataFrame) -> DataFrame:
    """(node, label) of all nodes: those of one component, and only those, share a label."""
    edges = pin(_simple(pairs))
    if dict(edges.dtypes)["a"] == "bigint" and edges.count() <= ONE_TASK:
        return pin(edges.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(lambda t: _peel(t), "node long, label long"))
    labels = pin(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    maps: list[DataFrame] = []

    def contract(e: DataFrame, rounds: int) -> DataFrame:
        for _ in range(rounds):
            maps.append(_hook(e))
            nxt = pin(_relabel(e, maps[-1]))
            drop(e)
            e = nxt
            if not e.limit(1).count():
                break
        return e

    edges = contract(edges, HOOKS)
    # the giant component
    while (seed := _hub(edges)) is not None:
        both = pin(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        waves = [pin(edges.sparkSession.createDataFrame([(seed,)], both.select("a").schema).withColumnRenamed("a", "v"))]
        ended = False
        for _ in range(WAVES):
            # in an undirected graph a wave leads back to itself and the one before only
            old = waves[-1] if len(waves) == 1 else waves[-1].unionByName(waves[-2])
            out = both.join(waves[-1].withColumnRenamed("v", "w"), F.col("a") == F.col("w"), "left_semi").select(F.col("b").alias("v")).distinct()
            nxt = pin(out.join(old, "v", "left_anti"))
            if not nxt.limit(1).count():
                ended = True
                break
            waves.append(nxt)
        met = waves[0]
        for w in waves[1:]:
            met = met.unionByName(w)
        maps.append(pin(met.select(F.col("v").alias("node"), F.lit(seed).alias("label"))))
        drop(both)
        if ended:  # the component goes
            edges = pin(edges.join(met.withColumnRenamed("v", "w"), F.col("a") == F.col("w"), "left_anti"))
            break
        edges = contract(pin(_relabel(edges, maps[-1])), 1)
    # the small ones: minimum propagation, with a shortcut through the label found
    both = pin(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = pin(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while state.limit(1).count():
        near = both.join(state, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("l"))
        s = state.join(near, F.col("node") == F.col("n"), "left").select("node", "label", F.least("label", F.coalesce("l", "label")).alias("now"))
        via = s.select(F.col("node").alias("vn"), F.col("now").alias("vl"))
        nxt = pin(s.join(via, F.col("now") == F.col("vn"), "left").select("node", F.least("now", F.coalesce("vl", "now")).alias("label"), (F.col("now") < F.col("label")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        drop(state)
        state = nxt.drop("moved")
        if not moved:
            break
    for k, m in enumerate([*maps, state]):
        labels = _move(labels, m)
        if k % 4 == 3:
            labels = pin(labels)
    return pin(labels)


def _hub(edges: DataFrame):
    """The node of highest degree (ties: the smallest), or None without edges."""
    d = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count().agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("x")).first()
    return None if d is None or d[0] is None else d[0]["v"]
