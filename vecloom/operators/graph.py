"""Undirected weighted graphs as edge tables (src < dst, weight): spanning forests, components, paths, edge reads.

Work that fits one task of bounded size (``ONE_TASK`` edges, checked by a count) runs there in a single pass; beyond
that the same result comes from rounds of joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.blocks import kruskal, labels
from vecloom.session import drop, pin

ONE_TASK = 2_000_000
EDGE = "src long, dst long, weight double"


def normal(edges: DataFrame) -> DataFrame:
    """src < dst, one row per pair (the lightest), no loops, no nulls."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("weight").isNotNull() & (F.col("src") != F.col("dst")))
    return e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_g", F.lit(0)).repartition(1)


def spanning_forest(edges: DataFrame, small: bool | None = None) -> DataFrame:
    """The minimum spanning forest, ties by (weight, src, dst). Empty input gives no rows."""
    edges = pin(normal(edges))
    if small is None:
        small = edges.count() <= ONE_TASK
    if small:
        def one(t: pa.Table) -> pa.Table:
            k = kruskal(t["src"].to_numpy(), t["dst"].to_numpy(), t["weight"].to_numpy())
            return t.select(["src", "dst", "weight"]).take(pa.array(np.sort(k)))

        return _one(edges).groupBy("_g").applyInArrow(one, EDGE)
    # Boruvka: the lightest edge of each component is in the forest; components hook along it and pointers double
    left = pin(edges.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    kept = None
    while left.limit(1).count():
        e = F.struct("weight", "src", "dst")
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("x"), e.alias("e"))
        best = pin(ends.groupBy(F.col("x.c").alias("c")).agg(F.min(F.struct("e", F.col("x.o").alias("o"))).alias("m")))
        picked = pin(best.select("m.e.src", "m.e.dst", "m.e.weight").distinct())
        kept = picked if kept is None else pin(kept.unionByName(picked))
        up = best.select("c", F.col("m.o").alias("p"))
        back = up.select(F.col("c").alias("bc"), F.col("p").alias("bp"))
        up = pin(up.join(back, F.col("p") == F.col("bc"), "left").select("c", F.when((F.col("bp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            o = up.select(F.col("c").alias("oc"), F.col("p").alias("op"))
            nxt = pin(up.join(o, F.col("p") == F.col("oc"), "left").select("c", F.coalesce("op", "p").alias("p"), (F.coalesce("op", "p") != F.col("p")).alias("moved")))
            moved = nxt.where("moved").limit(1).count()
            drop(up)
            up = nxt.drop("moved")
            if not moved:
                break
        ra, rb = up.select(F.col("c").alias("ca"), F.col("p").alias("pa")), up.select(F.col("c").alias("cb"), F.col("p").alias("pb"))
        nxt = left.join(ra, F.col("a") == F.col("ca"), "left").join(rb, F.col("b") == F.col("cb"), "left")
        nxt = pin(nxt.select("src", "dst", "weight", F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b"))
        drop(left)
        left = nxt
    return kept if kept is not None else edges


def components(nodes: DataFrame, edges: DataFrame, small: bool | None = None) -> DataFrame:
    """(node, component): component is its smallest node. ``nodes`` has one column node; isolated nodes name themselves."""
    edges = pin(edges.where("src <> dst").select("src", "dst"))
    if small is None:
        small = edges.count() <= ONE_TASK
    if small:
        def one(t: pa.Table) -> pa.Table:
            v, c = labels(t["src"].to_numpy(), t["dst"].to_numpy())
            return pa.table({"v": v.astype(np.int64), "component": c.astype(np.int64)})

        lab = _one(edges).groupBy("_g").applyInArrow(one, "v long, component long")
    else:
        both = pin(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        lab = pin(both.select(F.col("src").alias("v")).distinct().withColumn("component", F.col("v")))
        while True:
            c = lab.select(F.col("v").alias("cv"), F.col("component").alias("cc"))
            near = both.join(c, F.col("dst") == F.col("cv")).groupBy(F.col("src").alias("nv")).agg(F.min("cc").alias("nc"))
            n = lab.join(near, F.col("v") == F.col("nv"), "left").select("v", "component", F.least("component", F.coalesce("nc", "component")).alias("now"))
            # the label's own label may be smaller already: follow it
            j = n.select(F.col("v").alias("jv"), F.col("now").alias("jn"))
            nxt = pin(n.join(j, F.col("now") == F.col("jv"), "left").select("v", F.least("now", F.coalesce("jn", "now")).alias("component"), (F.least("now", F.coalesce("jn", "now")) < F.col("component")).alias("moved")))
            moved = nxt.where("moved").limit(1).count()
            drop(lab)
            lab = nxt.drop("moved")
            if not moved:
                break
    return nodes.select("node").distinct().join(lab, F.col("node") == F.col("v"), "left").select("node", F.coalesce("component", "node").alias("component"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (a, b, weight)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))


def shortest(edges: DataFrame, start: int, hops: bool = False, small: bool | None = None) -> DataFrame:
    """(node, cost, previous) for every node reachable from ``start``: sums of weights, or hops. Ties: smaller previous.

    Small graphs are searched in one task; larger ones relax by joins on the frontier until no cost falls any more.
    Weights must not be negative. Raises KeyError when the start is no node.
    """
    e = pin(adjacency(edges).withColumn("weight", F.lit(1.0) if hops else F.col("weight")))
    if not e.where(F.col("a") == F.lit(start)).limit(1).count():
        raise KeyError(start)
    if small is None:
        small = e.count() <= 2 * ONE_TASK
    if small:
        return _one(e).groupBy("_g").applyInArrow(lambda t: _dijkstra(t, start), "node long, cost double, previous long")
    state = pin(e.sparkSession.createDataFrame([(start, 0.0, None)], "node long, cost double, previous long"))
    wave = state
    while True:
        step = wave.join(e, F.col("node") == F.col("a")).groupBy(F.col("b").alias("n")).agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("c"), F.col("node").alias("p"))).alias("m"))
        old = state.select(F.col("node").alias("on"), F.col("cost").alias("oc"), F.col("previous").alias("op"))
        same = (F.col("m.c") == F.col("oc")) & (F.col("m.p") < F.col("op"))
        better = F.col("on").isNull() | (F.col("m.c") < F.col("oc")) | same
        nxt = pin(step.join(old, F.col("n") == F.col("on"), "left").where(better).select(F.col("n").alias("node"), F.col("m.c").alias("cost"), F.col("m.p").alias("previous")))
        if not nxt.limit(1).count():
            return state
        new = pin(state.join(nxt.select("node"), "node", "left_anti").unionByName(nxt))
        drop(state), drop(wave)
        state, wave = new, nxt


def _dijkstra(t: pa.Table, start: int) -> pa.Table:
    import heapq

    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["weight"].to_pylist()):
        near.setdefault(a, []).append((b, w))
    cost, prev = {start: 0.0}, {start: None}
    heap, done = [(0.0, start)], set()
    while heap:
        c, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for b, w in near.get(v, ()):
            n = c + w
            if b not in cost or n < cost[b] or (n == cost[b] and b not in done and v < prev[b]):
                cost[b], prev[b] = n, v
                heapq.heappush(heap, (n, b))
    k = sorted(cost)
    return pa.table({"node": pa.array(k, pa.int64()), "cost": pa.array([cost[x] for x in k], pa.float64()), "previous": pa.array([prev[x] for x in k], pa.int64())})


def trail(edges: DataFrame, start: int, end: int, hops: bool = True) -> DataFrame:
    """(step, src, dst, weight): the path from start to end by fewest edges (or least weight), steps from 1.

    No rows when start = end or the end cannot be reached; KeyError when one of them is no node.
    """
    tree = shortest(edges, start, hops)
    if not adjacency(edges).where(F.col("a") == F.lit(end)).limit(1).count():
        raise KeyError(end)
    up = pin(tree.where(F.col("previous").isNotNull()).select(F.col("node").alias("v"), F.col("previous").alias("p")))
    # steps of the path by doubling pointers towards the start, so a long path takes few rounds
    on = pin(up.sparkSession.createDataFrame([(end,)], "v long").join(tree.select(F.col("node").alias("tn")), F.col("v") == F.col("tn"), "left_semi"))
    jump = up
    while True:
        more = on.join(jump, "v").select(F.col("p").alias("v")).join(on, "v", "left_anti")
        grown = pin(on.unionByName(more).distinct())
        same = grown.count() == on.count()
        on = grown
        j = jump.select(F.col("v").alias("jv"), F.col("p").alias("jp"))
        jump = pin(jump.join(j, F.col("p") == F.col("jv")).select("v", F.col("jp").alias("p")))
        if same and not jump.limit(1).count():
            break
    rank = tree.join(on.withColumnRenamed("v", "node"), "node").where(F.col("previous").isNotNull())
    w = F.least("node", "previous"), F.greatest("node", "previous")
    path = rank.select("cost", F.col("previous").alias("src"), F.col("node").alias("dst"), w[0].alias("lo"), w[1].alias("hi"))
    e = edges.select(F.least("src", "dst").alias("el"), F.greatest("src", "dst").alias("eh"), "weight").groupBy("el", "eh").agg(F.min("weight").alias("weight"))
    path = path.join(e, (F.col("lo") == F.col("el")) & (F.col("hi") == F.col("eh")))
    # hops count the steps; by weight the rows of the path are put in order
    step = F.col("cost").cast("int") if hops else F.row_number().over(Window.orderBy("cost", "dst"))
    return path.withColumn("step", step).select("step", "src", "dst", "weight")


def walk(edges: DataFrame, start: int, end: int, hops: bool = True) -> DataFrame:
    """(nodes, total): the path of ``trail`` as the list of its nodes and the sum of its weights; start alone and 0 if
    start = end, no row if the end cannot be reached."""
    t = trail(edges, start, end, hops)
    if start == end:
        return t.agg(F.array(F.lit(start).cast("long")).alias("nodes"), F.lit(0.0).alias("total"))
    steps = F.array_sort(F.collect_list(F.struct("step", "dst")))  # a path is what the caller asks for, as one row
    row = t.agg(F.count(F.lit(1)).alias("n"), steps.alias("s"), F.sum("weight").alias("total")).where("n > 0")
    return row.select(F.concat(F.array(F.lit(start).cast("long")), F.transform("s", lambda z: z["dst"])).alias("nodes"), "total")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of ``gone`` (src, dst), in either direction."""
    g = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges.join(g, ["src", "dst"], "left_anti")


def with_partitions(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """src_part and dst_part of each edge, derived from the membership (so a split or merge moves no edge)."""
    a = membership.select(F.col("vec_id").alias("src"), F.col("partition_id").alias("src_part"))
    b = membership.select(F.col("vec_id").alias("dst"), F.col("partition_id").alias("dst_part"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", "src_part", "dst_part")


def intra(edges: DataFrame) -> DataFrame:
    return edges.where("src_part = dst_part")


def inter(edges: DataFrame, partition: int | None = None) -> DataFrame:
    """Edges between partitions, or those of them that touch one partition."""
    e = edges.where("src_part <> dst_part")
    return e if partition is None else e.where((F.col("src_part") == partition) | (F.col("dst_part") == partition))


def extremes(edges: DataFrame, by: str) -> DataFrame:
    """Lightest and heaviest edge per value of ``by`` (ties: smaller ends): one aggregation."""
    e = lambda sign: F.struct((sign * F.col("weight")).alias("w"), "src", "dst", "weight")
    g = edges.groupBy(by).agg(F.min(e(1)).alias("lo"), F.min(e(-1)).alias("hi"))
    pick = lambda c, kind: g.select(by, F.lit(kind).alias("kind"), f"{c}.src", f"{c}.dst", f"{c}.weight")
    return pick("lo", "smallest").unionByName(pick("hi", "largest"))
