"""Capacity-bounded partitions: membership, metadata, neighbours, splits and merges.

Only the membership (vec_id, partition_id) is stored. The partition of an edge's ends is derived by a join, so a split
or a merge relabels members and moves no edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.blocks import rows_of
from vecloom.operators.graph import components, inter, with_partitions
from vecloom.session import drop, pin

CAPACITY = 64
ONE = 65_536  # vectors that one task divides alone
MAX_ITER = 128  # rounds of Lloyd per split
PIECES = 2_000_000  # trees and links between them that one task puts together
SIDES = "vec_id long, partition_id long, side int"


class Overflow(ValueError):
    """A merge would exceed the capacity."""


class NotConnected(ValueError):
    """No edge joins the two partitions."""


def assign(membership: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert of (vec_id, partition_id)."""
    return membership.join(changes.select("vec_id"), "vec_id", "left_anti").unionByName(changes.select("vec_id", "partition_id"))


def lookup(membership: DataFrame, ids: DataFrame) -> DataFrame:
    return membership.join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "partition_id")


def centroids(members: DataFrame) -> DataFrame:
    """(partition_id, centroid): mean per lane of members (partition_id, embedding). Partial sums per task first."""
    lanes = members.where(F.col("partition_id").isNotNull() & F.col("embedding").isNotNull()).select("partition_id", F.posexplode("embedding").alias("pos", "value"))
    mean = lanes.groupBy("partition_id", "pos").agg(F.avg(F.col("value").cast("double")).alias("m"))
    return mean.groupBy("partition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def meta(members: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(partition_id, size, centroid, min_edge, max_edge); edges (with src_part, dst_part) inside a partition count."""
    m = members.groupBy("partition_id").agg(F.count(F.lit(1)).alias("size")).join(centroids(members), "partition_id", "left")
    if edges is None:
        return m.withColumn("min_edge", F.lit(None).cast("double")).withColumn("max_edge", F.lit(None).cast("double"))
    e = edges.where("src_part = dst_part").groupBy(F.col("src_part").alias("partition_id")).agg(F.min("weight").alias("min_edge"), F.max("weight").alias("max_edge"))
    return m.join(e, "partition_id", "left")


def neighbours(edges: DataFrame) -> DataFrame:
    """(partition_id, neighbor_id): partitions joined by an edge, both ways; edges have src_part and dst_part."""
    e = inter(edges)
    both = e.select(F.col("src_part").alias("partition_id"), F.col("dst_part").alias("neighbor_id")).unionByName(e.select(F.col("dst_part").alias("partition_id"), F.col("src_part").alias("neighbor_id")))
    return both.distinct()


def expand(sources: DataFrame, near: DataFrame) -> DataFrame:
    """(partition_id): the sources and everything one hop away."""
    s = sources.select("partition_id").distinct()
    return s.unionByName(near.join(s, "partition_id", "left_semi").select(F.col("neighbor_id").alias("partition_id"))).distinct()


def partition_edges(edges: DataFrame) -> DataFrame:
    """The partition graph as an edge table: lightest edge between each two partitions."""
    return inter(edges).groupBy(F.least("src_part", "dst_part").alias("src"), F.greatest("src_part", "dst_part").alias("dst")).agg(F.min("weight").alias("weight"))


def required(near: DataFrame, sources: list[int], sink: int) -> DataFrame:
    """(partition_id): every partition on a path of fewest hops from each source to the sink (ties: smaller ids), and
    the sink. The frontier grows by joins, one per hop."""
    g = pin(near.select(F.col("partition_id").alias("a"), F.col("neighbor_id").alias("b")))
    spark = near.sparkSession
    tree = pin(spark.createDataFrame([(sink, None)], "v long, next long"))
    wave = tree
    while True:
        step = wave.join(g, F.col("v") == F.col("b")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("next"))
        wave = pin(step.join(tree.select("v"), "v", "left_anti"))
        if not wave.limit(1).count():
            break
        tree = pin(tree.unionByName(wave))
    on = pin(spark.createDataFrame([(s,) for s in {*sources, sink}], "v long").join(tree.select("v"), "v", "left_semi"))
    wave = on
    while True:
        wave = pin(wave.join(tree, "v").where(F.col("next").isNotNull()).select(F.col("next").alias("v")).distinct().join(on, "v", "left_anti"))
        if not wave.limit(1).count():
            return on.select(F.col("v").alias("partition_id"))
        on = pin(on.unionByName(wave))


def induced(edges: DataFrame, partitions: list[int]) -> DataFrame:
    """Edges whose ends both lie in the given partitions."""
    return edges.where(F.col("src_part").isin(partitions) & F.col("dst_part").isin(partitions))


# splits -----------------------------------------------------------------------------------------------------------

Strategy = Callable[[np.ndarray, np.ndarray, list[tuple[int, int]]], np.ndarray]


def two_means(max_iter: int | None = MAX_ITER) -> Strategy:
    """Lloyd with two means. Seeds: a point near the centroid and a neighbour of it, in that order of trial; equal
    distances go to side 0. Stops when a side no longer changes or after ``max_iter`` rounds; the next pair of seeds
    is tried while one side holds everything. Points that are all equal are divided by their order."""

    def run(ids: np.ndarray, x: np.ndarray, _: list) -> np.ndarray:
        n = len(ids)
        by_centre = np.lexsort((ids, ((x - x.mean(0)) ** 2).sum(1)))
        for a in by_centre:
            for b in np.lexsort((ids, ((x - x[a]) ** 2).sum(1))):
                if b == a or (x[a] == x[b]).all():
                    continue
                means, side, k = np.stack([x[a], x[b]]), None, 0
                while True:
                    now = (((x - means[1]) ** 2).sum(1) < ((x - means[0]) ** 2).sum(1)).astype(int)
                    k += 1
                    same = side is not None and (now == side).all()
                    side = now
                    if same or side.all() or not side.any() or (max_iter and k >= max_iter):
                        break
                    means = np.stack([x[side == 0].mean(0), x[side == 1].mean(0)])
                if side.any() and not side.all():
                    return side
        return (np.arange(n)[np.argsort(np.argsort(ids))] >= (n + 1) // 2).astype(int)

    return run


def grow(ids: np.ndarray, x: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """Two seeds (the point nearest the centroid, and the point farthest from it) take turns extending over the edges,
    depth first; points no seed reaches go to the smaller side."""
    n = len(ids)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    s0 = int(np.lexsort((ids, ((x - x.mean(0)) ** 2).sum(1)))[0])
    d = ((x - x[s0]) ** 2).sum(1)
    d[s0] = -1
    s1 = int(np.lexsort((ids, -d))[0])
    side = np.full(n, -1)
    stacks = [[s0], [s1]]
    side[s0], side[s1] = 0, 1
    while stacks[0] or stacks[1]:
        for k in (0, 1):
            while stacks[k]:
                v = stacks[k][-1]
                nxt = next((u for u in sorted(near[v], key=lambda u: ids[u]) if side[u] < 0), None)
                if nxt is None:
                    stacks[k].pop()
                    continue
                side[nxt] = k
                stacks[k].append(nxt)
                break
    for v in np.flatnonzero(side < 0):
        side[v] = int((side == 1).sum() < (side == 0).sum())
    return side


def split(members: DataFrame, edges: DataFrame, strategy: Strategy) -> DataFrame:
    """(vec_id, partition_id, side): side 0 or 1 of every member of each partition, each split on its own.

    members: vec_id, embedding, partition_id; edges with src_part and dst_part (those inside a partition are used).
    A partition with fewer than two members raises. Partitions are bounded by their capacity, so a group is small.
    """

    def one(m: pa.Table, e: pa.Table) -> pa.Table:
        o = np.argsort(m["vec_id"].to_numpy())
        ids, x = m["vec_id"].to_numpy()[o], rows_of(m["embedding"])[o]
        if len(ids) < 2:
            raise ValueError("a partition of fewer than two vectors cannot be split")
        at = {int(v): k for k, v in enumerate(ids)}
        pairs = [(at[a], at[b]) for a, b in zip(e["src"].to_pylist(), e["dst"].to_pylist())]
        side = strategy(ids, x, pairs)
        return pa.table({"vec_id": ids, "partition_id": pa.array(np.full(len(ids), m["partition_id"][0].as_py(), np.int64)), "side": pa.array(side.astype(np.int32))})

    inside = edges.where("src_part = dst_part").select("src", "dst", F.col("src_part").alias("partition_id"))
    return members.select("vec_id", "embedding", F.col("partition_id").cast("long").alias("partition_id")).groupBy("partition_id").cogroup(inside.withColumn("partition_id", F.col("partition_id").cast("long")).groupBy("partition_id")).applyInArrow(one, SIDES)


def first_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vec_id, side): side 0 is the tree of the smallest node, side 1 everything else."""
    c = components(nodes, edges)
    low = c.agg(F.min("component").alias("low"))
    return c.join(F.broadcast(low)).select(F.col("node").alias("vec_id"), F.when(F.col("component") == F.col("low"), 0).otherwise(1).alias("side"))


def tree_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n): number of trees of a forest."""
    return components(nodes, edges).agg(F.countDistinct("component").alias("n"))


def into_trees(members: DataFrame, edges: DataFrame, capacity: int = CAPACITY, small: bool | None = None) -> DataFrame:
    """(vec_id, partition_id, piece): each partition divided into its trees; pieces joined by an edge are put together
    again while they fit the capacity. piece is the smallest member.

    Up to ``PIECES`` pieces and links are put together in one task, link by link; more of them in rounds of joins, in
    each of which two pieces join if the link between them is the first of both in a random order.
    """
    inside = edges.where("src_part = dst_part")
    c = components(members.select(F.col("vec_id").alias("node")), inside)
    c = pin(c)
    m = members.select("vec_id", F.col("partition_id").cast("long").alias("partition_id")).join(c, F.col("vec_id") == F.col("node")).select("vec_id", "partition_id", "component")
    a, b = c.select(F.col("node").alias("src"), F.col("component").alias("ca")), c.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    links = edges.where("src_part <> dst_part").select("src", "dst").join(a, "src").join(b, "dst")
    links = pin(links.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).where("ca <> cb").distinct())
    sizes = pin(c.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    if small is None:
        small = links.count() + sizes.count() <= PIECES
    pieces = _joined(sizes, links, capacity) if small else _joined_by_rounds(sizes, links, capacity)
    return m.join(pieces, "component").select("vec_id", "partition_id", "piece")


def _joined(sizes: DataFrame, links: DataFrame, capacity: int) -> DataFrame:
    def merge(t: pa.Table) -> pa.Table:
        x, y, n = t["x"].to_pylist(), t["y"].to_pylist(), t["n"].to_pylist()
        size = {a: k for a, b, k in zip(x, y, n) if b is None}
        home = {a: a for a in size}

        def root(v: int) -> int:
            while home[v] != v:
                home[v] = home[home[v]]
                v = home[v]
            return v

        for a, b in sorted((a, b) for a, b in zip(x, y) if b is not None):
            p, q = sorted((root(a), root(b)))
            if p != q and size[p] + size[q] <= capacity:
                home[q] = p
                size[p] += size[q]
        keys = sorted(home)
        return pa.table({"component": pa.array(keys, pa.int64()), "piece": pa.array([root(v) for v in keys], pa.int64())})

    none = F.lit(None).cast("long")
    plan = sizes.select(F.col("component").alias("x"), none.alias("y"), "n").unionByName(links.select(F.col("ca").alias("x"), F.col("cb").alias("y"), none.alias("n")))
    return plan.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(merge, "component long, piece long")


def _joined_by_rounds(sizes: DataFrame, links: DataFrame, capacity: int) -> DataFrame:
    home = pin(sizes.select("component", F.col("component").alias("piece")))
    size = sizes.select(F.col("component").alias("p"), "n")
    while True:
        s, t = size.select(F.col("p").alias("sp"), F.col("n").alias("sn")), size.select(F.col("p").alias("tp"), F.col("n").alias("tn"))
        open_ = pin(links.join(s, F.col("ca") == F.col("sp")).join(t, F.col("cb") == F.col("tp")).where(F.col("sn") + F.col("tn") <= capacity).select("ca", "cb", F.xxhash64("ca", "cb").alias("h")))
        if not open_.limit(1).count():
            return home
        rank = F.min(F.struct("h", "ca", "cb")).alias("m")
        mine = open_.select(F.explode(F.array("ca", "cb")).alias("v"), "h", "ca", "cb").groupBy("v").agg(rank)
        both = pin(mine.groupBy("m.ca", "m.cb").count().where("count = 2").select(F.col("cb").alias("gone"), F.col("ca").alias("into")))
        move = lambda d, c: d.join(both, F.col(c) == F.col("gone"), "left").withColumn(c, F.coalesce("into", c)).drop("gone", "into")  # noqa: E731, B023
        home = pin(move(home, "piece"))
        size = pin(move(size, "p").groupBy("p").agg(F.sum("n").alias("n")))
        moved = move(move(open_.select("ca", "cb"), "ca"), "cb")
        links = pin(moved.select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).where("ca <> cb").distinct())


def merge(membership: DataFrame, edges: DataFrame, sink: int, source: int, capacity: int = CAPACITY) -> DataFrame:
    """The membership after ``source`` is absorbed by ``sink``. Raises Overflow or NotConnected."""
    sizes = {r[0]: r[1] for r in membership.where(F.col("partition_id").isin([sink, source])).groupBy("partition_id").count().collect()}
    if sum(sizes.values()) > capacity:
        raise Overflow(f"{sum(sizes.values())} vectors exceed {capacity}")
    touching = (F.col("src_part") == sink) & (F.col("dst_part") == source) | (F.col("src_part") == source) & (F.col("dst_part") == sink)
    if not edges.where(touching).limit(1).count():
        raise NotConnected(f"no edge between {sink} and {source}")
    return membership.select("vec_id", F.when(F.col("partition_id") == source, F.lit(sink).cast("long")).otherwise(F.col("partition_id").cast("long")).alias("partition_id"))


def absorb(membership: DataFrame, edges: DataFrame, sink: int, candidates: list[int], capacity: int = CAPACITY) -> DataFrame:
    """Merge the candidates into the sink one after the other until one does not fit; unconnected ones are passed over."""
    for p in candidates:
        try:
            membership = merge(membership, with_partitions(edges.select("src", "dst", "weight"), membership), sink, p, capacity)
        except NotConnected:
            continue
        except Overflow:
            break
    return membership


Means = dict[int, tuple[np.ndarray, np.ndarray]]


def _far(x: np.ndarray, means: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return ((x - means[1]) ** 2).sum(1) < ((x - means[0]) ** 2).sum(1)


def _per_part(b: pa.RecordBatch, parts: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, positions, vectors) of the partitions asked for."""
    of = b.column("partition_id").to_numpy()
    x = None
    for p in np.unique(of).tolist():
        if p in parts:
            x = rows_of(pa.chunked_array([b.column("embedding")])) if x is None else x
            k = np.flatnonzero(of == p)
            yield p, k, x[k]


def _sides(it: Iterator[pa.RecordBatch], now: Means, before: Means) -> Iterator[pa.RecordBatch]:
    """Counts and sums of both sides under the means ``now``, and how many vectors had another side under ``before``."""
    got: dict[int, list] = {}
    for b in it:
        for p, _, x in _per_part(b, now) if b.num_rows else ():
            far = _far(x, now[p])
            moved = int((far != _far(x, before[p])).sum()) if p in before else len(far)
            new = [int((~far).sum()), int(far.sum()), moved, x[~far].sum(0), x[far].sum(0)]
            got[p] = [u + v for u, v in zip(got[p], new)] if p in got else new
    cols = list(zip(*[(p, *v) for p, v in got.items()])) or [()] * 6
    kinds = [pa.int64()] * 4 + [pa.list_(pa.float64())] * 2
    yield pa.RecordBatch.from_arrays([pa.array([list(z) if isinstance(z, np.ndarray) else z for z in c], k) for c, k in zip(cols, kinds)], names=["p", "n0", "n1", "moved", "s0", "s1"])


def _closest(it: Iterator[pa.RecordBatch], to: dict[int, np.ndarray], other: bool) -> Iterator[pa.RecordBatch]:
    """The vector nearest to a point per partition (``other``: that does not equal it), ties to the smaller id."""
    best: dict[int, tuple[float, int, list[float]]] = {}
    for b in it:
        for p, k, x in _per_part(b, to) if b.num_rows else ():
            d, ids = ((x - to[p]) ** 2).sum(1), b.column("vec_id").to_numpy()[k]
            if other:
                d[(x == to[p]).all(1)] = np.inf
            i = np.lexsort((ids, d))[0]
            if d[i] < np.inf and (p not in best or (d[i], ids[i]) < best[p][:2]):
                best[p] = (float(d[i]), int(ids[i]), x[i].tolist())
    cols = list(zip(*[(p, *v) for p, v in best.items()])) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["p", "d", "id", "x"])


def _side(it: Iterator[pa.RecordBatch], means: Means, middle: dict[int, int], names: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The rows with the partition of their side: by the nearer mean, or by id where there are no two means."""
    for b in it:
        ids, to = b.column("vec_id").to_numpy(), b.column("partition_id").to_numpy().copy()
        for p, k, x in _per_part(b, names) if b.num_rows else ():
            far = _far(x, means[p]) if p in means else ids[k] > middle[p]
            to[k] = np.where(far, names[p][1], names[p][0])
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(to, pa.int64())], names=["vec_id", "embedding", "partition_id"])


def _middle(part: DataFrame, n: int) -> int:
    """The id with (n + 1) // 2 ids up to it, found by counting."""
    lo, hi = part.agg(F.min("vec_id"), F.max("vec_id")).first()
    while lo < hi:
        mid = (lo + hi) // 2
        if part.where(F.col("vec_id") <= mid).count() >= (n + 1) // 2:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _all_means(v: DataFrame, big: dict[int, int]) -> Means:
    """Two means of each partition of ``big``, as ``two_means`` finds them, by passes over all of its vectors. A
    partition without two different vectors has none."""
    v = v.select("vec_id", "embedding", "partition_id").where(F.col("partition_id").isin(list(big)))
    dim = v.select(F.size("embedding")).first()[0]
    add = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), dim), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))

    def sides(now: Means, before: Means) -> list:
        got = v.mapInArrow(partial(_sides, now=now, before=before), "p long, n0 long, n1 long, moved long, s0 array<double>, s1 array<double>")
        return got.groupBy("p").agg(F.sum("n0"), F.sum("n1"), F.sum("moved"), add("s0"), add("s1")).collect()

    def closest(to: dict[int, np.ndarray], other: bool) -> dict[int, np.ndarray]:
        got = v.mapInArrow(partial(_closest, to=to, other=other), "p long, d double, id long, x array<double>")
        return {r[0]: np.array(r[1]["x"]) for r in got.groupBy("p").agg(F.min(F.struct("d", "id", "x"))).collect()}

    origin = np.zeros(dim)
    centre = {p: np.array(s0) / n0 for p, n0, _, _, s0, _ in sides({p: (origin, origin) for p in big}, {})}
    a = closest(centre, False)
    b = closest(a, True)
    now: Means = {p: (a[p], b[p]) for p in b}
    before: Means = {}
    done: Means = {}
    for k in range(1, MAX_ITER + 1):
        nxt: Means = {}
        for p, n0, n1, moved, s0, s1 in sides(now, before) if now else []:
            if not n0 or not n1:  # rounding alone: divided by order
                continue
            if not moved or k == MAX_ITER:
                done[p] = now[p]
            else:
                nxt[p] = (np.array(s0) / n0, np.array(s1) / n1)
        now, before = nxt, now
    return done


def bootstrap(vectors: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(vec_id, partition_id): two-means splits, level by level, until every partition is within the capacity.

    While a partition is larger than one task should hold (``ONE`` vectors), the rounds of its two means are passes
    over all of its vectors; smaller ones are divided the same way within a task. Equal vectors are divided by id.
    """
    from vecloom.operators.mst import clean

    v = pin(clean(vectors).withColumn("partition_id", F.lit(0).cast("long")).select("vec_id", "embedding", "partition_id"))
    last = 0
    while True:
        big = {r[0]: r[1] for r in v.groupBy("partition_id").count().where(F.col("count") > max(ONE, capacity)).collect()}
        if not big:
            break
        means = _all_means(v, big)
        middle = {p: _middle(v.where(F.col("partition_id") == p), n) for p, n in big.items() if p not in means}
        names = {p: (last + 2 * k + 1, last + 2 * k + 2) for k, p in enumerate(sorted(big))}
        last += 2 * len(big)
        nxt = pin(v.mapInArrow(partial(_side, means=means, middle=middle, names=names), v.schema))
        drop(v)
        v = nxt

    def divide(t: pa.Table) -> pa.Table:
        o = np.argsort(t["vec_id"].to_numpy())
        ids, x = t["vec_id"].to_numpy()[o], rows_of(t["embedding"])[o]
        todo, out = [np.arange(len(ids))], []
        cut = two_means()
        while todo:
            k = todo.pop()
            if len(k) <= capacity:
                out.append(k)
                continue
            side = cut(ids[k], x[k], [])
            todo += [k[side == 0], k[side == 1]]
        name = np.empty(len(ids), np.int64)
        for k in out:
            name[k] = ids[k].min()
        return pa.table({"vec_id": ids, "partition_id": name})

    return v.groupBy("partition_id").applyInArrow(divide, "vec_id long, partition_id long")


def delaunay(points: DataFrame) -> DataFrame:
    """(src, dst): Delaunay neighbours of 2-D points (id, x, y), both ids ordered. Points are partition centroids, so
    there are few; they are triangulated in one task by incremental insertion."""

    def run(t: pa.Table) -> pa.Table:
        ids, p = t["id"].to_numpy(), np.column_stack([t["x"].to_numpy(), t["y"].to_numpy()])
        edges = triangulate(p)
        a, b = (np.array(z, np.int64) for z in zip(*sorted(edges))) if edges else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"src": np.minimum(ids[a], ids[b]), "dst": np.maximum(ids[a], ids[b])})

    return points.where("x is not null and y is not null").select(F.col("id").cast("long").alias("id"), "x", "y").dropDuplicates(["x", "y"]).withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(run, "src long, dst long")


def triangulate(p: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation of points in the plane, by inserting them one after the other."""
    n = len(p)
    if n < 2:
        return set()
    if n == 2:
        return {(0, 1)}
    mid, span = p.mean(0), max(float(np.ptp(p, axis=0).max()), 1e-9) * 1e4
    q = np.vstack([p, mid + [-span, -span], mid + [span, -span], mid + [0, span]])

    def circle(tri: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        a, b, c = q[list(tri)]
        m = 2 * np.array([b - a, c - a])
        r = np.array([b @ b - a @ a, c @ c - a @ a])
        det = np.linalg.det(m)
        if abs(det) < 1e-300:
            return a, np.inf
        o = np.linalg.solve(m, r)
        return o, float(((a - o) ** 2).sum())

    tris = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for k in range(n):
        hit = [t for t, (o, r) in tris.items() if ((q[k] - o) ** 2).sum() < r * (1 + 1e-12)]
        rim: dict[tuple[int, int], int] = {}
        for t in hit:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                e = (min(e), max(e))
                rim[e] = rim.get(e, 0) + 1
            del tris[t]
        for (a, b), c in rim.items():
            if c == 1:
                t = tuple(sorted((a, b, k)))
                tris[t] = circle(t)
    return {(min(a, b), max(a, b)) for t in tris for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if a < n and b < n}


