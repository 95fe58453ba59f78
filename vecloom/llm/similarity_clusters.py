"""Clusters of mutually similar vectors: Markov flow on an exact similarity graph.

1. Links. Every pair closer than the largest threshold is found exactly: a vector visits each cell whose separating
   plane is near enough, and a cell is compared in tiles of bounded size. A tile hands on not its pairs but its
   lightest spanning forest and each vector's nearest links, which connect exactly the same vectors at every smaller
   threshold (MST(A u B) = MST(MST(A) u MST(B))).
2. Flow. Within a tile, sparse Markov clustering (square, inflate, prune) runs per threshold on the links themselves
   (of each vector the ``FLOW`` strongest, which is all that pruning would leave); attractor rows give first clusters. Clusters become nodes, links between them
   remain, and the same flow runs on that smaller graph as a distributed matrix product, until no link is left.
   Every merge follows links and none is left over, so the final clusters are exactly the chains of linked vectors.
3. Description. A cluster's attractor is the member on which the flow ends; its most central members are those nearest
   to its centroid, over all its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.vectors import Shards, fit_cells, fit_shards, fold_copies, matrix
from vecloom.session import drop, pin

TILE = 8192  # vectors on one side of a comparison
NEAREST = 3  # links kept per vector and tile besides the forest
FLOW = 64  # strongest links of a vector that the flow sees: as many entries as a column can keep
PRUNE = 1 / 64  # flow entries below this share of a column are dropped
ROUNDS = 3  # squarings per level
FLUSH = 65536  # rows summed before a partial sum is handed on
COPIES = 1.5  # copies of the table that stand on disk at once for comparisons; more are made in rounds
LEAST = 500_000  # copies that a round makes at least
MARGIN = 1e-3  # distances this near to a threshold are computed again in double
_pin = partial(pin, shuffles=False)


def forest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of the lightest spanning forest (ties: the earlier edge)."""
    order = np.argsort(w, kind="stable")
    i, j = i[order], j[order]
    lab, keep = np.arange(n), np.zeros(len(w), bool)
    idx = np.arange(len(w))
    while True:
        a, b = lab[i[idx]], lab[j[idx]]
        cross = a != b
        idx, a, b = idx[cross], a[cross], b[cross]
        if not len(idx):
            return order[keep]
        best = np.full(n, len(w))
        best[a[::-1]] = idx[::-1]
        other = np.full(n, len(w))
        other[b[::-1]] = idx[::-1]
        best = np.minimum(best, other)
        own = np.flatnonzero(best < len(w))
        e = best[own]
        keep[e] = True
        ea, eb = lab[i[e]], lab[j[e]]
        up = np.arange(n)
        up[own] = np.where(ea == own, eb, ea)
        pair = (up[up[own]] == own) & (own < up[own])
        up[own[pair]] = own[pair]
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
        lab = up[lab]


def flow(n: int, i: np.ndarray, j: np.ndarray, s: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse Markov clustering of n nodes with links (i, j) of strength s: (attractor of each node, flow received)."""
    loop = np.zeros(n)
    np.maximum.at(loop, i, s)
    np.maximum.at(loop, j, s)
    loop[loop == 0] = 1
    col = np.concatenate([i, j, np.arange(n)])
    row = np.concatenate([j, i, np.arange(n)])
    v = np.concatenate([s, s, loop])
    for k in range(rounds + 1):
        if k:  # square
            start = np.searchsorted(col, np.arange(n + 1))
            count = start[row + 1] - start[row]
            at = np.repeat(start[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            col, row, v = np.repeat(col, count), row[at], np.repeat(v, count) * v[at]
        key = col * n + row
        o = np.argsort(key, kind="stable")
        key, v = key[o], v[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, v = key[first], np.add.reduceat(v, first)
        col, row = np.divmod(key, n)
        v = v / np.bincount(col, v, n)[col]
        if k:  # inflate
            v = v * v
            v = v / np.bincount(col, v, n)[col]
        big = v >= np.minimum(PRUNE, np.maximum.reduceat(v, np.searchsorted(col, np.arange(n)))[col])
        col, row, v = col[big], row[big], v[big]
        v = v / np.bincount(col, v, n)[col]
    o = np.lexsort((row, -v, col))
    first = np.searchsorted(col[o], np.arange(n))
    return row[o][first], np.bincount(row, v, n)


def _strongest(i: np.ndarray, j: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """Whether a link is among the ``most`` shortest of one of its ends."""
    keep = np.zeros(len(w), bool)
    end, link = np.concatenate([i, j]), np.tile(np.arange(len(w)), 2)
    o = np.lexsort((w[link], end))
    first = np.searchsorted(end[o], end[o])
    keep[link[o[np.arange(len(o)) - first < most]]] = True
    return keep


def _tile(t: pa.Table, dim: int, limits: list[tuple[int, float]]) -> pa.Table:
    """Compare the rows of side 0 with those of side 1 (or among themselves): forest, nearest links and first clusters."""
    top = max(x for _, x in limits)
    side = t["side"].to_numpy()
    x, rep = matrix(t["vec"], dim), t["rep"].to_numpy()
    own = bool(t["own"][0].as_py())
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if own:
        b = a
    out: list[tuple] = []
    ei = ej = np.empty(0, np.int64)
    ew = np.empty(0)
    if len(a) and len(b):
        o = np.argsort(rep)  # positions follow ids, so ties are broken alike everywhere
        x, rep, side = x[o], rep[o], side[o]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
        y = x - x[a].mean(0)
        ya, yb = y[a], y[b]
        na, nb = np.einsum("ij,ij->i", ya, ya), np.einsum("ij,ij->i", yb, yb)
        for p in range(0, len(a), 512):
            d = na[p : p + 512, None] + nb[None] - 2 * (ya[p : p + 512] @ yb.T)
            i, j = np.nonzero(d < top + MARGIN)
            w = np.maximum(d[i, j].astype(np.float64), 0)
            i, j = a[p + i], b[j]
            if own:
                m = i < j
                i, j, w = i[m], j[m], w[m]
            near = np.zeros(len(w), bool)
            for _, lim in limits:
                near |= np.abs(w - lim) < MARGIN
            if near.any():
                w[near] = ((x[i[near]].astype(np.float64) - x[j[near]]) ** 2).sum(1)
                m = w < top
                i, j, w = i[m], j[m], w[m]
            if not len(w):
                continue
            o = np.argsort(w, kind="stable")
            i, j, w = i[o], j[o], w[o]
            keep = np.zeros(len(w), bool)
            for e in (i, j):
                s = np.argsort(e, kind="stable")
                first = np.searchsorted(e[s], e[s])
                keep[s[np.arange(len(s)) - first < (FLOW if own else NEAREST)]] = True
            keep[forest(len(x), i, j, w)] = True
            ei, ej, ew = np.concatenate([ei, i[keep]]), np.concatenate([ej, j[keep]]), np.concatenate([ew, w[keep]])
        if len(ew):
            if own:  # the flow runs on the links themselves
                for sid, lim in limits:
                    m = _strongest(ei, ej, ew, FLOW) & (ew < lim)
                    if not m.any():
                        continue
                    nodes, pos = np.unique(np.concatenate([ei[m], ej[m]]), return_inverse=True)
                    half = len(pos) // 2
                    lab = flow(len(nodes), pos[:half], pos[half:], 1.05 - ew[m] / lim)[0]
                    out.append((np.ones(len(nodes), np.int32), np.full(len(nodes), sid, np.int32), rep[nodes], rep[nodes[lab]], np.zeros(len(nodes))))
            keep = _strongest(ei, ej, ew, NEAREST)
            keep[forest(len(x), ei, ej, ew)] = True
            ei, ej, ew = ei[keep], ej[keep], ew[keep]
            lo, hi = np.minimum(rep[ei], rep[ej]), np.maximum(rep[ei], rep[ej])
            out.append((np.zeros(len(ew), np.int32), np.zeros(len(ew), np.int32), lo, hi, ew))
    cols = [np.concatenate(c) if out else np.empty(0) for c in zip(*out)] or [np.empty(0)] * 5
    return pa.table([pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.int64)), pa.array(cols[4].astype(np.float64))], names=["kind", "set_id", "a", "b", "w"])


def _visits(it: Iterator[pa.RecordBatch], shards: Shards, dim: int, reach: float, now: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per shard of those in ``now`` that a vector has to be compared in; home says which is its own."""
    for b in it:
        x = matrix(b.column("vec"), dim)
        for p in range(0, len(x), 1024):
            home = shards.home(x[p : p + 1024])
            r, c = shards.near(x[p : p + 1024], reach)
            r, c = r[now[c]], c[now[c]]
            part = b.slice(p, 1024).take(pa.array(r))
            yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("vec"), pa.array(c.astype(np.int32)), pa.array(home[r] == c)], names=["rep", "vec", "cell", "home"])


def _visitors(it: Iterator[pa.RecordBatch], shards: Shards, dim: int, reach: float) -> Iterator[pa.RecordBatch]:
    """How many vectors are at home in each shard, and how many visit it."""
    home, all_ = np.zeros(shards.n, np.int64), np.zeros(shards.n, np.int64)
    for b in it:
        x = matrix(b.column("vec"), dim)
        for p in range(0, len(x), 1024):
            home += np.bincount(shards.home(x[p : p + 1024]), minlength=shards.n)
            all_ += np.bincount(shards.near(x[p : p + 1024], reach)[1], minlength=shards.n)
    k = np.flatnonzero(all_)
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(home[k]), pa.array((all_ - home)[k])], names=["cell", "home", "visits"])


def _rounds(home: np.ndarray, visits: np.ndarray, most: float) -> list[tuple[np.ndarray, int, int]]:
    """(shards, parts, part): which shards are compared at one time, so that about ``most`` copies of vectors are made
    for it. A shard that alone needs more is compared in parts, by a hash of its tiles."""
    nh, nv = -(-home // TILE), -(-visits // TILE)
    copies = home * (nh + nv) + visits * nh
    out: list[tuple[np.ndarray, int, int]] = []
    for c in np.flatnonzero(copies > most):
        parts = int(-(-copies[c] // most))
        out += [(np.array([c]), parts, k) for k in range(parts)]
    rest = np.flatnonzero((copies > 0) & (copies <= most))
    held, first = 0, 0
    for i, c in enumerate(rest):
        if held and held + copies[c] > most:
            out.append((rest[first:i], 1, 0))
            held, first = 0, i
        held += copies[c]
    if first < len(rest):
        out.append((rest[first:], 1, 0))
    return out


def links(reps: DataFrame, dim: int, limits: list[tuple[int, float]]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(edges: a, b, w; first clusters: set_id, node, label; the pinned tables behind them) of all vectors nearer than
    the largest limit.

    A cell too large for a tile is divided by centres of its own, so that a vector meets only what can be near it; what
    is still too large for a tile is divided by hash. The copies of vectors that the tiles need are counted first and
    made a round at a time, so that they never fill more of the disk than ``COPIES`` tables.
    """
    n = reps.count()
    shards = fit_shards(reps, dim, 2 * TILE, fit_cells(reps, n, dim, grow=True))
    reach = float(np.sqrt(max(x for _, x in limits)))
    count = reps.select("vec").mapInArrow(partial(_visitors, shards=shards, dim=dim, reach=reach), "cell int, home long, visits long")
    home, visits = np.zeros(shards.n, np.int64), np.zeros(shards.n, np.int64)
    for r in count.groupBy("cell").agg(F.sum("home"), F.sum("visits")).collect():  # one row per shard, at most MANY_CELLS + MOST_SHARDS
        home[r[0]], visits[r[0]] = r[1], r[2]
    got = [_pin(_compared(reps, dim, limits, reach, shards, home, visits, *z)) for z in _rounds(home, visits, max(LEAST, COPIES * n))]
    every = reduce(DataFrame.unionByName, got or [reps.sparkSession.createDataFrame([], LINKS)])
    edges = every.where("kind = 0").groupBy("a", "b").agg(F.min("w").alias("w"))
    return edges, every.where("kind = 1").select("set_id", F.col("a").alias("node"), F.col("b").alias("label")), got


LINKS = "kind int, set_id int, a long, b long, w double"


def _compared(reps: DataFrame, dim: int, limits: list[tuple[int, float]], reach: float, shards: Shards, home: np.ndarray, visits: np.ndarray, which: np.ndarray, parts: int, part: int) -> DataFrame:
    """What the tiles of some shards give, or of one shard some of the tiles."""
    now = np.zeros(shards.n, bool)
    now[which] = True
    v = reps.select("rep", "vec").mapInArrow(partial(_visits, shards=shards, dim=dim, reach=reach, now=now), "rep long, vec binary, cell int, home boolean")
    large = [(int(c), int(-(-home[c] // TILE)), int(-(-visits[c] // TILE))) for c in which if home[c] > TILE or visits[c]]
    if large:
        sizes = reps.sparkSession.createDataFrame(large, "zc int, nh int, nv int")
        v = v.join(F.broadcast(sizes), F.col("cell") == F.col("zc"), "left")  # one row per shard, at most MANY_CELLS + MOST_SHARDS
        v = v.withColumn("nh", F.coalesce("nh", F.lit(1))).withColumn("nv", F.coalesce("nv", F.lit(0)))
    else:
        v = v.withColumn("nh", F.lit(1)).withColumn("nv", F.lit(0))
    tile = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("nh")).otherwise(F.greatest("nv", F.lit(1)))).cast("int")
    v = v.withColumn("t", tile)
    up_to = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda i, j, side, own: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"), own.alias("own"))
    zero, t, nh = F.lit(0), F.col("t"), F.col("nh")
    own = F.concat(
        F.transform(up_to(t, nh), lambda j: task(t, j, 0, j == t)),
        F.transform(up_to(zero, t), lambda i: task(i, t, 1, F.lit(False))),
        F.transform(up_to(zero, F.col("nv")), lambda j: task(t, -1 - j, 0, F.lit(False))),
    )
    guest = F.transform(up_to(zero, nh), lambda i: task(i, -1 - t, 1, F.lit(False)))
    tasks = F.when(F.col("home"), own).otherwise(guest)
    if parts > 1:
        tasks = F.filter(tasks, lambda z: F.pmod(F.xxhash64(z["i"], z["j"]), F.lit(parts)) == part)
    v = v.withColumn("task", F.explode(tasks))
    v = v.select("rep", "vec", "cell", F.col("task.i").alias("i"), F.col("task.j").alias("j"), F.col("task.side").alias("side"), F.col("task.own").alias("own"))
    return v.groupBy("cell", "i", "j").applyInArrow(lambda x: _tile(x, dim, limits), LINKS)


def markov_step(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One level of distributed Markov clustering: edges (set_id, a, b, s) to (set_id, node, label).

    The matrix is a table (set_id, c, r, v). Squaring is a self-join on the inner index and a sum; a column holds at
    most 1 / PRUNE entries after pruning, so a hub costs in proportion to its links and not to their square.
    """
    both = edges.select("set_id", F.col("a").alias("c"), F.col("b").alias("r"), "s").unionByName(edges.select("set_id", F.col("b").alias("c"), F.col("a").alias("r"), "s"))
    loops = both.groupBy("set_id", "c").agg(F.max("s").alias("s")).select("set_id", "c", F.col("c").alias("r"), "s")
    m = _pin(_columns(both.unionByName(loops).withColumnRenamed("s", "v"), False))
    for _ in range(rounds):
        left = m.select("set_id", "c", F.col("r").alias("k"), F.col("v").alias("v1"))
        right = m.select("set_id", F.col("c").alias("k"), "r", F.col("v").alias("v2"))
        sq = left.join(right, ["set_id", "k"]).groupBy("set_id", "c", "r").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))
        nxt = _pin(_columns(sq, True))
        drop(m)
        m = nxt
    return m.groupBy("set_id", F.col("c").alias("node")).agg(F.min(F.struct((-F.round("v", 9)).alias("n"), F.col("r").alias("r"))).alias("x")).select("set_id", "node", F.col("x.r").alias("label"))


def _columns(m: DataFrame, inflate: bool) -> DataFrame:
    w = Window.partitionBy("set_id", "c")
    if inflate:
        m = m.withColumn("v", F.col("v") * F.col("v"))
    m = m.withColumn("t", F.sum("v").over(w)).withColumn("x", F.max("v").over(w))
    m = m.where(F.col("v") >= F.least(F.col("t") * PRUNE, F.col("x")))
    return m.withColumn("v", F.col("v") / F.sum("v").over(w)).select("set_id", "c", "r", "v")


def similarity_clusters(vectors: DataFrame, key: str, dim: int, limits: list[tuple[int, float]]) -> tuple[DataFrame, DataFrame]:
    """(clusters: set_id, key, cluster_id; attractors: set_id, cluster_id, attractor) for each (set_id, threshold) of ``limits``.

    Vectors (key, vec) whose squared L2 distance is below a threshold, directly or through others, share a cluster,
    named by its smallest key; clusters of one are left out. Equal vectors have distance 0. Null or non-positive
    thresholds join nothing; an empty table gives no rows. The attractor of a cluster is the member on which the flow
    of the last level ends; of a group of copies the smallest key stands for all.
    """
    limits = sorted((int(s), float(t)) for s, t in limits if t is not None and t > 0)
    reps, members = fold_copies(vectors, key)
    members = _pin(members.withColumnRenamed("rep", "mrep"))
    if not limits:
        none = members.select(F.lit(0).alias("set_id"), key, F.col(key).alias("cluster_id")).where(F.lit(False))
        return none, none.select("set_id", "cluster_id", F.col(key).alias("attractor"))
    edges, first, behind = links(reps, dim, limits)
    drop(reps)
    sets = F.array(*[F.struct(F.lit(s).alias("set_id"), F.lit(t).alias("t")) for s, t in limits])
    edges = edges.withColumn("x", F.explode(sets)).where(F.col("w") < F.col("x.t")).select(F.col("x.set_id").alias("set_id"), "a", "b", (1.05 - F.col("w") / F.col("x.t")).alias("s"))
    labels = _pin(_seed(edges, first))
    edges = _pin(_contract(edges, labels))
    for x in behind:
        drop(x)
    left = edges.count()
    while left:
        step = markov_step(edges)
        nxt = _pin(_contract(edges, step))
        now = nxt.count()
        if now > left * 0.9:  # even cycles and grids have no attractors: follow each node's smallest neighbour instead
            drop(nxt)
            step = _smallest(edges)
            nxt = _pin(_contract(edges, step))
            now = nxt.count()
        s = step.select(F.col("set_id").alias("ss"), F.col("node").alias("sn"), F.col("label").alias("sl"))
        new = _pin(labels.join(s, (F.col("set_id") == F.col("ss")) & (F.col("label") == F.col("sn")), "left").select("set_id", "node", F.coalesce("sl", "label").alias("label")))
        drop(labels), drop(edges)
        labels, edges, left = new, nxt, now
    low = _pin(labels.groupBy("set_id", "label").agg(F.min("node").alias("low")))
    named = labels.join(low, ["set_id", "label"]).select(F.col("set_id").alias("ns"), F.col("node").alias("nn"), "low")
    every = members.withColumn("set_id", F.explode(F.array(*[F.lit(s) for s, _ in limits])))
    out = every.join(named, (F.col("set_id") == F.col("ns")) & (F.col("mrep") == F.col("nn")), "left").select("set_id", key, F.coalesce("low", "mrep").alias("cluster_id"))
    out = _pin(out)
    sizes = out.groupBy(F.col("set_id").alias("zs"), F.col("cluster_id").alias("zc")).count().where("count > 1").drop("count")
    found = out.join(sizes, (F.col("set_id") == F.col("zs")) & (F.col("cluster_id") == F.col("zc")), "left_semi")
    return found, low.select("set_id", F.col("low").alias("cluster_id"), F.col("label").alias("attractor"))


def _seed(edges: DataFrame, first: DataFrame) -> DataFrame:
    """A label for each node with a link: that of its tile, else its own."""
    ends = edges.select("set_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    f = first.select(F.col("set_id").alias("fs"), F.col("node").alias("fn"), "label")
    return ends.join(f, (F.col("set_id") == F.col("fs")) & (F.col("node") == F.col("fn")), "left").select("set_id", "node", F.coalesce("label", "node").alias("label"))


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different labels; of parallel ones the strengths add up to at most twice the strongest."""
    la = labels.select(F.col("set_id").alias("sa"), F.col("node").alias("na"), F.col("label").alias("xa"))
    lb = labels.select(F.col("set_id").alias("sb"), F.col("node").alias("nb"), F.col("label").alias("xb"))
    j = edges.join(la, (F.col("set_id") == F.col("sa")) & (F.col("a") == F.col("na")), "left")
    j = j.select("set_id", F.coalesce("xa", "a").alias("a"), "b", "s").join(lb, (F.col("set_id") == F.col("sb")) & (F.col("b") == F.col("nb")), "left")
    j = j.select("set_id", "a", F.coalesce("xb", "b").alias("b"), "s").where(F.col("a") != F.col("b"))
    g = j.groupBy("set_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("t"), F.max("s").alias("m"))
    return g.select("set_id", "a", "b", F.least(F.col("t"), 2 * F.col("m")).alias("s"))


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node's label: the smallest of itself and its neighbours, followed twice."""
    up = edges.groupBy("set_id", F.col("b").alias("node")).agg(F.min("a").alias("label"))
    top = edges.select("set_id", F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    one = up.unionByName(top).groupBy("set_id", "node").agg(F.min("label").alias("label"))
    again = one.select(F.col("set_id").alias("os"), F.col("node").alias("on"), F.col("label").alias("ol"))
    return one.join(again, (F.col("set_id") == F.col("os")) & (F.col("label") == F.col("on")), "left").select("set_id", "node", F.coalesce("ol", "label").alias("label"))


def _sums(it: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sums of vec and counts per (set_id, cluster_id), of up to FLUSH rows at a time; ``of`` lists a vector's clusters."""
    parts, held = [], 0
    for b in it:
        if b.num_rows:
            of = b.column("of")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(of).to_numpy(zero_copy_only=False))
            flat = of.flatten()
            parts.append((flat.field("set_id").to_numpy(), flat.field("cluster_id").to_numpy(), matrix(b.column("vec"), dim)[row]))
            held += len(row)
        if held > FLUSH:
            yield _summed(parts, dim)
            parts, held = [], 0
    if held:
        yield _summed(parts, dim)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dim: int) -> pa.RecordBatch:
    s, c, x = (np.concatenate(z) for z in zip(*parts))
    o = np.lexsort((c, s))
    s, c, x = s[o], c[o], x[o].astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
    n = np.diff(np.append(first, len(s)))
    sums = np.add.reduceat(x, first, axis=0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(first) + 1) * dim, dim, dtype=np.int32)), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(s[first], pa.int32()), pa.array(c[first]), pa.array(n.astype(np.int64)), lists], names=["set_id", "cluster_id", "n", "sums"])


def _grouped(s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in the order of (s, c): first row of each group, its size, and each row's group."""
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
    n = np.diff(np.append(first, len(s)))
    return first, n, np.repeat(np.arange(len(first)), n)


def _central(it: Iterator[pa.RecordBatch], key: str, dim: int, most: int) -> Iterator[pa.RecordBatch]:
    """Size, centroid and most central members of whole clusters; rows come in the order of ``coarse``, which holds together."""
    held, n, limit = [], 0, FLUSH // 4
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n > limit:
            t = pa.Table.from_batches(held).combine_chunks()
            coarse = t["coarse"].to_numpy()
            cut = int(np.searchsorted(coarse, coarse[-1]))  # the last cluster may go on
            if cut:
                yield _described(t.slice(0, cut), key, dim, most)
            held, n = t.slice(cut).to_batches(), n - cut
            limit = max(FLUSH // 4, 2 * n)
    if n:
        yield _described(pa.Table.from_batches(held), key, dim, most)


def _described(t: pa.Table, key: str, dim: int, most: int) -> pa.RecordBatch:
    of = t["of"].combine_chunks()
    row = np.repeat(np.arange(t.num_rows), pc.list_value_length(of).to_numpy(zero_copy_only=False))
    flat = of.flatten()
    s, c, ids = flat.field("set_id").to_numpy(), flat.field("cluster_id").to_numpy(), t[key].to_numpy()[row]
    o = np.lexsort((ids, c, s))
    s, c, ids = s[o], c[o], ids[o]
    first, n, g = _grouped(s, c)
    x = matrix(t["vec"], dim)[row[o]].astype(np.float64)
    mid = np.add.reduceat(x, first, axis=0) / n[:, None]
    x -= mid[g]
    d = np.einsum("ij,ij->i", x, x)
    d[n[g] <= 2] = 0  # two are equally far
    o = np.lexsort((ids, d, g))
    best = ids[o][np.arange(len(g)) - first[g] < most]
    lists = lambda ends, v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(v))
    cols = [pa.array(s[first], pa.int32()), pa.array(c[first]), pa.array(n.astype(np.int64)), lists(np.arange(1, len(first) + 1) * dim, mid.ravel()), lists(np.cumsum(np.minimum(n, most)), best)]
    return pa.RecordBatch.from_arrays(cols, names=["set_id", "cluster_id", "size", "centroid", "typical"])


def _nearest(it: Iterator[pa.RecordBatch], key: str, dim: int, most: int, mid: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The ``most`` rows of a task nearest to each of the centroids ``mid``, by (set_id, cluster_id)."""
    best: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for b in it:
        if not b.num_rows:
            continue
        of, x, ids = b.column("of"), matrix(b.column("vec"), dim), b.column(key).to_numpy()
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(of).to_numpy(zero_copy_only=False))
        flat = of.flatten()
        s, c = flat.field("set_id").to_numpy(), flat.field("cluster_id").to_numpy()
        o = np.lexsort((c, s))
        s, c, row = s[o], c[o], row[o]
        first, n, _ = _grouped(s, c)
        for f, k in zip(first, n):
            r, name = row[f : f + k], (int(s[f]), int(c[f]))
            d = ((x[r].astype(np.float64) - mid[name]) ** 2).sum(1)
            near = np.lexsort((ids[r], d))[:most]
            best[name] = sorted([*best.get(name, []), *zip(d[near].tolist(), ids[r][near].tolist())])[:most]
    out = [(*name, d, i) for name, z in best.items() for d, i in z]
    cols = list(zip(*out)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))], names=["set_id", "cluster_id", "d", key])


def describe(found: DataFrame, attractors: DataFrame, vectors: DataFrame, key: str, dim: int, typical: int = 3) -> DataFrame:
    """(set_id, cluster_id, size, centroid, typical, attractor) per cluster; typical: the keys nearest to the centroid of
    all members, best first (ties: the smaller key); attractor: the member on which the Markov flow ends (of a cluster of
    copies alone its smallest key).

    A vector travels once for all its clusters: clusters are nested, and the coarsest, by which rows are placed, has
    the smallest name. Clusters too large for one task (fewer than 4,096) are summed where their rows are, and the rows
    are then compared with the centroids.
    """
    a = attractors.select(F.col("set_id").alias("as"), F.col("cluster_id").alias("ac"), "attractor")
    out = _described_by_centre(found, vectors, key, dim, typical)
    out = out.join(a, (F.col("set_id") == F.col("as")) & (F.col("cluster_id") == F.col("ac")), "left").drop("as", "ac")
    return out.withColumn("attractor", F.coalesce("attractor", "cluster_id"))


def _described_by_centre(found: DataFrame, vectors: DataFrame, key: str, dim: int, typical: int) -> DataFrame:
    one = vectors.groupBy(key).agg(F.min("vec").alias("vec"))
    sizes = _pin(found.groupBy("set_id", "cluster_id").count())
    many = max(TILE, (sizes.agg(F.sum("count")).first()[0] or 0) // 4096)
    hot: dict[int, list[int]] = {}
    for s, c in sizes.where(F.col("count") > many).select("set_id", "cluster_id").collect():
        hot.setdefault(s, []).append(c)
    is_hot = lambda s, c: reduce(or_, [(s == F.lit(z)) & c.isin(v) for z, v in hot.items()], F.lit(False))
    large = is_hot(F.col("set_id"), F.col("cluster_id"))
    pair = F.struct("set_id", "cluster_id")
    of = found.groupBy(key).agg(F.collect_list(F.when(~large, pair)).alias("of"), F.collect_list(F.when(large, pair)).alias("hot"), F.min(F.when(~large, F.col("cluster_id"))).alias("coarse"))
    rows = one.join(of, key)
    if hot:
        rows = _pin(rows)
    placed = rows.where(F.col("coarse").isNotNull()).select(key, "of", "coarse", "vec").repartition("coarse").sortWithinPartitions("coarse")
    out = placed.mapInArrow(partial(_central, key=key, dim=dim, most=typical), "set_id int, cluster_id long, size long, centroid array<double>, typical array<long>")
    if not hot:
        return out
    rows = rows.where(F.size("hot") > 0).select(key, F.col("hot").alias("of"), "vec")
    part = rows.select("of", "vec").mapInArrow(partial(_sums, dim=dim), "set_id int, cluster_id long, n long, sums array<double>")
    add = F.aggregate(F.collect_list("sums"), F.array_repeat(F.lit(0.0), dim), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    total = _pin(part.groupBy("set_id", "cluster_id").agg(F.sum("n").alias("size"), add.alias("sums")))
    total = total.select("set_id", "cluster_id", "size", F.transform("sums", lambda z: z / F.col("size")).alias("centroid"))
    mid = {(r[0], r[1]): np.array(r[2]) for r in total.select("set_id", "cluster_id", "centroid").collect()}
    best = rows.mapInArrow(partial(_nearest, key=key, dim=dim, most=typical, mid=mid), f"set_id int, cluster_id long, d double, {key} long")
    best = best.groupBy("set_id", "cluster_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", key))), 1, typical).alias("b"))
    best = best.select("set_id", "cluster_id", F.transform("b", lambda z: z[key]).alias("typical"))
    return out.unionByName(total.join(best, ["set_id", "cluster_id"]))
