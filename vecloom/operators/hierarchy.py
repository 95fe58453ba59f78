"""Parent-child rows to full hierarchies by leaf peeling.

Leaves are taken off round by round; each sends its subtree's size, weight and height to its parent, and leaves the
table. In the reverse order roots hand down names, depths and paths. What is never a leaf stands on a circle. A table
that fits one task of bounded size (``ONE_TASK`` rows, checked by a count) is peeled there in as many rounds as it is
high; a larger one in rounds of joins that double their height, with the same result:

Round k peels 2**k generations at once. Each node still below somebody sends what it has gathered (descendants,
subtree size, height) to its ancestor 2**k generations up; in the other direction it takes that ancestor's path.
So a tree of depth d needs log2(d) rounds instead of d, each of them a few joins on the node key. Nodes that are
never finished are those that lead into a circle or stand on one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import drop, pin

ONE_TASK = 2_000_000
STATE = "v long, parent long, root long, depth int, path array<long>, n_below long, total_below long, height int, leads_to_circle boolean, on_circle boolean"


def _peel_table(t: pa.Table, lists: bool) -> pa.Table:
    """The whole hierarchy of a table (v, a, w) that fits one task."""
    t = t.sort_by("v")
    v, w = t["v"].to_numpy(), t["w"].to_numpy()
    n = len(v)
    has = t["a"].is_valid().to_numpy(zero_copy_only=False)
    up = np.full(n, -1)
    up[has] = np.searchsorted(v, t["a"].drop_null().to_numpy())
    pending = np.bincount(up[has], minlength=n)
    below, total, height = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32)
    rounds, leaves = [], np.flatnonzero(pending == 0)
    while len(leaves):
        rounds.append(leaves)
        k = leaves[up[leaves] >= 0]
        to = up[k]
        np.add.at(below, to, below[k] + 1)
        np.add.at(total, to, total[k] + w[k])
        np.maximum.at(height, to, height[k] + 1)
        np.subtract.at(pending, to, 1)
        to = np.unique(to)
        leaves = to[pending[to] == 0]
    on = np.ones(n, bool)
    for k in rounds:
        on[k] = False
    root, depth, leads = v.copy(), np.zeros(n, np.int32), on.copy()
    if on.any():  # the smallest node of each circle: minima over 1, 2, 4, ... steps
        jump, low, step = np.where(on, up, 0), v.copy(), 1
        while step < 2 * on.sum():
            low[on] = np.minimum(low[on], low[jump[on]])
            jump[on] = jump[jump[on]]
            step *= 2
        root[on] = low[on]
    paths: list[list[int] | None] = [None] * n
    for k in reversed(rounds):
        b = k[up[k] >= 0]
        root[b], depth[b], leads[b] = root[up[b]], depth[up[b]] + 1, leads[up[b]]
        if lists:
            for i in k.tolist():
                if not leads[i]:
                    paths[i] = [*paths[up[i]], int(v[i])] if up[i] >= 0 else [int(v[i])]
    return pa.table({
        "v": v, "parent": t["a"], "root": root, "depth": pa.array(depth, mask=leads), "path": pa.array(paths, pa.list_(pa.int64())),
        "n_below": pa.array(below, mask=on), "total_below": pa.array(total, mask=on), "height": pa.array(height, mask=on),
        "leads_to_circle": leads, "on_circle": on,
    })


def _clean(rows: DataFrame, node: str, parent: str, weight: str | None) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")) if weight else F.lit(0).cast("long")
    one = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("v")).agg(F.max(F.struct(F.col(parent).alias("p"), w.alias("w"))).alias("r"))
    one = one.select("v", F.col("r.p").alias("p"), F.col("r.w").alias("w"))
    known = one.select(F.col("v").alias("pv"))
    return one.join(known, F.col("p") == F.col("pv"), "left").select("v", F.col("pv").alias("a"), "w")


def _peel(base: DataFrame, lists: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """State (v, a, depth, root, path, n, total, height) and the pairs (ancestor, descendant) once nothing changes.

    ``a`` is the ancestor 2**k up, null when the walk has ended. ``n`` and ``total`` are exact for nodes that lead
    into no circle.
    """
    state = base.select(
        "v", "a", F.when(F.col("a").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("int").alias("depth"),
        F.coalesce("a", "v").alias("root"),
        F.when(F.col("a").isNull(), F.array("v")).otherwise(F.array("a", "v")).alias("path") if lists else F.lit(None).cast("array<bigint>").alias("path"),
        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), "w", F.lit(0).alias("height"),
    )
    state = pin(state)
    left = state.where(F.col("a").isNotNull()).count()
    k = 0
    while left:
        step = 1 << k
        up = state.where(F.col("a").isNotNull())
        # bottom-up: pre-aggregated per receiving ancestor, so a wide node gets one row per map task
        sent = up.groupBy(F.col("a").alias("sa")).agg(
            F.sum(F.col("n") + 1).alias("sn"), F.sum(F.col("total") + F.col("w")).alias("st"), F.max(F.col("height") + step).alias("sh")
        )
        # top-down: the ancestor's own ancestor, depth and path
        above = state.select(F.col("v").alias("av"), F.col("a").alias("aa"), F.col("depth").alias("ad"), F.col("root").alias("ar"), F.col("path").alias("ap"))
        j = state.join(sent, F.col("v") == F.col("sa"), "left").join(above, F.col("a") == F.col("av"), "left")
        path = F.when(F.col("av").isNull() | F.col("path").isNull(), F.col("path")).otherwise(
            F.concat(F.col("ap"), F.slice(F.col("path"), 2, F.greatest(F.size("path") - 1, F.lit(0)))))
        nxt = j.select(
            "v", F.col("aa").alias("a"),
            (F.col("depth") + F.coalesce("ad", F.lit(0))).cast("int").alias("depth"),
            F.coalesce("ar", "root").alias("root"), path.alias("path"),
            (F.col("n") + F.coalesce("sn", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("st", F.lit(0))).alias("total"), "w",
            F.greatest("height", F.coalesce("sh", F.lit(0))).cast("int").alias("height"),
        )
        nxt = pin(nxt)
        drop(state)
        state, k = nxt, k + 1
        now = state.where(F.col("a").isNotNull()).count()
        if now == left:  # a tree with nodes left always finishes at least one more in a round
            break
        left = now
    return state, None, left


def _circles(base: DataFrame, residual: DataFrame) -> DataFrame:
    """(v, ring, on_ring) for nodes that never end: ring is the smallest node of the circle they reach."""
    f = pin(base.join(residual.select(F.col("v").alias("rv")), F.col("v") == F.col("rv"), "left_semi").select("v", "a"))
    one_step = f
    size = -1
    while True:
        image = f.select(F.col("a").alias("v")).distinct()
        now = image.count()
        g = f.select(F.col("v").alias("gv"), F.col("a").alias("ga"))
        nxt = pin(f.join(g, F.col("a") == F.col("gv")).select("v", F.col("ga").alias("a")))
        if f is not one_step:
            drop(f)
        f = nxt
        if now == size:
            break
        size = now
    ring = pin(f.select(F.col("a").alias("v")).distinct())
    m = pin(one_step.join(ring.select(F.col("v").alias("rv")), F.col("v") == F.col("rv"), "left_semi").select("v", "a", F.least("v", "a").alias("m")))
    while True:
        o = m.select(F.col("v").alias("ov"), F.col("a").alias("oa"), F.col("m").alias("om"))
        nxt = pin(m.join(o, F.col("a") == F.col("ov")).select("v", F.col("oa").alias("a"), F.least("m", "om").alias("m"), (F.col("om") < F.col("m")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        drop(m)
        m = nxt.drop("moved")
        if not moved:
            break
    low = m.select(F.col("v").alias("mv"), F.col("m").alias("ring"))
    return f.join(low, F.col("a") == F.col("mv")).join(ring.select(F.col("v").alias("rv")), F.col("v") == F.col("rv"), "left").select("v", "ring", F.col("rv").isNotNull().alias("on_ring"))


def _beneath(base: DataFrame, ring: DataFrame) -> DataFrame:
    """``base`` without the nodes on a circle: a node whose parent stands on one becomes a root."""
    on = ring.where("on_ring").select(F.col("v").alias("rv"))
    off = base.join(on, F.col("v") == F.col("rv"), "left_anti").join(on, F.col("a") == F.col("rv"), "left")
    return off.select("v", F.when(F.col("rv").isNull(), F.col("a")).alias("a"), "w")


def hierarchy(rows: DataFrame, node: str, parent: str, weight: str | None = None, paths: bool = True, small: bool | None = None) -> DataFrame:
    """(node, parent, root, depth, path, n_below, total_below, height, leads_to_circle, on_circle), one row per node.

    A node whose parent is null or no node of the table is a root (depth 0). ``path`` runs from the root down to the
    node. ``n_below`` counts all descendants, ``total_below`` sums their ``weight`` (null counts 0). For nodes that
    lead into a circle root is the smallest node of that circle and depth and path are null; for nodes on a circle
    n_below, total_below and height are null too, those beneath one have their own subtree. Repeated rows of a node: the one with the largest parent counts. Null nodes are left out. An empty table
    gives no rows; further columns are ignored. ``small``: whether one task may do it (by default if it has at most
    ``ONE_TASK`` rows).
    """
    base = pin(_clean(rows, node, parent, weight))
    if small is None:
        small = base.count() <= ONE_TASK
    if small and dict(base.dtypes)["v"] in ("bigint", "int"):
        one = base.select(F.col("v").cast("long").alias("v"), F.col("a").cast("long").alias("a"), "w").withColumn("_g", F.lit(0))
        return one.groupBy("_g").applyInArrow(lambda t: _peel_table(t, paths), STATE).withColumnRenamed("v", node)
    state, _, left = _peel(base, paths)
    parents = base.select(F.col("v").alias("bv"), F.col("a").alias("parent"))
    out = state.join(parents, F.col("v") == F.col("bv"))
    if left:
        ring = pin(_circles(base, state.where(F.col("a").isNotNull())))
        bound = base.join(ring.select(F.col("v").alias("x")), F.col("v") == F.col("x"), "left_semi")
        own, _, _ = _peel(_beneath(bound, ring), False)
        own = own.select(F.col("v").alias("ov"), F.col("n").alias("on"), F.col("total").alias("ot"), F.col("height").alias("oh"))
        out = out.join(ring.withColumnRenamed("v", "cv"), F.col("v") == F.col("cv"), "left").join(own, F.col("v") == F.col("ov"), "left")
    else:
        none = lambda t: F.lit(None).cast(t)
        out = out.withColumns({"ring": none("long"), "on_ring": none("boolean"), "on": none("long"), "ot": none("long"), "oh": none("int")})
    lost = F.col("a").isNotNull()
    keep = lambda c: F.when(~lost, F.col(c)).alias(c)
    below = lambda c, own, name: F.when(~lost, F.col(c)).otherwise(F.col(own)).alias(name)
    # a node on a circle is also below itself and has no counts; nodes beneath a circle have those of their own subtree
    return out.select(
        F.col("v").alias(node), "parent", F.when(lost, F.col("ring")).otherwise(F.col("root")).alias("root"),
        keep("depth"), keep("path"), below("n", "on", "n_below"), below("total", "ot", "total_below"), below("height", "oh", "height"),
        lost.alias("leads_to_circle"), F.coalesce("on_ring", F.lit(False)).alias("on_circle"),
    )


def descendants(rows: DataFrame, node: str, parent: str, beneath_circles: bool = False) -> DataFrame:
    """(ancestor, descendant, distance): every pair, as rows, so that no node's list has to fit one task.

    Doubling: after round k the pairs at distance up to 2**(k+1) are known. Nodes that lead into a circle are left
    out (they have no last ancestor) unless ``beneath_circles``: then only those on a circle are, and the pairs beneath
    one are given too. ``hierarchy`` reports both.
    """
    base = pin(_clean(rows, node, parent, None))
    state, _, left = _peel(base, False)
    if left and beneath_circles:
        base = pin(_beneath(base, pin(_circles(base, state.where(F.col("a").isNotNull())))))
    elif left:
        base = pin(base.join(state.where(F.col("a").isNotNull()).select(F.col("v").alias("x")), F.col("v") == F.col("x"), "left_anti"))
    drop(state)
    jump = base.where(F.col("a").isNotNull()).select("v", "a")
    pairs = jump.select(F.col("a").alias("ancestor"), F.col("v").alias("descendant"), F.lit(1).alias("distance"))
    pairs, step = pin(pairs), 1
    jump = pin(jump)
    while jump.limit(1).count():
        j = jump.select(F.col("v").alias("jv"), F.col("a").alias("ja"))
        lifted = pairs.join(j, F.col("ancestor") == F.col("jv")).select(F.col("ja").alias("ancestor"), "descendant", (F.col("distance") + step).alias("distance"))
        more = pin(pairs.unionByName(lifted))
        nxt = pin(jump.join(j, F.col("a") == F.col("jv")).select("v", F.col("ja").alias("a")))
        drop(pairs)
        pairs, jump, step = more, nxt, step * 2
    return pairs
