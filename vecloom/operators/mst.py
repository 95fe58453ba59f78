"""Minimum spanning trees of vectors: built from tiles, kept current under inserts and deletes.

MST(A u B) = MST(MST(A) u MST(B)): vectors are dealt to blocks, each pair of blocks gives its own tree in one task of
bounded size, and the union of these trees (few edges per vector and block) is reduced to the final tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.blocks import kruskal, prim, rows_of, sq_dists
from vecloom.operators.graph import EDGE, components, normal, spanning_forest
from vecloom.session import pin

BLOCK = 2048


def _table(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> pa.Table:
    return pa.table({"src": lo.astype(np.int64), "dst": hi.astype(np.int64), "weight": w.astype(np.float64)})


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding: one row per key; null keys, vectors and elements are left out."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(ok).select("vec_id", "embedding").dropDuplicates(["vec_id"])


def _pairs(v: DataFrame, blocks: int) -> DataFrame:
    b = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    low = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("b"), j).alias("i"), F.greatest(F.col("b"), j).alias("j")))
    return v.withColumn("b", b).withColumn("t", F.explode(low)).select("vec_id", "embedding", "b", "t.i", "t.j")


def mst(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst, weight) of the minimum spanning tree by squared L2; ties by (weight, src, dst). Fewer than two
    vectors give no rows; equal vectors are joined by edges of weight 0."""
    v = clean(vectors)
    blocks = max(1, -(-v.count() // block))

    def tile(t: pa.Table) -> pa.Table:
        o = np.argsort(t["vec_id"].to_numpy())
        return _table(*prim(rows_of(t["embedding"])[o], t["vec_id"].to_numpy()[o]))

    edges = _pairs(v, blocks).groupBy("i", "j").applyInArrow(tile, EDGE)
    return edges if blocks == 1 else spanning_forest(edges)


def _star(t: pa.Table) -> pa.Table:
    """The forest of all pairs of one block of new vectors with one block of any."""
    x, ids, new = rows_of(t["embedding"]), t["vec_id"].to_numpy(), t["new"].to_numpy(zero_copy_only=False).astype(bool)
    n = np.flatnonzero(new)
    if not len(n):
        return _table(np.empty(0), np.empty(0), np.empty(0))
    lo = hi = np.empty(0, np.int64)
    w = np.empty(0)
    for p in range(0, len(n), 256):
        q = n[p : p + 256]
        d = sq_dists(x[q], x)
        i, j = np.repeat(ids[q], len(x)), np.tile(ids, len(q))
        m = i != j
        lo, hi, w = np.concatenate([lo, np.minimum(i, j)[m]]), np.concatenate([hi, np.maximum(i, j)[m]]), np.concatenate([w, d.ravel()[m]])
        k = kruskal(lo, hi, w)
        lo, hi, w = lo[k], hi[k], w[k]
    return _table(lo, hi, w)


def insert(tree: DataFrame, old: DataFrame, new: DataFrame, block: int = BLOCK) -> DataFrame:
    """The tree after adding ``new`` to ``old`` (its tree is given): old pairs are not compared again.

    New rows whose vec_id is already there are ignored.
    """
    o = clean(old)
    n = clean(new).join(o.select("vec_id"), "vec_id", "left_anti")
    every = pin(o.withColumn("new", F.lit(False)).unionByName(n.withColumn("new", F.lit(True))))
    many, all_ = every.where("new").count(), every.count()
    if not many:
        return normal(tree)
    nb, ab = -(-many // block), -(-all_ // block)
    h = F.xxhash64("vec_id")
    a = every.where("new").withColumn("i", F.pmod(h, F.lit(nb)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ab - 1))))
    b = every.withColumn("j", F.pmod(h, F.lit(ab)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("new", F.lit(False))
    t = a.unionByName(b).groupBy("i", "j", "vec_id").agg(F.max("new").alias("new"), F.first("embedding").alias("embedding"))
    star = t.groupBy("i", "j").applyInArrow(_star, EDGE)
    return spanning_forest(normal(tree).unionByName(star))


def delete(tree: DataFrame, vectors: DataFrame, gone: DataFrame, block: int = BLOCK) -> DataFrame:
    """The tree after deleting the vectors of ``gone`` (vec_id): the parts left are joined again by the lightest pairs.

    The largest part is not compared with itself: only the vectors of the other parts look for partners.
    """
    v = pin(clean(vectors).join(gone.select("vec_id").distinct(), "vec_id", "left_anti"))
    g = gone.select(F.col("vec_id").alias("g")).distinct()
    rest = normal(tree).join(g, F.col("src") == F.col("g"), "left_anti").join(g, F.col("dst") == F.col("g"), "left_anti")
    rest = pin(rest)
    parts = pin(components(v.select(F.col("vec_id").alias("node")), rest))
    top = parts.groupBy("component").count().agg(F.max(F.struct("count", "component"))).first()[0]
    if top is None:
        return rest
    every = v.join(parts, F.col("vec_id") == F.col("node")).select("vec_id", "embedding", "component")
    few = pin(every.where(F.col("component") != F.lit(top["component"])))
    n, m = few.count(), v.count()
    if not n:
        return rest
    n, m = -(-n // block), -(-m // block)
    h = F.xxhash64("vec_id")
    a = few.withColumn("i", F.pmod(h, F.lit(n)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("side", F.lit(0))
    b = every.withColumn("j", F.pmod(h, F.lit(m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("side", F.lit(1))

    def tile(t: pa.Table) -> pa.Table:
        x, ids, side = rows_of(t["embedding"]), t["vec_id"].to_numpy(), t["side"].to_numpy()
        part = np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        lo = hi = pl = ph = np.empty(0, np.int64)
        w = np.empty(0)
        for s in range(0, len(p) if len(q) else 0, 256):
            r = p[s : s + 256]
            d = sq_dists(x[r], x[q])
            i, j = np.nonzero(part[r][:, None] != part[q][None])
            z, i, j = d[i, j], r[i], q[j]
            a_, b_ = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            # of all pairs of two parts only the lightest can matter
            o = np.lexsort((b_, a_, z))
            key = np.minimum(part[i], part[j])[o] * (part.max() + 1) + np.maximum(part[i], part[j])[o]
            o = o[np.unique(key, return_index=True)[1]]
            lo, hi, w = np.concatenate([lo, a_[o]]), np.concatenate([hi, b_[o]]), np.concatenate([w, z[o]])
            pl, ph = np.concatenate([pl, part[i][o]]), np.concatenate([ph, part[j][o]])
        order = np.lexsort((hi, lo, w))
        k = order[kruskal(pl[order], ph[order], np.arange(len(order), dtype=np.float64))]
        return _table(lo[k], hi[k], w[k])

    return spanning_forest(rest.unionByName(a.unionByName(b).groupBy("i", "j").applyInArrow(tile, EDGE)))
