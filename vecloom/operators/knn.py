"""Nearest neighbours by squared L2: exact, batched, partition-pruned and probing a few partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.blocks import rows_of, sq_dists
from vecloom.functions.vectors import sq_dist
from vecloom.operators.mst import clean
from vecloom.session import pin

BLOCK = 1024


def literal(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def knn(data: DataFrame, query: list[float], k: int, metric: Callable[[Column, Column], Column] = sq_dist, where: Column | None = None) -> DataFrame:
    """(rank, vec_id, d): the k nearest, ascending, ties to the smaller vec_id. k < 1 gives none, k > n all.

    ``metric`` is any function of two array columns; ``where`` restricts the vectors first. A different dimension
    raises. Spark keeps k rows per task (TakeOrderedAndProject), so nothing is sorted as a whole.
    """
    v = data if where is None else data.where(where)
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    same = F.when(F.size("embedding") != len(query), F.raise_error(F.lit(f"invalid size: expected {len(query)} elements"))).otherwise(F.lit(True))
    near = v.where(same).select("vec_id", metric(F.col("embedding"), literal(query)).alias("d")).orderBy("d", "vec_id").limit(max(k, 0))
    return near.withColumn("rank", F.row_number().over(Window.orderBy("d", "vec_id"))).select("rank", "vec_id", "d")


def _scan(it: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        v, y = t["vec_id"].to_numpy(), rows_of(t["embedding"])
        o = np.argsort(v)
        v, y = v[o], y[o]
        d = sq_dists(x, y)
        if skip_self:
            d[ids[:, None] == v[None]] = np.inf
        at = np.argsort(d, 1, kind="stable")[:, :k]
        w = np.take_along_axis(d, at, 1)
        ok = np.isfinite(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(v[at][ok]), pa.array(w[ok])], names=["query_id", "vec_id", "d"])


def knn_batch(data: DataFrame, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, d) for many query vectors (vec_id, embedding): k nearest each, ties to the smaller id.

    Up to ``BLOCK`` queries travel to the data, which stay where they are. More are compared in tiles of a block of
    queries and a block of data, one task each. Either way only k rows per query and batch or tile are shuffled.
    """
    v, q = clean(data), clean(queries)
    few = q.orderBy("vec_id").limit(BLOCK + 1).collect() if k > 0 else []
    if not few:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("d")).where(F.lit(False))
    if len(few) <= BLOCK:
        ids, x = np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)
        out = v.mapInArrow(partial(_scan, ids=ids, x=x, k=k, skip_self=skip_self), "query_id long, vec_id long, d double")
    else:
        out = _tiled(q, v, k, skip_self).select(F.col("i").alias("query_id"), F.col("j").alias("vec_id"), "d")
    w = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "d")


def _tiled(rows: DataFrame, others: DataFrame, k: int, skip_self: bool, block: int = 2048) -> DataFrame:
    """(i, j, d): of each tile of ``rows`` by ``others`` (both vec_id, embedding) the k nearest j of each i."""
    n, m = (max(1, -(-d.count() // block)) for d in (rows, others))
    h = F.xxhash64("vec_id")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    a = rows.select("vec_id", "embedding", F.pmod(h, F.lit(n)).cast("int").alias("bi"), each(m).alias("bj"), F.lit(0).alias("side"))
    b = others.select("vec_id", "embedding", each(n).alias("bi"), F.pmod(h, F.lit(m)).cast("int").alias("bj"), F.lit(1).alias("side"))

    def tile(t: pa.Table) -> pa.Table:
        ids, x, side = t["vec_id"].to_numpy(), rows_of(t["embedding"]), t["side"].to_numpy()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        q = q[np.argsort(ids[q])]
        out = []
        for s in range(0, len(p) if len(q) else 0, 256):
            r = p[s : s + 256]
            d = sq_dists(x[r], x[q])
            if skip_self:
                d[ids[r][:, None] == ids[q][None]] = np.inf
            at = np.argsort(d, 1, kind="stable")[:, :k]
            w = np.take_along_axis(d, at, 1)
            ok = np.isfinite(w)
            out.append((np.repeat(ids[r], ok.sum(1)), ids[q][at][ok], w[ok]))
        i, j, w = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"i": i.astype(np.int64), "j": j.astype(np.int64), "d": w.astype(np.float64)})

    return a.unionByName(b).groupBy("bi", "bj").applyInArrow(tile, "i long, j long, d double")


def radii(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(partition_id, n, radius): members (partition_id, embedding); radius is the largest distance to the centroid."""
    c = centroids.select(F.col("partition_id").alias("cp"), "centroid")
    j = members.join(c, F.col("partition_id") == F.col("cp"))
    return j.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(sq_dist(F.col("embedding"), F.col("centroid")))).alias("radius"))


def bounds(query: list[float], centroids: DataFrame, meta: DataFrame) -> DataFrame:
    """(partition_id, b, n): no vector of a partition lies nearer than b, the distance to its centroid minus its radius."""
    q = literal(query)
    return centroids.join(meta, "partition_id").select("partition_id", F.greatest(F.lit(0.0), F.sqrt(sq_dist(F.col("centroid"), q)) - F.col("radius")).alias("b"), "n")


def knn_pruned(members: DataFrame, query: list[float], k: int, centroids: DataFrame, meta: DataFrame) -> DataFrame:
    """As ``knn``, but reads only partitions that can hold one of the k nearest; exact.

    First the partitions with the smallest bounds that hold k vectors together (at most k of them), then all whose
    bound is not above the k-th distance found, by a semi-join. ``members``: vec_id, embedding, partition_id (the filter
    prunes files if stored by partition).
    """
    if k < 1:
        return knn(members, query, 0)
    b = pin(bounds(query, centroids, meta))
    have, first = 0, []
    for r in b.where("n > 0").orderBy("b", "partition_id").limit(k).collect():
        first.append(r[0])
        have += r[2]
        if have >= k:
            break
    start = knn(members.where(F.col("partition_id").isin(first)), query, k)
    row = start.agg(F.max("d"), F.count(F.lit(1))).first()
    if row[1] >= k:
        b = b.where(F.col("b") <= F.lit(row[0] ** 0.5 * (1 + 1e-9)))
    return knn(members.join(b.select("partition_id"), "partition_id", "left_semi"), query, k)


def knn_probe(members: DataFrame, query: list[float], k: int, centroids: DataFrame, probes: int) -> DataFrame:
    """As ``knn`` within the ``probes`` partitions whose centroids are nearest: approximate."""
    near = centroids.select("partition_id", sq_dist(F.col("centroid"), literal(query)).alias("cd")).orderBy("cd", "partition_id").limit(probes)
    return knn(members.join(F.broadcast(near.select("partition_id")), "partition_id", "left_semi"), query, k)


def nearest_partition(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, partition_id, d): nearest centroid of each vector, ties to the smaller partition.

    Up to 16 ``BLOCK`` centroids travel to the vectors; more are compared with them in tiles.
    """
    v = clean(vectors)
    c = clean(centroids.select(F.col("partition_id").alias("vec_id"), F.col("centroid").alias("embedding")))
    few = c.orderBy("vec_id").limit(16 * BLOCK + 1).collect()
    if not few:
        return v.select("vec_id", F.lit(None).cast("long").alias("partition_id"), F.lit(None).cast("double").alias("d")).where(F.lit(False))
    if len(few) <= 16 * BLOCK:
        ids, x = np.array([r[0] for r in few], np.int64), np.array([r[1] for r in few], np.float64)
        return v.mapInArrow(partial(_nearest, ids=ids, x=x), "vec_id long, partition_id long, d double")
    best = _tiled(v, c, 1, False).groupBy(F.col("i").alias("vec_id")).agg(F.min(F.struct("d", "j")).alias("m"))
    return best.select("vec_id", F.col("m.j").alias("partition_id"), "m.d")


def _nearest(it: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            d = sq_dists(rows_of(t["embedding"]), x)
            k = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(ids[k]), pa.array(d[np.arange(len(d)), k])], names=["vec_id", "partition_id", "d"])


def knn_graph(data: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(i, j, rank, d): the k nearest other vectors of each vector, by pairs of blocks; a task compares two blocks and
    hands on k rows per vector."""
    v = clean(data)
    w = Window.partitionBy("i").orderBy("d", "j")
    return _tiled(v, v, k, True, block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "j", "rank", "d")


def pairwise(data: DataFrame, block: int = 2048) -> DataFrame:
    """(i, j, d) for all i < j: the full similarity matrix. Its size is the square of the input by definition; the
    comparison runs in tiles."""
    v = clean(data)
    n = max(1, -(-v.count() // block))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    low = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(F.col("b"), j).alias("bi"), F.greatest(F.col("b"), j).alias("bj")))
    t = v.withColumn("b", h).withColumn("t", F.explode(low)).select("vec_id", "embedding", "b", "t.bi", "t.bj")

    def tile(t: pa.Table) -> pa.Table:
        o = np.argsort(t["vec_id"].to_numpy())
        ids, x, b = t["vec_id"].to_numpy()[o], rows_of(t["embedding"])[o], t["b"].to_numpy()[o]
        i, j = np.triu_indices(len(ids), 1)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            m = b[i] != b[j]
            i, j = i[m], j[m]
        d = np.empty(len(i))
        for s in range(0, len(i), 65536):
            z = x[i[s : s + 65536]] - x[j[s : s + 65536]]
            d[s : s + 65536] = np.einsum("ij,ij->i", z, z)
        return pa.table({"i": ids[i], "j": ids[j], "d": d})

    return t.groupBy("bi", "bj").applyInArrow(tile, "i long, j long, d double")


