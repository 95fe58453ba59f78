"""Projection to two dimensions: fuzzy neighbour graph, a small network trained on it, and its application.

Neighbours are the k nearest other vectors; rho, sigma and the union of directed weights are those of the published
UMAP method; the network (linear layers with ReLU between them) minimises the fuzzy cross-entropy with Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions.blocks import rows_of
from vecloom.operators.knn import knn_graph
from vecloom.operators.mst import clean
from vecloom.session import pin

A, B = 1.0, 1.5  # shape of the low-dimensional similarity 1 / (1 + A * d^(2 B))
BUFFER = 4096  # vectors of one training set: a bounded sample
BATCH = 1152


class ModelNotInitialized(RuntimeError):
    """The projection was asked for before it was trained."""


def fuzzy_weights(near: DataFrame) -> DataFrame:
    """(i, j, w) from neighbour lists (i, j, d): w = exp(-(d - rho) / sigma), rho the nearest distance and sigma such
    that the weights of i sum to log2(k). A list is small (k rows); lists are solved together per batch of tasks."""

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            d = [np.asarray(x, float) for x in b.column("d").to_pylist()]
            w = [_weights(x) for x in d]
            n = np.array([len(x) for x in d])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("i").to_numpy(), n)), pa.array(np.concatenate([np.asarray(j, np.int64) for j in b.column("j").to_pylist()])), pa.array(np.concatenate(w))], names=["i", "j", "w"])

    lists = near.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("x")).select("i", F.transform("x", lambda z: z["d"]).alias("d"), F.transform("x", lambda z: z["j"]).alias("j"))
    return lists.mapInArrow(solve, "i long, j long, w double")


def _weights(d: np.ndarray) -> np.ndarray:
    rho, goal = d.min(), np.log2(max(len(d), 2))
    lo, hi, s = 0.0, np.inf, 1.0
    for _ in range(64):
        total = np.exp(-np.maximum(d - rho, 0) / s).sum()
        if abs(total - goal) < 1e-9:
            break
        if total > goal:
            hi = s
            s = (lo + hi) / 2
        else:
            lo = s
            s = s * 2 if hi == np.inf else (lo + hi) / 2
    return np.exp(-np.maximum(d - rho, 0) / max(s, 1e-12))


def fuzzy_union(weights: DataFrame) -> DataFrame:
    """(i, j, w), i < j: a + b - a * b of the two directed weights, 0 for a missing one; only w > 0 is kept."""
    w = weights.groupBy("i", "j").agg(F.max("w").alias("w"))
    side = F.when(F.col("i") < F.col("j"), F.col("w")).otherwise(F.lit(0.0))
    back = F.when(F.col("i") > F.col("j"), F.col("w")).otherwise(F.lit(0.0))
    g = w.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max(side).alias("a"), F.max(back).alias("b"))
    return g.select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w")).where("w > 0")


def training_batches(meta: DataFrame, capacity: int = BATCH) -> DataFrame:
    """(partition_id, size, batch, room): partitions fill batches of at most ``capacity`` vectors; ``room`` is what a
    batch leaves free and is padded with (``padded``).

    A partition that would overflow a batch opens the next one; one that alone exceeds the capacity is divided: its full
    batches and its rest are rows of their own. Partitions are dealt by a hash to groups of about 64 batches, each
    filled in one task in the order of a second hash, so no table is sorted as a whole and all but the last batch of a
    group are closed by the partition that did not fit. Null, zero and negative sizes have no place.
    """
    m = meta.where((F.col("size") > 0) & F.col("partition_id").isNotNull()).groupBy(F.col("partition_id").cast("long").alias("partition_id")).agg(F.max(F.col("size").cast("long")).alias("size"))
    total = m.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // (64 * capacity)))
    m = m.withColumn("g", F.pmod(F.xxhash64("partition_id"), F.lit(groups)).cast("int")).withColumn("h", F.xxhash64(F.lit(3), "partition_id"))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("partition_id", "ascending")])
        g, out, n, used = t["g"][0].as_py(), [], 0, 0
        for p, size in zip(t["partition_id"].to_pylist(), t["size"].to_pylist()):
            while size > 0:
                take = min(size, capacity)
                if used + take > capacity:
                    n, used = n + 1, 0
                out.append((p, take, n))
                used, size = used + take, size - take
        part, take, batch = (np.array(z, np.int64) for z in zip(*out))
        held = np.bincount(batch, take).astype(np.int64)
        return pa.table({"partition_id": part, "size": take, "batch": [f"{g}-{k}" for k in batch], "room": capacity - held[batch]})

    return m.groupBy("g").applyInArrow(fill, "partition_id long, size long, batch string, room long")


def padded(members: DataFrame, batches: DataFrame, dim: int, capacity: int = BATCH) -> DataFrame:
    """(batch, pos, vec_id, embedding): the vectors of each batch, filled up to ``capacity`` with rows of zeros whose
    vec_id is null. members: vec_id, embedding, partition_id; the members of a divided partition follow its rows in the
    order of their ids."""
    w = Window.partitionBy("partition_id").orderBy("batch")
    upto = F.sum("size").over(w)
    b = batches.select("partition_id", "batch", "size", upto.alias("to"), (upto - F.col("size")).alias("from")).withColumnRenamed("partition_id", "bp")
    m = clean(members).join(members.select("vec_id", F.col("partition_id").cast("long").alias("partition_id")).dropDuplicates(["vec_id"]), "vec_id")
    m = m.withColumn("n", F.row_number().over(Window.partitionBy("partition_id").orderBy("vec_id")))
    real = m.join(b, (F.col("partition_id") == F.col("bp")) & (F.col("n") > F.col("from")) & (F.col("n") <= F.col("to")))
    real = real.select("batch", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    short = real.groupBy("batch").count().where(F.col("count") < capacity)
    pad = short.select("batch", F.explode(F.sequence(F.lit(1), (F.lit(capacity) - F.col("count")).cast("int"))).alias("k")).select("batch", F.lit(None).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.0), dim).alias("embedding"))
    every = real.unionByName(pad)
    pos = F.row_number().over(Window.partitionBy("batch").orderBy(F.col("vec_id").asc_nulls_last()))
    return every.withColumn("pos", pos).select("batch", "pos", "vec_id", "embedding")


def mini_batches(near: DataFrame, others: DataFrame, anchors: int = 16, strangers: int = 8, seed: int = 7) -> DataFrame:
    """(batch, anchor, other, w): training pairs in batches of about ``anchors`` anchors, each with its neighbours (w from
    ``near``: i, j, w) and up to ``strangers`` others that are none of them (w = 0). others: vec_id.

    Anchors are dealt to batches by a hash, so every vector with a neighbour is an anchor once; strangers are the members
    of the batch dealt next. Nothing is sorted as a whole.
    """
    both = near.select("i", "j", "w").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    both = pin(both)
    n = max(1, -(-both.select("i").distinct().count() // anchors))
    deal = lambda c, salt: F.pmod(F.xxhash64(F.lit(seed + salt), c), F.lit(n)).cast("int")
    pairs = both.select(deal("i", 0).alias("batch"), F.col("i").alias("anchor"), F.col("j").alias("other"), "w")
    pool = others.select(F.col("vec_id").alias("other"), deal("vec_id", 1).alias("pb"))
    rank = F.row_number().over(Window.partitionBy("pb").orderBy(F.xxhash64(F.lit(seed), "other"), "other"))
    pool = pool.withColumn("rn", rank).where(F.col("rn") <= strangers)
    far = pairs.select("batch", "anchor").distinct().join(pool, F.col("batch") == F.col("pb")).where(F.col("anchor") != F.col("other")).select("batch", "anchor", "other")
    known = both.select(F.col("i").alias("ki"), F.col("j").alias("kj"))
    far = far.join(known, (F.col("anchor") == F.col("ki")) & (F.col("other") == F.col("kj")), "left_anti")
    return pairs.unionByName(far.withColumn("w", F.lit(0.0)))


class Projection:
    """A network dim -> 16 -> 16 -> 2. ``fit`` trains on a bounded sample; ``transform`` runs in Arrow batches."""

    def __init__(self, dim: int, hidden: int = 16, out: int = 2, seed: int = 11):
        rng = np.random.default_rng(seed)
        s = [dim, hidden, hidden, out]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(s, s[1:])]
        self.b = [np.zeros(b) for b in s[1:]]
        self.fitted, self.losses = False, []
        self.seed = seed

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            if k < len(self.w) - 1:
                x = np.maximum(x, 0)
            acts.append(x)
        return acts

    def fit(self, vectors: DataFrame, k: int = 10, epochs: int = 60, rate: float = 0.01) -> Projection:
        """Train, or train further, on at most about ``BUFFER`` vectors (chosen by hash); fewer than 6 raise."""
        v = clean(vectors)
        n = v.count()
        if n <= 5:
            raise ModelNotInitialized("too few vectors to train on")
        share = int(min(1.0, BUFFER / n) * (1 << 20))
        part = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share) if n > BUFFER else v
        rows = part.orderBy("vec_id").collect()
        ids = {r["vec_id"]: p for p, r in enumerate(rows)}
        x = np.array([r["embedding"] for r in rows], np.float64)
        e = fuzzy_union(fuzzy_weights(knn_graph(part, k).select("i", "j", "d"))).collect()
        i, j, w = (np.array(z) for z in zip(*[(ids[r[0]], ids[r[1]], r[2]) for r in e]))
        rng = np.random.default_rng(self.seed)
        m = [np.zeros_like(p) for p in self.w + self.b]
        s = [np.zeros_like(p) for p in self.w + self.b]
        t = 0
        for _ in range(epochs):
            total = 0.0
            for c in np.array_split(rng.permutation(len(i)), max(1, len(i) // 1024)):
                u = np.concatenate([i[c], i[c]])
                v2 = np.concatenate([j[c], rng.integers(0, len(x), len(c))])
                p = np.concatenate([w[c], np.zeros(len(c))])
                ok = u != v2
                u, v2, p = u[ok], v2[ok], p[ok]
                nodes, pos = np.unique(np.concatenate([u, v2]), return_inverse=True)
                acts = self.forward(x[nodes])
                y = acts[-1]
                a, b = pos[: len(u)], pos[len(u) :]
                diff = y[a] - y[b]
                d2 = (diff**2).sum(1) + 1e-6
                q = 1 / (1 + A * d2**B)
                q = np.clip(q, 1e-6, 1 - 1e-6)
                total += float(-(p * np.log(q) + (1 - p) * np.log(1 - q)).mean())
                dq = (q - p) / (q * (1 - q)) / len(u)
                g = (dq * -(q**2) * A * B * d2 ** (B - 1))[:, None] * 2 * diff
                g = np.clip(g, -1, 1)
                grad = np.zeros_like(y)
                np.add.at(grad, a, g)
                np.add.at(grad, b, -g)
                gw, gb = [], []
                for k2 in range(len(self.w) - 1, -1, -1):
                    gw.insert(0, acts[k2].T @ grad)
                    gb.insert(0, grad.sum(0))
                    if k2:
                        grad = (grad @ self.w[k2].T) * (acts[k2] > 0)
                t += 1
                for idx, (par, gr) in enumerate(zip(self.w + self.b, gw + gb)):
                    m[idx] = 0.9 * m[idx] + 0.1 * gr
                    s[idx] = 0.999 * s[idx] + 0.001 * gr**2
                    par -= rate * (m[idx] / (1 - 0.9**t)) / (np.sqrt(s[idx] / (1 - 0.999**t)) + 1e-8)
            self.losses.append(total)
        self.fitted = True
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(vec_id, x, y)."""
        if not self.fitted:
            raise ModelNotInitialized("fit the projection first")
        return clean(vectors).mapInArrow(partial(_apply, model=self), "vec_id long, x double, y double")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The layers as a table of one row each (layer, shape, value), to be stored like any other."""
        rows = [(k, list(p.shape), [float(v) for v in p.ravel()]) for k, p in enumerate(self.w + self.b)]
        return spark.createDataFrame(rows, "layer int, shape array<int>, value array<double>")

    def of_rows(self, rows: DataFrame) -> Projection:
        parts = [np.array(r["value"]).reshape(r["shape"]) for r in rows.orderBy("layer").collect()]
        self.w, self.b, self.fitted = parts[: len(parts) // 2], parts[len(parts) // 2 :], True
        return self


def _apply(it: Iterator[pa.RecordBatch], model: Projection) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            y = model.forward(rows_of(pa.Table.from_batches([b])["embedding"]))[-1]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["vec_id", "x", "y"])
