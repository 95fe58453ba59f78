"""Most similar vectors by robust-pruned directed graphs, one per shard.

Cells are fitted on a bounded sample; a cell with more vectors than a graph should hold is divided by centres of its
own, so every shard is a region of space. A shard's graph is stored as one row per vector (its vector and its edges).
Queries go to shards: first to the one they fall into; the k-th distance found then names, by the planes between
centres, the other shards that can hold a nearer vector, and the nearest of those (``PROBES``) are searched too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.graph_index import build, search
from vecloom.llm.vectors import Shards, fit_shards, fold_groups, matrix
from vecloom.session import drop, pin

SHARD = 8192  # vectors a graph should hold
BLOCK = 16_384  # queries of one task
PROBES = 64  # shards searched for a query besides its own, nearest first, where the planes leave more open
WIDTH = 64  # beam of a search, besides BEAM_PER_K for each neighbour sought
BEAM_PER_K = 4
NEAR = "found array<struct<d: double, id: long>>, more array<int>"
GRAPH = f"shard int, rep long, vec binary, copies array<long>, links binary, entry int, {NEAR}"


def _build(table: pa.Table, dim: int, each: int, shards: Shards, sizes: np.ndarray) -> pa.Table:
    """The graph of one shard, a row per vector in the order of ``rep``: links are positions, entry its turn as entry
    point. With ``each`` it also gives the ``each`` nearest of every vector of the shard."""
    table = table.sort_by("rep")  # the same graph whatever order the rows arrive in
    x = matrix(table["vec"], dim)
    n = len(x)
    nbr, entry = build(x - x.mean(0))
    turn = np.full(n, -1, np.int32)
    turn[entry[::-1]] = np.arange(len(entry), dtype=np.int32)[::-1]
    width = nbr.shape[1] * 4
    links = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(nbr.astype(np.int32).tobytes())])
    k = np.full(n if each else 0, each)
    ids, ds = _nearest(x, table["rep"].to_numpy(), table["copies"], nbr, entry, x[: len(k)], each)
    found, more = _lists(ids, ds, k, x[: len(k)], shards, sizes) if each else (pa.array([None] * n, FOUND), pa.array([None] * n, pa.list_(pa.int32())))
    return pa.table({"shard": table["shard"].cast(pa.int32()), "rep": table["rep"], "vec": table["vec"], "copies": table["copies"], "links": links, "entry": pa.array(turn), "found": found, "more": more})


FOUND = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))


def _place(it: Iterator[pa.RecordBatch], shards: Shards, dim: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        x = matrix(b.column("vec"), dim)
        h = [shards.home(x[a : a + 1024]) for a in range(0, len(x), 1024)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(h) if h else np.empty(0), pa.int32())], names=[*b.schema.names, "shard"])


class Index:
    """Folded vectors and the graphs of their shards; with ``each`` also the ``each`` nearest of every folded vector.

    Of a group of copies at most ``most`` keys are results: the smallest; they stand beside the vector in its graph.
    """

    def __init__(self, vectors: DataFrame, key: str, dim: int, most: int, each: int = 0):
        self.dim, self.each = dim, each
        self.reps, self.groups = fold_groups(vectors, key)
        self.key = key
        # the group limit runs before the shuffle, so a hot group stays small
        w = Window.partitionBy("rep").orderBy(key)
        few = self.groups.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
        copies = pin(few.groupBy(F.col("rep").alias("crep")).agg(F.sort_array(F.collect_list(key)).alias("copies")))
        self.shards = shards = fit_shards(self.reps, dim, SHARD)
        rows = pin(self.reps.mapInArrow(partial(_place, shards=shards, dim=dim), "rep long, vec binary, shard int"))
        whole = rows.join(copies, F.col("rep") == F.col("crep"), "left").drop("crep")
        self.sizes = sizes = np.zeros(shards.n, np.int64)
        for r in rows.groupBy("shard").count().collect():  # at most MOST_SHARDS
            sizes[r[0]] = r[1]
        self.graphs = pin(whole.groupBy("shard").applyInArrow(lambda t: _build(t, dim, each, shards, sizes), GRAPH))
        drop(rows)

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        """queries (q, k, vec) to (q, near): the k nearest keys found of each query, as an array of (d, id) by d and id.

        ``most`` is the largest k. A query whose k-th place is not filled keeps searching until enough shards are met.
        """
        q = queries.select(F.col("q").cast("long"), F.col("k").cast("int"), "vec")
        q = pin(q.mapInArrow(partial(_place, shards=self.shards, dim=self.dim), "q long, k int, vec binary, shard int"))
        return self._further(pin(self._pass(q, most, True)), q, most)

    def nearest_of_each(self) -> DataFrame:
        """(q, near) for every folded vector q: the ``each`` nearest keys found, its own among them."""
        near = self.graphs.select(F.col("rep").alias("q"), F.lit(self.each).alias("k"), "found", "more")
        return self._further(near, self.graphs.select(F.col("rep").alias("q"), "vec"), self.each)

    def _further(self, near: DataFrame, q: DataFrame, most: int) -> DataFrame:
        done = near.where(F.size("more") == 0).select("q", F.col("found").alias("near"))
        open_ = near.where(F.size("more") > 0)
        more = open_.select("q", "k", F.explode("more").alias("shard"))
        if not more.limit(1).count():
            return done
        vec = q.select(F.col("q").alias("vq"), "vec")
        more = pin(more.join(vec, F.col("q") == F.col("vq")).select("q", "k", "vec", "shard"))
        both = open_.select("q", "k", "found").unionByName(self._pass(more, most, False).select("q", "k", "found"))
        # a query has at most PROBES more lists, or as many as it takes to fill its places
        lists = both.groupBy("q", "k").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("near"))
        return done.unionByName(lists.select("q", F.slice("near", F.lit(1), F.col("k")).alias("near")))

    def _pass(self, q: DataFrame, most: int, route: bool) -> DataFrame:
        """One search of each query in the shard it is sent to. Only shards that are asked travel; one that very many
        queries ask travels once for each ``BLOCK`` of them."""
        blocks = q.groupBy(F.col("shard").alias("bs")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
        blocks = F.broadcast(blocks)  # at most MOST_SHARDS rows of two numbers
        g = self.graphs.join(blocks, F.col("shard") == F.col("bs")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        q = q.join(blocks, F.col("shard") == F.col("bs")).withColumn("block", F.pmod(F.xxhash64("q"), F.col("nb")).cast("int"))
        keys = ["shard", "block"]
        g, q = g.select(*keys, "rep", "vec", "copies", "links", "entry"), q.select(*keys, "q", "k", "vec")
        schema = f"q long, k int, {NEAR}"
        dim, shards, sizes = self.dim, self.shards if route else None, self.sizes
        return g.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, dim, most, shards, sizes), schema)


def _nearest(v: np.ndarray, reps: np.ndarray, copies: pa.ChunkedArray, nbr: np.ndarray, entry: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest keys found in a graph for each row of ``x``: (keys, squared L2 in double), -1 and infinity for none."""
    n, m = len(v), len(x)
    ids, ds = np.full((m, most), -1, np.int64), np.full((m, most), np.inf)
    if not m or not n:
        return ids, ds
    mid = v.mean(0)
    at, _ = search(v - mid, nbr, entry, x - mid, most, WIDTH + BEAM_PER_K * most)
    ok = at < n
    for a in range(0, m, 512):  # exact distances, so that results of different shards compare
        o = ok[a : a + 512]
        diff = v[np.where(o, at[a : a + 512], 0)].astype(np.float64) - x[a : a + 512, None].astype(np.float64)
        ds[a : a + 512] = np.where(o, np.einsum("ijk,ijk->ij", diff, diff), np.inf)
    ids = np.where(ok, np.append(reps, -1)[at], -1)
    o = np.lexsort((ids, ds), axis=1)
    ids, ds, at = np.take_along_axis(ids, o, 1), np.take_along_axis(ds, o, 1), np.take_along_axis(at, o, 1)
    several = {k: z for k, z in enumerate(copies.to_pylist()) if z} if copies.null_count < n else {}
    if several:
        shared = np.append(np.isin(np.arange(n), list(several)), False)
        for r in np.flatnonzero(shared[at].any(1)):
            every = sorted((d, key) for d, p in zip(ds[r].tolist(), at[r].tolist()) if p < n for key in several.get(p) or (int(reps[p]),))[:most]
            ids[r, : len(every)] = [z[1] for z in every]
            ds[r, : len(every)] = [z[0] for z in every]
    return ids, ds


def _lists(ids: np.ndarray, ds: np.ndarray, k: np.ndarray, x: np.ndarray, shards: Shards | None, sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """What each query found, and the other shards that can hold something nearer."""
    m, most = ds.shape
    full = np.isfinite(ds) & (np.arange(most)[None] < k[:, None])
    lens = full.sum(1)
    off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(ds[full]), pa.array(ids[full])], ["d", "id"]))
    more: list[np.ndarray] = [np.empty(0, np.int32)] * m
    if shards is not None and m:
        last = np.where(lens >= k, np.sqrt(ds[np.arange(m), np.clip(k, 1, most) - 1]), np.inf)
        step = max(16, (1 << 21) // shards.n)
        for a in range(0, m, step):
            part = x[a : a + step]
            f, h = shards.far(part), shards.home(part)
            f[np.arange(len(h)), h] = np.inf
            f[:, sizes == 0] = np.inf
            for r in np.flatnonzero((f <= last[a : a + step, None]).any(1)):
                c = np.flatnonzero(np.isfinite(f[r]) & (f[r] <= last[a + r]))
                c = c[np.argsort(f[r, c], kind="stable")]
                enough = int(np.searchsorted(np.cumsum(sizes[c]), k[a + r] - lens[a + r])) + 1 if lens[a + r] < k[a + r] else 0
                more[a + r] = c[: max(PROBES, enough)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(z) for z in more])]).astype(np.int32)), pa.array(np.concatenate([*more, np.empty(0, np.int32)])))
    return found, lists


def _search(graph: pa.Table, queries: pa.Table, dim: int, most: int, shards: Shards | None, sizes: np.ndarray) -> pa.Table:
    x, n = matrix(queries["vec"], dim), graph.num_rows
    graph = graph.sort_by("rep")
    nbr = np.frombuffer(b"".join(graph["links"].to_pylist()), np.int32).reshape(n, -1).astype(np.int64) if n else np.empty((0, 0), np.int64)
    turn = graph["entry"].to_numpy()
    entry = np.flatnonzero(turn >= 0)
    entry = entry[np.argsort(turn[entry])]
    ids, ds = _nearest(matrix(graph["vec"], dim), graph["rep"].to_numpy(), graph["copies"], nbr, entry, x, most)
    found, more = _lists(ids, ds, queries["k"].to_numpy(), x, shards, sizes)
    return pa.table({"q": queries["q"], "k": queries["k"], "found": found, "more": more})


def most_similar(vectors: DataFrame, key: str, queries: DataFrame, dim: int, own: bool = True, most: int | None = None) -> DataFrame:
    """(q, key, rank, d): the k nearest vectors of each query by squared L2, ties to the smaller key.

    ``vectors``: key, vec (see ``vectors.usable``); ``queries``: q (unique), k, vec and, if ``own``, self: a key that
    is left out of that query's result (may be null). Copies under other keys are results like any other. Queries with
    k < 1 have no rows; k above the number of vectors gives all of them. Empty tables give no rows. ``most``: the
    largest k, if known.
    """
    queries = queries.where(F.col("k") > 0)
    if most is None:
        most = queries.agg(F.max("k")).first()[0] or 1
    index = Index(vectors, key, dim, most + 1)
    near = index.search(queries.select("q", (F.col("k") + 1).alias("k"), "vec"), most + 1)
    mine = queries.select(F.col("q").alias("qq"), F.col("k").alias("qk"), (F.col("self") if own else F.lit(None).cast("long")).alias("qs"))
    j = near.join(mine, F.col("q") == F.col("qq"))
    others = F.filter("near", lambda z: F.col("qs").isNull() | (z["id"] != F.col("qs")))
    return _ranked(j.select("q", F.slice(others, F.lit(1), F.col("qk")).alias("near")), key)


def _ranked(near: DataFrame, key: str) -> DataFrame:
    r = near.select("q", F.posexplode("near").alias("pos", "n"))
    return r.select("q", F.col("n.id").alias(key), (F.col("pos") + 1).alias("rank"), "n.d")


def nearest_of_each(vectors: DataFrame, key: str, dim: int, k: int) -> DataFrame:
    """(q, key, rank, d): the k nearest other vectors of every vector (key, vec), ties to the smaller key.

    Every graph answers its own vectors where it is built. Copies share one search; each leaves itself out. Null keys
    have no rows, fewer than two vectors give none.
    """
    index = Index(vectors, key, dim, k + 1, k + 1)
    near = index.nearest_of_each()
    again = index.groups.where(F.col(key) != F.col("rep")).select(F.col(key).alias("own"), F.col("rep").alias("of"))
    near = near.select(F.col("q").alias("own"), "near").unionByName(near.join(again, F.col("q") == F.col("of")).select("own", "near"))
    others = F.filter("near", lambda z: z["id"] != F.col("own"))
    return _ranked(near.select(F.col("own").alias("q"), F.slice(others, 1, k).alias("near")), key)
