"""The engine as one object: insert, update, delete, search, read, cluster, project, over a versioned store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import graph, knn, mst, partitions
from vecloom.operators.clusters import ClusterSets
from vecloom.operators.projection import ModelNotInitialized, Projection
from vecloom.session import pin, ship
from vecloom.sources.store import KEYS, Delta, Store, Trace, difference
from vecloom.streaming import ingest

IDS, VECTORS, BOTH = "ids", "vectors", "both"
SETS = "threshold double, vec_id long, cluster_id long"


class Engine:
    """Every read runs on the newest version of the store; writes make new versions, so readers are never blocked.

    Vectors, tree, partitions, their metadata, cluster sets and the trained projection are all in the store: an engine
    opened on the same path goes on where the last one stopped. ``with engine.transaction():`` makes one version of all
    the commands in it, which see each other's results; an error leaves the store as it was, ``undo`` takes all back.
    """

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.store, self.trace = spark, Store(spark, path), Trace()
        self._pending: dict[str, DataFrame | Delta] | None = None
        self._forget()

    def _forget(self) -> None:
        self._clusters: ClusterSets | None = None
        self._projection: Projection | None = None
        self._touched: DataFrame | None = None

    # tables
    def _has(self, name: str) -> bool:
        return name in (self._pending or {}) or self.store.has(name)

    def _read(self, name: str) -> DataFrame:
        waiting = (self._pending or {}).get(name)
        if isinstance(waiting, DataFrame):
            return waiting
        df = self.store.read(name)
        return df if waiting is None else waiting.on(df, KEYS[name])

    def _write(self, tables: dict[str, DataFrame | Delta]) -> None:
        if self._pending is None:
            self.store.write(tables)
            return
        for name, t in tables.items():
            if isinstance(t, Delta):
                t = Delta(*(None if d is None else pin(d) for d in (t.added, t.removed)))
                was = self._pending.get(name)
                t = t if was is None else was.then(t, KEYS[name]) if isinstance(was, Delta) else t.on(was, KEYS[name])
            self._pending[name] = t if isinstance(t, Delta) else pin(t)

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """All commands within become one version, or none if one of them fails."""
        if self._pending is not None:
            raise RuntimeError("a transaction is open already")
        self._pending = {}
        try:
            yield self
            tables, self._pending = self._pending, None
            if tables:
                self.store.write(tables)
        except BaseException:
            self._pending = None
            self._forget()
            raise

    # writes
    def insert(self, batch: DataFrame) -> None:
        with self.trace.span("insert"):
            if not self._has("vectors"):
                self._changed(ingest.first(batch), None)
            else:
                centres = self._read("partition_meta").select("partition_id", "centroid")
                self._changed(*ingest.changes(self.vectors(), self._read("mst_edges"), self._read("membership"), centres, batch))

    def delete(self, ids: DataFrame) -> None:
        """Unknown ids change nothing. Partitions that the deletion cuts are divided into their trees."""
        with self.trace.span("delete"):
            v, t, m = self.vectors(), self._read("mst_edges").select("src", "dst", "weight"), self._read("membership")
            gone = pin(ids.select("vec_id").distinct().join(v.select("vec_id"), "vec_id", "left_semi"))
            if not gone.limit(1).count():
                return
            tree = pin(mst.delete(t, v, gone))
            touched = pin(m.join(gone, "vec_id", "left_semi").select("partition_id").distinct())
            left = m.join(gone, "vec_id", "left_anti").select("vec_id", "partition_id")
            rest = v.select("vec_id", "embedding").join(gone, "vec_id", "left_anti")
            moved = pin(ingest.upkeep(rest, left, tree, touched))
            edges = difference(t, tree, KEYS["mst_edges"])
            member = Delta(moved, gone.unionByName(moved.select("vec_id")))
            ends = lambda d: d.select(F.explode(F.array("src", "dst")).alias("vec_id"))
            ids = gone.unionByName(moved.select("vec_id")).unionByName(ends(edges.added)).unionByName(ends(edges.removed))
            about = ingest.meta_of(rest, m.select("vec_id", "partition_id"), member.on(m.select("vec_id", "partition_id"), ["vec_id"]), tree, ids)
            self._changed({"vectors": Delta(None, gone), "mst_edges": edges, "membership": member, "partition_meta": about}, touched)

    def update(self, batch: DataFrame) -> None:
        """New vectors for known ids: deleted and inserted again as one transaction. Unknown ids are inserted."""
        if self._pending is not None:
            self.delete(batch)
            self.insert(batch)
            return
        with self.transaction():
            self.delete(batch)
            self.insert(batch)

    def undo(self) -> None:
        """Take back the last command or transaction as a whole."""
        self.store.undo()
        self._forget()

    def split(self, strategy: partitions.Strategy, partition: int) -> None:
        """Divide one partition: side 0 keeps its id, side 1 takes the next free one."""
        m = self.members().where(F.col("partition_id") == partition)
        s = partitions.split(m, self.edges(), strategy)
        new = self._read("membership").agg(F.max("partition_id")).first()[0] + 1
        self._moved(pin(s.where("side = 1").select("vec_id", F.lit(new).cast("long").alias("partition_id"))))

    def merge(self, sink: int, source: int) -> None:
        """Raises Overflow or NotConnected, and changes nothing then."""
        m = self._read("membership")
        now = partitions.merge(m, self.edges(), sink, source)
        self._moved(pin(now.join(m.where(F.col("partition_id") == source).select("vec_id"), "vec_id", "left_semi")))

    def _moved(self, moved: DataFrame) -> None:
        """Members (vec_id, partition_id) that go to another partition."""
        m, member = self._read("membership").select("vec_id", "partition_id"), Delta(moved, moved.select("vec_id"))
        about = ingest.meta_of(self.vectors(), m, member.on(m, ["vec_id"]), self._read("mst_edges"), moved)
        self._changed({"membership": member, "partition_meta": about}, None)

    def _changed(self, tables: dict[str, DataFrame | Delta], touched: DataFrame | None) -> None:
        """Write what a command changes, and with it the cluster sets that follow from that."""
        sets = self._thresholds() if "mst_edges" in tables else []
        own = self._pending is None
        if own:
            self._pending = {}
        try:
            self._write(tables)
            if sets:
                c = ClusterSets(self._nodes(), self._read("mst_edges"))
                for t in sets:
                    c.create(t)
                # only rows that differ are written
                self._write({n: difference(self._read(n), pin(d), KEYS[n]) for n, d in self._cluster_tables(c).items()})
                self._clusters = c
            elif "mst_edges" in tables:
                self._clusters = None
            if own:
                waiting, self._pending = self._pending, None
                self.store.write(waiting)
        except BaseException:
            if own:
                self._pending = None
                self._forget()
            raise
        if touched is not None:
            self._touched = touched if self._touched is None else self._touched.unionByName(touched)

    # reads
    def vectors(self) -> DataFrame:
        return self._read("vectors")

    def members(self) -> DataFrame:
        return self.vectors().join(self._read("membership"), "vec_id")

    def edges(self) -> DataFrame:
        return graph.with_partitions(self._read("mst_edges"), self._read("membership"))

    def _nodes(self) -> DataFrame:
        return self.vectors().select(F.col("vec_id").alias("node"))

    def get(self, vector: int | None = None, partition: int | None = None, cluster: int | None = None, threshold: float | None = None, show: str = BOTH, dims: int | None = None) -> DataFrame:
        """Vectors of one source: a vector, a partition, a cluster of a threshold, or everything. Unknown ids and
        thresholds raise KeyError. ``dims``: 2 gives the projection instead of the vector."""
        v = self.vectors()
        if vector is not None:
            v = v.where(F.col("vec_id") == vector)
        elif partition is not None:
            v = self.members().where(F.col("partition_id") == partition).select("vec_id", "embedding")
        elif threshold is not None:
            c = self.cluster_sets().get(threshold)
            if cluster is not None:
                c = c.where(F.col("cluster_id") == cluster)
            v = v.join(c.select("vec_id"), "vec_id", "left_semi")
        if (vector, partition, cluster) != (None, None, None) and not v.limit(1).count():
            raise KeyError((vector, partition, cluster))
        if dims is not None:
            return self.projection().transform(v)
        return v.select({IDS: ["vec_id"], VECTORS: ["embedding"], BOTH: ["vec_id", "embedding"]}[show])

    def knn(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        return knn.knn(self.vectors(), query, k, where=where)

    def knn_many(self, queries: DataFrame, k: int) -> DataFrame:
        return knn.knn_batch(self.vectors(), queries, k)

    def partition_meta(self, partition: int | None = None) -> DataFrame:
        """(partition_id, size, centroid, min_edge, max_edge) as stored; KeyError for an unknown partition."""
        m = self._read("partition_meta")
        if partition is None:
            return m
        m = m.where(F.col("partition_id") == partition)
        if not m.limit(1).count():
            raise KeyError(partition)
        return m

    def neighbours(self, partition: int | None = None) -> DataFrame:
        """(src, dst): partitions whose projected centroids are Delaunay neighbours in the plane."""
        c = self.partition_meta().select(F.col("partition_id").alias("vec_id"), F.col("centroid").alias("embedding"))
        d = partitions.delaunay(self.projection().transform(c).withColumnRenamed("vec_id", "id"))
        return d if partition is None else d.where((F.col("src") == partition) | (F.col("dst") == partition))

    def vector_meta(self, vector: int) -> DataFrame:
        """(vec_id, dim, partition_id, threshold, cluster_id): where a vector belongs, in every cluster set."""
        v = self.members().where(F.col("vec_id") == vector).select("vec_id", F.size("embedding").alias("dim"), "partition_id")
        if not v.limit(1).count():
            raise KeyError(vector)
        if not self._thresholds():
            return v.withColumn("cluster_id", F.lit(None).cast("long")).withColumn("threshold", F.lit(None).cast("double"))
        return v.join(self._read("cluster_membership"), "vec_id")

    # clusters
    def _thresholds(self) -> list[float]:
        """One row per cluster set, of which a user makes a handful."""
        return sorted(r[0] for r in self._read("cluster_meta").select("threshold").distinct().collect()) if self._has("cluster_meta") else []

    def cluster_sets(self) -> ClusterSets:
        if self._clusters is None:
            c = ClusterSets(self._nodes(), self._read("mst_edges"))
            if self._has("cluster_membership"):
                m = self._read("cluster_membership")
                c.sets = {t: m.where(F.col("threshold") == F.lit(t)).select("vec_id", "cluster_id") for t in self._thresholds()}
            self._clusters = c
        return self._clusters

    def _cluster_tables(self, c: ClusterSets) -> dict[str, DataFrame | Delta]:
        rows = None
        for t, s in c.sets.items():
            d = s.select(F.lit(t).alias("threshold"), "vec_id", "cluster_id")
            rows = d if rows is None else rows.unionByName(d)
        m = rows.join(self.vectors(), "vec_id")
        centre = partitions.centroids(m.select(F.struct("threshold", "cluster_id").alias("partition_id"), "embedding"))
        centre = centre.select("partition_id.threshold", "partition_id.cluster_id", "centroid")
        meta = rows.groupBy("threshold", "cluster_id").agg(F.count(F.lit(1)).alias("size")).join(centre, ["threshold", "cluster_id"])
        return {"cluster_membership": rows, "cluster_meta": meta}

    def create_cluster_set(self, threshold: float) -> DataFrame:
        with self.trace.span("create clusters"):
            c = self.cluster_sets()
            new = threshold not in c.sets
            out = c.create(threshold)
            if new:
                self._write(self._cluster_tables(c))
            return out

    def clusters(self, threshold: float) -> DataFrame:
        return self.cluster_meta(threshold).select("cluster_id", "size")

    def cluster_meta(self, threshold: float, cluster: int | None = None, members: bool = False) -> DataFrame:
        """(cluster_id, size, centroid) of the clusters of a set or of one of them; ``members``: also their ids as rows
        (cluster_id, size, centroid, vec_id). KeyError for an unknown threshold or cluster."""
        self.cluster_sets().get(threshold)
        m = self._read("cluster_meta").where(F.col("threshold") == F.lit(threshold)).select("cluster_id", "size", "centroid")
        if cluster is not None:
            m = m.where(F.col("cluster_id") == cluster)
            if not m.limit(1).count():
                raise KeyError(cluster)
        return m.join(self.cluster_sets().get(threshold), "cluster_id") if members else m

    # projection
    def projection(self) -> Projection:
        """The trained projection. It is trained on first use, and trained further on the partitions that commands have
        touched since; the result is stored."""
        p = self._projection
        if p is None and self._has("projection"):
            p = Projection(1).of_rows(self._read("projection"))
        if p is not None and self._touched is None:
            self._projection = p
            return p
        if p is None:
            one = self.vectors().select(F.size("embedding")).first()
            if one is None:
                raise ModelNotInitialized("no vectors")
            p = Projection(one[0]).fit(self.vectors())
        else:
            near = partitions.expand(self._touched.select("partition_id").distinct(), partitions.neighbours(self.edges()))
            part = pin(self.members().join(near, "partition_id", "left_semi").select("vec_id", "embedding"))
            p.fit(part if part.limit(6).count() > 5 else self.vectors(), epochs=20)
        self._projection, self._touched = p, None
        self._write({"projection": p.rows(self.spark)})
        return p
