"""Queries of the engine's own operators over the whole ``embeddings`` table, with their SQL.

Partitions are the label (column ``label``) or the nearest of eight pivots (vec_id < 8). d is squared L2. Distances,
weights and means are rounded to 6 decimals, since sums in different order differ in the last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.engine import Engine
from vecloom.functions import vectors as vec
from vecloom.operators import clusters as cl
from vecloom.operators import graph, knn, partitions
from vecloom.operators import mst as trees
from vecloom.operators import projection as umap
from vecloom.session import pin, scratch
from vecloom.sources.store import Store
from vecloom.sources.tables import table
from vecloom.streaming import ingest

T1, T2 = 1.3, 1.35
THRESHOLDS = (1.1, 1.2, 1.25, 1.3, 1.35, 1.4)
NEW = 20  # the vectors with the largest ids play the new ones
GONE = (10, 11, 12, 13, 14)
PIVOTS = 8


def _v(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "embedding")


def _query(s: SparkSession, d: str) -> list[float]:
    return list(_v(s, d).where("vec_id = 0").first()["embedding"])


def _r(c: str):
    return F.round(c, 6).alias(c)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("partition_id"))


def _members(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("partition_id"))


def _pivots(s: SparkSession, d: str) -> DataFrame:
    c = _v(s, d).where(F.col("vec_id") < PIVOTS).select(F.col("vec_id").alias("partition_id"), F.col("embedding").alias("centroid"))
    return knn.nearest_partition(_v(s, d), c).select("vec_id", "partition_id")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return trees.mst(_v(s, d))


def _parted(s: SparkSession, d: str) -> DataFrame:
    return pin(graph.with_partitions(_tree(s, d), _labels(s, d)))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return _v(s, d).select(F.col("vec_id").alias("node"))


def _last(s: SparkSession, d: str) -> int:
    return _v(s, d).agg(F.max("vec_id")).first()[0]


def _split_new(s: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame]:
    v, last = _v(s, d), _last(s, d)
    return v.where(F.col("vec_id") <= last - n), v.where(F.col("vec_id") > last - n)


def _lanes(df: DataFrame, value: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(value).alias("pos", "value"))


def _next(s: SparkSession, d: str) -> DataFrame:
    a = _v(s, d).select("vec_id", F.col("embedding").alias("u"))
    return a.join(_v(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w")), "vec_id")


# vector algebra
def vec_add(s, d):
    return _lanes(_next(s, d).select("vec_id", vec.add(F.col("u"), F.col("w")).alias("x")), "x")


def vec_sub(s, d):
    return _lanes(_next(s, d).select("vec_id", vec.sub(F.col("u"), F.col("w")).alias("x")), "x")


def vec_scale(s, d):
    return _lanes(_v(s, d).select("vec_id", vec.scale(F.col("embedding"), 0.5).alias("x")), "x")


def vec_splat(s, d):
    return _lanes(_v(s, d).select("vec_id", vec.splat(1.0, F.size("embedding")).alias("x")), "x")


def vec_extremes(s, d):
    n = _next(s, d)
    return _lanes(n.select("vec_id", F.transform(F.arrays_zip(vec.least_element(F.col("u"), F.col("w")).alias("a"), vec.greatest_element(F.col("u"), F.col("w")).alias("b")), lambda z: z["a"].cast("double") * 2 + z["b"].cast("double")).alias("x")), "x")


def vec_dot(s, d):
    return _v(s, d).select("vec_id", F.round(vec.dot(F.col("embedding"), knn.literal(_query(s, d))), 6).alias("value"))


def vec_sq_dist(s, d):
    return _v(s, d).select("vec_id", F.round(vec.sq_dist(F.col("embedding"), knn.literal(_query(s, d))), 6).alias("value"))


def vec_dim_check(s, d):
    return _v(s, d).select(F.size(vec.checked(F.col("embedding"), 64)).alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


def vec_position(s, d):
    return _v(s, d).select("vec_id", vec.position(F.col("embedding")).alias("p")).select("vec_id", "p.x", "p.y")


def vec_equal(s, d):
    n = _next(s, d)
    return n.select("vec_id", vec.equal(F.col("u"), F.col("w")).alias("same"))


# nearest neighbours
def knn_exact(s, d):
    return knn.knn(_v(s, d), _query(s, d), 10).select("rank", "vec_id", _r("d"))


def knn_batch(s, d):
    v = _v(s, d)
    return knn.knn_batch(v, v.where("vec_id % 20 = 0"), 5).select("query_id", "rank", "vec_id", _r("d"))


def _pivot_meta(s, d):
    members = pin(_v(s, d).join(_pivots(s, d), "vec_id"))
    c = pin(partitions.centroids(members))
    return members, c, pin(knn.radii(members, c))


def knn_partition_pruned(s, d):
    members, c, meta = _pivot_meta(s, d)
    return knn.knn_pruned(members, _query(s, d), 10, c, meta).select("rank", "vec_id", _r("d"))


def knn_approx_nprobe(s, d):
    members, c, _ = _pivot_meta(s, d)
    return knn.knn_probe(members, _query(s, d), 10, c, 2).select("rank", "vec_id", _r("d"))


def nearest_partition(s, d):
    c = pin(partitions.centroids(_members(s, d)))
    return knn.nearest_partition(_v(s, d), c).select("vec_id", "partition_id", _r("d"))


def assign_batch(s, d):
    old, new = _split_new(s, d, NEW)
    near = knn.knn_batch(old, new, 1)
    return near.join(_labels(s, d), "vec_id").select(F.col("query_id").alias("vec_id"), "partition_id")


def pairwise_dist(s, d):
    return knn.pairwise(_v(s, d)).select("i", "j", _r("d"))


def knn_graph(s, d):
    return knn.knn_graph(_v(s, d), 3).select("i", "j", "rank")


# partitions
def partition_centroids(s, d):
    c = partitions.centroids(_members(s, d)).select("partition_id", F.posexplode("centroid").alias("pos", "value"))
    return c.select("partition_id", "pos", _r("value"))


def partition_meta(s, d):
    return partitions.meta(_members(s, d), _parted(s, d)).select("partition_id", "size", _r("min_edge"), _r("max_edge"))


def membership_lookup(s, d):
    ids = _v(s, d).where("vec_id BETWEEN 10 AND 20")
    return partitions.lookup(_pivots(s, d), ids)


def partition_neighbors(s, d):
    return partitions.neighbours(_parted(s, d))


def expand_one_hop(s, d):
    one = s.createDataFrame([(0,)], "partition_id long")
    return partitions.expand(one, partitions.neighbours(_parted(s, d)))


def partition_trail(s, d):
    e = partitions.partition_edges(_parted(s, d))
    return graph.trail(e, 0, 9).select("step", "src", "dst", _r("weight"))


def required_partitions(s, d):
    return partitions.required(partitions.neighbours(_parted(s, d)), [0, 3], 9)


def induced_subgraph(s, d):
    return partitions.induced(_parted(s, d), [0, 1, 2]).select("src", "dst", _r("weight"))


def split_first_tree(s, d):
    return partitions.first_tree(_nodes(s, d), _tree(s, d).where(F.col("weight") < T1)).select("vec_id", "side")


def forest_tree_count(s, d):
    return partitions.tree_count(_nodes(s, d), _tree(s, d).where(F.col("weight") < T1))


def merge_partitions(s, d):
    return partitions.merge(_labels(s, d), _parted(s, d), 0, 1, capacity=1 << 40)


def split_edge_rehome(s, d):
    tree = pin(_tree(s, d))
    m = _labels(s, d)
    inside = graph.intra(graph.with_partitions(tree, m)).where("src_part = 0")
    side = partitions.first_tree(m.where("partition_id = 0").select(F.col("vec_id").alias("node")), inside)
    moved = side.where("side = 1").select("vec_id", F.lit(100).cast("long").alias("partition_id"))
    e = graph.with_partitions(tree, partitions.assign(m, moved))
    return e.select("src", "dst", F.when(F.col("src_part") == F.col("dst_part"), "intra").otherwise("inter").alias("kind"))


def split_kmeans2(s, d):
    return partitions.split(_members(s, d), _parted(s, d), partitions.two_means())


def split_grow(s, d):
    return partitions.split(_members(s, d), _parted(s, d), partitions.grow)


def split_into_trees(s, d):
    return partitions.into_trees(_members(s, d), _parted(s, d))


def bootstrap_partitions(s, d):
    return partitions.bootstrap(_v(s, d))


def split_kmeans2_sides(s, d):
    return _sides(split_kmeans2(s, d))


def split_grow_sides(s, d):
    return _sides(split_grow(s, d))


def _sides(parts: DataFrame) -> DataFrame:
    """What has to hold of a split: every member once, and two sides."""
    return parts.groupBy("partition_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("members"), (F.countDistinct("side") == 2).alias("two_sides"))


def split_into_trees_pieces(s, d):
    """Every vector once, in a piece named by its smallest member; pieces of one partition join others only if they fit."""
    p = pin(split_into_trees(s, d))
    n = p.groupBy(F.col("piece").alias("q")).agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.countDistinct("partition_id").alias("parts"))
    return p.join(n, F.col("piece") == F.col("q")).select("vec_id", "partition_id", (F.col("low") == F.col("piece")).alias("named"), ((F.col("n") <= partitions.CAPACITY) | (F.col("parts") == 1)).alias("fits"))


def bootstrap_partitions_fit(s, d):
    p = pin(bootstrap_partitions(s, d))
    n = p.groupBy(F.col("partition_id").alias("q")).count()
    return p.join(n, F.col("partition_id") == F.col("q")).select("vec_id", (F.col("count") <= partitions.CAPACITY).alias("fits"))


def delaunay_plane(s, d):
    """Neighbours of centroids in the plane of their first two lanes."""
    c = partitions.centroids(_members(s, d)).select(F.col("partition_id").alias("id"), F.get("centroid", F.lit(0)).alias("x"), F.get("centroid", F.lit(1)).alias("y"))
    return partitions.delaunay(c)


def delaunay_neighbors(s, d):
    """Neighbours of centroids in the projection, over all lanes."""
    p = umap.Projection(64).fit(_v(s, d), epochs=10)
    c = partitions.centroids(_members(s, d)).select(F.col("partition_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    return partitions.delaunay(p.transform(c).withColumnRenamed("vec_id", "id"))


# trees and graphs
def _weights(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", _r("weight"))


def mst_full(s, d):
    return _tree(s, d).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight"), 6).alias("total_weight"))


def mst_edges(s, d):
    return _weights(_tree(s, d))


def mst_insert_one(s, d):
    old, new = _split_new(s, d, 1)
    return _weights(trees.insert(trees.mst(old), old, new))


def mst_insert_batch(s, d):
    old, new = _split_new(s, d, NEW)
    return _weights(trees.insert(trees.mst(old), old, new))


def delete_vectors(s, d):
    gone = s.createDataFrame([(x,) for x in GONE], "vec_id long")
    return _weights(trees.delete(_tree(s, d), _v(s, d), gone))


def edge_extremes(s, d):
    e = graph.intra(_parted(s, d)).withColumn("partition_id", F.col("src_part"))
    return graph.extremes(e, "partition_id").select("partition_id", "kind", "src", "dst", _r("weight"))


def intra_edges(s, d):
    return graph.intra(_parted(s, d)).select("src", "dst", _r("weight"), F.col("src_part").alias("partition_id"))


def inter_edges(s, d):
    return graph.inter(_parted(s, d)).select("src", "dst", _r("weight"), "src_part", "dst_part")


def edge_delete(s, d):
    t = pin(_tree(s, d))
    gone = t.where(F.col("weight") >= T1).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _weights(graph.delete_edges(t, gone))


def tree_path(s, d):
    return graph.trail(pin(_tree(s, d)), 0, _last(s, d)).select("step", "src", "dst", _r("weight"))


def tree_walk(s, d):
    w = graph.walk(pin(_tree(s, d)), 0, _last(s, d))
    return w.select(F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"), F.round("total", 6).alias("total"))


def mini_batches(s, d):
    """Anchors with their neighbours: every link of the fuzzy graph in both directions, each anchor in one batch."""
    near = fuzzy_union(s, d)
    m = umap.mini_batches(near, _v(s, d))
    one = m.groupBy("anchor").agg(F.countDistinct("batch").alias("batches"), F.count(F.when(F.col("w") > 0, 1)).alias("neighbours"), F.max(F.when(F.col("w") == 0, F.col("anchor") == F.col("other"))).alias("own"))
    return one.select(F.col("anchor").alias("vec_id"), "batches", "neighbours", F.coalesce("own", F.lit(False)).alias("own"))


def path_bottleneck(s, d):
    return tree_path(s, d).agg(F.max("weight").alias("max_weight"))


def sssp_tree(s, d):
    return graph.shortest(_tree(s, d), 0).select(F.col("node").alias("vec_id"), _r("cost"))


# clusters
def _clusters(s, d, t=T1):
    return cl.single_linkage(_nodes(s, d), _tree(s, d), t)


def cluster_single_linkage(s, d):
    return _clusters(s, d)


def cluster_coarsen(s, d):
    tree = pin(_tree(s, d))
    return cl.coarsen(pin(cl.single_linkage(_nodes(s, d), tree, T1)), tree, T2)


def cluster_sizes(s, d):
    return cl.sizes(_clusters(s, d))


def cluster_members(s, d):
    c = pin(_clusters(s, d))
    mine = c.where("vec_id = 0").select("cluster_id")
    return c.join(mine, "cluster_id", "left_semi").select("cluster_id", "vec_id")


def cluster_of_vector(s, d):
    return _clusters(s, d).where("vec_id = 42").select("vec_id", "cluster_id")


def cluster_listing(s, d):
    return cl.listing(_clusters(s, d)).select("cluster_id", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"))


def cluster_meta(s, d):
    c = pin(_clusters(s, d, T2))
    m = partitions.centroids(_v(s, d).join(c.withColumnRenamed("cluster_id", "partition_id"), "vec_id"))
    lanes = m.select(F.col("partition_id").alias("cluster_id"), F.posexplode("centroid").alias("pos", "value"))
    return lanes.join(cl.sizes(c), "cluster_id").select("cluster_id", "size", "pos", _r("value"))


def cluster_hierarchy_counts(s, d):
    return cl.hierarchy_counts(_nodes(s, d), pin(_tree(s, d)), list(THRESHOLDS))


def cluster_boundary_edges(s, d):
    return _weights(cl.boundary(_tree(s, d), T1))


def cluster_graph(s, d):
    t = pin(_tree(s, d))
    return cl.cluster_graph(cl.single_linkage(_nodes(s, d), t, T1), t).select("src_cluster", "dst_cluster", _r("weight"))


def dendrogram(s, d):
    return cl.dendrogram(_tree(s, d))


def cluster_merge_steps(s, d):
    c = pin(_clusters(s, d))
    two = [r[0] for r in cl.sizes(c).orderBy(F.desc("size"), "cluster_id").limit(2).collect()]
    return cl.merge_step(c, two[0], two[1])


def cluster_after_insert(s, d):
    old, new = _split_new(s, d, NEW)
    sets = cl.ClusterSets(old.select(F.col("vec_id").alias("node")), trees.mst(old))
    sets.create(T1)
    sets.update(_nodes(s, d), pin(trees.insert(trees.mst(old), old, new)))
    return sets.get(T1)


# reads
def get_vector(s, d):
    return _lanes(_v(s, d).where("vec_id = 7"), "embedding").select("vec_id", "pos", F.col("value").cast("double").alias("value"))


def vectors_by_partition(s, d):
    return _members(s, d).where("partition_id = 3").select("vec_id")


def vectors_by_partitions(s, d):
    return _members(s, d).where(F.col("partition_id").isin(1, 4, 7)).select("partition_id", "vec_id")


def vectors_by_cluster(s, d):
    return _v(s, d).join(cluster_members(s, d).select("vec_id"), "vec_id", "left_semi").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


def project_ids(s, d):
    return _v(s, d).select("vec_id")


def project_vectors(s, d):
    return _v(s, d).select(F.posexplode("embedding").alias("pos", "value")).select("pos", F.col("value").cast("double").alias("value"))


def all_ids(s, d):
    return _v(s, d).select("vec_id")


def vector_meta(s, d):
    v = _v(s, d).select("vec_id", F.size("embedding").alias("dim"))
    return v.join(_labels(s, d), "vec_id").join(_clusters(s, d), "vec_id").select("vec_id", "dim", "partition_id", "cluster_id")


# projection
def fuzzy_weights(s, d):
    return umap.fuzzy_weights(knn.knn_graph(_v(s, d), 10).select("i", "j", "d"))


def fuzzy_union(s, d):
    w = knn.knn_graph(_v(s, d), 3).select("i", "j", F.exp(-F.col("d")).alias("w"))
    return umap.fuzzy_union(w).select("i", "j", _r("w"))


def fuzzy_weights_sums(s, d):
    w = fuzzy_weights(s, d)
    return w.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"), F.round(F.max("w"), 6).alias("top"))


def training_batches(s, d):
    return umap.training_batches(table(s, d, "embeddings").groupBy(F.col("label").cast("long").alias("partition_id")).agg(F.count(F.lit(1)).alias("size")))


def training_batches_fit(s, d):
    b = pin(training_batches(s, d))
    full = b.groupBy(F.col("batch").alias("q")).agg(F.sum("size").alias("n"), F.max("room").alias("r"))
    j = b.join(full, F.col("batch") == F.col("q"))
    return j.groupBy("partition_id").agg(F.sum("size").alias("placed"), F.max(F.when(F.col("n") + F.col("r") == umap.BATCH, 0).otherwise(1)).alias("wrong"))


def umap_project(s, d):
    return umap.Projection(64).fit(_v(s, d), epochs=10).transform(_v(s, d))


# writes
def insert_then_mst(s, d):
    """The table streamed in through micro-batches; the tree that the store holds afterwards."""
    root = scratch(s, "stream")
    store = Store(s, f"{root}/store")
    old, new = _split_new(s, d, NEW)
    old.write.mode("overwrite").parquet(f"{root}/in/a")
    ingest.apply_batch(store, s.read.parquet(f"{root}/in/a"))
    new.write.mode("overwrite").parquet(f"{root}/in/b")
    stream = s.readStream.schema(new.schema).parquet(f"{root}/in/b")
    ingest.start(stream, store, f"{root}/checkpoint").awaitTermination()
    return _weights(store.read("mst_edges"))


def roundtrip_parquet(s, d):
    root = scratch(s, "store")
    store = Store(s, root)
    v = store.write({"vectors": _members(s, d)}, by={"vectors": "partition_id"})
    return store.read("vectors", v).select("vec_id", F.col("partition_id").cast("long").alias("partition_id"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


def reopened_clusters(s, d):
    """A cluster set made before an insert, read from the store by another engine."""
    path = scratch(s, "engine")
    old, new = _split_new(s, d, NEW)
    e = Engine(s, path)
    e.insert(old)
    e.create_cluster_set(T1)
    with e.transaction():
        e.insert(new)
    return Engine(s, path).cluster_sets().get(T1).select("vec_id", "cluster_id")


def reopened_after_undo(s, d):
    """Vectors and partitions after a transaction of a delete and an insert is taken back."""
    path = scratch(s, "engine")
    old, new = _split_new(s, d, NEW)
    e = Engine(s, path)
    e.insert(old)
    with e.transaction():
        e.delete(s.createDataFrame([(x,) for x in GONE], "vec_id long"))
        e.insert(new)
    e = Engine(s, path)
    e.undo()
    return Engine(s, path).members().select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


def updated_tree(s, d):
    """The tree after vectors were replaced by those of their successors."""
    e = Engine(s, scratch(s, "engine"))
    v = _v(s, d)
    swap = v.where(F.col("vec_id").isin(*[g + 1 for g in GONE])).select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    e.insert(v)
    e.update(swap)
    return e.store.read("mst_edges").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("weight"), 4).alias("total_weight"))


_NAMES = """vec_add vec_sub vec_scale vec_splat vec_extremes vec_dot vec_sq_dist vec_dim_check vec_position vec_equal
knn_exact knn_batch knn_partition_pruned knn_approx_nprobe nearest_partition assign_batch pairwise_dist knn_graph
partition_centroids partition_meta membership_lookup partition_neighbors expand_one_hop partition_trail
required_partitions induced_subgraph split_first_tree forest_tree_count merge_partitions split_edge_rehome
split_kmeans2 split_grow split_into_trees bootstrap_partitions delaunay_neighbors
split_kmeans2_sides split_grow_sides split_into_trees_pieces bootstrap_partitions_fit delaunay_plane
mst_full mst_edges mst_insert_one mst_insert_batch delete_vectors edge_extremes intra_edges inter_edges edge_delete
tree_path tree_walk path_bottleneck sssp_tree
cluster_single_linkage cluster_coarsen cluster_sizes cluster_members cluster_of_vector cluster_listing cluster_meta
cluster_hierarchy_counts cluster_boundary_edges cluster_graph dendrogram cluster_merge_steps cluster_after_insert
get_vector vectors_by_partition vectors_by_partitions vectors_by_cluster project_ids project_vectors all_ids vector_meta
fuzzy_weights fuzzy_weights_sums fuzzy_union training_batches training_batches_fit mini_batches umap_project insert_then_mst roundtrip_parquet reopened_clusters reopened_after_undo updated_tree""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# SQL ---------------------------------------------------------------------------------------------------------------
_ID = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::BIGINT AS part FROM embeddings)"
_Q = "q AS (SELECT embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id = 0)"
_D = "list_distance({0}, {1}) ** 2"


def _prim(where: str = "true") -> str:
    """CTEs up to mst(src, dst, weight): Prim's algorithm, one row per step."""
    return f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::BIGINT AS part FROM embeddings),
 pos AS (SELECT vec_id, x, row_number() OVER (ORDER BY vec_id) AS p FROM e WHERE {where}),
 cnt AS (SELECT count(*) AS n FROM pos),
 dist AS (SELECT a.p, list(list_distance(a.x, b.x) ** 2 ORDER BY b.p) AS ds FROM pos a, pos b GROUP BY a.p),
 prim(k, cur, ws, fs, w, f) AS (
  SELECT 1::BIGINT, 1::BIGINT, list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN NULL ELSE 1e300::DOUBLE END), list_transform(range(1, n + 1), lambda i: 0::BIGINT), NULL::DOUBLE, NULL::BIGINT FROM cnt
  UNION ALL
  SELECT k + 1, list_position(nw, list_min(nw))::BIGINT, list_transform(nw, lambda x, i: CASE WHEN i = list_position(nw, list_min(nw)) THEN NULL ELSE x END), nf, list_min(nw), nf[list_position(nw, list_min(nw))]
  FROM (SELECT k, cur, list_transform(ws, lambda x, i: CASE WHEN ds[i] < x THEN ds[i] ELSE x END) AS nw, list_transform(fs, lambda x, i: CASE WHEN ds[i] < ws[i] THEN cur ELSE x END) AS nf
        FROM prim JOIN dist ON dist.p = prim.cur, cnt WHERE k < n)),
 mst AS (SELECT least(a.vec_id, b.vec_id) AS src, greatest(a.vec_id, b.vec_id) AS dst, w AS weight
  FROM prim JOIN pos a ON a.p = cur JOIN pos b ON b.p = f WHERE w IS NOT NULL)"""


_PART = """, pe AS (SELECT m.src, m.dst, m.weight, a.part AS src_part, b.part AS dst_part FROM mst m JOIN e a ON a.vec_id = m.src JOIN e b ON b.vec_id = m.dst),
 near AS (SELECT DISTINCT src_part AS partition_id, dst_part AS neighbor_id FROM pe WHERE src_part <> dst_part UNION SELECT DISTINCT dst_part, src_part FROM pe WHERE src_part <> dst_part)"""


def _with(tail: str, *more: str, where: str = "true") -> str:
    return "WITH RECURSIVE " + _prim(where) + "".join(more) + " " + tail


def _comp(t: float, name: str = "c") -> str:
    """CTEs up to ``name`` (vec_id, cluster_id): components of the pairs nearer than t."""
    return f""", {name}_near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE a.vec_id <> b.vec_id AND list_distance(a.x, b.x) ** 2 < {t}),
 {name}_reach AS (SELECT vec_id AS v, vec_id AS low FROM e UNION SELECT n.b, r.low FROM {name}_reach r JOIN {name}_near n ON n.a = r.v WHERE r.low < n.b),
 {name} AS (SELECT v AS vec_id, min(low) AS cluster_id FROM {name}_reach GROUP BY 1)"""


def _lanes_sql(expr: str, frm: str = "e a JOIN e b ON b.vec_id = a.vec_id + 1") -> str:
    return f"WITH {_ID} SELECT vec_id, unnest(range(0, len(l))) ::INT AS pos, unnest(l) AS value FROM (SELECT a.vec_id, {expr} AS l FROM {frm})"


_CLUST = "WITH RECURSIVE " + _ID + _comp(T1)
_PIV = f"""WITH {_ID}, {_Q}, piv AS (SELECT vec_id AS partition_id, x FROM e WHERE vec_id < {PIVOTS}),
 m AS (SELECT vec_id, x, partition_id FROM (SELECT e.vec_id, e.x, piv.partition_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_D.format('e.x', 'piv.x')}, piv.partition_id) AS rn FROM e, piv) WHERE rn = 1),
 cen AS (SELECT partition_id, list(v ORDER BY i) AS c FROM (SELECT partition_id, i, avg(v) AS v FROM (SELECT partition_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM m) GROUP BY 1, 2) GROUP BY 1)"""
_CEN = f"""WITH {_ID}, cen AS (SELECT partition_id, list(v ORDER BY i) AS c FROM (SELECT partition_id, i, avg(v) AS v FROM (SELECT part AS partition_id, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)"""
_OLD = f"vec_id <= (SELECT max(vec_id) FROM embeddings) - {NEW}"
_E = "SELECT src, dst, round(weight, 6) AS weight FROM mst"
_PG = """, pg AS (SELECT least(src_part, dst_part) AS a, greatest(src_part, dst_part) AS b, min(weight) AS w FROM pe WHERE src_part <> dst_part GROUP BY 1, 2)"""
#: hop distances in the partition graph from one partition, and its search tree (each partition's smallest predecessor)
_HOPS = """, hop(p, h) AS (SELECT {0}::BIGINT, 0 UNION SELECT n.neighbor_id, h + 1 FROM hop JOIN near n ON n.partition_id = hop.p WHERE h < 40),
 lvl AS (SELECT p, min(h) AS h FROM hop GROUP BY 1),
 par AS (SELECT l.p, l.h, min(n.neighbor_id) AS q FROM lvl l JOIN near n ON n.partition_id = l.p JOIN lvl k ON k.p = n.neighbor_id AND k.h = l.h - 1 GROUP BY 1, 2)"""
_PATH = """, bi AS (SELECT src AS a, dst AS b, weight AS w FROM mst UNION ALL SELECT dst, src, weight FROM mst),
 go(v, frm, w, cost, step) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, 0.0::DOUBLE, 0 UNION ALL SELECT b, a, bi.w, cost + bi.w, step + 1 FROM go JOIN bi ON bi.a = go.v WHERE bi.b IS DISTINCT FROM go.frm)"""
_UP = """, up(v, frm, w, step) AS (SELECT v, frm, w, step FROM go WHERE v = (SELECT max(vec_id) FROM e) UNION ALL SELECT g.v, g.frm, g.w, g.step FROM up JOIN go g ON g.v = up.frm)"""

ORACLES = {
    "vec_add": _lanes_sql("list_transform(a.x, lambda z, i: z + b.x[i])"),
    "vec_sub": _lanes_sql("list_transform(a.x, lambda z, i: z - b.x[i])"),
    "vec_scale": _lanes_sql("list_transform(a.x, lambda z: z * 0.5::DOUBLE)", "e a"),
    "vec_splat": _lanes_sql("list_transform(a.x, lambda z: 1.0::DOUBLE)", "e a"),
    "vec_extremes": _lanes_sql("list_transform(a.x, lambda z, i: least(z, b.x[i]) * 2 + greatest(z, b.x[i]))"),
    "vec_dot": f"WITH {_ID}, {_Q} SELECT vec_id, round(list_inner_product(x, y), 6) AS value FROM e, q",
    "vec_sq_dist": f"WITH {_ID}, {_Q} SELECT vec_id, round({_D.format('x', 'y')}, 6) AS value FROM e, q",
    "vec_dim_check": "SELECT len(embedding)::INT AS dim, count(*) AS n FROM embeddings GROUP BY 1",
    "vec_position": "SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings",
    "vec_equal": "SELECT a.vec_id, a.embedding = b.embedding AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "knn_exact": f"WITH {_ID}, {_Q} SELECT row_number() OVER (ORDER BY d, vec_id)::INT AS rank, vec_id, round(d, 6) AS d FROM (SELECT vec_id, {_D.format('x', 'y')} AS d FROM e, q ORDER BY d, vec_id LIMIT 10)",
    "knn_batch": f"WITH {_ID} SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_D.format('a.x', 'b.x')} AS d FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5",
    "knn_approx_nprobe": _PIV + f", two AS (SELECT partition_id FROM cen, q ORDER BY {_D.format('c', 'y')}, partition_id LIMIT 2) SELECT row_number() OVER (ORDER BY d, vec_id)::INT AS rank, vec_id, round(d, 6) AS d FROM (SELECT vec_id, {_D.format('x', 'y')} AS d FROM m JOIN two USING (partition_id), q ORDER BY d, vec_id LIMIT 10)",
    "nearest_partition": _CEN + f" SELECT vec_id, partition_id, round(d, 6) AS d FROM (SELECT vec_id, partition_id, {_D.format('x', 'c')} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {_D.format('x', 'c')}, partition_id) AS rn FROM e, cen) WHERE rn = 1",
    "assign_batch": f"WITH {_ID} SELECT query_id AS vec_id, part AS partition_id FROM (SELECT a.vec_id AS query_id, b.part, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D.format('a.x', 'b.x')}, b.vec_id) AS rn FROM e a, e b WHERE NOT (a.{_OLD}) AND b.{_OLD}) WHERE rn = 1",
    "pairwise_dist": f"WITH {_ID} SELECT a.vec_id AS i, b.vec_id AS j, round({_D.format('a.x', 'b.x')}, 6) AS d FROM e a, e b WHERE a.vec_id < b.vec_id",
    "knn_graph": f"WITH {_ID} SELECT i, j, rank::INT AS rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D.format('a.x', 'b.x')}, b.vec_id) AS rank FROM e a, e b WHERE a.vec_id <> b.vec_id) WHERE rank <= 3",
    "partition_centroids": _CEN + " SELECT partition_id, unnest(range(0, len(c)))::INT AS pos, round(unnest(c), 6) AS value FROM cen",
    "partition_meta": _with("SELECT part AS partition_id, n AS size, round(lo, 6) AS min_edge, round(hi, 6) AS max_edge FROM (SELECT part, count(*) AS n FROM e GROUP BY 1) LEFT JOIN (SELECT src_part, min(weight) AS lo, max(weight) AS hi FROM pe WHERE src_part = dst_part GROUP BY 1) ON src_part = part", _PART),
    "membership_lookup": _PIV + " SELECT vec_id, partition_id FROM m WHERE vec_id BETWEEN 10 AND 20",
    "partition_neighbors": _with("SELECT * FROM near", _PART),
    "expand_one_hop": _with("SELECT 0::BIGINT AS partition_id UNION SELECT neighbor_id FROM near WHERE partition_id = 0", _PART),
    "required_partitions": _with("SELECT DISTINCT p AS partition_id FROM walk", _PART, _HOPS.format(9), ", walk(p) AS (SELECT unnest([0, 3, 9])::BIGINT UNION SELECT par.q FROM walk JOIN par ON par.p = walk.p)"),
    "partition_trail": _with("SELECT (1 + n.h - (SELECT h FROM walk WHERE p = 9))::INT + (SELECT h FROM lvl WHERE p = 9)::INT - 1 AS step, n.q AS src, n.p AS dst, round(g.w, 6) AS weight FROM walk n JOIN pg g ON g.a = least(n.p, n.q) AND g.b = greatest(n.p, n.q) WHERE n.q IS NOT NULL", _PART, _PG, _HOPS.format(0), ", walk(p, q, h) AS (SELECT p, q, h FROM par WHERE p = 9 UNION ALL SELECT par.p, par.q, par.h FROM walk JOIN par ON par.p = walk.q)"),
    "induced_subgraph": _with("SELECT src, dst, round(weight, 6) AS weight FROM pe WHERE src_part IN (0, 1, 2) AND dst_part IN (0, 1, 2)", _PART),
    "split_first_tree": _CLUST + " SELECT vec_id, CASE WHEN cluster_id = (SELECT min(cluster_id) FROM c) THEN 0 ELSE 1 END AS side FROM c",
    "forest_tree_count": _CLUST + " SELECT count(DISTINCT cluster_id) AS n FROM c",
    "merge_partitions": "SELECT vec_id, CASE WHEN label = 1 THEN 0 ELSE label END::BIGINT AS partition_id FROM embeddings",
    "split_edge_rehome": _with("SELECT src, dst, CASE WHEN coalesce(a.np, 0) = coalesce(b.np, 0) AND src_part = dst_part THEN 'intra' ELSE 'inter' END AS kind FROM pe LEFT JOIN moved a ON a.v = src LEFT JOIN moved b ON b.v = dst", _PART, """, zero AS (SELECT src AS a, dst AS b FROM pe WHERE src_part = 0 AND dst_part = 0 UNION ALL SELECT dst, src FROM pe WHERE src_part = 0 AND dst_part = 0),
 side(v) AS (SELECT min(vec_id) FROM e WHERE part = 0 UNION SELECT zero.b FROM side JOIN zero ON zero.a = side.v),
 moved AS (SELECT vec_id AS v, 100 AS np FROM e WHERE part = 0 AND vec_id NOT IN (SELECT v FROM side))"""),
    "mst_full": _with("SELECT count(*) AS n_edges, round(sum(weight), 6) AS total_weight FROM mst"),
    "mst_edges": _with(_E),
    "delete_vectors": _with(_E, where=f"vec_id NOT IN {GONE}"),
    "edge_extremes": _with("""SELECT partition_id, kind, src, dst, round(weight, 6) AS weight FROM (
 SELECT src_part AS partition_id, 'smallest' AS kind, src, dst, weight, row_number() OVER (PARTITION BY src_part ORDER BY weight, src, dst) AS rn FROM pe WHERE src_part = dst_part UNION ALL
 SELECT src_part, 'largest', src, dst, weight, row_number() OVER (PARTITION BY src_part ORDER BY weight DESC, src, dst) FROM pe WHERE src_part = dst_part) WHERE rn = 1""", _PART),
    "intra_edges": _with("SELECT src, dst, round(weight, 6) AS weight, src_part AS partition_id FROM pe WHERE src_part = dst_part", _PART),
    "inter_edges": _with("SELECT src, dst, round(weight, 6) AS weight, src_part, dst_part FROM pe WHERE src_part <> dst_part", _PART),
    "edge_delete": _with(_E + f" WHERE weight < {T1}"),
    "tree_path": _with("SELECT step, frm AS src, v AS dst, round(w, 6) AS weight FROM up WHERE frm IS NOT NULL", _PATH, _UP),
    "path_bottleneck": _with("SELECT round(max(w), 6) AS max_weight FROM up", _PATH, _UP),
    "sssp_tree": _with("SELECT v AS vec_id, round(cost, 6) AS cost FROM go", _PATH),
    "cluster_single_linkage": _CLUST + " SELECT vec_id, cluster_id FROM c",
    "cluster_coarsen": "WITH RECURSIVE " + _ID + _comp(T2) + " SELECT vec_id, cluster_id FROM c",
    "cluster_sizes": _CLUST + " SELECT cluster_id, count(*) AS size FROM c GROUP BY 1",
    "cluster_members": _CLUST + " SELECT cluster_id, vec_id FROM c WHERE cluster_id = (SELECT cluster_id FROM c WHERE vec_id = 0)",
    "cluster_of_vector": _CLUST + " SELECT vec_id, cluster_id FROM c WHERE vec_id = 42",
    "cluster_listing": _CLUST + " SELECT cluster_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM c GROUP BY 1",
    "cluster_meta": "WITH RECURSIVE " + _ID + _comp(T2) + ", l AS (SELECT cluster_id, unnest(range(0, len(x)))::INT AS pos, unnest(x) AS v FROM c JOIN e USING (vec_id)) SELECT cluster_id, count(*) AS size, pos, round(avg(v), 6) AS value FROM l GROUP BY cluster_id, pos",
    "cluster_hierarchy_counts": "WITH RECURSIVE " + _ID + "".join(_comp(t, f"c{k}") for k, t in enumerate(THRESHOLDS)) + " " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(*) AS n_clusters, max(n) AS largest FROM (SELECT cluster_id, count(*) AS n FROM c{k} GROUP BY 1)" for k, t in enumerate(THRESHOLDS)),
    "cluster_boundary_edges": _with(_E + f" WHERE weight >= {T1}"),
    "cluster_graph": _with("SELECT least(a.cluster_id, b.cluster_id) AS src_cluster, greatest(a.cluster_id, b.cluster_id) AS dst_cluster, round(min(weight), 6) AS weight FROM mst JOIN c a ON a.vec_id = src JOIN c b ON b.vec_id = dst WHERE a.cluster_id <> b.cluster_id GROUP BY 1, 2", _comp(T1)),
    "cluster_after_insert": _CLUST + " SELECT vec_id, cluster_id FROM c",
    "get_vector": f"WITH {_ID} SELECT vec_id, unnest(range(0, len(x)))::INT AS pos, unnest(x) AS value FROM e WHERE vec_id = 7",
    "vectors_by_partition": "SELECT vec_id FROM embeddings WHERE label = 3",
    "vectors_by_partitions": "SELECT label::BIGINT AS partition_id, vec_id FROM embeddings WHERE label IN (1, 4, 7)",
    "vectors_by_cluster": _CLUST + " SELECT vec_id, x[1] AS first FROM c JOIN e USING (vec_id) WHERE cluster_id = (SELECT cluster_id FROM c WHERE vec_id = 0)",
    "project_ids": "SELECT vec_id FROM embeddings",
    "project_vectors": f"WITH {_ID} SELECT unnest(range(0, len(x)))::INT AS pos, unnest(x) AS value FROM e",
    "all_ids": "SELECT vec_id FROM embeddings",
    "vector_meta": _CLUST + " SELECT vec_id, len(x)::INT AS dim, part AS partition_id, cluster_id FROM c JOIN e USING (vec_id)",
    "fuzzy_union": f"""WITH {_ID}, k AS (SELECT i, j, exp(-d) AS w FROM (SELECT a.vec_id AS i, b.vec_id AS j, {_D.format('a.x', 'b.x')} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D.format('a.x', 'b.x')}, b.vec_id) AS rn FROM e a, e b WHERE a.vec_id <> b.vec_id) WHERE rn <= 3),
 s AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(CASE WHEN i < j THEN w ELSE 0 END) AS a, max(CASE WHEN i > j THEN w ELSE 0 END) AS b FROM k GROUP BY 1, 2)
 SELECT i, j, round(a + b - a * b, 6) AS w FROM s""",
    "roundtrip_parquet": "SELECT vec_id, label::BIGINT AS partition_id, embedding[1]::DOUBLE AS first FROM embeddings",
}
_SIDES = "SELECT label::BIGINT AS partition_id, count(*) AS rows, count(DISTINCT vec_id) AS members, true AS two_sides FROM embeddings GROUP BY 1"
ORACLES |= {
    "tree_walk": _with("SELECT '0,' || string_agg(v::VARCHAR, ',' ORDER BY step) AS nodes, round(sum(w), 6) AS total FROM up WHERE frm IS NOT NULL", _PATH, _UP),
    "mini_batches": ORACLES["fuzzy_union"].rsplit("SELECT i, j", 1)[0].rstrip() + """, b AS (SELECT i, j FROM s UNION ALL SELECT j, i FROM s)
 SELECT i AS vec_id, 1::BIGINT AS batches, count(*) AS neighbours, false AS own FROM b GROUP BY 1""",
    "reopened_clusters": ORACLES["cluster_single_linkage"],
    "reopened_after_undo": f"SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE {_OLD}",
    "updated_tree": _with("SELECT count(*) AS n_edges, round(sum(weight), 4) AS total_weight FROM mst").replace(
        "e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::BIGINT AS part FROM embeddings)",
        f"e AS (SELECT a.vec_id, CASE WHEN a.vec_id IN {GONE} THEN list_transform(b.embedding::DOUBLE[], lambda z: -z) ELSE a.embedding::DOUBLE[] END AS x FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)", 1),
    "split_kmeans2_sides": _SIDES,
    "split_grow_sides": _SIDES,
    "split_into_trees_pieces": "SELECT vec_id, label::BIGINT AS partition_id, true AS named, true AS fits FROM embeddings",
    "bootstrap_partitions_fit": "SELECT vec_id, true AS fits FROM embeddings",
    "training_batches_fit": "SELECT label::BIGINT AS partition_id, count(*) AS placed, 0 AS wrong FROM embeddings GROUP BY 1",
    "fuzzy_weights_sums": "SELECT vec_id AS i, 10::BIGINT AS n, round(log2(10), 4) AS total, 1.0::DOUBLE AS top FROM embeddings",
    "cluster_merge_steps": _CLUST + """, n AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) AS k FROM c GROUP BY 1)
 SELECT vec_id, CASE WHEN cluster_id = (SELECT cluster_id FROM n WHERE k = 2) THEN (SELECT cluster_id FROM n WHERE k = 1) ELSE cluster_id END AS cluster_id FROM c""",
    # the triangles whose circumcircle is empty
    "delaunay_plane": _CEN + """, p AS (SELECT partition_id AS id, c[1] AS x, c[2] AS y FROM cen),
 t AS (SELECT a.id AS i, b.id AS j, c.id AS k, a.x AS ax, a.y AS ay, 2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d,
   (a.x ** 2 + a.y ** 2) * (b.y - c.y) + (b.x ** 2 + b.y ** 2) * (c.y - a.y) + (c.x ** 2 + c.y ** 2) * (a.y - b.y) AS u,
   (a.x ** 2 + a.y ** 2) * (c.x - b.x) + (b.x ** 2 + b.y ** 2) * (a.x - c.x) + (c.x ** 2 + c.y ** 2) * (b.x - a.x) AS v
   FROM p a JOIN p b ON a.id < b.id JOIN p c ON b.id < c.id),
 o AS (SELECT i, j, k, u / d AS ox, v / d AS oy, (ax - u / d) ** 2 + (ay - v / d) ** 2 AS r FROM t WHERE d <> 0),
 tri AS (SELECT i, j, k FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id NOT IN (i, j, k) AND (p.x - ox) ** 2 + (p.y - oy) ** 2 < r))
 SELECT i AS src, j AS dst FROM tri UNION SELECT i, k FROM tri UNION SELECT j, k FROM tri""",
}
ORACLES["knn_partition_pruned"] = ORACLES["knn_exact"]
for _n in ("mst_insert_one", "mst_insert_batch", "insert_then_mst"):
    ORACLES[_n] = ORACLES["mst_edges"]

