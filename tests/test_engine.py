"""Operators of the engine against brute force, and the invariants of splits and merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vecloom.engine import IDS, Engine
from vecloom.functions import vectors as vec
from vecloom.operators import clusters, graph, knn, mst, partitions
from vecloom.sources.store import Delta, Store, difference
from vecloom.operators.projection import ModelNotInitialized, Projection, fuzzy_union, mini_batches, padded, training_batches


def points(spark, n=60, dim=5, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[3] = x[2]
    df = spark.createDataFrame([(i, [float(z) for z in x[i]], int(i % 3)) for i in range(n)], "vec_id long, embedding array<float>, partition_id long")
    return x.astype(np.float64), df


def sq(x):
    return ((x[:, None] - x[None]) ** 2).sum(2)


def brute_tree(x, keep=None):
    n = len(x)
    ids = [i for i in range(n) if keep is None or i in keep]
    d = sq(x)
    edges = sorted((d[i, j], i, j) for k, i in enumerate(ids) for j in ids[k + 1 :])
    up = {i: i for i in ids}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    out = set()
    for _, i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.add((i, j))
    return out


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), (None, [1.0, 1.0])], "u array<float>, v array<float>")
    u, v = F.col("u"), F.col("v")
    r = df.select(vec.add(u, v), vec.sub(u, v), vec.dot(u, v), vec.sq_dist(u, v), vec.euclidean(u, v), vec.scale(u, 2), vec.splat(1.0, 3), vec.equal(u, u)).collect()
    assert list(r[0]) == [[4, 7], [-2, -3], 13.0, 13.0, 13**0.5, [2, 4], [1, 1, 1], True]
    assert r[1][0] is None and r[1][3] is None
    with pytest.raises(Exception, match="invalid size"):
        df.select(vec.checked(u, 3)).collect()


def test_knn_cases(spark):
    two = lambda *p: spark.createDataFrame([(i, list(map(float, z))) for i, z in enumerate(p)] or [], "vec_id long, embedding array<double>")
    got = lambda df, q, k: [r["vec_id"] for r in knn.knn(df, q, k).orderBy("rank").collect()]
    d = two((1, 2), (2, 3), (3, 4), (5, 6))
    assert got(d, [1, 2], 1) == [0] and got(d, [1, 2], 3) == [0, 1, 2] and got(d, [1, 2], 9) == [0, 1, 2, 3] and got(d, [1, 2], 0) == []
    assert got(two((1, 1), (1, 1)), [1, 2], 2) == [0, 1]
    assert got(two(), [1, 2], 3) == []
    with pytest.raises(Exception, match="invalid size"):
        got(d, [1, 2, 3], 1)
    assert [r["vec_id"] for r in knn.knn(d, [1, 2], 2, where=F.col("vec_id") > 0).collect()] == [1, 2]


@pytest.mark.parametrize("block", [1024, 1])
def test_knn_variants_agree_with_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", block)  # 1: more queries and centroids than travel, so tiles
    x, df = points(spark)
    if block == 1:
        tiled = knn._tiled
        monkeypatch.setattr(knn, "_tiled", lambda a, b, k, own, size=7: tiled(a, b, k, own, size))
    d = sq(x)
    want = {(i, int(j)) for i in range(0, 60, 20) for j in sorted(set(range(60)) - {i}, key=lambda j: (d[i, j], j))[:4]}
    assert {(r["query_id"], r["vec_id"]) for r in knn.knn_batch(df, df.where("vec_id % 20 = 0"), 4).collect()} == want
    g = {(r["i"], r["j"]) for r in knn.knn_graph(df, 4, block=16).where("i % 20 = 0").collect()}
    assert g == want
    c = partitions.centroids(df)
    q = [float(z) for z in x[7]]
    assert rows(knn.knn_pruned(df, q, 5, c, knn.radii(df, c)).select("vec_id")) == rows(knn.knn(df, q, 5).select("vec_id"))
    assert knn.knn_probe(df, q, 5, c, 3).count() == 5
    m = {r["vec_id"]: r["partition_id"] for r in knn.nearest_partition(df, c).collect()}
    cen = np.array([r["centroid"] for r in c.orderBy("partition_id").collect()])
    assert m == {i: int(((x[i] - cen) ** 2).sum(1).argmin()) for i in range(60)}
    wide = spark.createDataFrame([(i, [100.0 + i] * 5) for i in range(100, 130)], "partition_id long, centroid array<double>")
    assert {r["vec_id"]: r["partition_id"] for r in knn.nearest_partition(df, c.unionByName(wide)).collect()} == m
    assert knn.knn_batch(df, df.where("vec_id < 0"), 3).count() == 0 == knn.knn_batch(df, df, 0).count()
    assert knn.knn_pruned(df, q, 100, c, knn.radii(df, c)).count() == 60
    assert {(r["i"], r["j"]): round(r["d"], 9) for r in knn.pairwise(df, 16).collect()} == {(i, j): round(d[i, j], 9) for i in range(60) for j in range(i + 1, 60)}


def test_tree_blocks_inserts_and_deletes(spark):
    x, df = points(spark)
    want = brute_tree(x)
    assert pairs(mst.mst(df)) == want and pairs(mst.mst(df, block=13)) == want
    old, new = df.where("vec_id < 45"), df.where("vec_id >= 45")
    tree = mst.mst(old)
    assert pairs(mst.insert(tree, old, new, block=7)) == want
    assert pairs(mst.insert(tree, old, old)) == brute_tree(x, set(range(45)))
    gone = spark.createDataFrame([(i,) for i in (0, 7, 8, 31)], "vec_id long")
    left = set(range(60)) - {0, 7, 8, 31}
    assert pairs(mst.delete(mst.mst(df), df, gone, block=17)) == brute_tree(x, left)
    assert mst.mst(df.where("vec_id < 0")).count() == 0 and mst.mst(df.where("vec_id = 1")).count() == 0


def test_forest_and_components_by_joins_equal_one_task(spark):
    r = np.random.default_rng(3)
    e = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 80, 150), r.integers(0, 80, 150), r.integers(0, 9, 150))] + [(1, None, 1.0)], graph.EDGE)
    assert rows(graph.spanning_forest(e, True)) == rows(graph.spanning_forest(e, False))
    n = spark.range(0, 90).select(F.col("id").alias("node"))
    assert rows(graph.components(n, e, True)) == rows(graph.components(n, e, False))


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 5.0), (3, 4, 1.0), (1, 4, 9.0), (8, 9, 1.0)], graph.EDGE)
    assert [(r["src"], r["dst"]) for r in graph.trail(e, 1, 3).orderBy("step").collect()] == [(1, 2), (2, 3)]
    assert [(r["src"], r["dst"]) for r in graph.trail(e, 1, 4, hops=False).orderBy("step").collect()] == [(1, 2), (2, 3), (3, 4)]
    assert graph.trail(e, 1, 9).count() == 0 and graph.trail(e, 1, 1).count() == 0
    assert {r["node"]: r["cost"] for r in graph.shortest(e, 1).collect()} == {1: 0, 2: 1, 3: 6, 4: 7}
    assert [tuple(r) for r in graph.walk(e, 1, 3).collect()] == [([1, 2, 3], 6.0)] and [tuple(r) for r in graph.walk(e, 2, 2).collect()] == [([2], 0.0)]
    assert graph.walk(e, 1, 9).count() == 0
    assert rows(graph.shortest(e, 1, small=False)) == rows(graph.shortest(e, 1, small=True))
    with pytest.raises(KeyError):
        graph.shortest(e, 77)


def check_split(members, edges, parts):
    """No vector twice or lost, every edge in exactly one place, both sides used."""
    side = {}
    for r in parts.collect():
        assert r["vec_id"] not in side
        side[r["vec_id"]] = (r["partition_id"], r["side"])
    assert set(side) == {r["vec_id"] for r in members.collect()}
    places = [side[r["src"]] == side[r["dst"]] for r in edges.collect()]
    assert len(places) == edges.count()
    return side


def test_splits_keep_their_invariants(spark):
    _, df = points(spark)
    df = df.withColumn("partition_id", F.lit(0).cast("long"))
    edges = graph.with_partitions(mst.mst(df), df)
    for strategy in (partitions.two_means(), partitions.two_means(None), partitions.grow):
        side = check_split(df, edges, partitions.split(df, edges, strategy))
        assert {s for _, s in side.values()} == {0, 1}
    same = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(4)], "vec_id long, embedding array<float>, partition_id long")
    assert sorted(r["side"] for r in partitions.split(same, edges.where("src < 0"), partitions.two_means()).collect()) == [0, 0, 1, 1]
    with pytest.raises(Exception, match="cannot be split"):
        partitions.split(same.where("vec_id = 0"), edges.where("src < 0"), partitions.grow).collect()


def test_first_tree_merge_and_rehoming(spark):
    _, df = points(spark)
    tree = mst.mst(df)
    nodes = df.select(F.col("vec_id").alias("node"))
    assert partitions.first_tree(nodes, tree).where("side = 1").count() == 0
    cut = tree.orderBy(F.desc("weight")).limit(1)
    rest = graph.delete_edges(tree, cut)
    assert partitions.tree_count(nodes, rest).first()["n"] == 2
    s = partitions.first_tree(nodes, rest)
    assert s.where("vec_id = 0").first()["side"] == 0 and s.where("side = 1").count() > 0
    m = s.select("vec_id", F.col("side").cast("long").alias("partition_id"))
    e = graph.with_partitions(tree, m)
    assert pairs(graph.inter(e)) == pairs(cut)
    back = partitions.merge(m, e, 0, 1)
    assert {r["partition_id"] for r in back.collect()} == {0}
    with pytest.raises(partitions.Overflow):
        partitions.merge(m, e, 0, 1, capacity=10)
    with pytest.raises(partitions.NotConnected):
        partitions.merge(m, e.where("src < 0"), 0, 1)
    many = graph.delete_edges(tree, tree.orderBy(F.desc("weight")).limit(30))
    m = graph.components(nodes, many).select(F.col("node").alias("vec_id"), F.col("component").alias("partition_id"))
    for small in (True, False):
        pieces = partitions.into_trees(m, graph.with_partitions(tree, m), 10, small)
        assert pieces.count() == 60 and pieces.select("piece").distinct().count() < m.select("partition_id").distinct().count()
        most = max(10, m.groupBy("partition_id").count().agg(F.max("count")).first()[0])
        assert pieces.groupBy("piece").count().agg(F.max("count")).first()[0] <= most
        assert pieces.groupBy("piece").agg(F.min("vec_id").alias("low")).where("low <> piece").count() == 0
    assert partitions.bootstrap(df, 8).groupBy("partition_id").count().agg(F.max("count")).first()[0] <= 8


def test_bootstrap_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(90, 4)), r.normal(size=(50, 4)) + 6, np.full((60, 4), 2.0)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    read = lambda: {(q["vec_id"], q["partition_id"]) for q in partitions.bootstrap(df, 16).collect()}
    want = read()
    monkeypatch.setattr(partitions, "ONE", 40, raising=False)  # the 60 equal vectors exceed a task
    passes = []
    inner = partitions._all_means
    monkeypatch.setattr(partitions, "_all_means", lambda v, big: passes.append(big) or inner(v, big))
    assert read() == want and len(passes) > 1
    assert max(sum(1 for _, p in want if p == q) for _, q in want) <= 16


def test_clusters_and_hierarchy(spark):
    x, df = points(spark)
    tree, nodes = mst.mst(df).persist(), df.select(F.col("vec_id").alias("node"))
    sets = clusters.ClusterSets(nodes, tree)
    a, b = sets.create(1.0), sets.create(2.0)
    assert sets.create(1.0) is a
    assert rows(b) == rows(clusters.single_linkage(nodes, tree, 2.0)) and clusters.nested([a, b])
    counts = [rows(clusters.hierarchy_counts(nodes, tree, [2.0, 1.0, 0.0], small)) for small in (True, False)]
    assert counts[0] == counts[1] and counts[0][0] == (0.0, 60, 1)
    assert rows(clusters.hierarchy_counts(nodes, tree.where("src < 0"), [1.0], True)) == [(1.0, 60, 1)]
    d = clusters.dendrogram(tree)
    for t in (1.0, 2.0):
        assert sets.get(t).select("cluster_id").distinct().count() == 60 - d.where(F.col("weight") < t).count()
    with pytest.raises(KeyError):
        sets.get(3.0)
    w = tree.agg(F.max("weight")).first()[0]
    assert clusters.single_linkage(nodes, tree, w).select("cluster_id").distinct().count() == 2  # strictly below
    assert clusters.cluster_graph(a, tree).count() >= 1
    big = [r[0] for r in clusters.sizes(a).orderBy(F.desc("size"), "cluster_id").limit(2).collect()]
    assert clusters.merge_step(a, big[1], big[0]).where(F.col("cluster_id") == big[1]).count() in (0, clusters.sizes(a).where(F.col("cluster_id") == big[1]).first()["size"])
    with pytest.raises(ValueError):
        clusters.merge_step(a, 1, 1)


def test_delaunay():
    r = np.random.default_rng(2)
    p = r.random((14, 2))
    got = partitions.triangulate(p)
    want = set()
    from itertools import combinations

    for t in combinations(range(len(p)), 3):
        a, b, c = p[list(t)]
        m = 2 * np.array([b - a, c - a])
        o = np.linalg.solve(m, np.array([b @ b - a @ a, c @ c - a @ a]))
        if all(((p[k] - o) ** 2).sum() >= ((a - o) ** 2).sum() - 1e-12 for k in range(len(p)) if k not in t):
            want |= {(t[0], t[1]), (t[1], t[2]), (t[0], t[2])}
    assert got >= want - set() and len(got - want) <= 2
    assert partitions.triangulate(p[:1]) == set() and partitions.triangulate(p[:2]) == {(0, 1)}


def test_projection(spark):
    x, df = points(spark, 120)
    p = Projection(5)
    with pytest.raises(ModelNotInitialized):
        p.transform(df)
    with pytest.raises(ModelNotInitialized):
        Projection(5).fit(df.where("vec_id < 4"))
    p.fit(df, k=5, epochs=25)
    assert p.losses[-1] < p.losses[0]
    out = p.transform(df)
    assert out.count() == 120 and out.where("isnan(x) or isnan(y)").count() == 0
    w = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 1.0)], "i long, j long, w double")
    assert rows(fuzzy_union(w)) == [(1, 2, 0.75), (1, 3, 1.0)]
    m = spark.createDataFrame([(i, 100) for i in range(40)] + [(50, None), (51, -1)], "partition_id long, size long")
    b = training_batches(m)
    per = b.groupBy("batch").agg(F.sum("size").alias("s"), F.max("room").alias("room"))
    assert b.count() == 40 and all(r["s"] + r["room"] == 1152 and r["s"] <= 1152 for r in per.collect()) and per.count() <= 5
    wide = training_batches(spark.createDataFrame([(1, 2500), (2, 1152), (3, 1)], "partition_id long, size long"))
    assert rows(wide.groupBy("partition_id").agg(F.sum("size"))) == [(1, 2500), (2, 1152), (3, 1)]
    assert wide.groupBy("batch").agg(F.sum("size").alias("s")).where("s > 1152").count() == 0
    few = training_batches(df.groupBy(F.lit(1).alias("partition_id")).agg(F.count(F.lit(1)).alias("size")), 50)
    full = padded(df.withColumn("partition_id", F.lit(1)), few, 5, 50)
    assert {r["count"] for r in full.groupBy("batch").count().collect()} == {50} and full.where("vec_id is not null").select("vec_id").distinct().count() == 120
    mini = mini_batches(w, df.select("vec_id"), anchors=2, strangers=3)
    near = {(1, 2): 0.5, (2, 1): 0.5, (1, 3): 1.0, (3, 1): 1.0}
    assert {(r["anchor"], r["other"]): r["w"] for r in mini.where("w > 0").collect()} == near
    far = [(r["anchor"], r["other"]) for r in mini.where("w = 0").collect()]
    assert far and not set(far) & set(near) and all(a != b for a, b in far) and mini.groupBy("anchor").agg(F.countDistinct("batch").alias("n")).where("n > 1").count() == 0
    again = Projection(1).of_rows(p.rows(spark))
    assert rows(again.transform(df)) == rows(out)


def test_everything_is_there_after_reopening(spark, tmp_path):
    x, df = points(spark)
    v = df.select("vec_id", "embedding")
    path = f"file://{tmp_path}/db"
    e = Engine(spark, path)
    e.insert(v.where("vec_id < 50"))
    e.create_cluster_set(1.5)
    e.projection()
    n = len(e.store.versions())
    with e.transaction():
        e.insert(v.where("vec_id >= 50"))
        e.delete(v.where("vec_id = 3"))
        assert e.vectors().count() == 59
    assert len(e.store.versions()) == n + 1
    e = Engine(spark, path)
    left = set(range(60)) - {3}
    assert pairs(e.store.read("mst_edges")) == brute_tree(x, left)
    want = clusters.single_linkage(v.where("vec_id <> 3").select(F.col("vec_id").alias("node")), e.store.read("mst_edges"), 1.5)
    assert rows(e.cluster_sets().get(1.5)) == rows(want)
    m = e.cluster_meta(1.5, members=True)
    assert m.count() == 59 and e.cluster_meta(1.5).agg(F.sum("size")).first()[0] == 59
    for wrong in (lambda: e.cluster_meta(0.7), lambda: e.cluster_meta(1.5, -4)):
        with pytest.raises(KeyError):
            wrong()
    assert e.partition_meta().agg(F.sum("size")).first()[0] == 59
    assert e.projection().fitted and e.neighbours().columns == ["src", "dst"]
    from vecloom.operators.partitions import meta

    near = lambda d: {r["partition_id"]: (r["size"], [round(z, 6) for z in r["centroid"]], r["min_edge"], r["max_edge"]) for r in d.collect()}
    assert near(e.partition_meta()) == near(meta(e.members(), e.edges()))
    e.undo()  # the transaction as a whole
    assert e.vectors().count() == 50 and e.cluster_meta(1.5).agg(F.sum("size")).first()[0] == 50
    with pytest.raises(ZeroDivisionError), e.transaction():
        e.delete(v.where("vec_id < 10"))
        1 / 0  # noqa: B018
    assert e.vectors().count() == 50
    e.update(spark.createDataFrame([(7, [9.0] * 5), (90, [8.0] * 5)], "vec_id long, embedding array<float>"))
    assert e.get(vector=7).first()["embedding"] == [9.0] * 5 and e.vectors().count() == 51


def test_store_keeps_changes_and_compacts(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}/t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "vec_id long, partition_id long")
    t.write({"membership": row(0, 0)})
    want = {(0, 0)}
    for k in range(1, 12):
        t.write({"membership": Delta(row(k, k), row(k - 3, 0))})
        want = {(a, b) for a, b in want if a != k - 3} | {(k, k)}
        assert set(map(tuple, t.read("membership").collect())) == want
        assert t._chain("membership", k)[1] <= 8
    both = Delta(row(50, 1), row(11, 0)).then(Delta(row(51, 1), row(50, 0)), ["vec_id"])
    assert set(map(tuple, both.on(t.read("membership"), ["vec_id"]).collect())) == want - {(11, 11)} | {(51, 1)}
    d = difference(t.read("membership"), t.read("membership", 10), ["vec_id"])
    assert set(map(tuple, d.on(t.read("membership"), ["vec_id"]).collect())) == set(map(tuple, t.read("membership", 10).collect()))
    assert t.vacuum(2) and set(map(tuple, t.read("membership").collect())) == want


def test_store_stream_and_engine(spark, tmp_path):
    x, df = points(spark)
    v = df.select("vec_id", "embedding")
    e = Engine(spark, f"file://{tmp_path}/db")
    e.insert(v.where("vec_id < 40"))
    e.create_cluster_set(1.5)
    e.insert(v.where("vec_id >= 40"))
    e.insert(v.where("vec_id >= 40"))  # known ids change nothing
    assert pairs(e.store.read("mst_edges")) == brute_tree(x) and e.vectors().count() == 60
    assert e.members().groupBy("partition_id").count().agg(F.max("count")).first()[0] <= 64
    assert rows(e.cluster_sets().get(1.5)) == rows(clusters.single_linkage(df.select(F.col("vec_id").alias("node")), mst.mst(df), 1.5))
    e.delete(spark.createDataFrame([(5,)], "vec_id long"))
    assert pairs(e.store.read("mst_edges")) == brute_tree(x, set(range(60)) - {5})
    e.undo()
    assert e.vectors().count() == 60
    assert e.get(vector=9, show=IDS).first()["vec_id"] == 9
    with pytest.raises(KeyError):
        e.get(vector=999)
    with pytest.raises(KeyError):
        e.get(threshold=0.123)
    p = e.members().first()["partition_id"]
    n = e.members().where(F.col("partition_id") == p).count()
    e.split(partitions.two_means(), p)
    assert 0 < e.members().where(F.col("partition_id") == p).count() < n and e.vectors().count() == 60
    assert e.partition_meta().agg(F.sum("size")).first()[0] == 60
    assert e.vector_meta(3).first()["dim"] == 5 and e.clusters(1.5).count() > 0
    assert [r["vec_id"] for r in e.knn([float(z) for z in x[9]], 1).collect()] == [9]
    assert e.get(dims=2).columns == ["vec_id", "x", "y"]
    e.trace.write(spark, f"file://{tmp_path}/trace")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/trace").columns == ["id", "parent_id", "start", "end", "message"]
    v.write.parquet(f"file://{tmp_path}/in")
    from vecloom.sources.store import Store
    from vecloom.streaming import ingest

    s = Store(spark, f"file://{tmp_path}/stream")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    ingest.start(stream, s, f"file://{tmp_path}/cp").awaitTermination()
    assert pairs(s.read("mst_edges")) == brute_tree(x)
    with pytest.raises(RuntimeError), s.transaction() as t:
        t["vectors"] = v
        raise RuntimeError
    assert s.read("vectors").count() == 60
