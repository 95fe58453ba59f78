import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vecloom.llm import similar, similarity_clusters, vectors
from vecloom.llm.graph_index import build, search
from vecloom.llm.similar import most_similar
from vecloom.llm.similarity_clusters import describe, flow, forest, markov_step, similarity_clusters as clusters
from vecloom.llm.vectors import Cells, fold_copies, usable

DIM = 8


def blobs(n=600, seed=0, copies=40):
    r = np.random.default_rng(seed)
    c = r.normal(0, 6, (5, DIM))
    x = (c[r.integers(0, 5, n)] + r.normal(0, 0.4, (n, DIM))).astype(np.float32)
    x[:copies] = x[0]  # a hot group of copies
    x[n // 2 : n // 2 + n // 4] = (c[0] + r.normal(0, 0.05, (n // 4, DIM))).astype(np.float32)  # a dense group
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def usable_frame(spark, x):
    return usable(frame(spark, x), "embedding", DIM, ["vec_id"])


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [1.0], "c"), (4, [1.0, None], "d"), (5, [nan, 1.0], "e"), (6, [1.0, inf], "f"), (7, [], "g"), (8, [1.0, 2.0, 3.0], "h"), (None, [0.0, -0.0], "i")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, vec string")
    got = {(r["vec_id"], np.frombuffer(r["vec"], np.float32).tolist().__str__()) for r in usable(df, "embedding", 2, ["vec_id"]).collect()}
    assert got == {(1, "[1.0, 2.0]"), (None, "[0.0, 0.0]")}
    reps, members = fold_copies(usable(df, "embedding", 2, ["vec_id"]), "vec_id")
    assert reps.count() == 1 and members.count() == 1


def test_graph_recall_and_reach():
    x = blobs(2000, 3, 1)
    nbr, entry = build(x, degree=12, width=24)
    met, wave = set(entry.tolist()), entry
    while len(wave):
        wave = np.array([v for v in np.unique(nbr[wave]) if v < len(x) and v not in met], dtype=int)
        met |= set(wave.tolist())
    assert len(met) == len(x)
    q = x[::20]
    ids, d = search(x, nbr, entry, q, 10, 64)
    full = ((q[:, None] - x[None]) ** 2).sum(2)
    want = np.argsort(full, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.97
    for n in (0, 1, 2, 5):
        nbr, entry = build(x[:n], degree=12, width=24)
        if n:
            i, d = search(x[:n], nbr, entry, q[:3], 10, 16)
            assert ((i < n).sum(1) == n).all()


def test_cell_bound_is_a_bound():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, DIM)).astype(np.float32)
    cells = Cells(r.normal(size=(7, DIM)))
    far, home = cells.far(x), cells.home(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(0, 400, 7):
        for c in range(7):
            other = d[i][home == c]
            if c != home[i] and len(other):
                assert far[i, c] <= other.min() + 1e-5


@pytest.mark.parametrize("shard", [64, 4096])
def test_most_similar(spark, shard, monkeypatch):
    monkeypatch.setattr(similar, "SHARD", shard)
    monkeypatch.setattr(similar, "BLOCK", 50)
    x = blobs()
    v = usable_frame(spark, x).persist()
    ks = {i: [0, 1, 5, 60, 2000][i % 5] for i in range(0, 600, 20)}
    q = spark.createDataFrame([(i, k, i if i % 40 else None) for i, k in ks.items()], "q long, k int, self long").join(v.select(F.col("vec_id").alias("q"), "vec"), "q")
    got = {}
    for r in most_similar(v, "vec_id", q, DIM).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["vec_id"], r["d"]))
    hit = want_n = 0
    for i, k in ks.items():
        d = ((x.astype(np.float64) - x[i]) ** 2).sum(1)
        own = i if i % 40 else None
        order = [j for j in np.lexsort((np.arange(600), d)) if j != own][:k]
        have = sorted(got.get(i, []))
        assert len(have) == len(order) and [h[0] for h in have] == list(range(1, len(order) + 1))
        assert all(abs(h[2] - d[h[1]]) < 1e-9 for h in have)
        hit += len({h[1] for h in have} & set(order))
        want_n += len(order)
    assert hit >= 0.95 * want_n


@pytest.mark.parametrize("shard", [64, 4096])
def test_nearest_of_each(spark, shard, monkeypatch):
    monkeypatch.setattr(similar, "SHARD", shard)
    x = blobs()
    got = {}
    for r in similar.nearest_of_each(usable_frame(spark, x), "vec_id", DIM, 5).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["vec_id"], r["d"]))
    hit = 0
    for i in range(len(x)):
        d = ((x.astype(np.float64) - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:5]
        have = sorted(got[i])
        assert [h[0] for h in have] == [1, 2, 3, 4, 5] and all(abs(h[2] - d[h[1]]) < 1e-9 for h in have)
        hit += len({h[1] for h in have} & set(order))
    assert hit >= 0.97 * 5 * len(x)
    assert similar.nearest_of_each(usable_frame(spark, x[:1]), "vec_id", DIM, 5).count() == 0
    assert similar.nearest_of_each(usable_frame(spark, x[:0]), "vec_id", DIM, 5).count() == 0


def test_query_at_an_empty_centre(spark, monkeypatch):
    x = blobs(60, copies=1)
    monkeypatch.setattr(vectors, "fit_cells", lambda *_: Cells(np.stack([np.full(DIM, 500.0), x[0], np.full(DIM, -500.0), x[1]])))
    q = usable_frame(spark, np.full((1, DIM), 400)).select(F.col("vec_id").alias("q"), F.lit(3).alias("k"), F.lit(None).cast("long").alias("self"), "vec")
    got = [r["vec_id"] for r in most_similar(usable_frame(spark, x), "vec_id", q, DIM).orderBy("rank").collect()]
    assert got == np.argsort(((x.astype(np.float64) - 400) ** 2).sum(1))[:3].tolist()


def test_most_similar_empty(spark):
    none = usable_frame(spark, np.empty((0, DIM)))
    q = spark.createDataFrame([], "q long, k int, self long, vec binary")
    assert most_similar(none, "vec_id", q, DIM, most=3).count() == 0


def brute(x, t):
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    lab = np.arange(len(x))
    while True:
        new = np.array([lab[d[i] < t].min() for i in range(len(x))]) if t > 0 else lab
        if (new == lab).all():
            break
        lab = new
    size = np.bincount(lab, minlength=len(x))
    return {(i, int(c)) for i, c in enumerate(lab) if size[c] > 1}


@pytest.mark.parametrize("tile", [50, 8192])
def test_clusters_are_the_chains_of_links(spark, tile, monkeypatch):
    monkeypatch.setattr(similarity_clusters, "TILE", tile)
    x = blobs(400, 4)
    line = np.zeros((60, DIM), np.float32)
    line[:, 0] = 100 + np.arange(60) * 0.9  # an even chain, on which flow alone finds no attractor
    x = np.vstack([x, line])
    limits = [(1, 0.5), (2, 0.9), (3, None), (4, 0.0)]
    v = usable_frame(spark, x).persist()
    found, weights = clusters(v, "vec_id", DIM, limits)
    got = {s: set() for s in (1, 2)}
    for r in found.collect():
        got[r["set_id"]].add((r["vec_id"], r["cluster_id"]))
    assert got[1] == brute(x, 0.5) and got[2] == brute(x, 0.9)
    for r in describe(found, weights, v, "vec_id", DIM).collect():
        own = [i for i, c in got[r["set_id"]] if c == r["cluster_id"]]
        assert r["size"] == len(own) and np.allclose(r["centroid"], x[own].astype(np.float64).mean(0), atol=1e-5)
        assert 0 < len(r["typical"]) <= 3 and set(r["typical"]) <= set(own)


@pytest.mark.parametrize("tile", [50, 8192])
def test_typical_members_are_nearest_to_the_centroid_of_all(spark, tile, monkeypatch):
    monkeypatch.setattr(similarity_clusters, "TILE", tile)
    x = np.vstack([blobs(400, 4), np.full((1, DIM), 50, np.float32), np.full((1, DIM), 50.01, np.float32)])
    v = usable_frame(spark, x).persist()
    found, weights = clusters(v, "vec_id", DIM, [(1, 0.5), (2, 0.9)])
    members = {}
    for r in found.collect():
        members.setdefault((r["set_id"], r["cluster_id"]), []).append(r["vec_id"])
    got = {(r["set_id"], r["cluster_id"]): r for r in describe(found, weights, v, "vec_id", DIM).collect()}
    assert set(got) == set(members) and max(map(len, members.values())) > 50
    for name, own in members.items():
        y = x[sorted(own)].astype(np.float64)
        d = dict(zip(sorted(own), ((y - y.mean(0)) ** 2).sum(1)))
        assert got[name]["size"] == len(own) and len(got[name]["typical"]) == min(3, len(own))
        assert np.allclose([d[i] for i in got[name]["typical"]], sorted(d.values())[:3])


def test_clusters_empty_and_alone(spark):
    for x in (np.empty((0, DIM)), blobs(1)):
        assert clusters(usable_frame(spark, x), "vec_id", DIM, [(1, 1.0)])[0].count() == 0
    assert clusters(usable_frame(spark, blobs(5)), "vec_id", DIM, [(1, -1.0)])[0].count() == 0


def test_flow_separates_two_cliques(spark):
    pairs = [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4)]
    s = [0.1 if p == (3, 4) else 1.0 for p in pairs]
    lab, got = flow(8, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.array(s))
    assert len(set(lab[:4])) == 1 and len(set(lab[4:])) == 1 and lab[0] != lab[7] and abs(got.sum() - 8) < 1e-9
    e = spark.createDataFrame([(1, a, b, w) for (a, b), w in zip(pairs, s)], "set_id int, a long, b long, s double")
    lab = {r["node"]: r["label"] for r in markov_step(e).collect()}
    assert len({lab[i] for i in range(4)}) == 1 and lab[0] != lab[7] and len({lab[i] for i in range(4, 8)}) == 1


def test_forest():
    i, j, w = np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([1.0, 1.0, 1.0, 5.0])
    assert sorted(forest(4, i, j, w)) == [0, 1, 3]
    assert len(forest(3, i[:0], j[:0], w[:0])) == 0


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]


def test_more_clusters_than_cells_and_copies_in_rounds(spark, monkeypatch):
    r = np.random.default_rng(5)
    c = r.normal(0, 6, (24, DIM))
    x = (c[np.arange(480) % 24] + r.normal(0, 0.15, (480, DIM))).astype(np.float32)
    for k, v in {"MOST_CELLS": 4, "SAMPLE": 64, "ROWS_A_CELL": 10}.items():
        monkeypatch.setattr(vectors, k, v)
    reps = usable_frame(spark, x).withColumnRenamed("vec_id", "rep")
    shards = vectors.fit_shards(reps, DIM, 64, vectors.fit_cells(reps, 480, DIM, grow=True))
    assert shards.n >= 24 and len(shards.near(x, 1.0)[0]) < 1.2 * 480  # each cluster has a cell, hardly any vector visits
    full = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    rows_, cells = shards.near(x, 1.0)
    met, home = set(zip(rows_.tolist(), cells.tolist())), shards.home(x)
    assert all((i, home[j]) in met for i, j in zip(*np.nonzero(full < 1.0)))
    for k, v in {"TILE": 8, "LEAST": 700, "COPIES": 0.1}.items():
        monkeypatch.setattr(similarity_clusters, k, v)
    held = []
    one = similarity_clusters._compared
    monkeypatch.setattr(similarity_clusters, "_compared", lambda *a: held.append(a[-3:]) or one(*a))
    found, _ = clusters(usable_frame(spark, x), "vec_id", DIM, [(1, 0.5)])
    assert {(z["vec_id"], z["cluster_id"]) for z in found.collect()} == brute(x, 0.5)
    assert len(held) > 1  # no round makes all copies


def test_rounds_hold_every_tile_once():
    home, visits = np.array([3, 0, 20000, 9000, 1]), np.array([0, 5, 70000, 0, 2])
    got = similarity_clusters._rounds(home, visits, 30000)
    parts = {}
    for which, n, k in got:
        for c in which:
            parts.setdefault(int(c), []).append((n, k))
    assert set(parts) == {0, 2, 3, 4} and all(sorted(k for _, k in z) == list(range(z[0][0])) for z in parts.values()) and len(parts[2]) > 1
