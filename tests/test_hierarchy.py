import random

import pytest
from pyspark.sql import functions as F

from vecloom.operators import hierarchy as module
from vecloom.operators.hierarchy import descendants, hierarchy

SCHEMA = "id long, parent long, size long, root long, v string"  # root and v: further columns with clashing names


@pytest.fixture(autouse=True, params=["one task", "joins"])
def way(request, monkeypatch):
    if request.param == "joins":
        monkeypatch.setattr(module, "ONE_TASK", -1)


def frame(spark, pairs, size=None):
    return spark.createDataFrame([(a, b, (size or {}).get(a), 99, "x") for a, b in pairs], SCHEMA)


def brute(pairs):
    parent = {}
    for a, b in pairs:
        if a is not None and (a not in parent or (b is not None and (parent[a] is None or b > parent[a]))):
            parent[a] = b
    out = {}
    for x in parent:
        path, y = [x], x
        while parent.get(y) is not None and parent[y] in parent and parent[y] not in path:
            y = parent[y]
            path.append(y)
        p = parent.get(y)
        if p is not None and p in parent:
            ring = path[path.index(p):]
            out[x] = (min(ring), None, None, x in ring)
        else:
            out[x] = (y, len(path) - 1, path[::-1], False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_circles(spark, seed):
    r = random.Random(seed)
    n = 60
    pairs = [(i, r.choice([None, r.randrange(n), i - 1 if i else None, 1000])) for i in range(n)]
    pairs += pairs[:5]
    want = brute(pairs)
    got = {x["id"]: x for x in hierarchy(frame(spark, pairs, {i: i for i in range(n)}), "id", "parent", "size").collect()}
    assert set(got) == set(want)
    for x, (root, depth, path, ring) in want.items():
        g = got[x]
        assert (g["root"], g["depth"], g["path"], g["on_circle"]) == (root, depth, path, ring), x
    for x, g in got.items():
        if not g["leads_to_circle"]:
            below = [y for y, (_, _, p, _) in want.items() if p and x in p and y != x]
            assert g["n_below"] == len(below) and g["total_below"] == sum(below)
    pairs_got = {(a, d, k) for a, d, k in (tuple(z) for z in descendants(frame(spark, pairs), "id", "parent").collect())}
    assert pairs_got == {(a, y, len(p) - 1 - k) for y, (_, _, p, _) in want.items() if p for k, a in enumerate(p[:-1])}


def test_long_chain_self_loop_and_nulls(spark):
    chain = [(i, i + 1) for i in range(200)] + [(200, None), (300, 300), (301, 300), (None, 5), (302, 77777)]
    got = {x["id"]: x for x in hierarchy(frame(spark, chain), "id", "parent").collect()}
    assert got[0]["depth"] == 200 and got[0]["root"] == 200 and got[200]["n_below"] == 200 and got[200]["height"] == 200
    assert got[300]["root"] == 300 and got[300]["on_circle"] and got[301]["root"] == 300 and not got[301]["on_circle"]
    assert got[302]["root"] == 302 and got[302]["parent"] is None
    assert None not in got


def test_empty(spark):
    assert hierarchy(frame(spark, []), "id", "parent").count() == 0
    assert descendants(frame(spark, []), "id", "parent").count() == 0


def test_wide_tree_is_preaggregated(spark):
    df = spark.range(1, 5001).select(F.col("id"), F.lit(0).cast("long").alias("parent")).unionByName(spark.createDataFrame([(0, None)], "id long, parent long"))
    assert hierarchy(df, "id", "parent", paths=False).where("id = 0").first()["n_below"] == 5000


@pytest.mark.parametrize("seed", range(2))
def test_subtrees_that_lead_into_a_circle(spark, seed):
    r = random.Random(seed)
    ring = [(0, 1), (1, 2), (2, 0), (3, 3)]
    pairs = ring + [(i, r.randrange(i)) for i in range(4, 40)]
    parent = dict(pairs)
    want = set()
    for x in range(4, 40):
        y, k = parent[x], 1
        while y > 3:
            want.add((y, x, k))
            y, k = parent[y], k + 1
    assert want
    got = {x["id"]: x for x in hierarchy(frame(spark, pairs, {i: i for i in range(40)}), "id", "parent", "size").collect()}
    for x in range(40):
        own = [(d, k) for a, d, k in want if a == x]
        g = got[x]
        assert (g["n_below"], g["total_below"], g["height"]) == ((None,) * 3 if x < 4 else (len(own), sum(d for d, _ in own), max((k for _, k in own), default=0)))
        assert g["leads_to_circle"] and g["on_circle"] is (x < 4)
    assert {tuple(z) for z in descendants(frame(spark, pairs), "id", "parent", beneath_circles=True).collect()} == want
