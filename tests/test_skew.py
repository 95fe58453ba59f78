import random
from collections import Counter

from pyspark.sql import functions as F

from vecloom.operators.skew import distinct_per_key, frequencies, hot_keys, mode_per_key, salted_join, weighted_percentile
from vecloom.sources.tables import latest, uuid_text


def data(spark, n=6000):
    r = random.Random(5)
    rows = [(1 if r.random() < 0.5 else r.randrange(40), r.choice([None, *range(30)]), i // 2, 7) for i in range(n)]
    rows += [(None, 3, -1, 7), (2, None, -2, 7)]
    return rows, spark.createDataFrame(rows, "k long, v long, row long, n long")


def test_frequencies_against_brute_force(spark):
    rows, df = data(spark)
    seen = {(k, v, row) for k, v, row, _ in rows if k is not None and v is not None}
    want = Counter((k, v) for k, v, _ in seen)
    freq = frequencies(df, "k", "v", "row")
    assert {(r["k"], r["v"]): r["n"] for r in freq.collect()} == dict(want)
    per = {}
    for (k, v), n in want.items():
        per.setdefault(k, Counter())[v] = n
    got = {r["k"]: (r["n_rows"], r["n_values"]) for r in distinct_per_key(freq, "k").collect()}
    assert got == {k: (sum(c.values()), len(c)) for k, c in per.items()}
    mode = {r["k"]: (r["mode"], r["mode_n"]) for r in mode_per_key(freq, "k", "v").collect()}
    assert mode == {k: min(((v, n) for v, n in c.items()), key=lambda z: (-z[1], z[0])) for k, c in per.items()}
    for q in (0.0, 0.25, 0.5, 1.0):
        p = {r["k"]: r["percentile"] for r in weighted_percentile(freq, "k", "v", q, buckets=4).collect()}
        for k, c in per.items():
            every = sorted(c.elements())
            assert p[k] == every[max(1, -(-int(q * 100) * len(every) // 100)) - 1], (k, q)


def test_salted_join_equals_join(spark):
    rows, df = data(spark)
    assert list(hot_keys(df, "k")) == [1] and hot_keys(df, "k")[1] in (3, 4)
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 40, 2)] + [(None, "none"), (1, "one")], "key long, w string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        cols = ["k", "v", "row", *(["w"] if how in ("left", "inner") else [])]
        a = sorted(map(repr, salted_join(df, right, "k", "key", "row", how).select(cols).collect()))
        b = sorted(map(repr, df.join(right, F.col("k") == F.col("key"), how).select(cols).collect()))
        assert a == b


def test_percentile_of_skewed_values(spark):
    rows = [(1, v, 1) for v in [0, 2**62, -(2**62), *range(500)]] + [(2, 2**63 - 1, 5), (2, -(2**63), 4), (3, None, 1), (None, 3, 1), (4, 7, 0)]
    df = spark.createDataFrame(rows, "k long, v long, n long")
    for q in (0.0, 0.5, 1.0):
        got = {r["k"]: r["percentile"] for r in weighted_percentile(df, "k", "v", q, buckets=8).collect()}
        one = sorted(v for k, v, _ in rows if k == 1)
        two = [-(2**63)] * 4 + [2**63 - 1] * 5
        assert got == {1: one[max(1, -(-int(q * 2) * len(one) // 2)) - 1], 2: two[max(1, -(-int(q * 2) * 9 // 2)) - 1]}


def test_empty(spark):
    none = spark.createDataFrame([], "k long, v long, row long")
    freq = frequencies(none, "k", "v", "row")
    assert freq.count() == 0 and distinct_per_key(freq, "k").count() == 0 and weighted_percentile(freq, "k", "v", 0.5).count() == 0


def test_latest_and_uuid(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 6, "c"), (2, None, "d"), (None, 9, "e")], "id long, at long, x string")
    assert {tuple(r) for r in latest(df, "id", "at", ["id", "at", "x"]).collect()} == {(1, 6, "c"), (2, None, "d")}
    one = "0188a8a0-1b2c-4d3e-8f90-abcdefabcdef"
    forms = [one, one.upper(), "{" + one + "}", f"  {one} ", one.replace("-", ""), f"urn:uuid:{one}", " ", None, "no uuid"]
    got = [r[0] for r in spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, s string").orderBy("i").select(uuid_text(F.col("s"))).collect()]
    assert got == [one] * 6 + [None, None, "no uuid"]
