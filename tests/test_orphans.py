from datetime import datetime

from pyspark.sql import functions as F

from vecloom.operators.orphans import Reference, direct, orphans, report
from vecloom.operators.skew import hot_keys

T = [datetime(2024, m, 1) for m in range(1, 13)]
KEYS = "key long, since timestamp_ntz, until timestamp_ntz"
REFS = "ref_id long, target long, at timestamp_ntz, key string"


def tables(spark):
    targets = spark.createDataFrame([(1, T[0], None), (2, T[0], T[5]), (3, T[8], None), (4, T[0], None), (5, T[0], None), (6, None, None)], KEYS)
    rows = spark.createDataFrame([
        (10, 1, T[2], "a"), (11, 2, T[5], "a"), (12, 2, T[4], "a"), (13, 3, T[2], "a"), (14, 99, T[2], "a"), (15, None, T[2], "a"),
        (16, 98, None, "a"), (17, 2, None, "a"), (18, 6, T[2], "a"), (10, 1, T[2], "b"), (19, -1, T[0], "a"), (20, 5, T[3], "a"),
    ], REFS)
    return rows, targets


def test_direct(spark):
    rows, targets = tables(spark)
    got = {(r["ref_id"], r["target"], r["why"]) for r in direct(Reference("m", rows, "t"), targets).collect()}
    assert got == {(11, "2", "deleted"), (13, "3", "early"), (14, "99", "missing"), (16, "98", "missing"), (19, "-1", "missing")}


def test_cascade_and_report(spark):
    rows, targets = tables(spark)
    # 1 -> 777 is missing; 4 -> 1 and 5 -> 4 inherit it, and so do references to 1 and 5
    tree = spark.createDataFrame([(1, 777, T[0], "x"), (4, 1, T[0], "x"), (5, 4, T[0], "x"), (6, 6, T[0], "x")], REFS)
    found = orphans([Reference("m", rows, "t"), Reference("t", tree, "t", "t")], {"t": targets})
    got = {(r["ref_table"], r["ref_id"], r["kind"]) for r in found.collect()}
    assert {("t", 1, "direct"), ("t", 4, "inherited"), ("t", 5, "inherited"), ("m", 10, "inherited"), ("m", 20, "inherited"), ("m", 14, "direct")} <= got
    assert not any(r[1] == 6 for r in got)
    n = {(r["ref_table"], r["period"], r["kind"], r["why"]): r["n_references"] for r in report(found).collect()}
    assert n["m", None, "direct", "missing"] == 1 and n["m", "2024-03", "direct", "missing"] == 1


def test_several_references_per_record_and_circle(spark):
    targets = spark.createDataFrame([(i, None, None) for i in (1, 2, 3)], KEYS)
    rows = spark.createDataFrame([(1, 2, T[0], ""), (2, 3, T[0], ""), (3, 1, T[0], ""), (3, 9, T[0], "")], REFS)
    found = orphans([Reference("t", rows, "t", "t")], {"t": targets})
    got = {(r["ref_id"], r["target"], r["kind"]) for r in found.collect()}
    assert got == {(3, "9", "direct"), (2, "3", "inherited"), (1, "2", "inherited"), (3, "1", "inherited")}


def test_half_of_the_rows_on_one_key_in_the_cascade(spark):
    # cluster 1 refers to one that is missing; half of 20,000 members refer to cluster 1
    targets = spark.createDataFrame([(i, None, None) for i in range(1, 2001)], KEYS)
    members = spark.range(20000).select(F.col("id").alias("ref_id"), F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id") % 2000 + 1).cast("long").alias("target"), F.lit(T[0]).cast("timestamp_ntz").alias("at"))
    tree = spark.createDataFrame([(1, 99999, T[0], ""), (3, 1, T[0], "")], REFS)
    assert hot_keys(members, "target") == {1: 11} or len(hot_keys(members, "target")) == 1
    found = orphans([Reference("m", members, "t"), Reference("t", tree, "t", "t")], {"t": targets})
    n = {(r["ref_table"], r["kind"]): r["count"] for r in found.groupBy("ref_table", "kind").count().collect()}
    want = sum(1 for i in range(20000) if i % 2 == 0 or i % 2000 + 1 in (1, 3))
    assert n == {("t", "direct"): 1, ("t", "inherited"): 1, ("m", "inherited"): want}


def test_empty(spark):
    none = spark.createDataFrame([], REFS)
    targets = spark.createDataFrame([], KEYS)
    assert orphans([Reference("t", none, "t", "t")], {"t": targets}).count() == 0
    assert direct(Reference("t", none, "t"), targets).count() == 0
