"""Keys that hold most rows: frequency compression, and joins on hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import drop, pin


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> dict:
    """key: number of tasks it should be spread over, for each key with more rows than a task should get.

    A task should get 1/``parts`` of the rows (by default parts is the number of shuffle partitions, 64 at least), so
    fewer than ``parts`` keys can exceed it: collecting them is bounded by the shares, which sum to one. Null keys are
    not counted. ``df`` is read twice; pin it first if it is costly.
    """
    parts = parts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bound = max(df.count() // parts, 1000)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > F.lit(bound))
    return {r[0]: -(-r[1] // bound) for r in counts.collect()}


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: str, how: str = "left", hot: dict | None = None) -> DataFrame:
    """Equi-join whose hot left keys are spread by a hash of column ``spread`` over as many tasks as their rows need.

    Only rows of ``right`` with a hot key are repeated (once for each of its tasks), all others stay single. ``hot``:
    ``hot_keys`` of the left side, if known. Rows with a null key match nothing. Columns of both sides must not clash;
    the result has all of them (those of the left side in a semi or anti join).
    """
    hot = hot_keys(left, left_key) if hot is None else hot
    cond = F.col(left_key) == F.col(right_key)
    if not hot:
        return left.join(right, cond, how)
    one = F.lit(1).cast("long")
    tasks = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in hot.items() for x in (k, int(n))]).cast(f"map<{kind},bigint>"), c), one)
    kind = dict(left.dtypes)[left_key]
    a = left.withColumn("_ls", F.when(F.col(left_key).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), tasks(F.col(left_key)))))
    b = right.where(F.col(right_key).isNotNull()).withColumn("_rs", F.explode(F.sequence(F.lit(0).cast("long"), tasks(F.col(right_key)) - 1)))
    return a.join(b, cond & (F.col("_ls") == F.col("_rs")), how).drop("_ls", "_rs")


def frequencies(df: DataFrame, key: str, value: str, once: str | None = None) -> DataFrame:
    """(key, value, n): value-frequency compression. A hot key is spread by its values before any grouping by key.

    ``once`` names a row key of which copies count once. Null keys are left out; null values form no value.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    if once:
        rows = rows.repartition(key, value).groupBy(key, value, once).agg(F.lit(1).alias("_one"))
    return rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def distinct_per_key(freq: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_values) from frequencies; each hot key arrives pre-aggregated, one row per map task."""
    return freq.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))


def mode_per_key(freq: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode, mode_n): the most frequent value, ties to the smallest."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")
    return freq.groupBy(key).agg(best).select(key, F.col("b.v").alias("mode"), (-F.col("b.m")).alias("mode_n"))


def weighted_percentile(freq: DataFrame, key: str, value: str, q: float, buckets: int = 64) -> DataFrame:
    """(key, percentile): exact lower percentile of the weighted values, the smallest v with F(v) >= q.

    No key is sorted in one task: each round sums the weights of a key's range in at most ``buckets`` equal parts, finds
    the part that holds the rank and goes on with that part alone, until it is a single value. However the values are
    spread, a round leaves 1/``buckets`` of the range, so 64-bit values take 11 rounds at most.
    ``value`` must be an integer column. Rows with a null key, value or weight count for nothing.
    """
    from pyspark.sql import Window

    rows = pin(freq.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col("n") > 0)).select(F.col(key).alias("_k"), F.col(value).cast("decimal(20,0)").alias("_v"), F.col("n").cast("long").alias("_n")))
    hot = hot_keys(rows, "_k")
    ends = rows.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("_n") * F.lit(q)).cast("long")).alias("_rank"))
    state = pin(ends.withColumnRenamed("_k", "_sk"))
    while state.where("_hi > _lo").limit(1).count():
        width = F.expr(f"cast((_hi - _lo) div {buckets} + 1 as decimal(20,0))")  # whole numbers: nothing is rounded
        near = salted_join(rows, state, "_k", "_sk", "_v", "inner", hot).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        near = pin(near.select("_k", "_v", "_n", "_lo", "_hi", "_rank", width.alias("_w")).withColumn("_b", F.expr("cast((_v - _lo) div _w as int)")))
        per = near.groupBy("_k", "_b").agg(F.sum("_n").alias("_bn"), F.max("_rank").alias("_rank"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_w").alias("_w"))
        per = per.withColumn("_to", F.sum("_bn").over(Window.partitionBy("_k").orderBy("_b")))  # at most ``buckets`` rows a key
        hit = per.where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_bn") < F.col("_rank")))
        low = (F.col("_lo") + F.col("_b") * F.col("_w")).cast("decimal(20,0)")
        nxt = pin(hit.select(F.col("_k").alias("_sk"), low.alias("_lo"), F.least(F.col("_hi"), (low + F.col("_w") - 1).cast("decimal(20,0)")).alias("_hi"), (F.col("_rank") - (F.col("_to") - F.col("_bn"))).alias("_rank")))
        drop(state), drop(rows)
        state, rows = nxt, near.select("_k", "_v", "_n")
    return state.select(F.col("_sk").alias(key), F.col("_lo").cast(dict(freq.dtypes)[value]).alias("percentile"))
