"""Fixed-capacity containers: best-fit decreasing per shard, certified by dual-feasible-function bounds.

A shard whose number of containers equals its lower bound is proved best and stays. The shards with a gap give up
their containers that are not full, exchange these items by a new hash into fewer shards and pack them again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import pin

SHARD = 8192  # items one task packs
EXCHANGES = 3


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions on integer sizes 1..capacity with their counts.

    A dual feasible function maps sizes so that what fits a container still sums to at most 1; the sum over all items
    is then a bound. Family 1 (threshold L): sizes above capacity - L count as a container, sizes below L as nothing.
    Family 2 (step k): sizes are rounded to multiples of capacity / k, downwards unless they fall on one.
    """
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    for low in {int(s) for s in sizes if s * 2 <= capacity}:
        f = np.where(sizes > capacity - low, capacity, np.where(sizes < low, 0, sizes))
        best = max(best, -(-int((f * counts).sum()) // capacity))
    for k in range(1, 33):
        whole = (sizes * (k + 1)) % capacity == 0
        f = np.where(whole, sizes * k, ((sizes * (k + 1)) // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((f * counts).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes in decreasing order). The free space of open containers is a bit mask."""
    free: dict[int, list[int]] = {}
    mask, used = 0, 0
    out = np.empty(len(sizes), np.int64)
    for n, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            room = s + ((fits & -fits).bit_length() - 1)
            box = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            box, room, used = used, capacity, used + 1
        out[n] = box
        left = room - s
        if left:
            free.setdefault(left, []).append(box)
            mask |= 1 << left
    return out


def _pack(t: pa.Table, capacity: int) -> pa.Table:
    t = t.sort_by([("amount", "descending"), ("item", "ascending"), ("piece", "ascending")])
    size = t["amount"].to_numpy()
    box = best_fit(size, capacity)
    bound = lower_bound(*np.unique(size, return_counts=True), capacity)
    n = len(size)
    filled = np.bincount(box, size)[box].astype(np.int64)
    keep = t.select(["item", "piece", "amount", "shard"])
    return keep.append_column("box", pa.array(box)).append_column("filled", pa.array(filled)).append_column("gap", pa.array(np.full(n, box.max() + 1 - bound, np.int64)))


def _packed(items: DataFrame, capacity: int, shards: int, seed: int) -> DataFrame:
    s = items.select("item", "piece", "amount", F.pmod(F.xxhash64(F.lit(seed), "item", "piece"), F.lit(shards)).alias("shard"))
    out = s.groupBy("shard").applyInArrow(lambda t: _pack(t, capacity), "item long, piece long, amount long, shard long, box long, filled long, gap long")
    return out.withColumn("round", F.lit(seed))


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, amount, batch): every item of positive size in exactly one container of at most ``capacity``.

    Only an item larger than ``capacity`` is divided: into full containers (pieces 0, 1, ...) and a rest that is
    packed like any item. Repeated items count once (the largest size holds); null items or sizes and sizes below 1
    have no place. batch is text: round, shard and container. An empty table gives no rows.
    """
    one = items.where((F.col(size) > 0) & F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(F.col(size)).cast("long").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("long")
    full = one.where(whole > 0).select("item", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece")).select("item", "piece", F.lit(capacity).cast("long").alias("amount"))
    rest = one.select("item", whole.alias("piece"), (F.col("size") % capacity).alias("amount")).where("amount > 0")
    rest = pin(rest)
    n = rest.count()
    done = full.withColumn("batch", F.concat_ws("-", F.lit("full"), "item", "piece"))
    name = F.concat_ws("-", "round", "shard", "box")
    state = pin(_packed(rest, capacity, max(1, -(-n // SHARD)), 1)) if n else None
    if state is None:
        return done.select(F.col("item").alias(item), "piece", "amount", "batch")
    last = 0
    for seed in range(2, 2 + EXCHANGES):
        loose = (F.col("gap") > 0) & (F.col("filled") < capacity)
        pool = pin(state.where(loose))
        m = pool.count()
        shards = max(1, -(-m // SHARD))
        if not m or (shards == 1 and last == 1):
            break
        again = pin(_packed(pool, capacity, shards, seed))
        last = shards
        before, after = (d.select("round", "shard", "box").distinct().count() for d in (pool, again))
        if after < before:
            state = pin(state.where(~loose).unionByName(again))
        elif shards == 1:
            break
    return done.unionByName(state.select("item", "piece", "amount", name.alias("batch"))).select(F.col("item").alias(item), "piece", "amount", "batch")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(batches, bound, total, room): containers used, their certified lower bound, total size and unused share."""
    sizes = packed.groupBy("amount").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` different sizes
    bound = lower_bound(np.array([r[0] for r in sizes], np.int64), np.array([r[1] for r in sizes], np.int64), capacity)
    t = packed.agg(F.countDistinct("batch").alias("batches"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
    return t.select("batches", F.lit(bound).cast("long").alias("bound"), "total", F.when(F.col("batches") > 0, 1 - F.col("total") / (F.col("batches") * capacity)).alias("room"))
