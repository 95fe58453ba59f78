"""Continuous inserts: each micro-batch extends the tree and writes one version of the store, as changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecloom.operators.graph import with_partitions
from vecloom.operators.knn import nearest_partition
from vecloom.operators.mst import clean, insert, mst
from vecloom.operators.partitions import CAPACITY, bootstrap, into_trees, meta
from vecloom.session import pin
from vecloom.sources.store import KEYS, Delta, Store, difference


def first(batch: DataFrame) -> dict[str, DataFrame | Delta]:
    """The tables of an empty engine after its first batch."""
    new = pin(clean(batch))
    tree, members = pin(mst(new)), pin(bootstrap(new).select("vec_id", "partition_id"))
    return {"vectors": new, "mst_edges": tree, "membership": members, "partition_meta": meta(new.join(members, "vec_id"), with_partitions(tree, members))}


def meta_of(vectors: DataFrame, before: DataFrame, now: DataFrame, tree: DataFrame, ids: DataFrame) -> Delta:
    """What changes in the partition metadata when the membership goes from ``before`` to ``now`` and the vectors or edges
    of ``ids`` (vec_id) have changed: only the partitions concerned are read."""
    ids = pin(ids.select("vec_id").distinct())
    of = lambda m: m.join(ids, "vec_id", "left_semi").select("partition_id")
    touched = pin(of(before).unionByName(of(now)).distinct())
    mine = pin(now.join(touched, "partition_id", "left_semi").select("vec_id", "partition_id"))
    return Delta(pin(meta(mine.join(vectors, "vec_id"), with_partitions(tree, mine))), touched)


def changes(vectors: DataFrame, tree: DataFrame, members: DataFrame, centres: DataFrame, batch: DataFrame) -> tuple[dict[str, DataFrame | Delta], DataFrame]:
    """(what an insert changes in each table, the partitions touched: partition_id). Known ids change nothing. centres:
    partition_id, centroid."""
    new = pin(clean(batch).join(vectors.select("vec_id"), "vec_id", "left_anti"))
    tree = tree.select("src", "dst", "weight")
    grown = pin(insert(tree, vectors, new).select("src", "dst", "weight"))
    edges = difference(tree, grown, KEYS["mst_edges"])
    edges = Delta(pin(edges.added), pin(edges.removed))
    home = pin(nearest_partition(new, centres).select("vec_id", "partition_id"))
    now = members.select("vec_id", "partition_id").unionByName(home)
    # an edge that went may have cut a partition's tree
    cut = edges.removed.select(F.explode(F.array("src", "dst")).alias("vec_id"))
    touched = pin(now.join(cut.unionByName(home.select("vec_id")).distinct(), "vec_id", "left_semi").select("partition_id").distinct())
    every = vectors.select("vec_id", "embedding").unionByName(new.select("vec_id", "embedding"))
    moved = pin(upkeep(every, now, grown, touched))
    member = Delta(moved, moved.select("vec_id"))
    ids = moved.select("vec_id").unionByName(cut).unionByName(edges.added.select(F.explode(F.array("src", "dst")).alias("vec_id")))
    about = meta_of(every, now, member.on(now, KEYS["membership"]), grown, ids)
    return {"vectors": Delta(new), "mst_edges": edges, "membership": member, "partition_meta": about}, touched


def upkeep(vectors: DataFrame, members: DataFrame, tree: DataFrame, touched: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(vec_id, partition_id) of all members of the partitions ``touched``: one whose tree fell apart is divided into
    its trees, pieces joined by an edge are put together again where they fit, and what exceeds the capacity is divided
    by two means. Partitions that change get new ids; the others keep theirs."""
    mine = pin(members.join(touched, "partition_id", "left_semi").select("vec_id", "partition_id"))
    last = members.agg(F.max("partition_id")).first()[0] or 0
    edges = with_partitions(tree, mine)
    pieces = pin(into_trees(mine.join(vectors, "vec_id"), edges, capacity))
    size = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("partition_id").alias("lo"), F.max("partition_id").alias("hi"))
    old = pieces.groupBy(F.col("partition_id").alias("op")).agg(F.count(F.lit(1)).alias("on"))
    whole = size.join(old, (F.col("lo") == F.col("op")) & (F.col("n") == F.col("on")), "left")
    keeps = F.when(F.col("on").isNotNull() & (F.col("lo") == F.col("hi")), F.col("lo"))
    # a piece is named by its smallest member, so these names are new and never meet
    name = whole.select(F.col("piece").alias("np"), F.coalesce(keeps, F.col("piece") + last + 1).alias("name"), "n")
    named = pin(pieces.join(name, F.col("piece") == F.col("np")).select("vec_id", F.col("name").cast("long").alias("partition_id"), "n"))
    full = named.where(F.col("n") > capacity)
    if not full.limit(1).count():
        return named.select("vec_id", "partition_id")
    top = named.agg(F.max("partition_id")).first()[0]
    part = bootstrap(vectors.join(full.select("vec_id"), "vec_id", "left_semi"), capacity)
    part = part.select("vec_id", (F.col("partition_id") + max(top, last) + 1).alias("partition_id"))
    return pin(named.where(F.col("n") <= capacity).select("vec_id", "partition_id").unionByName(part))


def apply_batch(store: Store, batch: DataFrame, version: int | None = None) -> None:
    """Insert the batch (vec_id, embedding) into the newest version. A batch already written does nothing."""
    if version is not None and version in store.versions():
        return
    if store.versions():
        meta_ = store.read("partition_meta").select("partition_id", "centroid")
        tables, _ = changes(store.read("vectors"), store.read("mst_edges"), store.read("membership"), meta_, batch)
    else:
        tables = first(batch)
    store.write(tables, version)


def start(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run the inserts over a streaming DataFrame (vec_id, embedding). Versions carry the micro-batch's number, so a
    replayed batch changes nothing (exactly once)."""
    base = (store.versions() or [-1])[-1] + 1
    w = stream.writeStream.foreachBatch(lambda df, n: apply_batch(store, df, base + n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
