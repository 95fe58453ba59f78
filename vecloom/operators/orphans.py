"""References to records that do not exist, direct and inherited."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.skew import hot_keys, salted_join
from vecloom.session import drop, pin


@dataclass
class Reference:
    """One foreign key. ``rows``: ref_id, target, at. ``targets``: key, since, until (one row per key).

    ``key_of_row`` tells that ref_id is itself a key that others refer to, in the table of that name.
    """

    name: str
    rows: DataFrame
    into: str
    key_of_row: str | None = None


def direct(ref: Reference, targets: DataFrame, hot: dict | None = None) -> DataFrame:
    """(ref_table, ref_id, target, at, why): references whose target is missing, deleted or not yet there.

    why is missing, deleted (until <= at) or early (since > at). A reference without time can only be missing.
    Null targets are no references. Hot targets are salted by ref_id; ``hot`` names them if they are known.
    """
    rows = ref.rows.where(F.col("target").isNotNull()).select("ref_id", "target", "at").distinct()
    t = targets.select(F.col("key").alias("_key"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    j = salted_join(rows, t, "target", "_key", "ref_id", "left", hot)
    why = F.when(F.col("_key").isNull(), F.lit("missing")).when(F.col("_until") <= F.col("at"), F.lit("deleted")).when(F.col("_since") > F.col("at"), F.lit("early"))
    return j.withColumn("why", why).where(F.col("why").isNotNull()).select(F.lit(ref.name).alias("ref_table"), "ref_id", F.col("target").cast("string").alias("target"), "at", "why")


def _below(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of ``rows`` (v, a: at most one a per v) that have a key of ``new`` above them, at any distance.

    Rounds double the distance looked at, so a chain of d records takes log2(d) rounds; circles end it too.
    """
    hit = new.select(F.col("key").alias("nk"))
    state = pin(rows.join(hit, F.col("a") == F.col("nk"), "left").select("v", "a", F.col("nk").isNotNull().alias("hit")))
    before = (-1, -1)
    while True:
        now = state.agg(F.count("a"), F.count(F.when(F.col("hit"), 1))).first()
        if now[0] == 0 or tuple(now) == before:
            return state.where("hit").select(F.col("v").alias("key"))
        before = tuple(now)
        up = state.select(F.col("v").alias("uv"), F.col("a").alias("ua"), F.col("hit").alias("uh"))
        nxt = pin(state.join(up, F.col("a") == F.col("uv"), "left").select("v", F.col("ua").alias("a"), (F.col("hit") | F.coalesce("uh", F.lit(False))).alias("hit")))
        drop(state)
        state = nxt


def orphans(refs: list[Reference], targets: dict[str, DataFrame]) -> DataFrame:
    """(ref_table, ref_id, target, at, kind, why): all direct and inherited orphans.

    A reference is an inherited orphan when its target exists but is itself a record with an orphaned reference. The
    cascade runs down the foreign-key graph by semi-joins on the newly orphaned keys until no new one appears; a
    circle of references ends it because each key enters once. Within a table that refers to itself a round takes
    all generations at once (by doubling) where each record has one reference, else one generation.
    """
    # every reference is read, cleaned and counted once
    once = {r.name: pin(r.rows.where(F.col("target").isNotNull()).select("ref_id", "target", "at").distinct()) for r in refs}
    hot = {r.name: hot_keys(once[r.name], "target") for r in refs}
    found = None
    for r in refs:
        d = direct(replace(r, rows=once[r.name]), targets[r.into], hot[r.name])
        found = d if found is None else found.unionByName(d)
    found = pin(found.withColumn("kind", F.lit("direct")))
    by_table = {r.name: r.key_of_row for r in refs if r.key_of_row}
    rows = {n: d.select("ref_id", F.col("target").cast("string").alias("target"), "at") for n, d in once.items()}
    hot = {n: {str(k): m for k, m in h.items()} for n, h in hot.items()}
    trees = {}
    for r in refs:
        if r.key_of_row == r.into:
            edges = pin(rows[r.name].select(F.col("ref_id").cast("string").alias("v"), F.col("target").alias("a")).distinct())
            if not edges.groupBy("v").count().where("count > 1").limit(1).count():
                trees[r.into] = edges
    bad = pin(_keys(found, by_table))
    new = bad
    while by_table and new.limit(1).count():
        for name, edges in trees.items():
            more = _below(edges, new.where(F.col("in_table") == name)).select(F.lit(name).alias("in_table"), "key")
            new = pin(new.unionByName(more).distinct())
        parts = None
        for r in refs:
            b = new.where(F.col("in_table") == r.into).select(F.col("key").alias("_bad"))
            p = salted_join(rows[r.name], b, "target", "_bad", "ref_id", "left_semi", hot[r.name]).select(F.lit(r.name).alias("ref_table"), "ref_id", "target", "at", F.lit("parent is an orphan").alias("why"), F.lit("inherited").alias("kind"))
            parts = p if parts is None else parts.unionByName(p)
        fresh = pin(parts.join(found.select("ref_table", "ref_id", "target", "at").distinct(), ["ref_table", "ref_id", "target"], "left_anti"))
        joined = pin(found.unionByName(fresh))
        drop(found)
        found = joined
        bad = pin(bad.unionByName(new).distinct())
        new = pin(_keys(fresh, by_table).join(bad, ["in_table", "key"], "left_anti"))
    return found


def _keys(found: DataFrame, by_table: dict[str, str]) -> DataFrame:
    name = F.lit(None).cast("string")
    for table, into in by_table.items():
        name = F.when(F.col("ref_table") == table, F.lit(into)).otherwise(name)
    return found.withColumn("in_table", name).where(F.col("in_table").isNotNull()).select("in_table", F.col("ref_id").cast("string").alias("key")).distinct()


def report(found: DataFrame) -> DataFrame:
    """(ref_table, period, kind, why, n_references, n_targets) per month of the reference; period is null without time."""
    return found.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("period"), "kind", "why").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target").alias("n_targets"))
