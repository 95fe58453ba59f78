"""Queries of the general data-processing problems over the engine's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.hierarchy import descendants, hierarchy
from vecloom.operators.orphans import Reference, orphans, report
from vecloom.operators.skew import distinct_per_key, frequencies, mode_per_key, weighted_percentile
from vecloom.sources.tables import latest, table, uuid_text


def current_meta(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "cluster_meta"), "cluster_id", "loaded_at", ["cluster_id", "loaded_at", *columns]).drop("loaded_at")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    h = hierarchy(current_meta(spark, folder, "merged_into"), "cluster_id", "merged_into", paths=False)
    return h.where(F.col("parent").isNotNull()).select("cluster_id", F.col("root").alias("root_id"))


def p2_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    h = hierarchy(current_meta(spark, folder, "merged_into", "size"), "cluster_id", "merged_into", "size")
    path = F.when(F.col("path").isNotNull(), F.concat_ws("/", F.col("path").cast("array<string>")))
    return h.withColumn("path", path)


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(current_meta(spark, folder, "merged_into"), "cluster_id", "merged_into")


def p2_descendants_all(spark: SparkSession, folder: str) -> DataFrame:
    """``p2_descendants`` with the pairs beneath circles, which its SQL leaves out; only clusters on a circle have none."""
    return descendants(current_meta(spark, folder, "merged_into"), "cluster_id", "merged_into", beneath_circles=True)


def references(spark: SparkSession, folder: str) -> tuple[list[Reference], dict[str, DataFrame]]:
    meta = current_meta(spark, folder, "merged_into", "created_at", "merged_at", "deleted_at")
    clusters = meta.select(F.col("cluster_id").alias("key"), F.col("created_at").alias("since"), F.col("deleted_at").alias("until"))
    vectors = table(spark, folder, "vectors").select(uuid_text(F.col("id")).alias("key"), "inserted_at", "deleted_at").where(F.col("key").isNotNull())
    vectors = vectors.groupBy("key").agg(F.min("inserted_at").alias("since"), F.min("deleted_at").alias("until"))
    members = table(spark, folder, "cluster_membership").select(F.col("membership_id").alias("ref_id"), F.col("cluster_id").alias("target"), F.col("assigned_at").alias("at"))
    merges = meta.select(F.col("cluster_id").alias("ref_id"), F.col("merged_into").alias("target"), F.col("merged_at").alias("at"))
    graphs = table(spark, folder, "graphs").select(F.col("graph_id").alias("ref_id"), F.explode("ids").alias("id"), F.col("saved_at").alias("at"))
    graphs = graphs.select("ref_id", uuid_text(F.col("id")).alias("target"), "at")
    refs = [Reference("cluster_membership", members, "cluster_meta"), Reference("cluster_meta", merges, "cluster_meta", "cluster_meta"), Reference("graphs", graphs, "vectors")]
    return refs, {"cluster_meta": clusters, "vectors": vectors}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    refs, targets = references(spark, folder)
    found = orphans(refs, targets).where("kind = 'direct'")
    return found.select("ref_table", "ref_id", "target", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    refs, targets = references(spark, folder)
    return report(orphans(refs, targets))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    freq = frequencies(table(spark, folder, "cluster_membership"), "cluster_id", "vec_id")
    members = distinct_per_key(freq, "cluster_id").select(F.col("cluster_id").alias("_c"), "n_values")
    meta = current_meta(spark, folder, "size").where(F.col("size").isNotNull())
    j = meta.join(members, F.col("cluster_id") == F.col("_c"), "left")
    return j.where(F.col("size") != F.coalesce("n_values", F.lit(0))).select("cluster_id")


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "cluster_membership").withColumn("day", F.unix_date(F.to_date("assigned_at")))
    freq = frequencies(rows, "cluster_id", "vec_id", "membership_id")
    days = frequencies(rows, "cluster_id", "day", "membership_id")
    half = weighted_percentile(days, "cluster_id", "day", 0.5).select("cluster_id", F.date_from_unix_date(F.col("percentile").cast("int")).alias("median_day"))
    out = distinct_per_key(freq, "cluster_id").withColumnRenamed("n_values", "n_members").join(mode_per_key(freq, "cluster_id", "vec_id"), "cluster_id")
    out = out.join(half, "cluster_id", "left")
    return out.join(current_meta(spark, folder, "size"), "cluster_id", "left").select("cluster_id", "n_rows", "n_members", F.col("mode").alias("mode_vec_id"), "mode_n", "median_day", "size")


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p2_descendants_all, p3_found, p3_report, p6_found, p6_clusters)}

_META = """meta AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY loaded_at DESC) rn
  FROM cluster_meta WHERE cluster_id IS NOT NULL) WHERE rn = 1)"""
_UUID = """CASE WHEN length(regexp_replace(lower({c}), '[^0-9a-f]', '', 'g')) = 32
  THEN regexp_replace(regexp_replace(lower({c}), '[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
  ELSE nullif(lower(trim({c})), '') END"""
_WALK = f"""WITH RECURSIVE {_META},
 edge AS (SELECT m.cluster_id AS v, p.cluster_id AS a, m.size FROM meta m LEFT JOIN meta p ON m.merged_into = p.cluster_id),
 walk(v, top, path) AS (
   SELECT v, a, [v] FROM edge
   UNION ALL
   SELECT w.v, e.a, list_append(w.path, w.top) FROM walk w JOIN edge e ON e.v = w.top
   WHERE w.top IS NOT NULL AND NOT list_contains(w.path, w.top)),
 ends AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY len(path) DESC) rn FROM walk),
 last AS (SELECT v, top, path, top IS NOT NULL AS lost,
   CASE WHEN top IS NULL THEN path[len(path)] ELSE list_min(path[list_position(path, top):]) END AS root
   FROM ends WHERE rn = 1)"""

_RING = ", ring AS (SELECT v FROM last WHERE lost AND top = v)"
_REFS = f"""WITH RECURSIVE {_META},
 vec AS (SELECT {_UUID.format(c='id')} AS key, min(inserted_at) AS since, min(deleted_at) AS until FROM vectors GROUP BY 1),
 refs AS (
  SELECT 'cluster_membership' AS ref_table, m.membership_id AS ref_id, m.cluster_id::VARCHAR AS target, m.assigned_at AS ts, t.cluster_id IS NULL AS gone, t.created_at AS since, t.deleted_at AS until
   FROM cluster_membership m LEFT JOIN meta t ON m.cluster_id = t.cluster_id WHERE m.cluster_id IS NOT NULL
  UNION
  SELECT 'cluster_meta', m.cluster_id, m.merged_into::VARCHAR, m.merged_at, t.cluster_id IS NULL, t.created_at, t.deleted_at
   FROM meta m LEFT JOIN meta t ON m.merged_into = t.cluster_id WHERE m.merged_into IS NOT NULL
  UNION
  SELECT 'graphs', g.graph_id, g.target, g.saved_at, v.key IS NULL, v.since, v.until FROM
   (SELECT graph_id, saved_at, {_UUID.format(c='x')} AS target FROM (SELECT graph_id, saved_at, unnest(ids) AS x FROM graphs)) g
   LEFT JOIN vec v ON g.target = v.key WHERE g.target IS NOT NULL),
 direct AS (SELECT *, CASE WHEN gone THEN 'missing' WHEN until <= ts THEN 'deleted' ELSE 'early' END AS why FROM refs WHERE gone OR until <= ts OR since > ts),
 bad AS (SELECT ref_id AS key FROM direct WHERE ref_table = 'cluster_meta' UNION SELECT m.cluster_id FROM meta m JOIN bad ON m.merged_into = bad.key),
 found AS (SELECT ref_table, ref_id, target, ts, 'direct' AS kind, why FROM direct UNION
  SELECT r.ref_table, r.ref_id, r.target, r.ts, 'inherited', 'parent is an orphan' FROM refs r JOIN bad ON r.target = bad.key::VARCHAR
  WHERE r.ref_table <> 'graphs' AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.ref_table = r.ref_table AND d.ref_id = r.ref_id AND d.target = r.target))"""

ORACLES = {
    "p3_report": _REFS + " SELECT ref_table, strftime(ts, '%Y-%m') AS period, kind, why, count(*) AS n_references, count(DISTINCT target) AS n_targets FROM found GROUP BY 1, 2, 3, 4",
    "p2_found": _WALK + " SELECT l.v AS cluster_id, l.root AS root_id FROM last l JOIN edge e USING (v) WHERE e.a IS NOT NULL",
    "p2_descendants": _WALK + """, up AS (SELECT v AS descendant, unnest(path[2:]) AS ancestor, unnest(range(1, len(path))) AS distance FROM last WHERE NOT lost)
      SELECT ancestor, descendant, distance::INT AS distance FROM up""",
    "p2_descendants_all": _WALK + _RING + """, up AS (SELECT v AS descendant, unnest(path[2:]) AS ancestor, unnest(range(1, len(path))) AS distance FROM last)
      SELECT ancestor, descendant, distance::INT AS distance FROM up WHERE ancestor NOT IN (SELECT v FROM ring) AND descendant NOT IN (SELECT v FROM ring)""",
    "p2_hierarchy": _WALK + _RING + """, up AS (SELECT v AS d, unnest(path[2:]) AS anc, unnest(range(1, len(path))) AS dist FROM last),
      n AS (SELECT anc, count(*) AS n, sum(coalesce(size, 0))::BIGINT AS total, max(dist)::INT AS height FROM up JOIN edge ON edge.v = up.d GROUP BY 1)
      SELECT l.v AS cluster_id, e.a AS parent, l.root, CASE WHEN NOT l.lost THEN len(l.path)::INT - 1 END AS depth,
       CASE WHEN NOT l.lost THEN array_to_string(list_reverse(l.path), '/') END AS path,
       CASE WHEN r.v IS NULL THEN coalesce(n.n, 0) END AS n_below, CASE WHEN r.v IS NULL THEN coalesce(n.total, 0) END AS total_below,
       CASE WHEN r.v IS NULL THEN coalesce(n.height, 0) END AS height, l.lost AS leads_to_circle, r.v IS NOT NULL AS on_circle
      FROM last l JOIN edge e USING (v) LEFT JOIN ring r ON r.v = l.v LEFT JOIN n ON n.anc = l.v""",
    "p3_found": f"""WITH {_META},
 vec AS (SELECT {_UUID.format(c='id')} AS key, min(inserted_at) AS since, min(deleted_at) AS until FROM vectors GROUP BY 1),
 refs AS (
  SELECT 'cluster_membership' AS ref_table, m.membership_id AS ref_id, m.cluster_id::VARCHAR AS target, m.assigned_at AS ts, t.cluster_id IS NULL AS gone, t.created_at AS since, t.deleted_at AS until
   FROM cluster_membership m LEFT JOIN meta t ON m.cluster_id = t.cluster_id WHERE m.cluster_id IS NOT NULL
  UNION ALL
  SELECT 'cluster_meta', m.cluster_id, m.merged_into::VARCHAR, m.merged_at, t.cluster_id IS NULL, t.created_at, t.deleted_at
   FROM meta m LEFT JOIN meta t ON m.merged_into = t.cluster_id WHERE m.merged_into IS NOT NULL
  UNION ALL
  SELECT 'graphs', g.graph_id, g.target, g.saved_at, v.key IS NULL, v.since, v.until FROM
   (SELECT graph_id, saved_at, {_UUID.format(c='x')} AS target FROM (SELECT graph_id, saved_at, unnest(ids) AS x FROM graphs)) g
   LEFT JOIN vec v ON g.target = v.key WHERE g.target IS NOT NULL)
 SELECT DISTINCT ref_table, ref_id, target, strftime(ts, '%Y-%m') AS period FROM refs WHERE gone OR until <= ts OR since > ts""",
    "p6_found": f"""WITH {_META}, n AS (SELECT cluster_id, count(DISTINCT vec_id) AS n FROM cluster_membership GROUP BY 1)
 SELECT meta.cluster_id FROM meta LEFT JOIN n USING (cluster_id) WHERE meta.size IS NOT NULL AND meta.size <> coalesce(n.n, 0)""",
    "p6_clusters": f"""WITH {_META}, one AS (SELECT DISTINCT membership_id, cluster_id, vec_id, assigned_at::DATE AS day FROM cluster_membership WHERE cluster_id IS NOT NULL),
 f AS (SELECT cluster_id, vec_id, count(*) AS n FROM one WHERE vec_id IS NOT NULL GROUP BY ALL),
 a AS (SELECT cluster_id, sum(n)::BIGINT AS n_rows, count(*) AS n_members, max(n) AS mode_n FROM f GROUP BY 1),
 m AS (SELECT f.cluster_id, min(f.vec_id) AS mode_vec_id FROM f JOIN a ON f.cluster_id = a.cluster_id AND f.n = a.mode_n GROUP BY 1),
 d AS (SELECT cluster_id, quantile_disc(day, 0.5) AS median_day FROM one WHERE day IS NOT NULL GROUP BY 1)
 SELECT a.cluster_id, a.n_rows, a.n_members, m.mode_vec_id, a.mode_n, d.median_day, meta.size
 FROM a JOIN m USING (cluster_id) LEFT JOIN d USING (cluster_id) LEFT JOIN meta USING (cluster_id)""",
}
