"""Queries of the llm problems over the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.garbled import garbled_lines, restore
from vecloom.llm.leaks import leaks, without_leaks
from vecloom.llm.match_groups import match_groups, pairs_of_lists
from vecloom.llm.mixing import mix, mix_report, with_tokens
from vecloom.llm.packing import pack, packing_report
from vecloom.llm.similar import most_similar, nearest_of_each
from vecloom.llm.similarity_clusters import describe, similarity_clusters
from vecloom.llm.vectors import usable
from vecloom.session import pin
from vecloom.sources.tables import table, uuid_text

DIM = 64


def usable_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "vectors").where(F.col("deleted_at").isNull() & F.col("vec_id").isNotNull())
    return usable(v, "embedding", DIM, ["vec_id"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "knn_requests").where((F.col("k") > 0) & F.col("request_id").isNotNull())
    r = usable(r, "vector", DIM, ["request_id", "vec_id", "k"]).groupBy("request_id").agg(F.min(F.struct("k", F.col("vec_id").alias("self"), "vec")).alias("r"))
    r = r.select(F.col("request_id").alias("q"), "r.k", "r.self", "r.vec")
    return most_similar(usable_vectors(spark, folder), "vec_id", r, DIM).select(F.col("q").alias("request_id"), "vec_id")


def p1_neighbours(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    near = nearest_of_each(usable_vectors(spark, folder), "vec_id", DIM, k)
    return near.select(F.col("q").alias("of_vec_id"), "vec_id", "rank", F.round("d", 5).alias("d"))


def p1_twentieth(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """The vectors whose id is divisible by 20 as queries against all."""
    v = usable_vectors(spark, folder)
    q = v.where("vec_id % 20 = 0").groupBy("vec_id").agg(F.min("vec").alias("vec")).select(F.col("vec_id").alias("q"), F.lit(k).alias("k"), F.col("vec_id").alias("self"), "vec")
    return most_similar(v, "vec_id", q, DIM, most=k).select(F.col("q").alias("of_vec_id"), "vec_id", "rank", F.round("d", 5).alias("d"))


def _limits(spark: SparkSession, folder: str) -> list[tuple[int, float]]:
    return [(r[0], r[1]) for r in table(spark, folder, "cluster_sets").select("set_id", "threshold").distinct().collect()]  # a fixed, small table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = similarity_clusters(usable_vectors(spark, folder), "vec_id", DIM, _limits(spark, folder))
    return found.select("set_id", "vec_id", "cluster_id")


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    v = usable_vectors(spark, folder)
    found, attractors = similarity_clusters(v, "vec_id", DIM, _limits(spark, folder))
    return describe(found, attractors, v, "vec_id", DIM)


def p4_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """``p4_clusters`` with one row per lane of the centroid and the central members as text."""
    c = p4_clusters(spark, folder)
    typical = F.concat_ws(",", F.col("typical").cast("array<string>")).alias("typical")
    return c.select("set_id", "cluster_id", "size", typical, F.posexplode("centroid").alias("pos", "v")).select("set_id", "cluster_id", "size", "typical", "pos", F.round("v", 4).alias("value"))


def match_pairs(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "graphs").select(F.transform("ids", uuid_text).alias("ids"), "connections")  # each id is spelled once
    inside = lambda i: (i >= 0) & (i < F.size("ids"))
    c = F.filter("connections", lambda z: (z["i"] != z["j"]) & inside(z["i"]) & inside(z["j"]))
    c = F.transform(c, lambda z: F.struct(F.get("ids", z["i"]).alias("a"), F.get("ids", z["j"]).alias("b")))
    g = g.select(F.explode(c).alias("c")).select("c.a", "c.b")
    lists = table(spark, folder, "cluster_payloads").select(F.explode("clusters").alias("name", "ids"))
    return g.unionByName(pairs_of_lists(lists, F.transform("ids", uuid_text)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return match_groups(match_pairs(spark, folder))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return match_groups(match_pairs(spark, folder)).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))


BATCH = 1152


def p7_batches(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "partition_meta"), "partition_id", "size", BATCH)


def p7_placed(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold of the batches: each partition placed whole, divided only beyond a batch, no batch overfull."""
    p = pin(p7_batches(spark, folder))
    over = p.groupBy(F.col("batch").alias("b")).agg(F.sum("amount").alias("held"))
    j = p.join(over, F.col("batch") == F.col("b"))
    return j.groupBy("partition_id").agg(F.sum("amount").alias("placed"), F.count(F.when(F.col("amount") == BATCH, 1)).alias("full_batches"), (F.count(F.lit(1)) - F.count(F.when(F.col("amount") == BATCH, 1))).alias("rests"), F.max(F.col("held") > BATCH).alias("overfull"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(p7_batches(spark, folder), BATCH)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_documents(spark, folder, "line_boxes"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return without_leaks(_documents(spark, folder, "line_boxes"), table(spark, folder, "eval_items"))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    docs = table(spark, folder, "documents").join(targets.select("source"), "source", "left_semi")
    return mix(with_tokens(docs, ["doc_id", "source"]), targets)


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold of the mix: each source that has documents within one document of its share, none repeated too often."""
    mixed = pin(_mixed(spark, folder))
    r = mix_report(mixed, table(spark, folder, "mix_targets"))
    most = mixed.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest"), F.sum(F.col("uses") * F.col("n_tokens")).alias("every"))
    there = table(spark, folder, "documents").select(F.col("source").alias("s")).distinct()
    r = r.join(there, F.col("source") == F.col("s"), "left").join(most)
    whole = F.sum(F.when(F.col("s").isNotNull(), F.col("target_share"))).over(Window.partitionBy(F.lit(1)))  # a fixed, small table
    goal = F.when(F.col("s").isNotNull(), F.col("target_share") / whole * F.col("every")).otherwise(0.0)
    near = F.abs(F.col("tokens") - goal) <= F.col("longest") * (F.col("most_uses") + 1)
    return r.select("source", near.alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", *columns)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_lines(_documents(spark, folder, "lang", "source")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "lang", "source")
    return restore(docs, garbled_lines(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p1_twentieth, p4_found, p4_clusters, p4_lanes, p5_found, p5_groups, p7_batches, p7_placed, p7_report, p8_found, p8_cleaned, p9_documents, p9_kept, p9_report, p10_found, p10_restored)}
ORACLES: dict[str, str] = {
    "p1_found": """WITH q AS (SELECT DISTINCT request_id, vec_id AS own, k, vector FROM knn_requests WHERE k > 0 AND len(vector) = 64
   AND len(list_filter(vector, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
 v AS (SELECT DISTINCT vec_id, embedding FROM vectors WHERE deleted_at IS NULL AND len(embedding) = 64
   AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
 d AS (SELECT request_id, vec_id, k, list_distance(vector::DOUBLE[], embedding::DOUBLE[]) AS d FROM q, v WHERE own IS NULL OR own <> vec_id)
 SELECT request_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY d, vec_id) rn FROM d) WHERE rn <= k""",
    "p4_found": """WITH RECURSIVE v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM vectors WHERE deleted_at IS NULL AND len(embedding) = 64
   AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = 64),
 near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) ** 2 AS d FROM v a, v b WHERE a.vec_id < b.vec_id AND abs(a.e[1] - b.e[1]) < 1.3 AND abs(a.e[2] - b.e[2]) < 1.3 AND list_distance(a.e, b.e) ** 2 < 1.7),
 e AS (SELECT set_id, a, b FROM near, cluster_sets WHERE d < threshold UNION ALL SELECT set_id, b, a FROM near, cluster_sets WHERE d < threshold),
 reach AS (SELECT DISTINCT set_id, a AS v, a AS low FROM e UNION SELECT r.set_id, e.b, r.low FROM reach r JOIN e ON e.set_id = r.set_id AND e.a = r.v WHERE r.low < e.b)
 SELECT set_id, v AS vec_id, min(low) AS cluster_id FROM reach GROUP BY 1, 2""",
    "p5_found": r"""WITH RECURSIVE g AS (SELECT ids, unnest(connections) AS c FROM graphs),
 named AS (SELECT regexp_replace(lower(ids[c.i + 1]), '[^0-9a-f]', '', 'g') AS a, regexp_replace(lower(ids[c.j + 1]), '[^0-9a-f]', '', 'g') AS b FROM g
   WHERE c.i <> c.j AND c.i >= 0 AND c.j >= 0 AND c.i < len(ids) AND c.j < len(ids)),
 lists AS (SELECT list_sort(list_distinct(list_transform(l, lambda z: regexp_replace(lower(z), '[^0-9a-f]', '', 'g')))) AS l FROM (SELECT unnest(map_values(clusters)) AS l FROM cluster_payloads)),
 e AS (SELECT a, b FROM named WHERE a <> b UNION SELECT b, a FROM named WHERE a <> b
   UNION SELECT l[1], x FROM (SELECT l, unnest(l) AS x FROM lists) WHERE x <> l[1] UNION SELECT x, l[1] FROM (SELECT l, unnest(l) AS x FROM lists) WHERE x <> l[1]),
 reach AS (SELECT DISTINCT a AS v, a AS low FROM e UNION SELECT e.b, r.low FROM reach r JOIN e ON e.a = r.v WHERE r.low < e.b),
 low AS (SELECT v, min(low) AS low FROM reach GROUP BY 1)
 SELECT regexp_replace(v, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id, regexp_replace(low, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS group_id FROM low""",
}
_V = """v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM vectors WHERE deleted_at IS NULL AND len(embedding) = 64
   AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = 64)"""
ORACLES |= {
    "p5_groups": ORACLES["p5_found"].rsplit("SELECT", 1)[0] + r"SELECT regexp_replace(low, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS group_id, count(*) AS size FROM low GROUP BY 1",
    "p7_placed": f"""SELECT partition_id, placed, placed // {BATCH} AS full_batches, CASE WHEN placed % {BATCH} > 0 THEN 1 ELSE 0 END::BIGINT AS rests, false AS overfull
 FROM (SELECT partition_id, max(size) AS placed FROM partition_meta WHERE size > 0 AND partition_id IS NOT NULL GROUP BY 1)""",
    "p9_kept": "SELECT source, true AS share_reached, true AS repeats_kept FROM mix_targets",
    "p4_lanes": ORACLES["p4_found"].rsplit("SELECT set_id, v AS vec_id", 1)[0].rstrip() + """,
 f AS (SELECT set_id, v AS vec_id, min(low) AS cluster_id FROM reach GROUP BY 1, 2),
 l AS (SELECT set_id, cluster_id, unnest(range(0, 64))::INT AS pos, unnest(e) AS x FROM f JOIN v USING (vec_id)),
 m AS (SELECT set_id, cluster_id, pos, avg(x) AS mid, count(*) AS size FROM l GROUP BY 1, 2, 3),
 c AS (SELECT set_id, cluster_id, any_value(size) AS size, list(mid ORDER BY pos) AS mid FROM m GROUP BY 1, 2),
 d AS (SELECT set_id, cluster_id, vec_id, CASE WHEN size <= 2 THEN 0 ELSE list_distance(e, mid) ** 2 END AS d FROM f JOIN v USING (vec_id) JOIN c USING (set_id, cluster_id)),
 t AS (SELECT set_id, cluster_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rn) AS typical FROM (SELECT *, row_number() OVER (PARTITION BY set_id, cluster_id ORDER BY d, vec_id) AS rn FROM d) WHERE rn <= 3 GROUP BY 1, 2)
 SELECT set_id, cluster_id, size, typical, pos, round(mid, 4) AS value FROM m JOIN t USING (set_id, cluster_id)""",
}
