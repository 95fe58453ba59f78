"""Parquet sources: named tables of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a single file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """The row of each key with the largest ``by`` (ties: the largest values, in the order of ``columns``).

    One aggregation with map-side combine: no sort and no window, so a hot key costs one row per map task.
    Rows without key are left out. A null ``by`` counts as the oldest.
    """
    rest = [c for c in columns if c not in (key, by)]
    newest = F.max(F.struct(F.col(by), *[F.col(c) for c in rest])).alias("_row")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(newest)
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in [by, *rest] if c in columns])
    )


_SPELLED = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_text(c: Column) -> Column:
    """One spelling per UUID: lower case, 8-4-4-4-12. Case, braces, hyphens, blanks and a urn prefix do not matter.

    Text that has not 32 hexadecimal digits is no UUID and comes back trimmed and in lower case; blank text is null.
    """
    # each step is a column of a one-element array, so that it is computed once however often it is named
    plain = F.lower(F.trim(c))
    step = F.transform(F.array(plain), lambda p: F.struct(p.alias("p"), F.regexp_replace(F.regexp_replace(p, "^urn:uuid:", ""), "[^0-9a-f]", "").alias("d")))
    spelled = F.transform(step, lambda z: F.when(F.length(z["d"]) == 32, F.concat_ws(
        "-", z["d"].substr(1, 8), z["d"].substr(9, 4), z["d"].substr(13, 4), z["d"].substr(17, 4), z["d"].substr(21, 12)
    )).when(F.length(z["p"]) > 0, z["p"]))
    return F.when(c.rlike(_SPELLED), c).otherwise(F.get(spelled, F.lit(0)))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order (a top-k per key; Spark prunes with a group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
