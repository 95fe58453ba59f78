"""Mixing sources to target shares by hash thresholds: no sort, and each pass after the first reads one bucket."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import pin

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary above divides text before byte pairs are merged.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BITS = 12  # bits of the hash per pass


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(it: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    e = _encoder(SparkFiles.get(name))
    for b in it:
        n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
        cols = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(n, pa.int64())], names=[*cols, "n_tokens"])


def with_tokens(docs: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and n_tokens of the whole text; null text has none. The vocabulary file goes from the driver to
    every executor."""
    docs.sparkSession.sparkContext.addFile(path)
    df = docs.select(*keep, F.col(text).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    return df.mapInArrow(partial(_count, name=os.path.basename(path)), f"{kinds}, n_tokens long")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses): documents chosen so that each source gives its target share of all tokens.

    docs: doc_id (unique), source, n_tokens; targets: source (unique), target_share, max_repeats. ``total`` tokens are
    sought; by default the most at which every target source that has tokens reaches its share within max_repeats
    uses of a document (shares of sources without tokens are divided among the others in proportion). A source that
    needs r times its tokens and a rest uses each document r times, and once more those below a hash threshold: tokens
    are summed per source and hash bucket, the bucket that holds the threshold is divided again by the next bits, and
    so on to single documents. With a larger ``total`` a source too small gives max_repeats uses of everything.
    Sources without target, null sources, null or non-positive shares and documents without tokens give no rows.
    """
    t = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("r"))
    t = t.select(F.col("source").alias("ts"), F.col("r.target_share").alias("share"), F.col("r.max_repeats").cast("long").alias("most"))
    h = F.xxhash64(F.lit(97), "doc_id")
    d = pin(docs.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens").join(t, F.col("source") == F.col("ts")).select("doc_id", "source", "n_tokens", h.alias("h")))
    have = d.groupBy("source").agg(F.sum("n_tokens").alias("have")).join(t, F.col("source") == F.col("ts"))
    whole = have.agg(F.sum("share").alias("s"), F.min(F.col("have") * F.col("most") / F.col("share")).alias("x")).first()
    if whole["s"] is None:
        return d.select("doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("uses"))
    goal = float(total) if total is not None else whole["x"] * whole["s"]
    need = F.least(F.col("share") / whole["s"] * goal, F.col("have") * F.col("most"))
    plan = have.withColumn("need", need).withColumn("r", F.least(F.floor(F.col("need") / F.col("have") + 1e-12), F.col("most")).cast("long"))
    plan = pin(plan.select(F.col("source").alias("ps"), "r", F.when(F.col("r") < F.col("most"), F.greatest(F.col("need") - F.col("r") * F.col("have"), F.lit(0.0))).otherwise(0.0).alias("rest")))
    # thresholds: (source, prefix of the hash below which a document is used once more), refined pass by pass
    near = pin(d.select("source", "n_tokens", "h"))
    edge = plan.select(F.col("ps").alias("es"), F.lit(0).cast("long").alias("prefix"), "rest")
    shift = 64
    while shift > 64 - 5 * BITS:
        shift -= BITS
        b = F.shiftrightunsigned("h", shift)
        sums = near.groupBy("source", b.alias("b")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        j = sums.join(edge.select("es", "rest"), F.col("source") == F.col("es"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy("b"))  # at most 2**BITS rows per source
        j = j.withColumn("to", run)
        cut = j.where(F.col("to") > F.col("rest")).groupBy("source").agg(F.min(F.struct("b", (F.col("rest") - (F.col("to") - F.col("n"))).alias("left"), "docs")).alias("c"))
        edge = pin(cut.select(F.col("source").alias("es"), F.col("c.b").alias("prefix"), F.col("c.left").alias("rest"), F.col("c.docs").alias("docs")))
        if not edge.where("docs > 1").limit(1).count():
            break
        near = near.join(edge.select("es", "prefix"), (F.col("source") == F.col("es")) & (b == F.col("prefix"))).select("source", "n_tokens", "h")
        near = pin(near)
    # the document on the threshold is taken if that comes nearer to the goal
    last = near.groupBy("source", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("n_tokens").alias("n"))
    e = edge.join(last, (F.col("es") == F.col("source")) & (F.col("prefix") == F.col("b")), "left")
    e = pin(e.select("es", (F.col("prefix") + F.when(F.col("rest") * 2 > F.col("n"), 1).otherwise(0)).alias("below")))
    out = d.join(plan, F.col("source") == F.col("ps")).join(e, F.col("source") == F.col("es"), "left")
    once = F.when((F.col("rest") > 0) & (F.col("below").isNull() | (F.shiftrightunsigned("h", shift) < F.col("below"))), 1).otherwise(0)
    return out.select("doc_id", "source", "n_tokens", (F.col("r") + once).cast("long").alias("uses")).where("uses > 0")


def mix_report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, uses, tokens, share): what each target source gives; 0 for none."""
    c = chosen.groupBy(F.col("source").alias("cs")).agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"))
    j = targets.select("source", "target_share", "max_repeats").join(c, F.col("source") == F.col("cs"), "left").drop("cs").fillna(0, ["documents", "most_uses", "tokens"])
    every = chosen.agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("every"))
    return j.join(every).withColumn("share", F.when(F.col("every") > 0, F.col("tokens") / F.col("every")).otherwise(0.0)).drop("every")
