"""Session set-up and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "16g", name: str = "vecloom") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and everything
    runs on this machine. On a cluster without the setting this raises: a machine's own folder would hold a part only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
    own = getattr(spark, "_vecloom_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark._vecloom_dir = own
    return own


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of every executor, once a session; they need not have it installed."""
    if getattr(spark.sparkContext, "_vecloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/vecloom-{uuid.uuid4().hex}.zip"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._vecloom_shipped = True
    atexit.register(_delete, spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the session ends."""
    path = f"{shared_dir(spark)}/vecloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, spark: SparkSession | None = None, shuffles: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (iterative operators would otherwise grow their plan with each round) and, unlike a
    local checkpoint, a lost executor loses nothing. The files go when the session ends, or with ``drop``.
    Without ``shuffles`` the shuffle files of the writing go at once, not when the driver collects its garbage.
    """
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/vecloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    if not shuffles:
        spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if not shuffles:
            spark.conf.set(CLEANED, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vecloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files behind a pinned table that nothing reads any more."""
    path = getattr(df, "_vecloom_path", None)
    if path:
        _delete(df.sparkSession, path)
