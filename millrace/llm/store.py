"""Shared folder, materialised tables and distributed connected components."""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder takes its place for the session, on a local master only: executors
    of a cluster would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("millrace.local.dir", None) or "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.local.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker: what a task holds beside the engine's own rows is a small multiple of it.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for the session, so that rows of long texts do not make batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Remove the shuffle files of a command at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables written between two calls of ``tidy``.
TIDY = 12

_written = itertools.count(1)


def tidy(spark: SparkSession) -> None:
    """Give back what the driver no longer uses. Each scan and stage leaves a broadcast in it that goes only when garbage
    is collected, which the JVM puts off by taking more memory; Python keeps freed memory for itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    spark._jvm.System.gc()


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    The shuffle files of the write are removed once it is done, as nothing reads them any more. The rows are counted as
    they are written (``kept_rows``): a job less for each question about their number, and the driver holds on to all jobs.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    written = Observation()
    try:
        df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at, out.kept_rows = path, written.get["n"]
    if next(_written) % TIDY == 0:
        tidy(spark)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables that ``keep`` wrote, once nothing will read them again."""
    for t in tables:
        if path := getattr(t, "kept_at", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Rows of at most three numbers each that may be broadcast: at most some 80 bytes a row as a hash table, 32 MB.
BROADCAST_ROWS = 400_000


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, table: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only where a count proves ``df`` (a materialised, narrow table) within ``limit`` rows; ``table``:
    what ``keep`` returned, where ``df`` has a row for each of its."""
    n = getattr(df if table is None else table, "kept_rows", None)
    return F.broadcast(df) if (df.limit(limit + 1).count() if n is None else n) <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node of the undirected ``edges``; comp is the smallest node reachable.

    Alternating large-star and small-star contraction: logarithmically many rounds, each of grouped minima and
    joins, nothing collected. A node of many edges is a hot key of these: minima are pre-aggregated in tasks, and joins on
    it have one row on the other side, so skewed partitions can be split. Rows with a null end are ignored; loops give no
    node.
    """
    e = keep(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).distinct(), "edges")

    def stars(x: DataFrame) -> bool:
        """Whether each node is a centre, or a leaf of one centre."""
        ends = x.select(F.col("v").alias("n"), F.lit(0).alias("leaf")).union(x.select("u", F.lit(1)))
        nodes = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.min("leaf").alias("least"))
        return not nodes.where("leaf > 1 or leaf = 1 and least = 0").limit(1).count()

    while not stars(e):
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u"))).toDF("n", "u")
        low = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("m").alias("v"), F.col("n").alias("u")).where("v < u").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))).alias("x"))
            .select("x.v", "x.u")
            .where("v < u")
            .distinct()
        )
        before, e = e, keep(small, "edges")
        forget(before)
    out = keep(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct()), "comps")
    forget(e)
    return out
