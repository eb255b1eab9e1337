"""Shared folders, stored tables and connected components for the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladefreq.operators import ranks
from cladefreq.operators.joins import TASK_ROWS, salted_join


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='llm-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a shared folder and read it back, which also ends its lineage."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of stored tables that nothing reads any more: all that came of them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows and bytes that travel to Python at once, unless the session says otherwise: whole texts and blobs are long, and a
#: batch is held outside the heap by the JVM and once more by Python.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, for drivers that only put it on their own path; keep the
    batches that travel to Python short."""
    context = spark.sparkContext
    given = dict(context.getConf().getAll())
    for name, value in ARROW.items():
        if name not in given:
            spark.conf.set(name, value)
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / "cladefreq.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in package.rglob("*.py"):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._llm_shipped = True


def release() -> None:
    """Give freed memory back to the system: a Python worker serves many tasks, and what one needed isn't the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """Root (smallest id) of every id that `links` (a, b) mentions: columns id, root.

    Alternates large and small stars until the links no longer change; each round is stored, so a lost executor costs
    one round at most. Rounds grow with the logarithm of the component size. Null ends and loops are left out. While no id
    has more than TASK_ROWS links a round is one plan of two windows; else hot centres are spread by salted joins.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(found) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        seen, before = tuple(found), [edges]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # No id has more links than there are; only if these are many are they counted for each id.
        if seen[0] <= TASK_ROWS or both.groupBy("u").count().agg(F.max("count")).first()[0] <= TASK_ROWS:
            edges = stored(_small_stars(_large_stars(both)), name)
        else:
            before.append(large := stored(_large_stars_spread(both), name))
            edges = stored(_small_stars_spread(large), name)
        discard(*before)


def _large_stars(both: DataFrame) -> DataFrame:
    """Every larger neighbour of an id now leads to the least of the id and its neighbours."""
    near = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_stars(large: DataFrame) -> DataFrame:
    """An id and its neighbours, which are smaller, now lead to the least of them."""
    near = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
    ends = F.explode(F.array("u", "v")).alias("u")
    return near.select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def _large_stars_spread(both: DataFrame) -> DataFrame:
    """As `_large_stars`; a centre with many neighbours is spread over places in proportion to their number."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    sizes, least = least.select("u", "n"), least.select("u", F.least("u", "m").alias("m"))
    near = salted_join(both, least, "u", sizes, how="inner", spread=["v"])
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_stars_spread(large: DataFrame) -> DataFrame:
    """As `_small_stars`; a centre with many neighbours is spread over places in proportion to their number."""
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = salted_join(large, least.select("u", "m"), "u", least.select("u", "n"), how="inner", spread=["v"])
    small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def numbered(rows: DataFrame, within: str, order: Sequence[Column]) -> DataFrame:
    """`rows`, stored, with `pos` (from 0, in the given order) and `n` (rows) within each value of `within`."""
    return ranks.numbered(rows, order, within)
