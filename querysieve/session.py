"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.util import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

T = TypeVar("T")

# A side is broadcast only when both bounds hold.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("querysieve")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='querysieve-')}/{package.name}", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="querysieve-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/querysieve/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan with fewer splits than cores ahead of heavy per-row work.

    Larger inputs already have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and pins the result of
    anything evaluated at run time (such as partition numbers).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.scratch = path
    return held


# Paths of the tables written so far, in order.
_written: list[str] = []


def written() -> int:
    """How many tables were written so far: the place from which ``drop_written`` deletes."""
    return len(_written)


def drop_written(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables written since, except those given; nothing may read them any more."""
    kept = {df.scratch for df in keep}
    for path in _written[since:]:
        if path not in kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[since:] = [path for path in _written[since:] if path in kept]


def give_back() -> None:
    """Memory that this process has freed goes back to the system where its allocator can do so."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver find the shuffles that nothing reads any more; else their files stay until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def side_by_side(spark: SparkSession, calls: dict[str, Callable[[], T]], most: int = 2) -> dict[str, T]:
    """What the functions return, ``most`` of them running at a time, begun in order; the first error is raised when all have ended."""
    with ThreadPoolExecutor(most) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(call)) for name, call in calls.items()}
    return {name: future.result() for name, future in running.items()}


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Materialise ``df`` and hint a broadcast only if its measured size is under both bounds.

    Rows and characters are counted while the table is written. Over the bound the frame
    carries no hint: Spark then shuffles both sides and AQE splits skewed partitions.
    """
    width = sum(
        (F.coalesce(F.length(F.col(f.name)), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(16))
        for f in df.schema.fields
    )
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(width).alias("size"))
    held = materialise(counted, "side")
    rows, size = seen.get["rows"], seen.get["size"] or 0
    return F.broadcast(held) if rows <= max_rows and size * 4 <= max_bytes else held
