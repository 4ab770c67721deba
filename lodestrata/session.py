"""Session helpers: the shared work folder, written intermediate tables, and shipping the package to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session, which all executors share.

    Only where that setting is absent and Spark runs on this machine alone (tests) a private temporary folder is made and set;
    on a cluster its absence is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = getattr(spark, "_lodestrata_dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            local = tempfile.mkdtemp(prefix="spark-lodestrata-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            shared = spark._lodestrata_dir = f"file://{local}"
            spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


_written: list[str] = []


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far by this process; results that still read them must be stored before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_own = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end; what is read later must be written with ``keep``."""
    outer, _own.paths = getattr(_own, "paths", None), []
    try:
        yield
    finally:
        paths, _own.paths = _own.paths, outer
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and compiled classes of what ended; it does so only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of a row group where a task writes to several folders at once.
_GROUP = 16 << 20
_writing = threading.Lock()


def materialize(df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in a folder for each value of ``by`` (a few), and read it back: cuts the lineage and survives lost executors.

    A task keeps a file open for each value, so that no rows must be sorted by it, and spilled, before they are written.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lodestrata-{name}-{uuid.uuid4().hex}"
    if by:
        with _writing:
            setting = "spark.sql.maxConcurrentOutputFileWriters"
            before = spark.conf.get(setting)
            spark.conf.set(setting, "8")
            try:
                df.write.option("compression", codec).option("parquet.block.size", _GROUP).partitionBy(*by).parquet(path)
            finally:
                spark.conf.set(setting, before)
    else:
        df.write.option("compression", codec).parquet(path)
    (_written if keep or getattr(_own, "paths", None) is None else _own.paths).append(path)
    return spark.read.schema(df.schema).parquet(path)


_shipping = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that functions run there can import it."""
    with _shipping:
        if not getattr(spark.sparkContext, "_lodestrata_shipped", False):
            _ship(spark)


def _ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-lodestrata-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lodestrata.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._lodestrata_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: small tables often come as one file, thus one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
