"""Scratch tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, local
    mode) is a temporary folder made, once for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
        return re.sub("^file:/+", "file:///", whole)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return _LOCAL_ROOTS[app]


class Scratch:
    """Parquet tables of one run, in a folder of its own under the shared root.

    A written table cuts lineage as a checkpoint does: a lost executor makes
    Spark read files again, and never repeats what lies before them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = 0
        atexit.register(self._remove)  # the tables serve results of this process only

    def _remove(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, tag: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{tag}"

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def sweep(self) -> None:
        """Has the driver collect its garbage: Spark removes shuffle files once nothing refers to them.

        A written table refers to none of the shuffles before it, but Spark
        learns that only when the driver's objects are gone.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Gives memory that this worker has freed back to the system; reused workers would keep it."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def worker_cache() -> dict:
    """A dict that outlives a task in a reused Python worker."""
    name = "_nearfield_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].store = {}
    return sys.modules[name].store
