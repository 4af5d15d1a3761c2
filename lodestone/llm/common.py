"""What the operators of this subpackage share: shared-folder tables, shipping, number helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import importlib
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null text gives no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it in `body`.

    A lambda variable is never inlined, so a costly array is not computed again for each
    element of a later lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where it is unset in a local session (as in tests) a folder of this process is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch for Python while a table is written, unless the session sets its own. An executor holds some five
#: copies of a batch for each task, outside its heap; Spark's 64 MB take in all texts of a usual file.
BATCH_BYTES = 4 << 20


class Workspace:
    """Tables in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        conf, before, batch = self.spark.conf, self.spark.conf.get(_CLEANUP, "false"), self.spark.conf.get(_BATCH, None)
        conf.set(_CLEANUP, "true")  # the table is what is read from now on, so its shuffle files go at once
        if batch is None:
            conf.set(_BATCH, str(BATCH_BYTES))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
            if batch is None:
                conf.unset(_BATCH)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the tables of this workspace that `df` reads; nothing else may read them."""
        self._delete({uri for uri in _folders(df) if uri.startswith(f"{self.root}/")})

    def close(self, result: DataFrame) -> DataFrame:
        """Delete all tables but those that the result reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        there = {str(f.getPath()) for f in root.getFileSystem(conf).listStatus(root)} if self.count else set()
        names = {uri.rsplit("/", 1)[1] for uri in _folders(result)}
        self._delete({uri for uri in there if uri.rsplit("/", 1)[1] not in names})
        return result

    def _delete(self, uris: set[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for uri in uris:
            path = jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(conf).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def release_worker() -> None:
    """Give back what tasks of other operators left in this reused Python worker, to the system too: a cluster
    stops an executor by its resident memory."""
    held = sys.modules.get(f"{__package__}.tokens")
    if held:
        held.release()
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A task's function over batches that finds a worker without memory of other tasks, and leaves it so: while it is
    idle, up to a minute, other stages need the executor's memory."""

    @functools.wraps(run)
    def whole(batches):
        release_worker()
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(importlib.import_module(__package__.split(".")[0]).__file__).parent
    out = os.path.join(tempfile.mkdtemp(prefix="lodestone-ship-"), f"lodestone_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(out)
