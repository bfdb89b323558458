"""Shared intermediate tables.

An intermediate that is read more than once, or that ends a long lineage, is
written as Parquet below ``spark.checkpoint.dir``: a folder that the driver and
all executors share, so a lost executor costs a retry of its own tasks only. It stays
until the application ends, or until ``settled`` has written what it was made for.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The paths that were made since the innermost ``settled`` began.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. One is set only where none is and all tasks run in this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="resonant-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()``, materialised. What was materialised on the way to it, by a ``settled`` within too, is then removed."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
    finally:
        _made.reset(token)
    done = materialise(df, name)
    for path in made:
        files, target = _files(spark, path)
        files.delete(target, True)
    memory_returned(spark)
    return done


def memory_returned(spark: SparkSession) -> None:
    """The driver and the executors give back what they have done with, for use between the steps of a long job.

    Spark runs each exchange of a plan in a thread of its own, and the C library keeps what such
    threads and the JVM's compiler have freed; a heap that has once grown stays until a full
    collection, as do broadcasts and generated classes. A JVM that cannot trim only collects.
    Executors collect in a job of a task for each, which free ones get one by one.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        _trim(spark)
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()  # and the driver
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def _trim(spark: SparkSession) -> None:
    """Through the interface MBeanServer, as its class is hidden from Py4J."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    named = jvm.java.lang.Class.forName
    kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, *kinds))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args = array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String))
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is executed within leaves no shuffle files: they go as it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched exactly; extra or clashing ones are left behind."""
    return df.select(*[df[f"`{n}`"] for n in names])
