"""Make the package importable by the Python workers of any cluster, and keep what these hold small."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per Spark context, and bound the bytes of Arrow batches where the
    session doesn't: rows are wide, so a batch of many rows is large in the JVM and the worker at once."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tessella_shipped = True


def release() -> None:
    """Give freed memory back to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """The same for the driver's JVM: compilers and buffers free much native memory, which the C library keeps for each of its
    many threads. A JVM that has no such command (older ones, or without glibc) stays as it is."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        beans, kind = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName("javax.management.MBeanServer")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in kind.getMethods() if m.getName() == "invoke").invoke(beans, given)  # the bean server's own class isn't open
    except Py4JError:
        pass


def map_arrow(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with the package known to the workers."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(batches)
        release()

    return df.mapInArrow(run, schema)
