"""Shared scratch space: where lineage is cut, so that lost executors cost no recomputation from the start."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What the JVM calls its command that trims native memory.
_TRIM = "systemTrimNativeHeap"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="linkspark-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has these values within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def materialize(df: DataFrame, name: str = "table", arrow_rows: int = 2048) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors. discard() deletes it.

    The query's shuffle files go when it ends, and what the driver's JVM has freed is trimmed. arrow_rows: rows that are handed
    to Python at a time (a batch of texts is held by the JVM and by Python at once).
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with settings(spark, {_CLEANUP: "true", _BATCH: str(arrow_rows)}):
        df.write.parquet(path)
    trim(spark)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing will be computed from them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_table)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def trim(spark: SparkSession) -> str:
    """Has the C library hand back what threads of the driver's JVM have freed. glibc else keeps it in up to 8 arenas a core, and
    Spark runs each stage of a plan in another of hundreds of threads, so that each query leaves some more behind.

    Returns what the JVM says of it, nothing where it has no such command (other than HotSpot on Linux, or before 17.0.9).
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named, command = jvm.java.lang.Class.forName, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    types, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, x in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = named(x)
    args[0], args[1] = command, _TRIM
    try:  # by the interface: Java lets no one call the class itself
        return str(named("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JJavaError:
        return ""


def release(spark: SparkSession) -> None:
    """Collects the driver's garbage, by which its heap shrinks and Spark drops broadcasts and shuffles that nothing refers to, and
    trims the rest. A full collection: for the ends of long steps, not for every table."""
    spark._jvm.System.gc()
    trim(spark)
