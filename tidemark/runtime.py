"""Where intermediate tables go, and how lineage is cut.

Executors and the driver share no local folder, so everything that has to
outlive a stage is written under the folder the session names in
``spark.checkpoint.dir``.  A private temporary folder is used only where that
setting is absent and all executors are on this machine (local runs and tests).

Results are lazy, so a table has to last until its caller has read what was made from it:
within :func:`scope` until that is left, else until the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own_dir: str | None = None
_trimming = 0  # how many blocks of :func:`trimming` are open
_scopes: list[dict[str, SparkSession]] = [{}]  # tables made and not yet deleted, by path; the first is the process's


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read."""
    global _own_dir
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {SETTING} to a folder that driver and executors share; master is {master}")
    if _own_dir is None or not os.path.isdir(_own_dir):
        _own_dir = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage behind it: a lost executor costs a reread, not a
    recomputation, and values that depend on row placement (row numbers,
    sampling) are fixed.  Columns of type ``void`` are not allowed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    _scopes[-1][path] = spark
    df.write.parquet(path)
    if _trimming:
        trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def reread(df: DataFrame) -> DataFrame:
    """A table made by :func:`materialise` with what was appended to its files since."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._tidemark_path)
    out._tidemark_path = df._tidemark_path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise`, once nothing reads it."""
    path = getattr(df, "_tidemark_path", None)
    for made in _scopes:
        if spark := made.pop(path, None):
            _delete(spark, path)


@contextmanager
def scope(keep: tuple[DataFrame, ...] | list[DataFrame] = ()) -> Iterator[None]:
    """Delete, on leaving, the tables made inside; those in ``keep`` (a list may be filled inside) pass to the scope around."""
    _scopes.append({})
    try:
        yield
    finally:
        made, kept = _scopes.pop(), {getattr(df, "_tidemark_path", None) for df in keep}
        for path, spark in made.items():
            if path in kept:
                _scopes[-1][path] = spark
            else:
                _delete(spark, path)


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM and pyarrow give native memory that they don't use back to the system.

    Spark's threads leave freed memory in up to 8 malloc arenas a core, which grow with the number of queries
    and lie outside the heap's limit.  False where the JVM has no command for it: it has on Linux with glibc,
    from Java 17.0.9 on.
    """
    pa.default_memory_pool().release_unused()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        named = jvm.java.lang.Class.forName
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class isn't open to py4j, its interface is
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


@contextmanager
def trimming(spark: SparkSession) -> Iterator[None]:
    """Trim on entering, after each table written inside, and on leaving."""
    global _trimming
    trim(spark)
    _trimming += 1
    try:
        yield
    finally:
        _trimming -= 1
        trim(spark)


@atexit.register
def _clear() -> None:
    """Delete what is left when the process ends, as far as its Spark still runs."""
    for made in _scopes:
        for path, spark in made.items():
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session is gone: nothing more can be done here
                return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
