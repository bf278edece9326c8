"""Tables written to the folder that the cluster shares, to cut lineage and to survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset (tests), a new local folder becomes it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="corpuswright-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own, which goes when the session's file systems close."""
    path = f"{shared_dir(spark)}/corpuswright-{name}-{uuid.uuid4().hex}"
    where = _path(spark, path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def drop(spark: SparkSession, pattern: str) -> None:
    """Delete the files and folders that match."""
    where = _path(spark, pattern)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(where) or []:
        fs.delete(found.getPath(), True)


def written(df: DataFrame, name: str, *partition_by: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """The rows written once and read again, and their folder."""
    path = f"{new_dir(df.sparkSession, name)}/table"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path), path


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as executors need it."""
    where = _path(spark, path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def file_system(uri: str):
    """(pyarrow file system, path) of a qualified path, on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def replace_file(uri: str, data_writer) -> None:
    """Write a file under another name first, so that a lost or repeated attempt never leaves half of one."""
    system, path = file_system(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        data_writer(out)
    system.move(part, path)


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1000


def lean(run):
    """A mapInArrow function that gives memory back when its task ends, on small batches.

    Python workers live on between tasks and allocators keep what is freed;
    the session's batch size is lowered to BATCH_ROWS if it is larger.
    """
    session = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session and not 0 < int(session.conf.get(name)) <= BATCH_ROWS:
        session.conf.set(name, BATCH_ROWS)

    def go(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return go


def release() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
