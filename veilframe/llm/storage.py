"""Files in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
local master without that setting (tests) gets a temporary folder. Executors
reach the files through ``pyarrow.fs``, so any scheme it knows will do, and every
file appears under its final name only when it is complete: a task that is lost
halfway leaves nothing that a later reader could take for a result.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; also makes it Spark's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilframe-")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """URI of a new, not yet existing folder below the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, blocks) -> int:
    """Write the byte blocks to uri in one step; the size."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    fs.move(part, path)
    return size


def open_file(uri: str):
    """A random access file."""
    fs, path = _open(uri)
    return fs.open_input_file(path)


_kept: list[str] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """shared_dir() for what is no result: release() deletes it."""
    _kept.append(shared_dir(spark, label))
    return _kept[-1]


def keep(df: DataFrame, label: str) -> DataFrame:
    """df, computed once into the shared folder and read again: short lineage, no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Delete what keep() and others wrote below scratch_dir() since the last call, once no frame that stems from it is needed; the number
    of folders.

    Files that operators were asked to write (archives, token files) are results and stay.
    """
    paths, _kept[:] = list(_kept), []
    for path in paths:
        fs, where = _open(path)
        if fs.get_file_info(where).type != pafs.FileType.NotFound:
            fs.delete_dir(where)
    return len(paths)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from the columns (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Rows of texts that Spark hands to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's scans: texts are long, and both sides hold several copies of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def tidy(scan):
    """A scan over record batches that gives unused memory back when its task ends.

    Workers live on and serve later tasks, whose needs would otherwise add to what allocators hold.
    """

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # other C libraries have no such call
                pass

    return run
