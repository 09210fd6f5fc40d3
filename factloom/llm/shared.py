"""Shared-folder and table helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see.

    It lies in the folder of ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder becomes the checkpoint folder on a single machine, as in tests;
    on a cluster it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = sc.getCheckpointDir()
        if not base:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later jobs neither
    compute it again nor lose it with an executor."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote: for tables that only other stored tables were made of."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Hadoop's names of stores that have another one in Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def give_back() -> None:
    """Returns what a task has freed to the system: its worker lives on, beside others that need the memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps what it keeps
        return


def tidy(run):
    """A function of Arrow batches that gives back its memory at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a folder or file of the shared store, whose schemes are Hadoop's."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_atomically(uri: str, write) -> None:
    """Runs ``write(stream)`` on a file of this attempt's own, then moves it to
    ``uri``: a task that is run again replaces whole files only."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own, compression=None) as out:
        write(out)
    try:
        store.move(own, path)
    except OSError:  # a store that does not replace: an earlier attempt's file is in the way
        store.delete_file(path)
        store.move(own, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
