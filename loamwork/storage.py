"""Tables between steps, in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Tables that a finished step no longer needs are
deleted by it; what is left when the driver ends, such as tables that a returned DataFrame reads, goes
then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local session (tests) gets a temporary one; a cluster is refused, because
    a machine-local folder would not be seen by the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loamwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path for a table or folder, which goes when the driver ends unless it is to ``keep``."""
    path = f"{shared_folder(spark)}/loamwork/{name}-{uuid.uuid4().hex}"
    if not keep:
        _LEFT[path] = _hadoop(spark, path)
    return path


def stage(df: DataFrame, name: str, level: int = 3, free: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet (zstd of a ``level``) in the shared folder and reads it back.

    ``free`` has the driver's JVM collect garbage then: Spark deletes a shuffle's files once nothing in
    the driver refers to it, which is else found out late.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if free:
        spark._jvm.System.gc()
    out._loamwork_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes a table that ``stage`` wrote, once nothing reads it any more."""
    path = getattr(df, "_loamwork_path", None)
    if path:
        delete_path(df.sparkSession, path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.delete(target, True)
    _LEFT.pop(path, None)


@atexit.register
def _sweep() -> None:
    for target, system in _LEFT.values():
        try:
            system.delete(target, True)
        except (Py4JError, OSError):
            return  # the JVM has ended before
    _LEFT.clear()


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _hadoop(spark, path)
    return system.exists(target)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver's in the shared folder, put in place in one step."""
    target, system = _hadoop(spark, path)
    part, _ = _hadoop(spark, f"{path}.part")
    out = system.create(part, True)
    out.write(data)
    out.close()
    system.delete(target, False)
    system.rename(part, target)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    target, system = _hadoop(spark, path)
    if not system.exists(target):
        return None
    source = system.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()
