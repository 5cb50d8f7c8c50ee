"""Paths on whatever file system the cluster uses, and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def _resolve(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _resolve(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder tree; False if it was not there."""
    hadoop_path, fs = _resolve(spark, path)
    return fs.exists(hadoop_path) and fs.delete(hadoop_path, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob pattern, sorted."""
    hadoop_path, fs = _resolve(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(hadoop_path) or [])


def side_by_side(act: Callable, paths: Iterable[str]) -> list:
    """``act`` on each path, sixteen at a time: file systems answer slowly but many at once."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(act, paths))


def delete_all(spark: SparkSession, paths: Iterable[str]) -> int:
    """Remove many files or folders; returns how many there were."""
    return sum(side_by_side(lambda path: delete(spark, path), paths))


def delete_matching(spark: SparkSession, pattern: str) -> int:
    return delete_all(spark, matching(spark, pattern))


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a folder another place on its file system."""
    source, fs = _resolve(spark, path)
    goal, _ = _resolve(spark, target)
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"can't move {path} to {target}")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else one in the warehouse, which executors share too."""
    sc = spark.sparkContext
    folder = sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def files_of(spark: SparkSession, pattern: str) -> list[str]:
    """Data files at a path or pattern, folders searched to the bottom, sorted; names that begin with
    ``_`` or ``.`` are no data."""
    hadoop_path, fs = _resolve(spark, pattern)
    found, todo = [], list(fs.globStatus(hadoop_path) or [])
    while todo:
        status = todo.pop()
        path = status.getPath()
        if path.getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo.extend(fs.listStatus(path))
        else:
            found.append(path.toString())
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a file, unpacked if its name ends like a packed file's; None if the file is empty.

    Reads a buffer of the file's start, however long the file is.
    """
    hadoop_path, fs = _resolve(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    codec = hadoop.io.compress.CompressionCodecFactory(fs.getConf()).getCodec(hadoop_path)
    stream = fs.open(hadoop_path)
    try:
        reader = hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        line = hadoop.io.Text()
        return line.toString() if reader.readLine(line) else None
    finally:
        stream.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage of an expensive step that several later passes read. The copy
    survives lost executors, and being columnar it still lets each pass read only
    its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
