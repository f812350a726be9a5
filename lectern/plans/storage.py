"""Where tables lie that a later step, or a later query of this application, reads again."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine, as in tests, a local one may stand for it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "file:///tmp/lectern-shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one for this application, which is deleted when its driver ends."""
    own = f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        atexit.register(_delete, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _delete(folder: str) -> None:
    """At the driver's end: by the JVM while it runs, else by the local path; what neither reaches stays for the folder's owner."""
    sc = SparkContext._active_spark_context
    if sc and sc._jvm:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    elif "://" not in folder or folder.startswith("file://"):
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it: lineage ends there, and a lost executor costs no more than its tasks."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> tuple[tuple[str, int, int, int], ...]:
    """Of the folders that df reads their files' number and bytes, and when they last changed: what a copy made of them goes by. A call for each folder, not for each file."""
    spark, out = df.sparkSession, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = fs.getContentSummary(path)
        out.append((folder, held.getFileCount(), held.getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what materialize() wrote for these, once nothing lazy reads it any more. What does not lie under the application's own folder is refused."""
    own = f"{urlparse(shared_dir(spark)).path}/lectern-{spark.sparkContext.applicationId}/"
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not urlparse(folder).path.startswith(own):
                raise ValueError(f"{folder} is not a table of this application")
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
