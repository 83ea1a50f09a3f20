"""What a session needs: the package on its executors, and a folder that they share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="stowage-ship-")) / "stowage.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
        _FOLDERS[app] = f"{folder or tempfile.mkdtemp(prefix='stowage-')}/stowage-{app}"
    return _FOLDERS[app]


def _let_go(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles that the garbage collectors of Python and of the driver find unused."""
    gc.collect()
    spark._jvm.System.gc()


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what isn't a function of the rows alone, such as a partition
    number, then stays the same. What is settled stays until clear(). The shuffles of what was settled before are let go of.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _let_go(df.sparkSession)
    df.write.parquet(path, compression="zstd")  # hashes and ids are text: half of what snappy leaves
    time.sleep(0.3)  # until then Spark's own listeners hold the plan
    _let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that the application has settled, stored and streamed; for the end of a job, or between jobs none of whose results
    are still to be read."""
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
