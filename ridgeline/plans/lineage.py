"""Cut lineage in storage that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own_folder(spark: SparkSession) -> str:
    """A temporary folder, only for a master on this machine alone."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ridgeline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once with a reliable checkpoint and read it from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only where a session names none and runs on one
    machine (tests) a temporary folder is set; a cluster without a shared folder is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or _own_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(cut: DataFrame) -> None:
    """Delete the files of a result of ``cut_lineage`` that nothing will read again."""
    spark = cut.sparkSession
    file = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that is removed when the driver ends: below ``spark.checkpoint.dir``, which all executors share, else temporary on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = f"{shared.removeprefix('file://').rstrip('/')}/ridgeline-{uuid.uuid4().hex}" if shared else f"{_own_folder(spark)}/w"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
