"""Where intermediate tables of the block operators lie."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a purely local session a temporary one that goes at exit, or the warehouse."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_layoutlint"
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="layoutlint-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def saved(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: plans do not pile up, nothing is worked out twice, and lost executors lose nothing.

    ``dealt``: blocks are dealt out evenly, so that what works on single blocks has no task with a whole large document.
    """
    df = df.repartition("doc_id", "ord") if dealt else df
    path = f"{folder(df.sparkSession)}/layoutlint-blocks/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes what :func:`saved` wrote for tables that nothing reads any more."""
    for df in tables:
        if df is not None and getattr(df, "_saved_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
