"""Cutting long lineages.

``cut`` writes a DataFrame as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back.  A lost executor then costs a reread of
those files, never a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []
_OWN: dict[str, str] = {}  # folders of local sessions that name none, by application


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local session may leave it unset, and gets a temporary one for its program's
    time; on a cluster a folder of one machine would be lost with it, so there it is an
    error.  The setting itself is fixed when a session starts and is left as it is.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _OWN:
            _OWN[name] = "file://" + tempfile.mkdtemp(prefix="weftline-")
        where = _OWN[name]
    return where.rstrip("/")


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the program."""
    path = f"{shared_dir(spark)}/weftline-{label}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def drop(*cuts: DataFrame | None) -> None:
    """Delete the files of ``cut`` tables that no later step reads."""
    for df in cuts:
        path = getattr(df, "_weftline_path", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _KEPT[:] = [kept for kept in _KEPT if kept[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    """What queries still read when they are run is deleted with the program."""
    for spark, path in _KEPT:
        try:
            _delete(spark, path)
        except Exception:  # its session has ended: the cluster clears its folder
            continue
