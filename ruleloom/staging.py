"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where the session names none, one is set: in local mode (tests) a temporary folder, on a cluster one in the
    warehouse, which all machines share; a machine's own folder never.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local")
        top = "file://" + tempfile.mkdtemp(prefix="ruleloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ruleloom-staged"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/ruleloom-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends, and a lost executor costs nothing that is written."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    # What the job shuffled is of no more use; Spark drops those files once the JVM has collected their handles.
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing refers to any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(df.staged_at).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
