"""Tables in the shared folder of the session: how iterative operators cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``; only in local mode, where
that is unset (tests, notebooks), is a folder of our own made and set. On a cluster an unset one is an error. Tables are
written by Spark's committer, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; in local mode one is made and set if the session has none."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for this application below the shared folder."""
    return f"{shared_root(spark)}/gridloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table written by :func:`materialise` that nothing will read again."""
    path = getattr(df, "_gridloom_path", None)
    if path is not None:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
