"""Shared-folder tables and files: how every operator here cuts lineage."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.store import drop_table, materialise, shared_path

__all__ = ["drop_table", "materialise", "shared_path", "write_bytes"]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file to the shared folder through Hadoop's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(data)
    finally:
        out.close()
