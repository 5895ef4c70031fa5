"""The star-schema, event and embedding tables as inputs of grid pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square that an embedding of 64 numbers makes.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, g, v, label)``: one row an image, its cells row by row in an array of float."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("g"), F.col("embedding").cast("array<float>").alias("v"), "label")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, grp, score, label)``: labelled documents scored by their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = labels.join(docs, "doc_id")
    return joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), F.col("n_chars").cast("double").alias("score"), "quality", "toxic")


#: Columns of ``lineitem`` that are features of a cell, in order.
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def row_key() -> F.Column:
    """A line item's key; its numbers alone repeat in places, so its price in cents is part of it."""
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] + [F.round(F.col("l_extendedprice") * 100)]
    return F.concat_ws("-", *(p.cast("long").cast("string") for p in parts))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_key, x, y)``: line items as cells, four float features and whether the item was returned."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(row_key().alias("row_key"), F.array(*[F.col(c).cast("float") for c in FEATURES]).alias("x"), (F.col("l_returnflag") == "R").alias("y"))
