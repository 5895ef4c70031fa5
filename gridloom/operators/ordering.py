"""Ranks and running totals over a whole table without a window over all of it.

The order is cut into ranges of about as many rows, at places of a sample; each is sorted by one
task, and totals of the buckets before it, one short row a bucket, are added to its running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise

#: Buckets of the order, at most; what is collected and broadcast is one row a bucket.
BUCKETS = 256


def ordered(df: DataFrame, order: list[Column | str], sums: dict[str, Column], buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with its rank ``k`` in ``order``, from 1 within each group of the columns ``by``, and for each of ``sums`` the running total by that name.

    ``order`` must be total. Rows are dealt by ranges of the whole order, so neither equal leading values nor a large group are one task's; they are written once,
    so that what they come from is computed once.
    """
    by = by or []
    if buckets is None:
        # As many as there are shuffle partitions: more would only be more tasks' keys.
        buckets = min(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = df.select("*", *(value.alias(f"__v_{name}") for name, value in sums.items()))
    dealt = materialise(valued.repartitionByRange(buckets, *by, *order).withColumn("__b", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    starts = totals.select(*(F.col(c).alias(f"__g_{c}") for c in by), F.col("__b").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__k0"), *(F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums))
    same = F.col("__b") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    joined = dealt.join(starts if by else F.broadcast(starts), same)  # without groups at most ``buckets`` rows
    window = Window.partitionBy("__b", *by).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select("*", (F.row_number().over(window) + F.col("__k0")).alias("__k"), *((F.sum(f"__v_{name}").over(upto) + F.col(f"__s_{name}")).alias(f"__r_{name}") for name in sums))
    return out.select(*(F.col(c) for c in df.columns), F.col("__k").alias("k"), *(F.col(f"__r_{name}").alias(name) for name in sums))


def running(df: DataFrame, score: str, ties: list[str], sums: dict[str, Column], buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``ordered`` by ``score`` descending, null last, and then ``ties``, which must make the order total."""
    return ordered(df, [F.desc_nulls_last(score), *ties], sums, buckets, by)


def hashed_rank(df: DataFrame, key: Column, seed: int, by: list[str] | None = None, digits: int = 3, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``rn``, its rank in the order of ``md5(seed:key)``, and ``h``, that digest, within each group of the columns ``by``.

    For each of ``sums`` the total of the rows before it comes by that name. The order's first ``digits`` hex digits are the buckets:
    evenly filled, whatever the keys are.
    """
    by, sums = by or [], sums or {}
    hashed = df.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))).withColumn("__p", F.substring("h", 1, digits))
    for name, value in sums.items():
        hashed = hashed.withColumn(f"__v_{name}", value)
    counted = hashed.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** digits rows a group
    starts = counted.select(*by, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__k0"), *(F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums))
    order = Window.partitionBy(*by, "__p").orderBy("h")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = hashed.withColumn("__k", F.row_number().over(order))
    for name in sums:
        ranked = ranked.withColumn(name, F.coalesce(F.sum(f"__v_{name}").over(earlier), F.lit(0)))
    ranked = ranked.join(starts, [*by, "__p"])
    return ranked.select(*df.columns, "h", (F.col("__k") + F.col("__k0")).cast("long").alias("rn"), *((F.col(name) + F.col(f"__s_{name}")).alias(name) for name in sums))
