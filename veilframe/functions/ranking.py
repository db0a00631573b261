"""Row numbers over a whole table or large groups without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .determinism import order_key

PREFIX = 3


def hashed_row_number(df: DataFrame, seed: int | str, key: str, output: str, by: str | None = None) -> DataFrame:
    """df with 1-based numbers in the order of (digest of key, key), within groups of ``by`` if given.

    Rows are numbered within buckets of the digest's first digits, which are even for any group, and
    moved on by the rows of the buckets before. The key has to be unique for a reproducible order.
    """
    group = [F.col(by)] if by else []
    df = df.withColumn("__d", order_key(seed, F.col(key))).withColumn("__b", F.substring("__d", 1, PREFIX))
    sizes = df.groupBy(*([by] if by else []), "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *([F.col(by).alias("__by")] if by else []), F.col("__b").alias("__ob"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o")
    )
    inside = Window.partitionBy(*group, "__b").orderBy("__d", key)
    on: Column = F.col("__b") == F.col("__ob")
    if by:
        on = on & F.col(by).eqNullSafe(F.col("__by"))
    numbered = df.withColumn("__r", F.row_number().over(inside)).join(offsets, on)
    return numbered.withColumn(output, (F.col("__r") + F.col("__o")).cast("long")).drop("__d", "__b", "__ob", "__by", "__o", "__r")


def in_ranges(df: DataFrame, column: str, part: str) -> DataFrame:
    """df with a number for each of the ranges that its rows are sorted into; ranges ascend with their numbers."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, column).withColumn(part, F.spark_partition_id())


def prefix_sum(df: DataFrame, column: str, value: Column, before: str, up_to: str) -> DataFrame:
    """df with the sums of value over all rows before, and up to, each one in the order of a column without repeats.

    Rows are summed within ranges of the column, and each range is moved on by those before it, so that no task sees more than
    a range. A row's first sum is exactly the second one of the row before it.
    """
    ranged = in_ranges(df.withColumn("__v", value), column, "__p")
    inside = Window.partitionBy("__p").orderBy(column)
    first = Window.unboundedPreceding
    local = ranged.withColumns({
        "__a": F.coalesce(F.sum("__v").over(inside.rowsBetween(first, -1)), F.lit(0)),
        "__b": F.sum("__v").over(inside.rowsBetween(first, 0))
    })
    ends = local.groupBy(F.col("__p").alias("__q")).agg(F.max_by("__b", column).alias("__s"))
    offsets = ends.select("__q", F.coalesce(F.sum("__s").over(Window.orderBy("__q").rowsBetween(first, -1)), F.lit(0)).alias("__o"))
    moved = local.join(offsets, F.col("__p") == F.col("__q"))
    return moved.withColumns({
        before: F.col("__a") + F.col("__o"), up_to: F.col("__b") + F.col("__o")
    }).drop("__v", "__p", "__q", "__o", "__a", "__b")
