"""Global row numbers without a one-task window, and scratch tables in the shared folder of the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard.session import scratch


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir`` and read again: survives lost executors, cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], number: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Adds the place of each row in ``order``, from 0 without gaps; with ``weight``, the sum of weights before it.

    Rows are sorted by range over all tasks and written once; only one sum for each written part meets in a window.
    ``total`` names a column for the overall sum. Equal rows are numbered in any order.
    """
    own = ("__part", "__own", "__before")
    if set(own) & set(df.columns):
        raise ValueError(f"columns {own} are taken")
    step = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long"))
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id())
    kept = stored(parts, "numbered")
    sums = kept.groupBy("__part").agg(F.sum(step).alias("__sum"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(ahead), F.lit(0).cast("long")).alias("__before"), F.sum("__sum").over(Window.partitionBy(F.lit(0))).alias("__all"))
    inside = Window.partitionBy("__part").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    if weight is None:
        local = F.col("__own").bitwiseAND((1 << 33) - 1)
    else:
        local = F.coalesce(F.sum(step).over(inside), F.lit(0).cast("long"))
    out = kept.join(F.broadcast(sums), "__part").withColumn(number, F.col("__before") + local)  # one row for each written part
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.select(*df.columns, number, *([total] if total else []))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
