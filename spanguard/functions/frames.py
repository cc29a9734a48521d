"""Row-level helpers that keep an expensive column from being computed twice.

Catalyst pushes a filter on a computed column, and the non-empty test of ``explode``, below the projection that
computes it, and then evaluates the whole computation in the filter as well.  An outer explode has no such test, and
nothing is pushed below a generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.session import scratch


def with_rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` for a condition on an expensive computed column."""
    return (
        df.withColumn("_keep", F.explode_outer(F.when(condition, F.array(F.lit(True)))))
        .where(F.col("_keep").isNotNull())
        .drop("_keep")
    )


def exploded(df: DataFrame, kept: list, array: str | Column, alias: str) -> DataFrame:
    """``kept`` columns and one row per array item; rows with an empty or null array go."""
    return df.select(*kept, F.explode_outer(array).alias(alias)).where(F.col(alias).isNotNull())


def apart(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which Catalyst merges no projections.

    It may draw one call of a Python function into the arguments of another, and then cannot take them apart again (Spark 4.1:
    "Cannot evaluate expression").
    """
    return df.withColumn("_apart", F.explode(F.array(F.lit(True)))).drop("_apart")


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The rows written below the shared folder of the cluster and read again: made once, whoever reads them."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
