"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.operators.policy import Policy, load_policy

#: Text tables that can be scanned: table name to (key columns, text column).
CORPORA = {
    "documents": (("doc_id",), "text"),
    "pages": (("page_id",), "html"),
    "conversations": (("conv_id", "turn", "role"), "text"),
    "benchmark": (("item_id",), "text"),
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Splits up to which rows are dealt out anew: at most this many times the split size are ever moved.
FEW_SPLITS = 2


def spread(df: DataFrame) -> DataFrame:
    """Give every core work where the whole input is one or two splits, as a small file with one row group is.

    Rows are dealt round robin, so no key is crowded.  Larger inputs stay as they are: their texts are never moved.
    """
    if df.rdd.getNumPartitions() > FEW_SPLITS:
        return df
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def read_corpus(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Keys and ``text`` of a text table."""
    keys, text = CORPORA[name]
    return spread(read_table(spark, directory, name).select(*keys, F.col(text).alias("text")))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragment rows of a written pool (the spans column is not read)."""
    return spark.read.parquet(path).drop("spans")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Span rows of a written pool."""
    from spanguard.plans.pipeline import spans

    return spans(spark.read.parquet(path))


def read_requests(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    requests = spark.read.parquet(path)
    return requests if since_ms is None else requests.where(F.col("started_at") >= since_ms)


def read_policy(spark: SparkSession, rules_path: str, fallback_path: str | None = None) -> Policy:
    """Compile the rules table; the fallback table has one row with ``action``."""
    fallback = "release"
    if fallback_path is not None:
        row = spark.read.parquet(fallback_path).select("action").first()
        fallback = row.action if row else fallback
    return load_policy(spark.read.parquet(rules_path), fallback)


def read_providers(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Providers by name, or the one with this name."""
    providers = spark.read.parquet(path)
    return providers.orderBy("name") if name is None else providers.where(F.col("name") == name)


def read_fragments_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{"text": …}`` per file, without empty texts.

    A JSON array cannot be split, so one file is one task; write JSON lines (``multiLine`` off) for large inputs.
    """
    return spark.read.schema("text string").json(path, multiLine=True).where(F.col("text") != "")


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines: request_id, path, body (text), started_at."""
    return spark.read.schema("request_id string, path string, body string, started_at bigint").json(path)


def day_of(milliseconds: str) -> Column:
    return F.to_date(F.timestamp_millis(milliseconds))


def write_pool(pool: DataFrame, path: str, mode: str = "append") -> None:
    """Write fragments with their nested spans, one row each, by day: a fragment and its spans arrive together."""
    pool.withColumn("day", day_of("created_at")).write.mode(mode).partitionBy("day").parquet(path)


def write_outcomes(outcomes: DataFrame, path: str, order: str = "started_at") -> None:
    """Append request outcomes that are not in the table yet; of several in one batch the earliest is kept."""
    target = _existing(outcomes.sparkSession, path)
    new_outcomes(outcomes, target, order).write.mode("append").parquet(path)


def new_outcomes(outcomes: DataFrame, existing: DataFrame | None, order: str = "started_at") -> DataFrame:
    """The earliest outcome of every request that is not in ``existing``.

    An outcome without ``order`` comes after those with one; equal ones are told apart by their values.  Outcomes without
    a request id are one request.
    """
    rest = [c for c in outcomes.columns if c != "request_id"]
    place = F.struct(F.col(order).isNull(), F.col(order), F.to_json(F.struct(*rest)))
    first = outcomes.groupBy("request_id").agg(F.min_by(F.struct(*rest), place).alias("_o"))
    rows = first.select("request_id", "_o.*").select(*outcomes.columns)
    if existing is None:
        return rows
    known = existing.select(F.col("request_id").alias("_known"))
    return rows.join(known, rows["request_id"].eqNullSafe(known["_known"]), "left_anti")


def attach_performance(outcomes: DataFrame, performance: DataFrame, order: str | None = None) -> DataFrame:
    """Outcomes with the latest model sample of their request, where there is one (``request_id``, ``performance_json``).

    ``order`` names the column of samples that tells which is the latest; without it, and among equals, the greatest sample
    counts.  Every outcome is returned once.
    """
    place = F.struct(*([F.col(order)] if order else []), "performance_json")
    samples = (
        performance.where(F.col("performance_json").isNotNull())
        .groupBy("request_id")
        .agg(F.max_by("performance_json", place).alias("_sample"))
    )
    joined = outcomes.join(samples, "request_id", "left")
    if "model_performance_json" in outcomes.columns:
        sample = F.coalesce("_sample", "model_performance_json")
    else:
        sample = F.col("_sample")
    return joined.withColumn("model_performance_json", sample).drop("_sample")


def append_nodes(nodes: DataFrame, path: str) -> None:
    """Append turn nodes whose hash is not stored yet."""
    absent_nodes(nodes, _existing(nodes.sparkSession, path)).write.mode("append").parquet(path)


def absent_nodes(nodes: DataFrame, existing: DataFrame | None) -> DataFrame:
    fresh = nodes.dropDuplicates(["hash"])
    return fresh if existing is None else fresh.join(existing.select("hash"), "hash", "left_anti")


def write_payloads(processed: DataFrame, path: str, mode: str = "append") -> None:
    """What would be forwarded.  A request that could not be rewritten stops the write instead of leaking."""
    guarded = F.when(
        F.col("rewrite_error").isNotNull(), F.raise_error(F.concat(F.lit("request not rewritten: "), "rewrite_error"))
    ).otherwise(F.col("payload"))
    processed.select("request_id", "api_format", guarded.alias("payload"), "released", "redacted").write.mode(
        mode
    ).parquet(path)


def payloads(df: DataFrame, original: str = "text", rewritten: str = "redacted_text") -> DataFrame:
    """``payload``: the exact original where nothing was redacted, the rewritten text elsewhere."""
    return df.withColumn("payload", F.when(F.col("redacted") == 0, F.col(original)).otherwise(F.col(rewritten)))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written; any other failure to read it is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
