"""The pipeline on arriving rows.  Redaction is map-only, so it runs unchanged on a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.functions.frames import exploded
from spanguard.functions.sqlx import each, each_indexed, hash_chain, let, link, lit, struct
from spanguard.operators.chain import lookup_nodes, new_nodes, replay_or_score, turn_chain
from spanguard.operators.extract import scannable_turns
from spanguard.operators.metrics import request_columns
from spanguard.operators.policy import Policy
from spanguard.operators.scoring import Scorer
from spanguard.plans.pipeline import pool_rows, redact_scored, run_pipeline
from spanguard.sources.tables import _existing, absent_nodes

PolicyProvider = Callable[[], Policy]


def stream_redact(stream: DataFrame, policy: Policy, text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """Redacted rows of a stream under a fixed policy."""
    return run_pipeline(stream, policy, text, scorer)


def redact_batches(
    policy_provider: PolicyProvider,
    sink: Callable[[DataFrame, int], None],
    text: str = "text",
    scorer: Scorer | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reads the policy anew for every micro-batch.

    Any failure fails the micro-batch, which Spark then repeats; rows that could not be scored are never handed on.
    ``sink`` gets the batch id, so it can overwrite what a failed attempt left.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(run_pipeline(batch, policy_provider(), text, scorer), batch_id)

    return run


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to: made once, kept beside the checkpoint, read again after a restart.

    A query with a new checkpoint counts its batches from 0 again; with a name of its own it cannot replace what an earlier
    run has written.
    """
    path = f"{checkpoint.rstrip('/')}-run"
    known = _existing(spark, path)
    if known is None:
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").coalesce(1).write.mode("ignore").parquet(path)
        known = spark.read.parquet(path)
    return known.first()["run"]


def batch_writer(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes one directory per run and micro-batch; a repeated batch replaces its own."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return write


def stream_outcomes(outcomes: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Every request id once, as far as repeats arrive within ``delay``."""
    return outcomes.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["request_id"])


def stream_stats(
    requests: DataFrame, event_time: str, delay: str = "1 hour", length: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Request statistics per time window; rows later than the watermark are left out."""
    span = F.window(event_time, length, slide) if slide else F.window(event_time, length)
    return (
        requests.withWatermark(event_time, delay)
        .groupBy(span.alias("window"))
        .agg(*request_columns())
        .select("window.start", "window.end", "*")
        .drop("window")
    )


def sent_turns(requests: DataFrame, root: str) -> DataFrame:
    """The turns of requests that carry their conversation (``request_id``, ``conv_id``, ``created_at``, ``turns`` as
    ``array<struct<role, text>>``), one row each, with a hash that covers a turn and all before it. Map-only.
    """
    digests = each("turns", lambda t: f"sha2(to_json(array(coalesce({t}.role, ''), coalesce({t}.text, ''))), 256)")
    rows = let(
        f"cast({hash_chain(digests, lit(root))} as binary)",
        lambda c: each_indexed("turns", lambda t, i: struct(turn=f"cast({i} as bigint)", role=f"{t}.role", text=f"{t}.text", hash=link(c, i))),
    )
    return exploded(requests, ["request_id", "conv_id", "created_at"], F.expr(rows), "t").select("request_id", "conv_id", "created_at", "t.*")


def new_turns(turns: DataFrame, remembered: str = "30 days") -> DataFrame:
    """Turns of a stream (:func:`sent_turns`) whose hash their conversation has not sent before, once each.

    What was sent is keyed state, one small entry for each turn, so no batch reads what earlier ones wrote, a long conversation is dealt
    to many tasks, and a restart goes on from the checkpoint. An entry is forgotten once the stream is ``remembered`` further on in
    ``created_at`` (milliseconds); rows that come later than that are left out. Of several requests that bring a turn in one
    batch any one is named. Rows without a conversation are one conversation.
    """
    timed = turns.withColumn("_at", F.timestamp_millis("created_at")).withWatermark("_at", remembered)
    return timed.dropDuplicatesWithinWatermark(["conv_id", "hash"]).drop("_at")


def stream_new_turns(requests: DataFrame, root: str, policy: Policy, scorer: Scorer, remembered: str = "30 days") -> DataFrame:
    """Redacted rows of the turns that a stream of requests brings anew; turns of the model are part of the chain only."""
    fresh = scannable_turns(new_turns(sent_turns(requests, root), remembered))
    return redact_scored(scorer.with_hits(fresh, "text", "hits"), policy, "hits")


def new_turn_batches(
    nodes_path: str,
    pool_path: str,
    root: str,
    policy_provider: PolicyProvider,
    scorer: Scorer,
    run: str,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for conversation snapshots: only turns that were never judged reach the pool.

    ``run`` names the run (see :func:`run_name`).  Each batch is scored once: what is scored is held for both writes.

    A row is one turn of a sent request: ``request_id``, ``conv_id``, ``turn``, ``role``, ``text``, ``created_at``.
    Everything is redacted again under the current policy; stored results only save scoring.  The pool is written
    before the nodes and replaced by a repeated batch, so a lost executor or a failed attempt leaves no gap.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _existing(spark, nodes_path)
        if stored is None:
            stored = spark.createDataFrame([], _NODES)
        # Nodes of this very batch are not counted as known when it is repeated.
        own = (F.col("run") == run) & (F.col("batch") == batch_id)
        known = stored.where(~own).drop("run", "batch")
        chained = scannable_turns(turn_chain(batch, root, keys=("request_id",)))
        scored = replay_or_score(lookup_nodes(chained, known), scorer).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write(scored, known, batch_id)
        finally:
            scored.unpersist()

    def write(scored: DataFrame, known: DataFrame, batch_id: int) -> None:
        # A turn that several requests of this batch repeat is recorded by the first of them.
        first = scored.groupBy("hash").agg(F.min(F.struct("created_at", "request_id")).alias("_first"))
        scored = scored.join(first, "hash")
        place = f"run={run}/batch={batch_id}"
        repeated = F.struct("created_at", "request_id") != F.col("_first")
        judged = redact_scored(scored, policy_provider(), "hits")
        rows = (
            judged.withColumn("id", F.concat_ws("/", "request_id", "turn"))
            .withColumn("api_format", F.lit("conversation"))
            .withColumn("path", F.col("role"))
            .withColumn("ordinal", F.col("turn").cast("bigint"))
        )
        pool = pool_rows(rows, already_audited=F.col("already_audited") | repeated)
        pool.write.mode("overwrite").parquet(f"{pool_path}/{place}")
        absent_nodes(new_nodes(scored), known).write.mode("overwrite").parquet(f"{nodes_path}/{place}")

    return record


_NODES = (
    "hash string, parent_hash string, hits array<struct<entity_group:string,score:double,start:int,end:int,word:string>>,"
    " run string, batch int"
)
