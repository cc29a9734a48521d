"""Requests that carry their history: what was scored before is replayed, what is new is scored once.

Every request is a chain of parts (see :func:`spanguard.plans.requests.request_turns`). Parts travel as hashes only. A part that is not
stored belongs to the earliest request of the batch that has it; that request scores the texts of its new parts, in its row. All
requests then take the hits of all their parts from what is stored and what is new, gathered per request in the order of fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions.frames import apart, exploded, with_rows_where, written
from spanguard.operators.extract import collected_by_format, parse_requests
from spanguard.operators.policy import Policy
from spanguard.operators.recognize import Recognizers
from spanguard.operators.ruletable import RuleTable
from spanguard.operators.scoring import Scorer
from spanguard.plans.requests import redact_scored_fields, request_turns
from spanguard.schemas import HIT

#: A stored result: the hits of each field of a part, in the order of its fields.
NODES = f"hash string, parent_hash string, entities array<array<{HIT}>>"
_NONE = f"cast(array() as array<{HIT}>)"


@dataclass
class Replay:
    """``requests`` with fields, hits and usage; ``nodes`` to append; ``rejected`` requests with a ``reject_reason``."""

    requests: DataFrame
    nodes: DataFrame
    rejected: DataFrame

    def redacted(self, policy: Policy | RuleTable, recognizers: Recognizers | None = None) -> DataFrame:
        """The requests judged and rewritten under the current policy, whether their hits are old or new."""
        return redact_scored_fields(self.requests, policy, recognizers)


def replayed(requests: DataFrame, nodes: DataFrame | None, roots: dict[str, str], scorer: Scorer) -> Replay:
    """Requests (``request_id``, ``api_format``, ``body``, ``created_at``) with the scorer's hits on all their fields.

    Adds ``fields``, ``_texts``, ``_scored`` (hits per field), ``audited`` (per field: its part was judged in an earlier request, stored or
    of this batch) and the usage: ``cached_fragments`` (fields of such parts), ``deduplicated_fragments`` and ``inferred_fragments`` (of
    the other fields, repeated texts and distinct ones; an empty text is neither).

    ``roots`` names the chain root for each format and must change with the scorer. Earlier is smaller by ``created_at``, then
    ``request_id``. A body that is no JSON object is rejected, and so is a request one of whose stored results does not fit:
    another parent, another number of fields, or a word that is no slice of its text. Nodes stored twice count once; null
    columns of a request are values like others; rows with one id are requests of their own.
    """
    spark = requests.sparkSession
    nodes = spark.createDataFrame([], NODES) if nodes is None else nodes
    good, quarantine = parse_requests(requests)
    turned = request_turns(collected_by_format(good), roots).drop("parsed").withColumn("_row", F.monotonically_increasing_id())
    turned = written(turned, "turns")
    listed = F.expr("transform(turns, (t, i) -> named_struct('turn', i, 'hash', t.hash))")
    parts = exploded(turned, ["_row", "request_id", "created_at"], listed, "t").select("_row", "request_id", "created_at", "t.*")

    first_node = F.min(F.struct("parent_hash", "entities")).alias("node")
    stored = nodes.join(parts.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(first_node)
    stored = written(stored.select("hash", "node.*"), "stored")
    place = F.struct(F.col("created_at"), F.col("request_id"), F.col("_row"), F.col("turn"))
    owners = parts.groupBy("hash").agg(F.min(place).alias("first")).join(stored.select("hash"), "hash", "left_anti")
    owned = owners.groupBy("first._row").agg(F.array_sort(F.collect_list("first.turn")).alias("owned"))

    # The small side of these joins is hashed, so rows that hold texts are dealt once and never sorted.
    asked = turned.select("_row", "turns", "fields").join(owned.hint("shuffle_hash"), "_row")
    texts = "flatten(transform(owned, k -> transform(turns[k].fields, i -> fields[i].text)))"
    asked = asked.withColumn("_missing", F.expr(f"filter({texts}, t -> t <> '')")).withColumn("_distinct", F.array_distinct("_missing"))
    scored = scorer.with_nested_hits(asked, "_distinct", "_hits")
    hits = f"coalesce(get(_hits, cast(array_position(_distinct, fields[i].text) as int) - 1), {_NONE})"
    made = F.expr(
        "transform(owned, k -> named_struct('hash', turns[k].hash, 'parent_hash', turns[k].parent_hash,"
        f" 'entities', transform(turns[k].fields, i -> {hits})))"
    )
    scored = scored.select("_row", "owned", made.alias("made"), F.size("_distinct").alias("inferred"), (F.size("_missing") - F.size("_distinct")).alias("repeated"))
    scored = written(scored, "scored")
    fresh = exploded(scored, [], "made", "n").select("n.*")

    known = parts.join(stored.unionByName(fresh), "hash").select("_row", F.struct("turn", "parent_hash", "entities").alias("part"))
    gathered = known.groupBy("_row").agg(F.array_sort(F.collect_list("part")).alias("_parts"))
    gathered = gathered.join(scored.select("_row", "owned", "inferred", "repeated"), "_row", "full")
    rows = turned.join(gathered.hint("shuffle_hash"), "_row", "left")
    rows = rows.withColumn("owned", F.coalesce("owned", F.array().cast("array<int>"))).withColumn("_parts", F.coalesce("_parts", F.array().cast(dict(gathered.dtypes)["_parts"])))
    placed = """array_sort(flatten(transform(turns, (t, k) -> transform(t.fields, (i, j) -> named_struct('i', i,
        'hits', get(get(_parts, k).entities, j), 'audited', not array_contains(owned, k))))))"""
    rows = apart(rows.withColumn("_placed", F.expr(placed)))  # made once for all that is read from it
    fits = F.expr(
        """size(_placed) = size(fields) and not exists(_parts, p -> not (p.parent_hash <=> turns[p.turn].parent_hash)
           or size(p.entities) <> size(turns[p.turn].fields)) and not exists(_placed, x -> exists(x.hits, h ->
           h.start < 0 or h.end > octet_length(fields[x.i].text)
           or not (cast(substring(cast(fields[x.i].text as binary), h.start + 1, h.end - h.start) as string) <=> h.word)))"""
    )
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    # Not written: bodies and texts lie in "turns" and hits in "stored" and "scored" already, whoever reads this takes only the columns
    # it needs, and one who wants the nodes alone never makes it.
    done = rows.withColumns(
        {
            "_texts": F.expr("transform(fields, f -> f.text)"),
            "_scored": F.expr("transform(_placed, x -> x.hits)"),
            "audited": F.expr("transform(_placed, x -> x.audited)"),
            "cached_fragments": F.expr("cast(size(filter(_placed, x -> x.audited)) as bigint)"),
            "deduplicated_fragments": count("repeated"),
            "inferred_fragments": count("inferred"),
        }
    ).drop("_row", "_parts", "_placed", "owned", "inferred", "repeated")
    unfit = with_rows_where(done, ~F.col("_fits")).select(*requests.columns, F.lit("stored_result").alias("reject_reason"))
    return Replay(with_rows_where(done, F.col("_fits")).drop("_fits"), fresh, quarantine.select(*requests.columns, "reject_reason").unionByName(unfit))


def request_outcomes(processed: DataFrame, started_at: Column | None = None) -> DataFrame:
    """What request statistics read of redacted requests: counts of spans, and the usage as JSON."""
    usage = F.to_json(F.struct("cached_fragments", "deduplicated_fragments", "inferred_fragments"))
    return processed.select(
        "request_id", "api_format", (F.col("created_at") if started_at is None else started_at).alias("started_at"), "released", "redacted", usage.alias("cache_usage_json")
    )
