"""Token predictions as tables: labels, probabilities, spans and comparisons.

A token row has ``doc_id``, ``token_idx``, ``start``, ``end`` (UTF-8 bytes) and ``logits`` (33 numbers).  One document is
one text, and a model reads a bounded number of tokens of it; that bounds every window and group by document here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanguard.functions.offsets import cut, widened
from spanguard.functions.sqlx import let

# Order of the model's categories and of the boundary marks; id = 1 + 4 * category + boundary, 0 = outside.
MODEL_LABELS = (
    "account_number", "private_address", "private_date", "private_email", "private_person", "private_phone",
    "private_url", "secret",
)
BOUNDARIES = "BIES"
LABEL_COUNT = 1 + len(MODEL_LABELS) * len(BOUNDARIES)


def label_dim(spark: SparkSession) -> DataFrame:
    """33 rows: id, category, boundary, label name, and whether a path may start or end there."""
    return spark.range(LABEL_COUNT).select(
        F.col("id").cast("int").alias("id"),
        group_of(F.col("id")).alias("entity_group"),
        boundary_of(F.col("id")).alias("boundary"),
        F.when(F.col("id") == 0, "O")
        .otherwise(F.concat_ws("-", boundary_of(F.col("id")), group_of(F.col("id"))))
        .alias("label"),
        boundary_of(F.col("id")).isin("O", "B", "S").alias("can_start"),
        boundary_of(F.col("id")).isin("O", "E", "S").alias("can_end"),
    )


def group_of(label_id: Column) -> Column:
    names = F.array(*map(F.lit, MODEL_LABELS))
    return F.when(label_id > 0, F.get(names, F.floor((label_id - 1) / len(BOUNDARIES)).cast("int")))


def boundary_of(label_id: Column) -> Column:
    marks = F.array(*map(F.lit, BOUNDARIES))
    return F.when(label_id == 0, F.lit("O")).otherwise(F.get(marks, ((label_id - 1) % len(BOUNDARIES)).cast("int")))


def token_label(logits: str = "logits") -> Column:
    """Id of the highest logit; the lowest id among equals."""
    return F.expr(f"cast(array_position({logits}, array_max({logits})) as int) - 1")


def label_probability(label_id: str, logits: str = "logits") -> Column:
    """Softmax probability of one label, in double, shifted by the maximum."""
    top = f"cast(array_max({logits}) as double)"

    def share(m: str) -> str:
        total = f"aggregate({logits}, 0D, (a, x) -> a + exp(cast(x as double) - {m}))"
        return f"exp(cast({logits}[{label_id}] as double) - {m}) / {total}"

    return F.expr(let(top, share))


def has_finite_logits(logits: str = "logits") -> Column:
    return F.expr(
        f"size({logits}) = {LABEL_COUNT} and"
        f" forall({logits}, x -> x is not null and not isnan(x) and abs(x) <> float('infinity'))"
    )


def token_violations(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Tokens without a text, whose range is missing, reversed, leaves the text or runs backwards, or whose logits are not finite."""
    order = Window.partitionBy("doc_id").orderBy("token_idx")
    sizes = texts.select("doc_id", F.octet_length("text").alias("_size"))
    return (
        tokens.select("doc_id", "token_idx", "start", "end", has_finite_logits().alias("_finite"))
        .withColumn("_last_start", F.lag("start", 1, 0).over(order))
        .withColumn("_last_end", F.lag("end", 1, 0).over(order))
        .join(sizes, "doc_id", "left")
        .withColumn(
            "violation",
            F.when(F.col("_size").isNull(), "no_text")
            .when(~F.coalesce("_finite", F.lit(False)), "logits")
            .when(F.col("start").isNull() | F.col("end").isNull(), "offsets")
            .when(F.col("start") > F.col("end"), "reversed")
            .when(F.col("end") > F.col("_size"), "outside")
            .when((F.col("start") < F.col("_last_start")) | (F.col("end") < F.col("_last_end")), "unordered"),
        )
        .where(F.col("violation").isNotNull())
        .select("doc_id", "token_idx", "violation")
    )


def checked(tokens: DataFrame) -> DataFrame:
    """The same tokens; one with unusable logits, or with a range that is missing, reversed or runs backwards, fails the job.

    A prediction that cannot be read must not be taken for a text without private data.
    """
    order = Window.partitionBy("doc_id").orderBy("token_idx")
    backwards = (F.col("start") < F.lag("start", 1, 0).over(order)) | (F.col("end") < F.lag("end", 1, 0).over(order))
    broken = (
        F.when(~F.coalesce(has_finite_logits(), F.lit(False)), "logits")
        .when(F.col("start").isNull() | F.col("end").isNull(), "offsets")
        .when(F.col("start") > F.col("end"), "reversed")
        .when(backwards, "unordered")
    )
    where = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(", token "), "token_idx")
    start = F.when(F.col("_broken").isNull(), F.col("start")).otherwise(
        F.raise_error(F.concat(F.lit("token prediction not usable ("), "_broken", F.lit("): "), where)).cast("int")
    )
    return tokens.withColumn("_broken", broken).withColumn("start", start).drop("_broken")


def labelled(tokens: DataFrame) -> DataFrame:
    """Add ``label_id`` (highest logit) and its ``probability``; the logits are not needed any more.

    Tokens that :func:`checked` refuses fail the job.
    """
    scored = checked(tokens).withColumn("label_id", token_label())
    return scored.withColumn("probability", label_probability("label_id")).drop("logits")


def viterbi_labelled(tokens: DataFrame) -> DataFrame:
    """Like :func:`labelled` with the best legal path of every document (no transition bias)."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token_idx")
        logits = np.array(pdf["logits"].tolist(), dtype=np.float64)
        path = best_path(logits)
        shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
        probability = shifted[np.arange(len(path)), path] / shifted.sum(axis=1)
        return pdf[["doc_id", "token_idx", "start", "end"]].assign(label_id=path, probability=probability)

    usable = checked(tokens.select("doc_id", "token_idx", "start", "end", "logits"))
    return usable.groupBy("doc_id").applyInPandas(
        best, "doc_id bigint, token_idx int, start int, end int, label_id int, probability double"
    )


def _transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.arange(LABEL_COUNT)
    boundary = np.array(["O", *(BOUNDARIES * len(MODEL_LABELS))])
    category = np.where(ids == 0, -1, (ids - 1) // len(BOUNDARIES))
    can_start, can_end = np.isin(boundary, ["O", "B", "S"]), np.isin(boundary, ["O", "E", "S"])
    continues = np.isin(boundary, ["I", "E"])
    same = category[:, None] == category[None, :]
    allowed = np.where(can_end[:, None], can_start[None, :], same & continues[None, :])
    return can_start, can_end, allowed


def best_path(logits: np.ndarray) -> np.ndarray:
    """Labels of the legal path with the highest sum; the lowest id wins among equals."""
    can_start, can_end, allowed = _transitions()
    barrier = np.where(allowed, 0.0, -np.inf)
    best = np.where(can_start, logits[0], -np.inf)
    back = np.zeros(logits.shape, dtype=np.int32)
    for t in range(1, len(logits)):
        reached = best[:, None] + barrier + logits[t][None, :]
        back[t] = reached.argmax(axis=0)
        best = reached.max(axis=0)
    path = np.zeros(len(logits), dtype=np.int32)
    path[-1] = np.where(can_end, best, -np.inf).argmax()
    for t in range(len(logits) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode_spans(labels: DataFrame) -> DataFrame:
    """Runs of labelled tokens as spans (doc_id, entity_group, score, start, end), widths still as the tokens have them.

    Empty tokens are left out first.  A token opens a span unless it continues one of its category: not after an
    outside token, not after an end or single mark, and not with a begin or single mark.
    """
    order = Window.partitionBy("doc_id").orderBy("token_idx")
    real = labels.where(F.col("start") < F.col("end")).select(
        "*", group_of(F.col("label_id")).alias("entity_group"), boundary_of(F.col("label_id")).alias("boundary")
    )
    last_group, last_boundary = F.lag("entity_group").over(order), F.lag("boundary").over(order)
    opens = (
        last_group.isNull()
        | (last_group != F.col("entity_group"))
        | last_boundary.isin("E", "S")
        | F.col("boundary").isin("B", "S")
    )
    numbered = real.withColumn("_opens", F.when(F.col("entity_group").isNotNull() & opens, 1).otherwise(0)).withColumn(
        "_span", F.sum("_opens").over(order)
    )
    return (
        numbered.where(F.col("entity_group").isNotNull())
        .groupBy("doc_id", "_span")
        .agg(
            F.first("entity_group").alias("entity_group"),
            F.avg("probability").alias("score"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .drop("_span")
    )


def with_words(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Widen spans to character boundaries and add their word.

    Spans are gathered per document, so each text is joined once however many spans it has.  A span of a document without
    text, or beyond the end of its text, fails the job.
    """
    gathered = spans.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "entity_group", "score"))).alias("_spans")
    )
    fits = F.expr("text is not null and forall(_spans, s -> s.end <= octet_length(text))")
    refused = F.concat(F.lit("spans outside the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    widen = let(
        "cast(text as binary)",
        lambda raw: f"transform(_spans, s -> {let(widened(raw, 's.start', 's.end'), lambda r: _hit(raw, r))})",
    )
    return (
        gathered.join(texts.select("doc_id", "text"), "doc_id", "left")
        .withColumn("text", F.when(fits, F.col("text")).otherwise(F.raise_error(refused).cast("string")))
        .select("doc_id", F.explode_outer(F.expr(widen)).alias("h"))
        .select("doc_id", "h.*")
    )


def _hit(raw: str, r: str) -> str:
    return (
        f"named_struct('entity_group', s.entity_group, 'score', s.score, 'start', {r}.start, 'end', {r}.end,"
        f" 'word', {cut(raw, f'{r}.start', f'{r}.end')})"
    )


def decode(tokens: DataFrame, texts: DataFrame, viterbi: bool = False) -> DataFrame:
    """Entities of every document: independent labels, or the best legal path."""
    return with_words(decode_spans(viterbi_labelled(tokens) if viterbi else labelled(tokens)), texts)


def compare_predictions(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: tokens on one side only, largest and mean logit error, and tokens with another label."""
    a = actual.select("doc_id", "token_idx", F.col("logits").alias("_a"))
    e = expected.select("doc_id", "token_idx", F.col("logits").alias("_e"))
    both, errors = "_a is not null and _e is not null", "zip_with(_a, _e, (x, y) -> abs(x - y))"
    per_token = a.join(e, ["doc_id", "token_idx"], "full").select(
        "doc_id",
        F.expr(both).alias("both"),
        F.expr(f"if({both}, array_max({errors}), null)").alias("largest"),
        F.expr(f"if({both}, aggregate({errors}, 0D, (s, x) -> s + cast(x as double)), null)").alias("total"),
        (token_label("_a") != token_label("_e")).alias("other_label"),
    )
    return per_token.groupBy("doc_id").agg(
        F.count_if(~F.col("both")).alias("unmatched_tokens"),
        F.max("largest").alias("max_error"),
        (F.sum("total") / (F.count_if("both") * LABEL_COUNT)).alias("mean_error"),
        F.count_if("other_label").alias("label_mismatches"),
    )


def compare_spans(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: spans on one side only, and the largest score error of shared spans."""
    keys = ["doc_id", "entity_group", "start", "end"]
    a = actual.select(*keys, F.col("score").alias("_a"))
    e = expected.select(*keys, F.col("score").alias("_e"))
    return (
        a.join(e, keys, "full")
        .groupBy("doc_id")
        .agg(
            F.count_if(F.col("_e").isNull()).alias("only_actual"),
            F.count_if(F.col("_a").isNull()).alias("only_expected"),
            F.max(F.abs(F.col("_a") - F.col("_e"))).alias("max_score_error"),
        )
    )
