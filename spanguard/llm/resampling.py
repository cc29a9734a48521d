"""Quality by importance resampling: hashed n-gram models of target and raw text, their ratio, Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.bytetext import ALPHANUMERIC, Hasher, mixed, slices, words
from spanguard.llm.rows import numbered, stored
from spanguard.llm.worker import kept

BINS = 1 << 14
#: The target model starts from so many n-grams drawn from the raw model.
PRIOR = 500.0


def bins(column) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all words and pairs of neighbouring words of a column, and the row each belongs to."""
    hashes, bounds = words(column, ALPHANUMERIC, kept("hasher", Hasher))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = rows[1:] == rows[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[same] if len(hashes) else hashes
    both = np.concatenate([hashes, pairs])
    return (both >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), np.concatenate([rows, rows[1:][same]])


def _counted(batches):
    sums = np.zeros((2, BINS), np.int64)
    for batch in slices(batches, "text"):
        own, rows = bins(batch.column(batch.schema.get_field_index("text")))
        target = batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)[rows]
        sums[0] += np.bincount(own, minlength=BINS)
        sums[1] += np.bincount(own[target], minlength=BINS)
    raw, target = (np.flatnonzero(s) for s in sums)
    yield pa.RecordBatch.from_pydict({"model": np.repeat([0, 1], [len(raw), len(target)]), "bin": np.concatenate([raw, target]), "n": np.concatenate([sums[0][raw], sums[1][target]])})


def ratios(df: DataFrame, text: str, target: Column) -> np.ndarray:
    """Log ratio of the probabilities of each bin, target over raw; counts of all rows, summed bin by bin."""
    rows = df.select(F.col(text).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    found = rows.mapInArrow(_counted, "model long, bin long, n long").groupBy("model", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BINS))
    counts[found.column("model").to_numpy(), found.column("bin").to_numpy()] = found.column("n").to_numpy()
    raw, target = counts
    share = (raw + 0.5) / (raw.sum() + 0.5 * BINS)
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR) / share)


def weight(df: DataFrame, text: str, table: np.ndarray) -> Column:
    """``struct<weight, grams>``: log importance of a text, the sum of the ratios of its n-grams; 0 and 0 without words."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<weight:double,grams:long>")
    def importance(texts: pa.Array) -> pa.Array:
        weights, grams = [], []
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
            own, rows = bins(part.column(0))
            weights.append(np.bincount(rows, shared.value[own], minlength=part.num_rows))
            grams.append(np.bincount(rows, minlength=part.num_rows))
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (weights, grams)]
        return pa.StructArray.from_arrays([pa.array(flat[0], pa.float64()), pa.array(flat[1], pa.int64())], names=["weight", "grams"])

    return importance(F.col(text))


def resampled(df: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text", fraction: float = 0.5, seed: int = 0, most_targets: int = 20_000) -> DataFrame:
    """``key, log_weight, n_grams, gumbel_key, rank, kept`` for every row: the share ``fraction`` with the greatest keys is kept.

    The key is the log importance plus Gumbel noise drawn from the row's own key and text, so a run can be repeated; top-k
    of such keys is sampling without replacement in proportion to importance. The raw model counts every row. The target
    model counts the rows of at most ``most_targets`` ids of ``target_ids`` (those with the smallest hashes: a bounded sample
    of labelled rows). Null and empty texts weigh 0; null keys are no targets; equal keys are ranked in any order.
    """
    few = target_ids.select(F.col(key).alias("__id")).where(F.col("__id").isNotNull()).distinct().orderBy(F.xxhash64("__id"), "__id").limit(most_targets)
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    marked = rows.join(F.broadcast(few), F.col("__key") == F.col("__id"), "left")  # at most most_targets ids
    table = ratios(marked, "__text", F.col("__id").isNotNull())
    uniform = (F.pmod(F.xxhash64("__key", "__text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = rows.select("__key", weight(rows, "__text", table).alias("w"), (-F.log(-F.log(uniform))).alias("noise"))
    small = scored.select(F.col("__key").alias(key), F.col("w.weight").alias("log_weight"), F.col("w.grams").alias("n_grams"), (F.col("w.weight") + F.col("noise")).alias("gumbel_key"))
    # Written before it is sorted: sorting by range reads its input twice, and the weights cost a pass over all texts.
    ranked = numbered(stored(small, "weights"), [F.col("gumbel_key").desc(), F.col(key).asc_nulls_last()], "rank", total="__n")
    return ranked.withColumn("kept", F.col("rank") < F.round(F.col("__n") * fraction)).drop("__n")
