"""Retention, percentiles and pages by range sums; new turns of a stream by keyed state."""

import random

from pyspark.sql import functions as F

from spanguard.operators import chain, metrics, pool
from spanguard.operators.policy import builtin_policy
from spanguard.operators.scoring import LexiconScorer
from spanguard.plans.queries import QUERIES
from spanguard.streaming import streams


def test_retention_with_budgets_of_any_size(spark):
    rng = random.Random(1)
    log = [(f"k{rng.randrange(400)}", rng.randrange(1, 50), at) for at in range(1500)]
    df = spark.createDataFrame(log, "key string, bytes long, at long").repartition(7)
    for entries, size in [(1, 10**9), (100, 10**9), (10**9, 777), (10**9, 10**12), (50, 900), (10**6, 1)]:
        last = {}
        for key, bytes_, at in log:
            if bytes_ <= size:
                last[key] = (at, bytes_)
        kept, total = set(), 0
        for key, (at, bytes_) in sorted(last.items(), key=lambda x: (-x[1][0], x[0])):
            if len(kept) == entries or total + bytes_ > size:
                break
            kept.add(key)
            total += bytes_
        assert {r.key for r in chain.retained(df, entries, size).collect()} == kept


def test_percentiles_are_nearest_ranks(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 19, 20, 21, 500):
        values = [rng.choice([None, *range(30)]) for _ in range(n)]
        known = sorted(v for v in values if v is not None)
        row = metrics.percentiles(spark.createDataFrame([(v,) for v in values], "v long"), "v", {"a": "0.5", "b": "0.95", "c": "1", "d": "0"}).first()
        rank = lambda p: known[max(1, -(-len(known) * p // 100)) - 1] if known else 0
        assert (row.a, row.b, row.c, row.d) == (rank(50), rank(95), rank(100), rank(0))


def test_pages_by_rank(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", rng.randrange(1, 6), rng.randrange(2), rng.randrange(2), rng.randrange(50)) for i in range(700)]
    summary = spark.createDataFrame(rows, "original_text string, occurrences long, released long, redacted long, last_seen long").repartition(5)
    order = [r.original_text for r in pool.review_order(summary).collect()]
    pages = pool.Pages(summary)
    assert pages.total == 700
    for limit, offset in [(40, 0), (500, 300), (500, 650), (7, 699), (10, 700), (None, None), (0, -3)]:
        first = max(offset or 0, 0)
        got = pages.page(limit, offset).collect()
        assert [r.original_text for r in got] == order[first : first + (50 if limit is None else max(limit, 1))]
        assert [r.place for r in got] == list(range(first, first + len(got)))


def requests(spark, *rows):
    turns = [(r, c, at, [(("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]) for r, c, at, texts in rows]
    return spark.createDataFrame(turns, "request_id string, conv_id string, created_at long, turns array<struct<role:string,text:string>>")


def test_new_turns_are_remembered_by_the_stream_alone(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    scorer = LexiconScorer((("zebra", "private_person", 0.95),))

    def drained():
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        done = streams.stream_new_turns(stream, "root", builtin_policy(), scorer)
        query = done.select("conv_id", "turn", "text", "redacted_text").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = sorted(((r.conv_id, r.turn, r.redacted_text) for r in spark.read.parquet(out).collect()), key=str)
        kept = max([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]], default=0)
        return rows, kept

    start = ["a zebra", "yes", None]
    requests(spark, ("r1", "c", 10_000, start[:1]), ("r2", "c", 11_000, start), ("r3", "d", 11_000, start[:1]), (None, None, 11_000, ["x"])).write.parquet(source)
    first = [("c", 0, "a <redacted_private_person>"), ("c", 2, None), ("d", 0, "a <redacted_private_person>"), (None, 0, "x")]
    rows, kept = drained()
    # Turns of the model are remembered too; the text of each is not.
    assert rows == sorted(first, key=str) and kept == 5
    # A restart goes on from the checkpoint: history sent again gives nothing, an edit starts a branch.
    more = requests(spark, ("r4", "c", 12_000, [*start, "ok", "new"]), ("r5", "c", 12_000, ["a zebra!", "yes", None]), ("r6", "d", 13_000, start[:1]))
    more.write.mode("append").parquet(source)
    rows, kept = drained()
    assert rows == sorted([*first, ("c", 4, "new"), ("c", 0, "a <redacted_private_person>!"), ("c", 2, None)], key=str) and kept == 10
    assert drained()[0] == rows


def test_old_turns_are_forgotten(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    sizes = []
    for at in (10_000, 20_000, 9_000_000_000, 9_000_001_000):
        requests(spark, (f"r{at}", "c", at, [f"text {at}"])).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = streams.new_turns(streams.sent_turns(stream, "root"), "1 hour").writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    assert sizes[1] == 2 and sizes[-1] <= 2


def test_table_streams_read_folders_and_files(spark, tmp_path):
    """a table that is a folder of parts is read like one file; the tables beside it are not."""
    texts = spark.createDataFrame([(i, f"mail a{i}@example.org") for i in range(6)], "doc_id bigint, text string")
    folder, file = tmp_path / "folder", tmp_path / "file"
    texts.repartition(3).write.parquet(str(folder / "documents.parquet"))
    texts.where("doc_id < 0").write.parquet(str(folder / "documents_other.parquet"))
    file.mkdir()
    texts.toPandas().to_parquet(file / "documents.parquet")
    for place in (folder, file):
        rows = QUERIES["stream_redact"](spark, str(place)).collect()
        assert sorted(r.doc_id for r in rows) == list(range(6)) and all(r.redacted == 1 for r in rows)
