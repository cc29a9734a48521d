"""A policy whose rules on single texts are a table of any number.

Rules that are one exact keyword, as people's decisions are, stay a table: they are cut into shards of bounded memory, and each
shard is shipped and applied to the texts in a narrow pass of its own. A shard holds hashes and digests in place of texts:
registered texts are found by hashes of their beginnings, the rule on a word is looked up by its digest. Of a table of many shards only
those rules are cut whose text can stand in the texts at hand: a few bits for each rule go over the texts once, and the windows that were
met come back to the rules. All other rules are compiled. The answer is that of :class:`spanguard.operators.policy.Policy` over the same rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions.frames import apart, exploded, written
from spanguard.functions.nests import flat, nested as nested_like
from spanguard.functions.phrases import Keys, Phrases, Sieve, Texts, end_windows, places_in
from spanguard.functions.ranges import Ordered
from spanguard.functions.worker import latest
from spanguard.operators.policy import Policy, PolicyError, keyword_rules, load_policy, rule_violations
from spanguard.schemas import ACTIONS, HIT, RULE_SCHEMA, SOURCES
from spanguard.session import smaller_batches

#: Bytes of one shard as it is shipped; counted before and checked after it is made.
SHARD_BYTES = 64 << 20
#: What a rule takes beside its id: digests, hashes, numbers.
_RULE_BYTES = 128
#: Shards that one pass holds at one time: texts are hashed once for all of them. Behind a pass what was found is written before the
#: next one begins.
PASSES = 4
#: Bytes of texts that are hashed at once.
_CHARACTERS = 1 << 20
#: Texts in one Arrow batch: a text may hold thousands of hits, and several Python steps each hold a batch.
BATCH = 500
#: Rules whose bits go over the texts at one time.
SIFTED = 1 << 25
#: Different windows of texts that go back to the rules at most; beyond, the table is cut whole.
MET = 1 << 24

#: Conditions that are one exact keyword, as Spark and Python write them: what stands before and behind its text.
_SHAPES = tuple(
    (f'{{"kind":{gap}"filter",{gap}"filter":{gap}{{"kind":{gap}"keyword",{gap}"pattern":{gap}{{"text":{gap}"', f'",{gap}"kind":{gap}"exact",{gap}"case_sensitive":{gap}{case}}}}}}}', case == "true")
    for gap in ("", " ")
    for case in ("false", "true")
)

RULED = "struct<registered:boolean,rank:int,id:string,action:string>"
_FOUND = "struct<rank:bigint,entity_group:string,score:double,start:int,end:int,word:string>"


class _Shard:
    """The rules of one shard: what is found in texts, and what is known of words."""

    def __init__(self, registered: pa.Table, known: pa.Table):
        self.rank = registered["place"].to_numpy().astype(np.int64)
        groups, self.group = np.unique(np.array(registered["category"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        self.groups = groups.tolist()
        self.phrases = Phrases(registered["keyword"].to_pylist(), registered["case_sensitive"].to_numpy())
        self.keys = Keys(known["key"].to_pylist(), known["case_sensitive"].to_numpy())
        self.registered = known["registered"].to_numpy(zero_copy_only=False)
        self.priority = known["rank"].fill_null(0).to_numpy()  # rank: the priority below zero, so that the least comes first
        self.redacts = np.array([a == "redact" for a in known["action"].to_pylist()], bool)
        self.ids = known["id"].combine_chunks().cast(pa.large_string())

    def halves(self) -> tuple[_Shard, _Shard]:
        """What is searched for, and what is known of words: no Python process needs both."""
        hunted, known = copy(self), copy(self)
        del hunted.keys, hunted.registered, hunted.priority, hunted.redacts, hunted.ids
        del known.rank, known.groups, known.group, known.phrases
        return hunted, known

    def nbytes(self) -> int:
        return self.phrases.nbytes() + self.ids.nbytes + 45 * len(self.priority) + 16 * len(self.rank)

    def ruled(self, distinct: list[tuple[str, str]]) -> dict[tuple[str, str], dict]:
        """What is known of words, each with its small form: whether it is registered, and the first rule on it."""
        as_is, low = self.keys.find([w for w, _ in distinct], True), self.keys.find([w for _, w in distinct], False)
        known: dict[tuple, dict | None] = {}
        for pair, numbers in zip(distinct, zip(as_is.tolist(), low.tolist())):
            numbers = [n for n in numbers if n >= 0]
            rules = [(int(self.priority[n]), self.ids[n].as_py(), "redact" if self.redacts[n] else "release") for n in numbers if self.ids[n].is_valid]
            best = min(rules, default=(None, None, None))
            registered = any(bool(self.registered[n]) for n in numbers)
            if numbers:
                known[pair] = {"registered": registered, "rank": best[0], "id": best[1], "action": best[2]}
        return known


def hits_of(shards: list[_Shard], texts: pa.Array, remembered: list[dict], ranked: bool = True) -> pa.Array:
    """Per text the registered texts of some shards in it, by rank, then place; offsets in bytes. Null texts have no answer."""
    kind = _HITS if ranked else _BARE
    read = Texts(texts)
    found = places_in([s.phrases for s in shards], read, remembered)
    at, sizes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    rank = np.concatenate([s.rank[f[2]] for s, f in zip(shards, found)])
    names, firsts = [g for s in shards for g in s.groups], np.cumsum([0, *(len(s.groups) for s in shards)])
    group = np.concatenate([s.group[f[2]] + first for s, f, first in zip(shards, found, firsts)])
    rows = np.searchsorted(read.begins, at, side="right") - 1
    # Every rank is found place by place, so a stable order by text and rank is one by place too.
    order = np.argsort(rows * (rank.max(initial=0) + 1) + rank, kind="stable")
    rows, at, sizes, rank, group = rows[order], at[order], sizes[order], rank[order], group[order]
    start, after = (read.before[x] - read.byte_begins[rows] for x in (at, at + sizes))
    named = pa.array(names, pa.string()).take(pa.array(group))
    columns = [named, pa.array(np.ones(len(order))), pa.array(start.astype(np.int32)), pa.array(after.astype(np.int32)), read.words(at, sizes).cast(pa.string())]
    values = pa.StructArray.from_arrays([pa.array(rank), *columns] if ranked else columns, fields=list(kind.value_type))
    ends = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=texts.is_null()).cast(kind)


_HITS = pa.list_(pa.struct([("rank", pa.int64()), ("entity_group", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))
_BARE = pa.list_(pa.struct(list(_HITS.value_type)[1:]))
_RULED = pa.struct([("registered", pa.bool_()), ("rank", pa.int32()), ("id", pa.string()), ("action", pa.string())])


def _pieces(values: pa.Array) -> Iterator[pa.Array]:
    """The texts of an array in slices of about ``_CHARACTERS`` bytes, so that hashing one takes little memory."""
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(values):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _CHARACTERS, side="right")))
        yield values.slice(low, high - low)
        low = high


def _search(shards: list, nested: bool, ranked: bool):
    kind, empty = (_FOUND, _HITS) if ranked else (HIT, _BARE)
    version = uuid.uuid4().hex

    @F.arrow_udf(f"array<array<{kind}>>" if nested else f"array<{kind}>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = [s.value for s in shards]
        remembered = latest("registered windows", version, lambda: [{} for _ in shards])
        for texts in batches:
            values, levels = flat(texts)
            yield nested_like(pa.concat_arrays([pa.array([], empty), *(hits_of(tables, piece, remembered, ranked) for piece in _pieces(values))]), levels)

    return search


def _look_up(shards: list, nested: bool):
    @F.arrow_udf(f"array<array<{RULED}>>" if nested else f"array<{RULED}>")
    def look_up(words: pa.Array, lowered: pa.Array) -> pa.Array:
        values, levels = flat(words)
        coded = values.dictionary_encode()
        codes = coded.indices.fill_null(-1).to_numpy()
        first = np.zeros(len(coded.dictionary), np.int64)
        first[codes[codes >= 0][::-1]] = np.flatnonzero(codes >= 0)[::-1]
        pairs = list(zip(coded.dictionary.to_pylist(), flat(lowered)[0].take(pa.array(first)).to_pylist()))
        known: dict[tuple, dict] = {}
        for shard in shards:  # a word and its small form lie in one shard
            known |= shard.value.ruled(pairs)
        values = pa.array([known.get(pair) for pair in pairs], _RULED)
        return nested_like(values.take(coded.indices), levels)

    return look_up


def _windows(last: bool):
    """Per batch of rules the first (or last) windows of their texts, each twice at most in a task."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes: set[int] = set()

        def out():
            probes = np.concatenate(Sieve.probes(np.unique(np.concatenate(held))) if held else [np.zeros(0, np.uint64)])
            return pa.RecordBatch.from_arrays([pa.array(probes.view(np.int64)), pa.nulls(len(probes), pa.int32())], ["probe", "size"])

        for batch in batches:
            size, hashes = end_windows(batch.column(0), last)
            sizes |= set(np.unique(size[size > 0]).tolist())
            held.append(np.unique(hashes[size > 0]))
            if sum(map(len, held)) > 1 << 20:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > 1 << 19:
                    yield out()
                    held = []
        yield out()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(sorted(sizes), pa.int32())], ["probe", "size"])

    return windows


class RuleTable:
    """A policy over a table of rules (the columns of ``schemas.RULE_SCHEMA``) without a limit on rules about single texts.

    Only rules with larger conditions are compiled and limited as in ``load_policy``. A broken rule is an error. The table is
    read once, when this is made; make a new one when rules change.
    """

    def __init__(self, rules: DataFrame, fallback: str = "release", shard_bytes: int | None = None):
        self.limit, self.fallback = shard_bytes or SHARD_BYTES, fallback
        # A rule as nearly all are, one exact keyword written without escapes, is known by its shape; no condition is kept of it.
        text, case, condition = F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.col("condition_json")
        for before, behind, sensitive in _SHAPES:
            fits = condition.startswith(before) & condition.endswith(behind)
            text = F.when(fits, F.substring(condition, F.lit(len(before) + 1), F.length(condition) - len(before + behind))).otherwise(text)
            case = F.when(fits, F.lit(sensitive)).otherwise(case)
        shaped = rules.select(*RULE_SCHEMA.fieldNames(), text.alias("_text"), case.alias("_case"))
        sound = F.col("id").rlike("[0-9A-Za-z]") & F.col("_text").rlike(r"[\p{L}\p{N}]") & ~F.col("_text").rlike(r'["\\\x00-\x1f]') & F.col("action").isin(*ACTIONS) & F.col("source").isin(*SOURCES)
        sound = F.coalesce(sound & ((F.col("source") != "approval") | F.col("category").isNotNull()), F.lit(False))
        shaped = shaped.withColumn("sound", sound)
        kept = {c: F.when(~F.col("sound"), F.col(c)).alias(c) for c in ("condition_json", "name")}
        rules = written(  # what they are made from is read once
            shaped.select(
                *[kept.get(c, F.col(c)) for c in RULE_SCHEMA.fieldNames()],
                "sound",
                F.when(F.col("sound"), F.col("_text")).alias("keyword"),
                F.when(F.col("sound"), F.col("_case")).alias("case_sensitive"),
            ),
            "rules",
        )
        other = rules.where("not sound").drop("sound", "keyword", "case_sensitive")
        # A minimum, not the first row: all parts are checked at once.
        if broken := rule_violations(other).agg(F.min(F.struct("id", "violation")).alias("first")).first().first:
            raise PolicyError(f"rule {broken.id!r}: {broken.violation}")
        is_single = F.coalesce(F.get_json_object("condition_json", "$.filter.pattern.kind") == "exact", F.lit(False))
        self.compiled: Policy = load_policy(other.where(~is_single), fallback)
        columns = ["id", "priority", "action", "enabled", "source", "category", "keyword", "case_sensitive", "single"]
        worded = written(keyword_rules(other, nested=True).withColumn("single", is_single).select(*columns), "rules-worded")
        self.worded = rules.where("sound").withColumn("single", F.lit(True)).select(*columns).unionByName(worded)

    @cached_property
    def size(self) -> int:
        """Bytes that the rules on single texts take, about."""
        return self.worded.agg(F.sum(F.octet_length("id") + _RULE_BYTES)).first()[0] or 0

    @property
    def count(self) -> int:
        return -(-2 * self.size // self.limit) if self.size > self.limit else 1

    @cached_property
    def shards(self) -> list:
        spark, shards = self.worded.sparkSession, self.count
        worded = self.worded.withColumn("key", F.when(F.col("case_sensitive"), F.col("keyword")).otherwise(F.lower("keyword")))
        shard = F.pmod(F.xxhash64(F.lower("keyword")), F.lit(shards)).alias("shard")
        approved = F.col("source") == "approval"
        first = F.min(F.when(F.col("enabled") & F.col("single"), F.struct((-F.col("priority")).alias("rank"), "id", "action")))
        known = worded.groupBy(shard, "case_sensitive", "key").agg(first.alias("first"), F.max(approved).alias("registered"))
        known = known.select("shard", "case_sensitive", "key", "registered", "first.rank", "first.id", "first.action")
        hunted = worded.where(F.col("enabled") & approved & F.col("category").isNotNull() & (F.col("keyword") != ""))
        hunted = hunted.select(shard, "id", "priority", "keyword", "case_sensitive", "category")
        placed = Ordered(hunted, [F.desc("priority"), F.asc("id"), F.asc("keyword")]).placed()
        tables = [written(known, "rules-known", "shard"), written(placed.drop("id", "priority"), "rules-registered", "shard")]
        out = []
        for number in range(shards):
            found, words = (t.where(F.col("shard") == number).toArrow() for t in (tables[1], tables[0]))
            made = _Shard(found, words)
            if made.nbytes() > 2 * self.limit + (1 << 20):  # hashes of beginnings have a least size
                raise PolicyError(f"a shard of rules takes {made.nbytes()} bytes; about {self.limit} were planned")
            out.append(tuple(map(spark.sparkContext.broadcast, made.halves())))
        return out

    @property
    def passes(self) -> list[list]:
        return [self.shards[n : n + PASSES] for n in range(0, len(self.shards), PASSES)]

    def narrowed(self, df: DataFrame, text: str, nested: bool = False) -> RuleTable:
        """This table for these texts: where it would take many shards, without the rules whose text stands in none of them.

        It decides parts of the texts as the whole table does. With ``nested`` the column is an array of texts.
        """
        out = self
        texts = exploded(df, [], F.col(text), "text") if nested else df.select(F.col(text).alias("text"))
        for last in (False, True):
            if out.count <= PASSES or df.isStreaming:
                break
            out = out._met(texts, last) or out
        return out

    def _met(self, texts: DataFrame, last: bool) -> RuleTable | None:
        """The rules whose first (or last) characters stand in some text; none if there are too many such windows."""
        spark = texts.sparkSession
        probes = written(self.worded.select("keyword").mapInArrow(_windows(last), "probe long, size int"), "rules-windows")
        told = probes.agg(F.approx_count_distinct("probe").alias("n"), F.collect_set("size").alias("sizes")).first()
        parts = -(-told.n // (2 * SIFTED)) or 1
        met: list[np.ndarray] = []
        for part in range(parts):
            bits = Sieve.bits(told.n // 2 // parts + 1)

            def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                blocks: dict[int, np.ndarray] = {}
                for batch in batches:
                    for number, packed in Sieve.block(batch.column(0).to_numpy().view(np.uint64), bits).items():
                        blocks[number] = blocks.get(number, np.uint8(0)) | np.frombuffer(packed, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

            mine = probes.where(F.col("probe").isNotNull() & (F.pmod(F.xxhash64("probe"), F.lit(parts)) == part) if parts > 1 else F.col("probe").isNotNull()).select("probe")
            dealt = mine.repartition(Sieve.BLOCKS, F.shiftrightunsigned("probe", 58))
            blocks: dict[int, np.ndarray] = {}
            for row in dealt.mapInArrow(made, "block int, bits binary").toArrow().to_pylist():
                blocks[row["block"]] = blocks.get(row["block"], np.uint8(0)) | np.frombuffer(row["bits"], np.uint8)
            sieve = spark.sparkContext.broadcast(Sieve(sorted(told.sizes), bits, {n: b.tobytes() for n, b in blocks.items()}))

            def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = [np.zeros(0, np.uint64)]
                for batch in batches:
                    held += [sieve.value.passing(piece) for piece in _pieces(batch.column(0))]
                    if sum(map(len, held)) > 1 << 21:
                        held = [np.unique(np.concatenate(held))]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["window"])

            found = written(texts.mapInArrow(sift, "window long").distinct(), "windows-met")
            sieve.destroy()
            if found.count() > MET:  # mostly such as fell through by chance
                found = written(found.join(mine.select(F.col("probe").alias("window")).distinct(), "window", "left_semi"), "windows-met")
            if found.count() + sum(map(len, met)) > MET:
                return None
            met.append(found.toArrow()["window"].to_numpy().view(np.uint64))
        windows = spark.sparkContext.broadcast(np.unique(np.concatenate(met)))

        @F.arrow_udf("boolean")
        def stands(keywords: pa.Array) -> pa.Array:
            size, hashes = end_windows(keywords, last)
            place = np.minimum(np.searchsorted(windows.value, hashes), max(0, len(windows.value) - 1))
            return pa.array((windows.value[place] == hashes) & (size > 0) if len(windows.value) else np.zeros(len(hashes), bool))

        out = copy(self)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("size", "shards")}
        out.worded = written(self.worded.withColumn("_stands", stands("keyword")).where("_stands").drop("_stands"), "rules-met")
        return out

    def _passes(self, df: DataFrame, output: str, one) -> DataFrame:
        """A column for every few shards, made by ``one``; behind each what was found is written, to let its shards go."""
        smaller_batches(df.sparkSession, BATCH)
        for number, few in enumerate(self.passes):
            if number:
                df = written(df, "passes")
            df = apart(apart(df).withColumn(f"{output}_{number}", one(few)))
        return df

    def with_registered_hits(self, df: DataFrame, text: str, output: str, nested: bool = False) -> DataFrame:
        """Add ``output``: every occurrence of a registered text, in the order of the rules, then by position.

        With ``nested`` the input column is an array of texts and the output has one hit array for each.
        """
        columns = [f"{output}_{n}" for n in range(len(self.passes))]
        if len(columns) == 1:
            return self._passes(df, output, lambda few: _search([hunted for hunted, _ in few], nested, False)(F.col(text))).withColumnRenamed(columns[0], output)
        found = self._passes(df, output, lambda few: _search([hunted for hunted, _ in few], nested, True)(F.col(text)))
        bare = lambda lists: f"transform(array_sort({lists}), h -> named_struct('entity_group', h.entity_group, 'score', h.score, 'start', h.start, 'end', h.end, 'word', h.word))"
        if nested:
            each = "concat(" + ", ".join(f"z.`{c}`" for c in columns) + ")"
            value = f"cast(transform(arrays_zip({', '.join(columns)}), z -> {bare(each)}) as array<array<{HIT}>>)"
        else:
            value = f"cast({bare('concat(' + ', '.join(columns) + ')')} as array<{HIT}>)"
        # Null texts have no hits, as with a compiled policy.
        return found.withColumn(output, F.expr(value)).drop(*columns)

    def with_ruled(self, df: DataFrame, words: str, output: str, nested: bool = False) -> DataFrame:
        """Add ``output``: for each word of an array column what the table knows of it (``RULED``), null if nothing."""
        columns = [f"{output}_{n}" for n in range(len(self.passes))]
        lower = f"transform({words}, ws -> transform(ws, w -> lower(w)))" if nested else f"transform({words}, w -> lower(w))"
        listed = df.withColumn(f"{output}_w", F.expr(words)).withColumn(f"{output}_l", F.expr(lower))
        found = self._passes(listed, output, lambda few: _look_up([known for _, known in few], nested)(F.col(f"{output}_w"), F.col(f"{output}_l")))
        value = f"`{columns[0]}`"
        for column in columns[1:]:
            pick = lambda a, b: f"zip_with({a}, {b}, (x, y) -> coalesce(x, y))"
            value = f"zip_with({value}, `{column}`, (a, b) -> {pick('a', 'b')})" if nested else pick(value, f"`{column}`")
        return found.withColumn(output, F.expr(value)).drop(*columns, f"{output}_w", f"{output}_l")

    def evaluate(self, spans: DataFrame, group="entity_group", score="score", word="word") -> DataFrame:
        """Add ``action``, ``matched_rule_id`` and ``priority`` to span rows."""
        from spanguard.operators.redact import first_rule

        ruled = self.with_ruled(spans.withColumn("_words", F.array(word)), "_words", "_ruled")
        choice: Column = F.expr(first_rule(self.compiled, f"`{group}`", f"`{score}`", f"`{word}`", "_ruled[0]"))
        return (
            ruled.withColumn("_decision", choice)
            .withColumns({"action": F.col("_decision.action"), "matched_rule_id": F.col("_decision.rule_id"), "priority": F.col("_decision.priority")})
            .drop("_decision", "_words", "_ruled")
        )
