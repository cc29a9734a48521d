"""Scorers: anything that proposes hits with a probability.  A scorer adds an ``array<HIT>`` column to its input.

Hits travel with their text in one row, so a result can never be assigned to another text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanguard.functions.content import scoring_text
from spanguard.functions.frames import exploded
from spanguard.functions.occurrences import byte_offsets
from spanguard.functions.offsets import candidates, cut, literal_ranges
from spanguard.functions.sqlx import each, empty, fold, islands, let, lit, prefix_sums, struct
from spanguard.operators.recognize import hit
from spanguard.schemas import HIT


class Scorer(Protocol):
    #: Fingerprint of whatever decides the result; part of every turn hash.
    identity: str

    def with_hits(self, df: DataFrame, text: str, output: str) -> DataFrame: ...

    def with_nested_hits(self, df: DataFrame, texts: str, output: str) -> DataFrame:
        """The same for a column of ``array<string>``; output is ``array<array<HIT>>``."""
        ...


@dataclass(frozen=True)
class LexiconScorer:
    """Every occurrence of fixed needles: entries are (needle, category, score)."""

    entries: tuple[tuple[str, str, float], ...]
    identity: str = "lexicon"

    def hits_sql(self, text: str) -> str:
        parts = []
        for needle, group, score in self.entries:
            word = lit(needle)
            parts.append(
                each(
                    literal_ranges(text, word),
                    lambda r: struct(
                        entity_group=lit(group), score=lit(float(score)), start=f"{r}.start", end=f"{r}.end", word=word
                    ),
                )
            )
        return f"concat({', '.join(parts)})" if parts else empty(HIT)

    def with_hits(self, df: DataFrame, text: str, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(_on_scoring_text(f"`{text}`", self.hits_sql)))

    def with_nested_hits(self, df: DataFrame, texts: str, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(each(f"`{texts}`", lambda t: _on_scoring_text(t, self.hits_sql))))


@dataclass(frozen=True)
class PatternScorer:
    """Every match of fixed patterns: entries are (category, score, pattern)."""

    entries: tuple[tuple[str, float, str], ...]
    identity: str = "patterns"

    def hits_sql(self, text: str) -> str:
        parts = [each(candidates(text, p), lambda c: hit(group, c, score)) for group, score, p in self.entries]
        return f"concat({', '.join(parts)})" if parts else empty(HIT)

    def with_hits(self, df: DataFrame, text: str, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(_on_scoring_text(f"`{text}`", self.hits_sql)))

    def with_nested_hits(self, df: DataFrame, texts: str, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(each(f"`{texts}`", lambda t: _on_scoring_text(t, self.hits_sql))))


def _on_scoring_text(text: str, hits_sql) -> str:
    return let(scoring_text(text), hits_sql)


#: What a loaded model does: a list of texts in, one list of (category, score, start, end) per text out.
BatchModel = Callable[[list[str]], Sequence[Sequence[tuple[str, float, int, int]]]]


@dataclass(frozen=True)
class ModelScorer:
    """A model loaded once per task and called on Arrow batches of texts.

    ``load`` returns the batch function.  Every text is scored with images blanked; a batch whose result has another
    length than its input, or a hit that is not a slice of its text, fails the task instead of shifting results.

    With ``limit`` a text that costs more is scored in overlapping windows that cost no more each; their hits are moved
    to the whole text, and overlapping ones of one category become one with the best score.  ``cost`` prices a text (its
    number of characters if not given).
    """

    load: Callable[[], BatchModel]
    identity: str
    limit: int | None = None
    cost: Callable[[str], int] = len

    def with_hits(self, df: DataFrame, text: str, output: str) -> DataFrame:
        load, limit, cost = self.load, self.limit, self.cost

        @F.pandas_udf(f"array<{HIT}>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(_scored(model, texts.tolist(), limit, cost), index=texts.index, dtype=object)

        ready = df.withColumn(f"{output}__text", F.expr(scoring_text(f"`{text}`")))
        return ready.withColumn(output, score(F.col(f"{output}__text"))).drop(f"{output}__text")

    def with_nested_hits(self, df: DataFrame, texts: str, output: str) -> DataFrame:
        load, limit, cost = self.load, self.limit, self.cost

        @F.pandas_udf(f"array<array<{HIT}>>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for lists in batches:
                flat = iter(_scored(model, [t for texts in lists for t in texts], limit, cost))
                yield pd.Series([[next(flat) for _ in texts] for texts in lists], index=lists.index, dtype=object)

        ready = df.withColumn(f"{output}__text", F.expr(each(f"`{texts}`", scoring_text)))
        return ready.withColumn(output, score(F.col(f"{output}__text"))).drop(f"{output}__text")


def _scored(model: BatchModel, texts: list[str], limit: int | None, cost: Callable[[str], int]) -> list[list[tuple]]:
    cuts = [[(0, t, 0)] if limit is None or not t else list(window_cuts(t, limit, cost)) for t in texts]
    chunks = [chunk for windows_of in cuts for _, chunk, _ in windows_of]
    results = model(chunks) if chunks else []
    if len(results) != len(chunks):
        raise ValueError(f"scorer returned {len(results)} results for {len(chunks)} texts")
    checked = iter([_checked(t, r) for t, r in zip(chunks, results)])
    out = []
    for text, windows_of in zip(texts, cuts):
        local = [(next(checked), offset) for _, _, offset in windows_of]
        if len(local) == 1:
            out.append(local[0][0])
        else:
            out.append(_joined(text, [(g, v, s + offset, e + offset) for hits, offset in local for g, v, s, e, _ in hits]))
    return out


def _joined(text: str, hits: list[tuple[str, float, int, int]]) -> list[tuple]:
    """Overlapping hits of one category as one with the best score; touching hits stay apart."""
    raw, runs = text.encode(), []
    for group, value, start, end in sorted(hits, key=lambda h: (h[0], h[2], h[3])):
        if runs and runs[-1][0] == group and start < runs[-1][3]:
            runs[-1][1], runs[-1][3] = max(runs[-1][1], value), max(runs[-1][3], end)
        else:
            runs.append([group, value, start, end])
    return [(g, v, s, e, raw[s:e].decode()) for g, v, s, e in sorted(runs, key=lambda r: (r[2], r[3], r[0]))]


def _checked(text: str, hits: Sequence[tuple[str, float, int, int]]) -> list[tuple]:
    raw, checked = text.encode(), []
    for group, value, start, end in hits:
        if not (0 <= start <= end <= len(raw)) or not math.isfinite(value):
            raise ValueError("scorer returned an offset outside its text or a score that is no number")
        checked.append((group, float(value), start, end, raw[start:end].decode()))
    return checked


# ---------------------------------------------------------------------------------------------------------------
# Texts too long for the scorer
# ---------------------------------------------------------------------------------------------------------------


def window_budget(characters: str, limit: int, actual: str) -> str:
    """SQL: characters per window for a text of ``characters`` that costs ``actual`` where ``limit`` is allowed."""
    floor = f"cast(floor(cast({characters} as double) * {limit} / greatest({actual}, 1) * 0.9D) as int)"
    return f"least(greatest({floor}, 1), greatest({characters}, 1))"


def windows(df: DataFrame, limit: int, text: str = "text", cost: Callable[[str], str] | None = None) -> DataFrame:
    """Half-overlapping windows of every text that costs more than ``limit``; other texts are one window.

    ``cost`` gives SQL for the cost of a text and defaults to its number of characters; windows of one text have the
    same number of characters, which is right where cost is even.  See :func:`adaptive_windows` for uneven cost.
    """
    price = (cost or (lambda t: f"char_length({t})"))(f"`{text}`")

    def starts(c: str) -> str:
        """The text is cut once into pieces of one step; a window is two or three neighbouring pieces."""
        step = f"greatest({c}.budget div 2, 1)"
        last = f"if({c}.characters <= {c}.budget, 0, cast(ceil(({c}.characters - {c}.budget) / {step}) as int))"

        def listed(pieces: str, offsets: str) -> str:
            near = ", ".join(f"coalesce(get({pieces}, {{k}} + {i}), '')" for i in range(3))
            return each(
                f"sequence(0, {last})",
                lambda k: struct(
                    window=k,
                    char_start=f"{k} * {step}",
                    chunk=f"if({last} = 0, {c}.text, substring(concat({near.format(k=k)}), 1, {c}.budget))",
                    byte_start=f"coalesce(get({offsets}, {k}), 0)",
                ),
            )

        return let(
            f"regexp_extract_all({c}.text, concat('(?s).{{1,', {step}, '}}'), 0)",
            lambda pieces: let(
                prefix_sums(each(pieces, lambda p: f"octet_length({p})")), lambda offsets: listed(pieces, offsets)
            ),
        )

    characters = f"char_length(`{text}`)"
    budget = f"if({price} <= {limit}, greatest({characters}, 1), {window_budget(characters, limit, price)})"
    kept = [c for c in df.columns if c != text]
    cuts = F.expr(let(struct(text=f"`{text}`", characters=characters, budget=budget), starts))
    return exploded(df, kept, cuts, "w").select(*kept, "w.*")


def adaptive_windows(df: DataFrame, limit: int, cost: Callable[[str], int], text: str = "text") -> DataFrame:
    """Windows for uneven cost: even ones first; one that is still too dear is split where it is, and only there."""

    def cut_texts(batches: Iterable):
        for batch in batches:
            rows = [
                (*row[:-1], k, first, chunk, offset)
                for row in batch.itertuples(index=False, name=None)
                for k, (first, chunk, offset) in enumerate(window_cuts(row[-1], limit, cost))
            ]
            yield pd.DataFrame(rows, columns=[*batch.columns[:-1], "window", "char_start", "chunk", "byte_start"])

    kept = [c for c in df.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]
    schema = ", ".join([*fields, "window int", "char_start int", "chunk string", "byte_start int"])
    return df.select(*kept, text).mapInPandas(cut_texts, schema)


def window_table(limit: int, cost: Callable[[str], int]):
    """The windows of :func:`window_cuts` as a table function of a text: ``window, char_start, chunk, byte_start``.

    For lateral joins: ``df.lateralJoin(window_table(500, len)(F.col("text").outer()))``. A null text has no windows.
    """

    class Windows:
        def eval(self, text: str):
            for k, (first, chunk, offset) in enumerate(window_cuts(text, limit, cost) if text is not None else ()):
                yield k, first, chunk, offset

    return F.udtf(Windows, returnType="window int, char_start int, chunk string, byte_start int")


def window_cuts(text: str, limit: int, cost: Callable[[str], int]) -> Iterator[tuple[int, str, int]]:
    """Windows of a text as (first character, window, first byte), none of which costs more than ``limit``.

    Even, half-overlapping windows of the size that fits an even cost; each that is too dear is split into two that share
    a third of it, and so on.  A text shorter than half of every window it meets lies whole in one of them.
    """
    price = cost(text)
    if price <= limit:
        yield 0, text, 0
        return
    offsets = byte_offsets(text)
    size = max(1, 9 * limit * len(text) // (10 * price))
    step = max(1, size // 2)
    count = 1 + max(0, -(-(len(text) - size) // step))
    pending = [(k * step, min(len(text), k * step + size)) for k in reversed(range(count))]
    while pending:
        low, high = pending.pop()
        chunk = text[low:high]
        if (price := cost(chunk)) <= limit:
            yield low, chunk, int(offsets[low])
        elif high - low == 1:
            raise ValueError(f"one character costs {price}, more than the limit of {limit}")
        else:
            third = max(1, (high - low) // 3)
            pending += [(low + third, high), (low, high - third)]


def rebase(hits: DataFrame, chunk: str = "chunk", offset: str = "byte_start") -> DataFrame:
    """Window-local hits to whole-text offsets; a hit that is no slice of its window fails the job."""
    bad = F.expr(
        f"`start` >= `end` or `start` < 0 or `end` > octet_length(`{chunk}`)"
        f" or {cut(f'cast(`{chunk}` as binary)', '`start`', '`end`')} <> `word`"
    )
    checked = F.when(bad, F.raise_error(F.lit("hit outside its window")).cast("int")).otherwise(F.col("start"))
    return hits.withColumn("start", checked + F.col(offset)).withColumn("end", F.col("end") + F.col(offset))


def reconciled(raw: str, hits: str) -> str:
    """SQL array form of :func:`spanguard.operators.merge.reconcile` for hits that are already in one row."""
    keyed = "struct<key:string,start:int,end:int,score:double>"
    listed = each(hits, lambda h: struct(key=f"{h}.entity_group", start=f"{h}.start", end=f"{h}.end", score=f"{h}.score"))

    def union(run: str) -> str:
        return let(
            struct(start=f"{run}[0].start", end=f"array_max({each(run, lambda x: f'{x}.end')})"),
            lambda r: struct(
                start=f"{r}.start",
                end=f"{r}.end",
                entity_group=f"{run}[0].key",
                score=fold(run, "cast(-1 as double)", lambda a, x: f"greatest({a}, {x}.score)"),
                word=cut(raw, f"{r}.start", f"{r}.end"),
            ),
        )

    merged = f"array_sort({each(islands(f'array_sort({listed})', keyed, key='key'), union)})"
    return each(
        merged,
        lambda m: struct(
            entity_group=f"{m}.entity_group", score=f"{m}.score", start=f"{m}.start", end=f"{m}.end", word=f"{m}.word"
        ),
    )


def hits_column(df: DataFrame, scorer: Scorer | None, text: str, output: str) -> DataFrame:
    if scorer is None:
        return df.withColumn(output, F.expr(empty(HIT)))
    return scorer.with_hits(df, text, output)

