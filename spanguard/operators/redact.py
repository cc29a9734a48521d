"""Deciding spans and replacing them, inside one row per text.

Order of steps: drop invalid hits, trim white space, complete cut tokens (not for registered texts), leave images out,
trim again, decide on the final text; then spread confirmed credentials over the same text, let higher-priority rules
overrule overlapping spans of the other action, merge redacted ranges and put placeholders in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanguard.functions import cover
from spanguard.functions.content import image_ranges
from spanguard.functions.frames import apart, written
from spanguard.functions.nests import flat, nested
from spanguard.functions.occurrences import literal_occurrences
from spanguard.functions.offsets import (
    CREDENTIAL_CLASS,
    TOKEN_CLASS,
    completed,
    cut,
    literal_ranges,
    overlaps,
    replaced,
    subtract,
    trimmed,
    valid_hit,
)
from spanguard.functions.sqlx import (
    each,
    each_indexed,
    empty,
    fresh,
    islands,
    keep,
    let,
    lit,
    prefix_max,
    some,
    struct,
)
from spanguard.operators.policy import Policy
from spanguard.operators.ruletable import RuleTable
from spanguard.schemas import CREDENTIALS, HIT, RANGE, SPAN

_CREDENTIAL_LIST = ", ".join(lit(g) for g in CREDENTIALS)
_PROPOSAL = f"struct<start:int,end:int,ord:int,span:{SPAN}>"
_EDGE = f"struct<start:int,kind:int,end:int,ord:int,span:{SPAN}>"

_NAMED_RANGE = "struct<start:int,end:int,entity_group:string>"


def decided(raw: str, hits: str, images: str, policy: Policy) -> str:
    """SQL array<SPAN> of the valid hits, in their order."""

    def pieces(h: str, r: str) -> str:
        whole = f"if({r}.start < {r}.end, array({r}), {empty(RANGE)})"
        return f"if(size({images}) = 0, {whole}, {subtract(f'{r}.start', f'{r}.end', images)})"

    def grown(h: str, t: str) -> str:
        wide = completed(raw, f"{t}.start", f"{t}.end", CREDENTIAL_CLASS)
        narrow = completed(raw, f"{t}.start", f"{t}.end", TOKEN_CLASS)
        by_group = f"if({h}.entity_group in ({_CREDENTIAL_LIST}), {wide}, {narrow})"
        registered = policy.registered_sql(cut(raw, f"{t}.start", f"{t}.end"))
        return by_group if registered == "false" else f"if({registered}, {t}, {by_group})"

    def judged(h: str, p: str) -> str:
        def with_word(q: str, w: str) -> str:
            return let(
                policy.decision_sql(f"{h}.entity_group", f"{h}.score", w),
                lambda d: struct(
                    entity_group=f"{h}.entity_group",
                    score=f"{h}.score",
                    byte_start=f"{q}.start",
                    byte_end=f"{q}.end",
                    original_text=w,
                    action=f"{d}.action",
                    matched_rule_id=f"{d}.rule_id",
                    priority=f"{d}.priority",
                ),
            )

        return let(
            trimmed(raw, f"{p}.start", f"{p}.end"),
            lambda q: let(cut(raw, f"{q}.start", f"{q}.end"), lambda w: with_word(q, w)),
        )

    def one(h: str) -> str:
        return let(
            trimmed(raw, f"{h}.start", f"{h}.end"),
            lambda t: let(grown(h, t), lambda r: each(pieces(h, r), lambda p: judged(h, p))),
        )

    return f"cast(flatten({each(keep(hits, lambda h: valid_hit(raw, h)), one)}) as array<{SPAN}>)"


# The same in three steps for a policy whose rules on single texts are a table: what it knows of a word is looked up between
# them, first of the trimmed text (a registered one is not completed), then of the final one.

_TRIMMED = f"struct<h:{HIT},t:{RANGE},w:string>"
_PIECE = "struct<entity_group:string,score:double,start:int,end:int,w:string>"


def trimmed_hits(raw: str, hits: str) -> str:
    """SQL array<_TRIMMED>: the valid hits with their trimmed range and its text."""

    def one(h: str) -> str:
        return let(
            trimmed(raw, f"{h}.start", f"{h}.end"),
            lambda t: struct(h=h, t=t, w=cut(raw, f"{t}.start", f"{t}.end")),
        )

    return each(keep(hits, lambda h: valid_hit(raw, h)), one)


def grown_pieces(raw: str, trims: str, ruled: str, images: str) -> str:
    """SQL array<_PIECE>: completed unless registered, without images, trimmed again."""

    def grown(x: str, i: str) -> str:
        wide = completed(raw, f"{x}.t.start", f"{x}.t.end", CREDENTIAL_CLASS)
        narrow = completed(raw, f"{x}.t.start", f"{x}.t.end", TOKEN_CLASS)
        return (
            f"if(coalesce({ruled}[{i}].registered, false), {x}.t,"
            f" if({x}.h.entity_group in ({_CREDENTIAL_LIST}), {wide}, {narrow}))"
        )

    def parts(r: str) -> str:
        whole = f"if({r}.start < {r}.end, array({r}), {empty(RANGE)})"
        return f"if(size({images}) = 0, {whole}, {subtract(f'{r}.start', f'{r}.end', images)})"

    def piece(x: str, p: str) -> str:
        return let(
            trimmed(raw, f"{p}.start", f"{p}.end"),
            lambda q: struct(
                entity_group=f"{x}.h.entity_group",
                score=f"{x}.h.score",
                start=f"{q}.start",
                end=f"{q}.end",
                w=cut(raw, f"{q}.start", f"{q}.end"),
            ),
        )

    return f"flatten({each_indexed(trims, lambda x, i: let(grown(x, i), lambda r: each(parts(r), lambda p: piece(x, p))))})"


def first_rule(compiled: Policy, group: str, score: str, word: str, ruled: str) -> str:
    """SQL struct(action, rule_id, priority): the first of the compiled rules and the one the table has for the word."""

    def chosen(d: str) -> str:
        table = f"({ruled}.id is not null and ({d}.rule_id is null or {ruled}.rank < -{d}.priority or ({ruled}.rank = -{d}.priority and {ruled}.id < {d}.rule_id)))"
        return f"if({table}, {struct(action=f'{ruled}.action', rule_id=f'{ruled}.id', priority=f'-{ruled}.rank')}, {d})"

    return let(compiled.decision_sql(group, score, word), chosen)


def table_decided(compiled: Policy, pieces: str, ruled: str) -> str:
    """SQL array<SPAN>: every piece with the first rule on it."""

    def one(p: str, i: str) -> str:
        return let(
            first_rule(compiled, f"{p}.entity_group", f"{p}.score", f"{p}.w", f"{ruled}[{i}]"),
            lambda d: struct(
                entity_group=f"{p}.entity_group",
                score=f"{p}.score",
                byte_start=f"{p}.start",
                byte_end=f"{p}.end",
                original_text=f"{p}.w",
                action=f"{d}.action",
                matched_rule_id=f"{d}.rule_id",
                priority=f"{d}.priority",
            ),
        )

    return each_indexed(pieces, one)


def _with_decided(steps: _Steps, policy: Policy | RuleTable, sources, hits: str) -> None:
    """Add ``_decided`` to the columns of ``steps``."""
    if isinstance(policy, Policy):
        steps.add(
            "_decided",
            f"array<{SPAN}>",
            lambda raw, hits, images: f"if(size({hits}) = 0, {empty(SPAN)}, {decided(raw, hits, images, policy)})",
            hits=hits,
            **sources("raw", "images"),
        )
        return
    nested = steps.over is not None
    words = lambda column: f"transform({column}, xs -> transform(xs, x -> x.w))" if nested else f"transform({column}, x -> x.w)"
    steps.add("_trims", f"array<{_TRIMMED}>", lambda raw, hits: f"if(size({hits}) = 0, {empty(_TRIMMED)}, {trimmed_hits(raw, hits)})", hits=hits, **sources("raw"))
    steps.df = policy.with_ruled(steps.df, words("_trims"), "_ruled", nested)
    steps.add(
        "_pieces",
        f"array<{_PIECE}>",
        lambda raw, trims, ruled, images: f"if(size({trims}) = 0, {empty(_PIECE)}, {grown_pieces(raw, trims, ruled, images)})",
        trims="_trims",
        ruled="_ruled",
        **sources("raw", "images"),
    )
    if not nested and not steps.df.isStreaming:
        # Every Python step of a plan has a process of its own in each task; of a text five would run at one time.
        steps.df = written(steps.df.drop("_trims", "_ruled", *["_hits"] * (hits == "`_hits`")), "pieces")
    steps.df = policy.with_ruled(steps.df, words("_pieces"), "_ruled", nested)
    steps.add("_decided", f"array<{SPAN}>", lambda pieces, ruled: table_decided(policy.compiled, pieces, ruled), pieces="_pieces", ruled="_ruled")
    steps.df = steps.df.drop("_trims", "_pieces", "_ruled")


def _confirmed(spans: str) -> str:
    """SQL: redacted spans of credential categories, in order."""
    return keep(
        spans,
        lambda s: f"{s}.action = 'redact' and {s}.entity_group in ({_CREDENTIAL_LIST}) and {s}.original_text <> ''",
    )


def _firsts(confirmed: str) -> str:
    """SQL array<struct<ord, v>>: every distinct text with the place of its first span, in that order."""

    def first_only(a: str) -> str:
        x, i = fresh("x"), fresh("i")
        firsts = f"filter({a}, ({x}, {i}) -> {i} = 0 or {x}.v <> {a}[{i} - 1].v)"
        return f"array_sort({each(firsts, lambda f: struct(ord=f'{f}.ord', v=f'{f}.v'))})"

    listed = each_indexed(confirmed, lambda s, i: struct(v=f"{s}.original_text", ord=i))
    return let(f"array_sort({listed})", first_only)


def confirmed_values(spans: str) -> str:
    """SQL array<string>: the distinct texts that are searched for in the rest of the text, by first span."""
    return each(_firsts(_confirmed(spans)), lambda f: f"{f}.v")


def proposed(raw: str, text: str, spans: str, images: str, occurrences: str | None = None) -> str:
    """SQL array<PROPOSAL>: every occurrence of a redacted credential, completed to its whole token, clear of images.

    ``occurrences`` may hold the places of all values found elsewhere (array<array<RANGE>> in the order of
    :func:`confirmed_values`, null where they are to be searched here).
    """

    def places(v: str, i: str) -> str:
        searched = literal_ranges(text, v)
        return searched if occurrences is None else f"if({occurrences} is null, {searched}, {occurrences}[{i}])"

    def found(confirmed: str, firsts: str) -> str:
        per_value = each_indexed(
            firsts,
            lambda f, i: each(
                places(f"{f}.v", i),
                lambda o: let(
                    completed(raw, f"{o}.start", f"{o}.end", CREDENTIAL_CLASS),
                    lambda r: struct(start=f"{r}.start", end=f"{r}.end", span=f"{confirmed}[{f}.ord]"),
                ),
            ),
        )
        clear = keep(f"flatten({per_value})", lambda p: f"not {some(images, lambda image: overlaps(p, image))}")
        return each_indexed(
            clear, lambda x, i: struct(start=f"{x}.start", end=f"{x}.end", ord=i, span=f"{x}.span")
        )

    return let(
        _confirmed(spans),
        lambda c: f"if(size({c}) = 0, {empty(_PROPOSAL)}, {let(_firsts(c), lambda f: found(c, f))})",
    )


def uncovered(spans: str, found: str) -> str:
    """SQL array<PROPOSAL>: proposals that no redacted span holds.

    One sorted pass with the furthest end of the redacted spans that began so far.
    """

    def late(e: str) -> str:
        def beyond(reach: str) -> str:
            edge, index = fresh("x"), fresh("i")
            return f"filter({e}, ({edge}, {index}) -> {edge}.kind = 1 and coalesce({reach}[{index}], -1) < {edge}.end)"

        return let(prefix_max(each(e, lambda x: f"if({x}.kind = 0, {x}.end, -1)")), beyond)

    redacted = each(
        keep(spans, lambda s: f"{s}.action = 'redact'"),
        lambda s: struct(start=f"{s}.byte_start", kind="0", end=f"{s}.byte_end", ord="-1", span=s),
    )
    asked = each(found, lambda p: struct(start=f"{p}.start", kind="1", end=f"{p}.end", ord=f"{p}.ord", span=f"{p}.span"))
    edges = f"array_sort(cast(concat({redacted}, {asked}) as array<{_EDGE}>))"
    rest = each(
        let(edges, late), lambda x: struct(start=f"{x}.start", end=f"{x}.end", ord=f"{x}.ord", span=f"{x}.span")
    )
    return f"if(size({found}) = 0, {empty(_PROPOSAL)}, {rest})"


# The same three and the merged ranges for a policy that may have registered very many texts, whose hits lie close together in long
# runs: spans go to Arrow as numbers, for many rows at once, and come back as indexes.

_HELD = "struct<start:int,end:int,priority:int,ruled:boolean,redacts:boolean>"
_SETTLED = "struct<start:int,end:int,first:int>"


def _numbers(values: pa.Array, *names: str) -> list[np.ndarray]:
    return [values.field(n).to_numpy(zero_copy_only=False).astype(bool if n in ("ruled", "redacts") else np.int64) for n in names]


def _per_row(lengths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of every value, and its place in that row."""
    sizes = lengths.to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]


def _listed(values: pa.Array, rows: np.ndarray, levels: list) -> pa.Array:
    """Values of some rows as lists nested like those that they were made from."""
    lengths, nulls = levels[-1]
    return nested(values, [*levels[:-1], (pa.array(np.bincount(rows, minlength=len(lengths))), nulls)])


def _with_settled(df: DataFrame, array: str) -> DataFrame:
    """Add ``_settled``: the indexes of ``fresh`` proposals that no redacted span and no earlier one of them holds, in order; the indexes
    of spans, with these behind them, that are ``kept``, by position; and the redacted ``ranges`` with the index of their first span.
    """
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int32())])
    names = ("start", "end", "priority", "ruled", "redacts")

    @F.arrow_udf(f"struct<fresh:{array.format('int')},kept:{array.format('int')},ranges:{array.format(_SETTLED)}>")
    def settled(spans: pa.Array, asked: pa.Array) -> pa.Array:
        (values, levels), (wanted, others) = flat(spans), flat(asked)
        own, more = _numbers(values, *names), _numbers(wanted, *names)
        (rows, place), (rows_of, order) = _per_row(levels[-1][0]), _per_row(others[-1][0])
        (start, end), (first, after) = cover.on_one_line([rows, rows_of], [tuple(own[:2]), tuple(more[:2])])
        left = np.flatnonzero(~cover.covered(first, after, start[own[4]], end[own[4]]))
        left = left[~cover.held(first[left], after[left], order[left])]
        fresh = _listed(pa.array(order[left], pa.int32()), rows_of[left], levels)

        behind = _per_row(pa.array(np.bincount(rows_of[left], minlength=len(levels[-1][0]))))[1]
        place = np.concatenate([place, levels[-1][0].to_numpy()[rows_of[left]] + behind])
        rows, start, end = np.concatenate([rows, rows_of[left]]), np.concatenate([start, first[left]]), np.concatenate([end, after[left]])
        begin, stop, priority, ruled, redacts = (np.concatenate([x, y[left]]) for x, y in zip(own, more))
        gone = np.zeros(len(rows), bool)
        gone[ruled] = cover.overruled(start[ruled], end[ruled], priority[ruled], redacts[ruled])
        kept = np.lexsort((place, end, start))
        kept = kept[~gone[kept]]
        cut = kept[redacts[kept]]
        firsts = cover.unions(start[cut], end[cut])
        reach = np.maximum.reduceat(stop[cut], firsts) if len(firsts) else np.zeros(0, np.int64)
        opens = cut[firsts]
        merged = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (begin[opens], reach, place[opens])], fields=list(kind))
        parts = [fresh, _listed(pa.array(place[kept], pa.int32()), rows[kept], levels), _listed(merged, rows[opens], levels)]
        return pa.StructArray.from_arrays(parts, ["fresh", "kept", "ranges"])

    return apart(apart(df).withColumn("_settled", settled(F.col("_held"), F.col("_asked"))))


def _settle(steps: _Steps, sources) -> None:
    """Add ``_spans`` and ``_ranges`` to the columns of ``steps``."""

    def ruling(s: str) -> dict[str, str]:
        return dict(priority=f"{s}.priority", ruled=f"{s}.matched_rule_id is not null", redacts=f"{s}.action = 'redact'")

    steps.add("_held", f"array<{_HELD}>", lambda spans: each(spans, lambda s: struct(start=f"{s}.byte_start", end=f"{s}.byte_end", **ruling(s))), spans="_decided")
    steps.add("_asked", f"array<{_HELD}>", lambda found: each(found, lambda p: struct(start=f"{p}.start", end=f"{p}.end", **ruling(f"{p}.span"))), found="_proposed")
    steps.df = _with_settled(steps.df, "array<{}>" if steps.over is None else "array<array<{}>>")
    steps.add(
        "_added",
        f"array<{SPAN}>",
        lambda raw, found, kept: each(kept, lambda i: let(f"{found}[{i}]", lambda p: _grown_span(raw, p))),
        found="_proposed",
        kept="_settled.fresh",
        **sources("raw"),
    )
    steps.add("_all", f"array<{SPAN}>", lambda first, more: f"concat({first}, {more})", first="_decided", more="_added")
    steps.add("_spans", f"array<{SPAN}>", lambda spans, kept: each(kept, lambda i: f"{spans}[{i}]"), spans="_all", kept="_settled.kept")
    steps.add(
        "_ranges",
        f"array<{_NAMED_RANGE}>",
        lambda spans, ranges: each(ranges, lambda r: struct(start=f"{r}.start", end=f"{r}.end", entity_group=f"{spans}[{r}.first].entity_group")),
        spans="_all",
        ranges="_settled.ranges",
    )


def _grown_span(raw: str, p: str) -> str:
    return struct(
        entity_group=f"{p}.span.entity_group",
        score=f"{p}.span.score",
        byte_start=f"{p}.start",
        byte_end=f"{p}.end",
        original_text=cut(raw, f"{p}.start", f"{p}.end"),
        action=f"{p}.span.action",
        matched_rule_id=f"{p}.span.matched_rule_id",
        priority=f"{p}.span.priority",
    )


def added(raw: str, fresh_ones: str) -> str:
    """SQL array<SPAN>: proposals as spans, in order, without those that an earlier proposal holds.

    Being held is transitive, so comparing with all earlier proposals equals adding them one after the other.
    """

    def first_of_each(run: str) -> str:
        held = keep(
            run,
            lambda p: "not "
            + some(run, lambda q: f"({q}.ord < {p}.ord and {q}.start <= {p}.start and {q}.end >= {p}.end)"),
        )
        return f"if(size({run}) = 1, {run}, {held})"

    kept = f"flatten({each(islands(fresh_ones, _PROPOSAL), first_of_each)})"
    ordered = f"array_sort({each(kept, lambda p: struct(ord=f'{p}.ord', p=p))})"
    spans = each(ordered, lambda o: _grown_span(raw, f"{o}.p"))
    return f"if(size({fresh_ones}) = 0, {empty(SPAN)}, {spans})"


def superseded(spans: str) -> str:
    """Survivors by position: a rule-backed span goes if one of the other action and higher priority overlaps it."""
    placed = each_indexed(spans, lambda s, i: struct(start=f"{s}.byte_start", end=f"{s}.byte_end", ord=i, span=s))

    def settle(run: str) -> str:
        def overruled(x: str) -> str:
            return some(
                run,
                lambda y: f"({y}.span.matched_rule_id is not null and {y}.span.action <> {x}.span.action"
                f" and {y}.span.priority > {x}.span.priority and {overlaps(x, y)})",
            )

        kept = keep(run, lambda x: f"{x}.span.matched_rule_id is null or not {overruled(x)}")
        return f"if(size({run}) = 1, {run}, {kept})"

    runs = islands(f"array_sort(cast({placed} as array<{_PROPOSAL}>))", _PROPOSAL)
    return each(f"flatten({each(runs, settle)})", lambda p: f"{p}.span")


def merged_ranges(spans: str) -> str:
    """Union of overlapping redacted spans (sorted by position); the first span's category names the range."""
    placed = each(
        keep(spans, lambda s: f"{s}.action = 'redact'"),
        lambda s: struct(start=f"{s}.byte_start", end=f"{s}.byte_end", entity_group=f"{s}.entity_group"),
    )
    return each(
        islands(placed, _NAMED_RANGE),
        lambda run: struct(
            start=f"{run}[0].start",
            end=f"array_max({each(run, lambda x: f'{x}.end')})",
            entity_group=f"{run}[0].entity_group",
        ),
    )


def placeholder(group: str) -> str:
    return f"concat('<redacted_', {group}, '>')"


_WORK = ("_raw", "_images", "_decided", "_values", "_places", "_proposed", "_fresh", "_added", "_all", "_held", "_asked", "_settled")


class _Steps:
    """Columns computed one after the other, for a row or for every item of an array in it.

    One step per column: the analyzer resolves nested lambdas one level per pass and gives up after a hundred.  Inputs
    are bound in front of the work, so Catalyst may merge steps but can never pull one into a loop of the next.
    """

    def __init__(self, df: DataFrame, over: str | None = None):
        self.df, self.over = df, over

    def add(self, output: str, kind: str, body, shared: dict[str, str] | None = None, **inputs: str) -> None:
        shared = shared or {}
        if self.over is None:
            work = let(
                struct(**shared, **inputs),
                lambda c: body(**{name: f"{c}.{name}" for name in (*shared, *inputs)}),
            )
        else:
            kind = f"array<{kind}>"
            work = let(
                struct(over_items=self.over, **shared, **inputs),
                lambda c: each_indexed(
                    f"{c}.over_items",
                    lambda _, i: body(
                        **{name: f"{c}.{name}" for name in shared}, **{name: f"{c}.{name}[{i}]" for name in inputs}
                    ),
                ),
            )
        self.df = self.df.withColumn(output, F.expr(f"cast({work} as {kind})"))


def judged(df: DataFrame, policy: Policy | RuleTable, text: str, hits: str, per: str = "row") -> DataFrame:
    """Add ``_spans``, ``_ranges`` and ``_redacted``.

    ``per`` says what is judged: a ``row`` (a text with its hits), every one of the ``texts`` in an array column with its
    own hits, or every one of the ``hits`` arrays of one text on its own.  The last two give arrays.
    """
    steps = _Steps(df, None if per == "row" else hits)
    raw = each(text, lambda t: f"cast({t} as binary)") if per == "texts" else f"cast({text} as binary)"
    own = {"raw": raw, "text": text, "images": "_images"}
    base: dict[str, str] = {}
    if per == "hits":
        base, own = own, {}

    def sources(*names: str) -> dict:
        return {
            **{n: v for n, v in own.items() if n in names},
            "shared": {n: v for n, v in base.items() if n in names},
        }

    if per == "hits":
        steps.df = steps.df.withColumn("_images", F.expr(image_ranges(text)))
    else:
        steps.add("_images", f"array<{RANGE}>", lambda text: image_ranges(text), **sources("text"))
    _with_decided(steps, policy, sources, hits)
    extra = {}
    if per == "row":
        steps.df = _with_places(steps.df, text)
        extra = {"places": "_places"}
    steps.add(
        "_proposed",
        f"array<{_PROPOSAL}>",
        lambda raw, text, spans, images, places=None: proposed(raw, text, spans, images, places),
        spans="_decided",
        **extra,
        **sources("raw", "text", "images"),
    )
    if isinstance(policy, RuleTable):
        _settle(steps, sources)
    else:
        steps.add("_fresh", f"array<{_PROPOSAL}>", uncovered, spans="_decided", found="_proposed")
        steps.add("_added", f"array<{SPAN}>", added, fresh_ones="_fresh", **sources("raw"))
        steps.add(
            "_spans",
            f"array<{SPAN}>",
            lambda first, more: let(f"concat({first}, {more})", superseded),
            first="_decided",
            more="_added",
        )
        steps.add("_ranges", f"array<{_NAMED_RANGE}>", lambda spans: merged_ranges(spans), spans="_spans")
    steps.add(
        "_redacted",
        "string",
        lambda raw, text, ranges: f"if(size({ranges}) = 0, {text},"
        f" {replaced(raw, ranges, lambda x: placeholder(f'{x}.entity_group'))})",
        ranges="_ranges",
        **sources("raw", "text"),
    )
    return steps.df.drop(*_WORK)


def _with_places(df: DataFrame, text: str) -> DataFrame:
    """Add ``_places``: where each confirmed credential occurs in its text, all found in one pass; null where there is none.

    Texts without a confirmed credential are not handed to Python.
    """

    kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    @F.arrow_udf(f"array<array<{RANGE}>>")
    def search(texts: pa.Array, values: pa.Array) -> pa.Array:
        def places(text: str, wanted: list[str]) -> list[list[dict]]:
            return [[{"start": a, "end": b} for a, b in found] for found in literal_occurrences(text, wanted)]

        # One text at a time: a worker holds its batch once.
        return pa.array([places(t.as_py(), v.as_py()) if t.is_valid else None for t, v in zip(texts, values)], kind)

    wanted = F.size("_values") > 0
    return df.withColumn("_values", F.expr(let("_decided", confirmed_values))).withColumn(
        "_places", search(F.when(wanted, F.expr(text)), F.when(wanted, F.col("_values")))
    )


def redact(df: DataFrame, policy: Policy | RuleTable, text: str = "text", hits: str = "hits") -> DataFrame:
    """Add ``spans``, ``redacted_text``, ``released``, ``redacted`` and ``changed`` to rows with a hit array."""
    return (
        judged(df, policy, f"`{text}`", f"`{hits}`")
        .withColumns({"spans": F.col("_spans"), "redact_ranges": F.col("_ranges"), "redacted_text": F.col("_redacted")})
        .withColumn("released", F.expr("size(filter(spans, s -> s.action = 'release'))"))
        .withColumn("redacted", F.expr("size(filter(spans, s -> s.action = 'redact'))"))
        .withColumn("changed", F.col("redacted") > 0)
        .drop("_spans", "_ranges", "_redacted")
    )

