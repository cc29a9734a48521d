"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are folded to small letters, everything that is no letter becomes one blank. Every n-gram of 1 to 3 characters
falls into one of ``BINS`` bins. The counts of all training texts are summed by language and bin; the log-probability
matrix (languages × bins, at most ``MOST_LANGUAGES`` rows) is broadcast and batches are scored in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.bytetext import slices, text_bytes
from spanguard.llm.worker import kept

BINS = 1 << 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 512
SMOOTHING = 0.5
PIECE = 1 << 17
#: Bytes of text worked on at a time; some forty times that are held.
SLICE = 2 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Folded letter for each character of the basic plane, blank for all else; characters beyond it count as letters if ideographs."""
    table = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        letter = chr(code)
        if letter.isalpha():
            small = letter.lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


def characters(column) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of a column of texts in order, and the offsets of its rows in them."""
    raw, bounds = text_bytes(column)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    table = kept("letters", _letters)
    beyond = codes >= 1 << 16
    folded = table[np.where(beyond, 32, codes)]
    if beyond.any():
        places = np.flatnonzero(beyond)
        folded = folded.copy()
        folded[places] = [c if chr(c).isalpha() else 32 for c in codes[places].tolist()]
    return folded, heads[bounds]


def squeezed(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of blanks become one; each text begins with a blank of its own."""
    blank = codes == 32
    again = blank.copy()
    again[1:] &= blank[:-1]
    again[bounds[:-1][bounds[:-1] < len(codes)]] = False
    keep = ~again
    places = np.concatenate([[0], np.cumsum(keep)])[bounds]
    codes = np.insert(codes[keep], places[:-1], np.uint32(32))
    return codes, places + np.arange(len(bounds))


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The bin of the n-gram that starts at each character."""
    mixed = codes[: len(codes) - order + 1].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(order * 0x61C88647 & 0xFFFFFFFF)
    for step in range(1, order):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[step : len(codes) - order + 1 + step] * np.uint32(0xC2B2AE35)
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)


def pieces(codes: np.ndarray, bounds: np.ndarray):
    """Pieces of bounded length for counting: characters with ORDERS[-1]-1 more behind, and the text each start lies in."""
    for low in range(0, len(codes), PIECE):
        high = min(len(codes), low + PIECE)
        yield low, high, codes[low : high + ORDERS[-1] - 1]


def _inside(low: int, size: int, order: int, bounds: np.ndarray) -> np.ndarray | None:
    """Starts whose n-gram crosses into the next text (to be left out)."""
    ends = bounds[(bounds > low) & (bounds < low + size + order)]
    bad = (ends[:, None] - np.arange(1, order)[None, :]).ravel() - low
    return bad[(bad >= 0) & (bad < size)]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages × bins
    priors: np.ndarray

    def scores(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Log score of each text under each language, and whether the text has a letter."""
        codes, bounds = characters(column)
        letters = np.concatenate([[0], np.cumsum(codes != 32)])
        lettered = letters[bounds[1:]] > letters[bounds[:-1]]
        codes, bounds = squeezed(codes, bounds)
        totals = np.zeros((len(bounds) - 1, len(self.languages)))
        for low, high, part in pieces(codes, bounds):
            first = int(np.searchsorted(bounds, low, side="right")) - 1
            last = int(np.searchsorted(bounds, high, side="left"))
            edges = np.maximum(bounds[first:last], low) - low
            for order in ORDERS:
                bins = grams(part, order)[: high - low]
                skip = _inside(low, len(bins), order, bounds)
                for row, logs in enumerate(self.logs):
                    values = logs[bins]
                    values[skip] = 0.0
                    sums = np.concatenate([[0.0], np.cumsum(values)])
                    ends = np.minimum(np.append(edges[1:], high - low), len(bins))
                    totals[first:last, row] += sums[ends] - sums[np.minimum(edges, len(bins))]
        return totals + self.priors, lettered

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        totals, lettered = self.scores(column)
        best = totals.argmax(1)
        share = 1.0 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, share, 0.0)


def _counts(text: str, lang: str):
    def run(batches):
        held: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in slices(batches, text, SLICE):
            codes, bounds = squeezed(*characters(batch.column(batch.schema.get_field_index(text))))
            names, own = np.unique(np.array(batch.column(batch.schema.get_field_index(lang)).to_pylist(), object).astype(str), return_inverse=True)
            for name in names.tolist():
                if name not in held:
                    if len(held) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    held[name], texts[name] = np.zeros(BINS, np.int64), 0
            for name, n in zip(names.tolist(), np.bincount(own, minlength=len(names)).tolist()):
                texts[name] += n
            owner = np.repeat(own, np.diff(bounds))
            for low, high, part in pieces(codes, bounds):
                for order in ORDERS:
                    bins = grams(part, order)[: high - low]
                    weight = np.ones(len(bins))
                    weight[_inside(low, len(bins), order, bounds)] = 0.0
                    sums = np.bincount(owner[low : low + len(bins)] * BINS + bins, weight, minlength=len(names) * BINS).reshape(-1, BINS)
                    for name, row in zip(names.tolist(), sums):
                        held[name] += row.astype(np.int64)
        for name, row in held.items():
            bins = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(bins) + 1)), pa.array(np.append(bins, -1)), pa.array(np.append(row[bins], texts[name]))],
                names=["lang", "bin", "n"],
            )

    return run


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Sums the counts of all training rows with a language. Each task sends at most languages × bins sums; so does the result."""
    rows = training.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sums = rows.mapInArrow(_counts("text", "lang"), "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts, texts = np.zeros((len(names), BINS)), np.zeros(len(names))
    row = np.searchsorted(np.array(names, object), np.array(found.column("lang").to_pylist(), object)) if names else np.zeros(0, int)
    bins, n = found.column("bin").to_numpy(), found.column("n").to_numpy()
    of_bin = bins >= 0
    counts[row[of_bin], bins[of_bin]] = n[of_bin]
    texts[row[~of_bin]] = n[~of_bin]
    logs = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BINS)) if names else counts
    return Model(names, logs, np.log((texts + 1) / (texts.sum() + len(names))) if names else texts)


def predicted(df: DataFrame, model: Model, text: str = "text") -> Column:
    """``struct<lang, score>``: the likeliest language and its posterior; ``und`` and 0 for null texts and texts without a letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def prediction(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        table = pa.RecordBatch.from_arrays([texts], names=["text"])
        for part in slices([table], "text", SLICE):
            a, b = shared.value.predict(part.column(0))
            names += a
            scores.append(b)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang", "score"])

    return prediction(F.col(text))
