"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run repeats the same `period` words at least three times over and is at least LEAST_WORDS long, so each of its words occurs three
times or more in any segment that holds it. Rarer words split their segment; the pieces are judged again by their own counts, until
no word is too rare. The survivors are scanned for lags in classes [P, 2P): a run of such a period repeats every stretch of 2P words
exactly one period later and never earlier, so the distance from a stretch to its next occurrence is the lag. Stretches get exact
names by doubling. No lag is tried that no repeated stretch shows, and a text of n words takes O(n log^2 n) steps, whatever it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.session import spread

#: A run is at least this many words and this many periods long.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Texts that are worked on at once, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Splitting ends when a round drops less than this share: texts made to lose a word a round stay linear. The lag scan takes any segment.
LEAST_DROP = 1 / 256

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ids) of the words between ASCII white space in UTF-8 bytes; equal words have equal ids."""
    blank = BLANK[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])])
    return starts, ends, words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _segments(at: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the stretches of neighbouring places `at` with one old segment."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(old) != 0)
    starts = np.flatnonzero(new)
    return starts, np.diff(starts, append=len(at))


def surviving(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The places of words that may stand in runs: those in segments whose every word occurs often enough in the segment itself."""
    at, stable, kinds = np.arange(len(words)), [], int(words.max(initial=0)) + 1
    while True:
        starts, lengths = _segments(at, segment)
        at, segment = (x[np.repeat(lengths >= LEAST_WORDS, lengths)] for x in (at, np.repeat(np.arange(len(starts)), lengths)))
        if not len(at):
            break
        codes = pd.factorize(segment * kinds + words[at])[0]
        often = np.bincount(codes)[codes] >= LEAST_PERIODS
        if len(at) - often.sum() < LEAST_DROP * len(at):
            stable.append(at)
            break
        whole = np.bincount(segment, ~often)[segment] == 0
        stable.append(at[whole])
        open_ = often & ~whole
        at, segment = at[open_], segment[open_]
    return np.sort(np.concatenate(stable)) if stable else at


def lag_scan(words: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs within segments, which are stretches of equal `segment`; smallest periods, maximal lengths."""
    size, found = len(words), []
    stop = np.repeat(*(lambda s, n: (s + n, n))(*_segments(np.arange(size), segment)))
    names, reach = words, 1
    while True:
        # `names` tells apart the stretches of `reach` words from each place on; -1 where none or none that occurs again
        here = np.flatnonzero((np.arange(size) + 2 * reach <= stop) & (names >= 0))
        here = here[names[here + reach] >= 0]
        if not len(here):
            return found
        codes = pd.factorize(names[here] * (int(names.max()) + 1) + names[here + reach])[0]
        order = np.argsort(codes, kind="stable")
        gap = np.diff(here[order])
        same = np.diff(codes[order]) == 0
        first, second = here[order[:-1]], here[order[1:]]
        lagged = same & (gap >= reach) & (gap < 2 * reach) & (segment[first] == segment[second])
        if lagged.any():
            place, lag = first[lagged], gap[lagged]
            by = np.argsort(place)
            place, lag = place[by], lag[by]
            starts, count = _segments(place, lag)
            length = count - 1 + 2 * reach + lag[starts]
            keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag[starts])
            found += zip(place[starts][keep].tolist(), length[keep].tolist(), lag[starts][keep].tolist())
        again = np.bincount(codes)[codes] > 1
        names = np.full(size, -1)
        names[here[again]] = codes[again]
        reach *= 2


class Slice:
    """The runs of a few whole texts, worked on together."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
        sizes = np.cumsum([len(t) + 1 for t in texts])
        self.text_ends = sizes
        self.starts, self.ends, words = word_places(self.data)
        self.first_word = np.searchsorted(self.starts, np.concatenate(([0], sizes)))
        self.n_words = np.diff(self.first_word)
        text = np.repeat(np.arange(len(texts)), self.n_words)
        at = surviving(words, text)
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        self.dropped = np.zeros(len(words) + 1, dtype=np.int64)
        if len(at):
            starts, lengths = _segments(at, text[at])
            for place, length, period in lag_scan(words[at], np.repeat(np.arange(len(starts)), lengths)):
                start = int(at[place])
                owner = int(text[start])
                self.runs[owner].append((start - int(self.first_word[owner]), length, period))
                self.dropped[start + period] += 1
                self.dropped[start + length] -= 1
            self.runs = [sorted(r, key=lambda x: (x[0], x[2])) for r in self.runs]

    def collapsed(self) -> list[bytes]:
        """Each text's words that no run repeats, joined by one space."""
        kept = np.cumsum(self.dropped[:-1]) == 0
        marks = np.zeros(len(self.data) + 1, dtype=np.int8)
        marks[self.starts[kept]] += 1
        marks[self.ends[kept] + 1] -= 1  # each word and the blank after it
        mask = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
        out = np.where(BLANK[self.data], np.uint8(0x20), self.data)[mask].tobytes()
        ends = np.concatenate(([0], np.cumsum(mask)[self.text_ends - 1]))
        return [out[a:b - 1] if b > a else b"" for a, b in zip(ends.tolist(), ends[1:].tolist())]


def slices(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Neighbouring texts of SLICE_BYTES together, longer ones alone; null counts as empty."""
    part, size = [], 0
    for text in texts:
        text = text or b""
        if part and size + len(text) > SLICE_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, runs, collapsed_sha256 and, on demand, collapsed.

    `runs` is an array of (start, length, period) in words by start and then period: every maximal stretch of at least LEAST_WORDS
    words and LEAST_PERIODS times its smallest period. `collapsed` joins by one space the words that are in no run or in the first
    period of each run that holds them. Null and empty texts have no words, no runs and an empty collapsed text; rows that repeat are
    judged each; texts of any length are read whole; other columns are not read; an empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                found = Slice(part)
                collapsed = found.collapsed()
                columns = [
                    batch.column(0).slice(done, len(part)), pa.array(found.n_words, pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found.runs], pa.list_(RUN)),
                    pa.array([hashlib.sha256(c).hexdigest() for c in collapsed], pa.string()),
                    *([pa.array(collapsed, pa.binary()).cast(pa.string())] if texts else [])]
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed_sha256", *["collapsed"] * texts])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"
    return rows.mapInArrow(find, schema + ", collapsed string" * texts)


def without_runs(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns; a text that holds runs becomes its collapsed words, other texts and nulls stay as they are."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, done = batch.schema.get_field_index("text"), 0
            for part in slices(batch.column(place).cast(pa.binary()).to_pylist()):
                rows, found = batch.slice(done, len(part)), Slice(part)
                done += len(part)
                pairs = zip(rows.column(place).to_pylist(), found.runs, found.collapsed())
                new = pa.array([c.decode() if r else t for t, r, c in pairs], pa.string())
                yield rows.set_column(place, rows.schema.field(place).with_type(pa.string()), new)

    return docs.mapInArrow(rewrite, docs.schema)
