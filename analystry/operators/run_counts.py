"""Distinct runs of neighbouring items and how often each document has them, counted on whole Arrow batches.

A document's items are numbered by a dictionary; a run is then one integer, made from the run that is shorter by one and the item
that follows, and one sort of (document, run) integers counts them. Spark places the documents and takes the rows on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

#: Items whose runs are held at a time; a longer document is taken alone.
SLICE = 1 << 20
#: Codes below this fit into 64 bits together with a step more.
MOST_CODES = 1 << 62
#: Codes up to here are looked up in a table instead of being sorted.
TABLE = 1 << 22


@dataclass
class Runs:
    """Runs of low..high neighbouring entries of an array column without null entries, joined by `glue`, or of the characters of a text column.

    With `allowed`, of the runs of `marker` entries or more only those whose every run of `marker` entries is allowed.
    """

    items: Column
    low: int = 1
    high: int = 1
    glue: str = ""
    marker: int = 0
    allowed: Sequence[str] | None = None


class _Codes:
    """The runs of n items as integers below `span`, one per place; `names` turns them back into text."""

    def __init__(self, ids: np.ndarray, words: pa.Array, glue: str):
        self.ids, self.words, self.glue, self.base = ids, words, glue, max(len(words), 1)
        self.code, self.span, self.tables = ids, self.base, [None]

    def longer(self, most: int) -> None:
        """One item more; places without a next item are dropped."""
        table = None
        if self.span * self.base >= most:
            table, self.code = np.unique(self.code, return_inverse=True)
            self.span = max(len(table), 1)
        self.tables.append(table)
        self.code = self.code[:-1] * self.base + self.ids[len(self.tables) - 1:]
        self.span *= self.base

    def names(self, code: np.ndarray) -> pa.Array:
        parts = []
        for table in self.tables[:0:-1]:
            parts.append(self.words.take(pa.array(code % self.base)))
            code = code // self.base
            code = code if table is None else table[code]
        parts.append(self.words.take(pa.array(code)))
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts[::-1], self.glue)

    def among(self, allowed: pa.Array) -> np.ndarray:
        """Which places hold an allowed run."""
        if self.span <= TABLE:
            seen = np.zeros(self.span, bool)
            seen[self.code] = True
            found = np.flatnonzero(seen)
            seen[found] = pc.is_in(self.names(found), allowed).to_numpy(zero_copy_only=False)
            return seen[self.code]
        found, place = np.unique(self.code, return_inverse=True)
        return pc.is_in(self.names(found), allowed).to_numpy(zero_copy_only=False)[place]


def _coded(words: pa.Array, ids: np.ndarray, sizes: np.ndarray, runs: Runs, allowed: pa.Array | None):
    """(document, code, tf, codes) of some documents of the given sizes, once per length of run; `codes` names them until the next length."""
    document = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))  # items from here to the document's end
    codes, most, good, fits = _Codes(ids, words, runs.glue), MOST_CODES // max(len(sizes), 1), None, None
    for n in range(1, runs.high + 1):
        if n > len(ids):
            return
        if n > 1:
            codes.longer(most)
        here = left[:len(codes.code)] >= n
        if allowed is not None and n >= runs.marker:
            good = codes.among(allowed) if n == runs.marker else good
            fits = good if n == runs.marker else fits[:-1] & good[n - runs.marker:]
            here &= fits
        if n < runs.low:
            continue
        cells, tf = np.unique(document[:len(here)][here] * codes.span + codes.code[here], return_counts=True)
        yield cells // codes.span, cells % codes.span, tf.astype(np.int64), codes


def _counted(words: pa.Array, ids: np.ndarray, sizes: np.ndarray, runs: Runs, allowed: pa.Array | None):
    """(document, term, tf) arrays of some documents of the given sizes, one triple per length of run."""
    for document, code, tf, codes in _coded(words, ids, sizes, runs, allowed):
        yield document, codes.names(code), tf


def _cut(arrays: pa.Array) -> tuple[np.ndarray, Callable]:
    """Items per document, and a function from a stretch of documents to (number of each item, what the numbers stand for)."""
    if pa.types.is_list(arrays.type):
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values, ends = arrays.flatten(), np.cumsum(sizes)

        def stretch(first: int, last: int):
            begin = int(ends[first] - sizes[first])
            part = values.slice(begin, int(ends[last - 1]) - begin).dictionary_encode()
            return part.indices.to_numpy().astype(np.int64), part.dictionary

        return sizes, stretch

    def characters(first: int, last: int):
        points = np.frombuffer("".join(arrays.slice(first, last - first).drop_null().to_pylist()).encode("utf-32-le"), np.uint32)
        number = np.zeros(int(points.max(initial=0)) + 1, np.int64)
        number[points] = 1
        found = np.flatnonzero(number)
        number[found] = np.arange(len(found))
        return number[points], pa.array([chr(c) for c in found], pa.string())

    return pc.fill_null(pc.utf8_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64), characters


def _stretches(arrays: pa.Array):
    """(documents before, their sizes, number of each item, what the numbers stand for) of stretches of documents of about SLICE items."""
    sizes, stretch = _cut(arrays)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        begin = int(ends[first] - sizes[first])
        last = max(int(np.searchsorted(ends, begin + SLICE, side="right")), first + 1)
        yield first, sizes[first:last], *stretch(first, last)
        first = last


def counter(runs: Runs) -> Callable:
    """A function over batches of (keys..., items) that gives (keys..., term, tf)."""
    low, high, glue, marker = runs.low, runs.high, runs.glue, runs.marker
    kept = None if runs.allowed is None else list(runs.allowed)
    settings = Runs(None, low, high, glue, marker)

    def count(batches):
        allowed = None if kept is None else pa.array(kept, pa.string())
        for batch in batches:
            keys = batch.columns[:-1]
            for first, sizes, ids, words in _stretches(batch.column(batch.num_columns - 1)):
                found = _counted(words, ids, sizes, settings, allowed)
                for document, term, tf in _merged(found) if high > 1 and _ambiguous(words, glue) else found:
                    place = pa.array(document + first)
                    yield pa.RecordBatch.from_arrays([*[k.take(place) for k in keys], term, pa.array(tf)], names=[*batch.schema.names[:-1], "term", "tf"])

    return count


def _placed(words: pa.Array, ids: np.ndarray, sizes: np.ndarray, runs: Runs, allowed: pa.Array | None = None):
    """(document, place, tf, names) of some documents, once per length of run: a run's text is names[place], each text being one name."""
    if runs.high > 1 and _ambiguous(words, runs.glue):
        for document, term, tf in _merged(_counted(words, ids, sizes, runs, allowed)):
            named = term.dictionary_encode()
            yield document, named.indices.to_numpy(), tf, named.dictionary
        return
    for document, code, tf, codes in _coded(words, ids, sizes, runs, allowed):
        found, place = np.unique(code, return_inverse=True)
        yield document, place, tf, codes.names(found)


def document_counter(runs: Runs) -> Callable:
    """A function over batches of (group, items) that gives (group, term, df): how many of the documents it meets have the run."""
    settings, kept = Runs(None, runs.low, runs.high, runs.glue, runs.marker), None if runs.allowed is None else list(runs.allowed)

    def count(batches):
        allowed = None if kept is None else pa.array(kept, pa.string())
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            group = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for first, sizes, ids, words in _stretches(batch.column(1)):
                for document, place, _, names in _placed(words, ids, sizes, settings, allowed):
                    base = max(len(names), 1)
                    pair, df = np.unique(group[document + first] * base + place, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [groups.dictionary.take(pa.array(pair // base)), names.take(pa.array(pair % base)), pa.array(df.astype(np.int64))],
                        names=[batch.schema.names[0], "term", "df"])

    return count


def known_counts(items: pa.Array, runs: Runs, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in terms, tf) of the runs that are terms."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for first, sizes, ids, words in _stretches(items):
        for document, place, tf, names in _placed(words, ids, sizes, runs):
            at = pc.fill_null(pc.index_in(names, value_set=terms), -1).to_numpy(zero_copy_only=False)[place]
            used = at >= 0
            parts.append((document[used] + first, at[used].astype(np.int64), tf[used]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def weigher(runs: Runs, terms: Sequence[str], idf: Sequence[float], sublinear: bool = True) -> Callable:
    """A function over batches of (keys..., items) that gives (keys..., term, weight): TF-IDF of the given terms, of unit length in each row."""
    settings, kept = Runs(None, runs.low, runs.high, runs.glue, runs.marker), None if runs.allowed is None else list(runs.allowed)
    terms, idf = list(terms), np.asarray(idf, float)

    def weigh(batches):
        allowed = None if kept is None else pa.array(kept, pa.string())
        known = pa.array(terms, pa.string())
        for batch in batches:
            keys, names_of = batch.columns[:-1], [*batch.schema.names[:-1], "term", "weight"]
            for first, sizes, ids, words in _stretches(batch.column(batch.num_columns - 1)):
                parts, square = [], np.zeros(len(sizes))
                for document, place, tf, names in _placed(words, ids, sizes, settings, allowed):
                    at = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False)[place]
                    document, at, tf = document[at >= 0], at[at >= 0], tf[at >= 0]
                    weight = (1 + np.log(tf) if sublinear else tf) * idf[at]
                    square += np.bincount(document, weight ** 2, len(sizes))
                    parts.append((document, at, weight))
                norm = np.sqrt(square)
                for document, at, weight in parts:
                    place = pa.array(document + first)
                    yield pa.RecordBatch.from_arrays([*[k.take(place) for k in keys], known.take(pa.array(at)), pa.array(weight / norm[document])], names=names_of)

    return weigh


def _ambiguous(words: pa.Array, glue: str) -> bool:
    """Can two runs be the same text?"""
    return bool(pc.any(pc.match_substring(words, glue) if glue else pc.not_equal(pc.utf8_length(words), 1)).as_py())


def _merged(found):
    """The same counts with one row per document and text."""
    tables = [pa.table([pa.array(document), term, pa.array(tf)], names=["d", "t", "n"]) for document, term, tf in found]
    if tables:
        together = pa.concat_tables(tables).group_by(["d", "t"]).aggregate([("n", "sum")])
        yield together["d"].to_numpy(), together["t"].combine_chunks(), together["n_sum"].to_numpy()
