"""Byte-level BPE of whole texts with content-defined chunk reuse.

A rolling hash cuts texts into chunks, so that texts which share passages share chunks. The chunks whose repeats would cost most are
counted over all documents, encoded once and handed to every task; other repeated chunks are encoded once per task. Joins of
chunks are then repaired: the text around a join is encoded again between two places where a run of white space begins, and
further out as long as a chunk's own tokens do not break there, until both sides agree. No pre-token holds white space
behind its first character, so at such a place the tokens of the whole text break too, and the result is that of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.llm.chunking import chunk_bounds
from analystry.llm.memory import frugal
from analystry.session import spread

#: Least, usual (as a power of two) and greatest bytes of a chunk.
CHUNK_LEAST, CHUNK_BITS, CHUNK_MOST = 512, 10, 8192
#: Chunks that are encoded once for all tasks; with 16-bit ids and CHUNK_MOST bytes a chunk, the broadcast stays below 64 MB.
SHARED_CHUNKS = 4096
#: Bytes of texts whose chunk encodings a task keeps, by least recent use.
KEPT_BYTES = 1 << 24
#: Texts of fewer bytes are encoded whole.
WHOLE_BELOW = 2 * CHUNK_LEAST

WHITE = b" \t\n\r\x0b\x0c"
#: The pre-token pattern of this kind of vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of whose class no two regular-expression engines disagree: a faster encoder takes texts of these.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]*")


@lru_cache(maxsize=2)
def tools(path: str):
    """(tokenizer, faster encoder or None, bytes of every id, special strings) of a BPE file, once a process.

    The faster encoder merges by id; it is used where the file's merges are in the order of the ids they make. The bytes are None for
    files whose normaliser, pre-tokeniser or decoder are not the plain byte-level ones: their texts are encoded and decoded whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    cut = described.get("pre_tokenizer") or {}
    if (described.get("normalizer") is not None or (described.get("decoder") or {}).get("type") != "ByteLevel" or cut.get("type") != "ByteLevel"
            or cut.get("add_prefix_space", True) or not cut.get("use_regex", True)):
        return tokenizer, None, None, []
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    vocabulary = described["model"]["vocab"]
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
    fast = None
    if made == sorted(made) and len(made) + 256 == len(ranks):
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = {i: piece for piece, i in ranks.items()} | {i: text.encode() for text, i in special.items()}
    return tokenizer, fast, [pieces.get(i, b"") for i in range(max(pieces) + 1)], list(special)


class ChunkEncoder:
    """Encodes texts by chunks, exactly as the tokenizer encodes them whole."""

    def __init__(self, path: str, shared: dict[bytes, bytes] | None = None):
        self.tokenizer, self.fast, self.pieces, self.special = tools(path)
        self.lengths = None if self.pieces is None else np.array([len(p) for p in self.pieces], np.int64)
        #: Shared ids are stored as these.
        self.narrow = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.shared = shared or {}
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.room = KEPT_BYTES

    def whole(self, data: bytes) -> np.ndarray:
        text = data.decode()
        if self.fast is not None and PLAIN.fullmatch(text) and not any(token in text for token in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def chunk(self, data: bytes) -> np.ndarray:
        digest = xxhash.xxh3_128_digest(data)
        if digest in self.shared:
            return np.frombuffer(self.shared[digest], self.narrow).astype(np.uint32)
        ids = self.kept.get(digest)
        if ids is not None:
            self.kept.move_to_end(digest)
            return ids
        ids = self.whole(data)
        self.kept[digest] = ids
        self.room -= 4 * len(ids)
        while self.room < 0:
            self.room += 4 * len(self.kept.popitem(last=False)[1])
        return ids

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text in UTF-8."""
        if len(data) < WHOLE_BELOW or self.pieces is None:
            return self.whole(data)
        ends = utf8_chunks(data)
        if len(ends) == 1:
            return self.whole(data)
        parts, starts = [], [0, *ends[:-1]]
        encoded = [self.chunk(data[a:b]) for a, b in zip(starts, ends)]
        breaks = [a + np.concatenate([[0], np.cumsum(self.lengths[ids])]) for a, ids in zip(starts, encoded)]
        done, k = 0, 0  # bytes encoded, chunk that holds that byte
        while True:
            # the chunk's own tokens up to the last place before its end where they can be cut
            if ends[k] == len(data):
                parts.append(encoded[k][np.searchsorted(breaks[k], done):])
                return np.concatenate(parts)
            left = cut_before(data, ends[k], done, breaks[k])
            if left > done:
                parts.append(encoded[k][np.searchsorted(breaks[k], done):np.searchsorted(breaks[k], left)])
            right, k = self.agree(data, ends, breaks, k + 1)
            parts.append(self.whole(data[left:right]))
            done = right
            if done == len(data):
                return np.concatenate(parts)

    @staticmethod
    def agree(data: bytes, ends: list[int], breaks: list[np.ndarray], k: int) -> tuple[int, int]:
        """First place in chunk k or a later one where white space begins and the chunk's own tokens break, and its chunk."""
        while k < len(ends):
            at = ends[k - 1] + 1
            while (at := next_white(data, at, ends[k])) >= 0:
                if breaks[k][np.searchsorted(breaks[k], at)] == at:
                    return at, k
                at += 1
            k += 1
        return len(data), len(ends) - 1

    def decode(self, ids: np.ndarray) -> str:
        if self.pieces is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def utf8_chunks(data: bytes) -> list[int]:
    """Chunk ends moved on to the next character."""
    moved = []
    for end in chunk_bounds(data, CHUNK_LEAST, CHUNK_BITS, CHUNK_MOST):
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if not moved or end > moved[-1]:
            moved.append(end)
    return moved


def next_white(data: bytes, at: int, end: int) -> int:
    """First place in [at, end) where ASCII white space follows something that is no white space of any kind."""
    while at < end:
        if data[at] in WHITE and 0x21 <= data[at - 1] < 0x7F:
            return at
        at += 1
    return -1


def cut_before(data: bytes, end: int, done: int, breaks: np.ndarray) -> int:
    """Last place in (done, end) of the same kind where the chunk's tokens break; `done` if there is none."""
    at = end - 1
    while at > done:
        if data[at] in WHITE and 0x21 <= data[at - 1] < 0x7F and breaks[np.searchsorted(breaks, at)] == at:
            return at
        at -= 1
    return done


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))


def _chunks_of(text: str) -> Iterator[bytes]:
    data = text.encode()
    if len(data) >= WHOLE_BELOW:
        start = 0
        for end in utf8_chunks(data):
            yield data[start:end]
            start = end


def repeated_chunks(docs: DataFrame, most: int = SHARED_CHUNKS) -> DataFrame:
    """(digest, bytes, times) of the `most` chunks with the most bytes in repeats, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text in batch.column(1).to_pylist():
                for chunk in _chunks_of(text):
                    seen.setdefault(xxhash.xxh3_128_digest(chunk), [len(chunk), 0])[1] += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
                ["digest", "bytes", "times"])

    counted = _texts(docs).mapInArrow(frugal(count), "digest binary, bytes long, times long").groupBy("digest").agg(F.max("bytes").alias("bytes"), F.sum("times").alias("times"))
    return counted.where("times > 1").orderBy(F.desc(F.col("bytes") * (F.col("times") - 1)), "digest").limit(most)


def shared_encodings(docs: DataFrame, path: str, most: int = SHARED_CHUNKS) -> dict[bytes, bytes]:
    """Digest to packed ids of the most repeated chunks, each encoded once. Bounded by `most` chunks of CHUNK_MOST bytes."""
    if tools(path)[2] is None:
        return {}
    wanted = {bytes(r["digest"]) for r in repeated_chunks(docs, most).select("digest").toLocalIterator()}
    if not wanted:
        return {}
    digests = docs.sparkSession.sparkContext.broadcast(wanted)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            found = {}
            for text in batch.column(1).to_pylist():
                for chunk in _chunks_of(text):
                    digest = xxhash.xxh3_128_digest(chunk)
                    if digest in digests.value and digest not in given:
                        found[digest] = chunk
                        given.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            ids = [encoder.whole(chunk).astype(encoder.narrow).tobytes() for chunk in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["digest", "ids"])

    picked = _texts(docs).mapInArrow(frugal(pick), "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    return {bytes(r["digest"]): bytes(r["ids"]) for r in picked.mapInArrow(frugal(encode), "digest binary, ids binary").toLocalIterator()}


def encode_documents(docs: DataFrame, path: str, digests_only: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and with `digests_only`
    off also the ids (array<int>).

    Null texts count as empty: no ids. Ids are those of the tokenizer on the whole text, special tokens in the text included;
    the decoded text is put together from them. Texts of any length are encoded whole, chunk by chunk; rows that repeat are encoded
    each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_encodings(docs, path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ChunkEncoder(path, shared.value), None
        for batch in batches:
            counts, ids_hash, text_hash, every = [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                if text != last:  # a mix holds copies of a text next to each other
                    last, ids = text, encoder.encode(text.encode())
                    digests = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()
                counts.append(len(ids))
                ids_hash.append(digests[0])
                text_hash.append(digests[1])
                if not digests_only:
                    every.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if not digests_only:
                columns.append(pa.array(every, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs).mapInArrow(frugal(encode), schema)
