"""Operator 10: byte-level BPE encoding and decoding with a two-tier lookup.

Whole pre-tokens that are in the vocabulary are found through a minimal perfect hash (hash and displace:
every key has a slot of its own among exactly as many slots as keys). The others are merged by rank with a
heap over a linked list of their bytes. Both happen once for each distinct segment of a slice of texts that the
worker process does not remember. Texts are mapped row by row; nothing is shuffled. The vocabulary file is read
on the driver and broadcast: its size is fixed by the file, below a few MB.

Null text counts as empty: no ids, empty bytes. Rows with the same id are encoded independently, and other
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import map_pieces
from folioscope.llm.pretokens import Splitter, joined, kept

_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _sum(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        data = f.read()
    return len(data), zlib.crc32(data)


def _slot(h: int, shift: int, n: int) -> int:
    return (((h ^ (h >> 29)) * (2 * shift + 1) & _MASK) >> 24) % n


class PerfectHash:
    """Minimal perfect hash from byte strings to integers; a key that is not in it gives -1."""

    def __init__(self, entries: dict[bytes, int]) -> None:
        n = self.n = max(1, len(entries))
        self.buckets = n // 4 + 1
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in entries:
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append((h, key))
        self.keys: list[bytes | None] = [None] * n
        self.values = array("q", [-1]) * n
        self.shifts = array("q", [0]) * self.buckets
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            shift = 0
            while members[b]:
                slots = [_slot(h, shift, n) for h, _ in members[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                shift += 1
            self.shifts[b] = shift
            for s, (_, key) in zip(slots if members[b] else (), members[b], strict=True):
                self.keys[s], self.values[s] = key, entries[key]

    def __getitem__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        slot = _slot(h, self.shifts[h % self.buckets], self.n)
        return self.values[slot] if self.keys[slot] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
    n, rank, push, pop = len(word), ranks.get, heapq.heappush, heapq.heappop
    after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    # Rank, place and length of a pair in one number, which orders like the three of them.
    bits, low = n.bit_length(), (1 << n.bit_length()) - 1
    heap = [(r << bits | i) << bits | 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        pair = pop(heap)
        i, length = pair >> bits & low, pair & low
        j = after[i]
        if not size[i] or j >= n or size[i] + size[j] != length:
            continue  # one of the two has been merged meanwhile
        size[i], size[j], after[i] = length, 0, after[j]
        if (right := after[i]) < n:
            before[right] = i
            grown = length + size[right]
            if (r := rank(word[i : i + grown])) is not None:
                push(heap, (r << bits | i) << bits | grown)
        if (left := before[i]) >= 0:
            grown = size[left] + length
            if (r := rank(word[left : left + grown])) is not None:
                push(heap, (r << bits | left) << bits | grown)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : i + size[i]]])
        i = after[i]
    return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str) -> None:
        self.ranks, self.whole, self.pattern = ranks, whole, regex.compile(pattern)
        self.texts = Splitter(pattern, lambda segments: list(map(self.segment, segments)))

    def segment(self, segment: bytes) -> bytes:
        ids = array("I")
        for word in self.pattern.findall(segment.decode()):
            word = word.encode()
            found = self.whole[word]
            ids.append(found) if found >= 0 else ids.extend(merge(word, self.ranks))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


class Decoder:
    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())

    def plain(self, ids: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The bytes of each row's tokens, laid end to end."""
        ends = np.frombuffer(ids.buffers()[1], "<i8")[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], "<u4", (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] else np.empty(0, "<u4")
        return joined(self.tokens.take(pa.array(flat)), (ends - ends[0]) // 4)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ids as little-endian unsigned 32-bit integers: (doc_id, ids binary)."""
    ranks, key = read_ranks(path), (_sum(path), pattern)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))

    def task():
        encoder = kept("bpe", key, lambda: Encoder(*shared.value, pattern))

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.texts(piece.column("text").to_pylist())
            return pa.record_batch([piece.column("doc_id"), ids.cast(pa.binary())], ["doc_id", "ids"])

        return step

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_pieces(source, "text", task, "doc_id long, ids binary")


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes the ids stand for: (doc_id, ids, decoded binary)."""
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens(read_ranks(path)))

    def task():
        decoder = Decoder(shared.value)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = piece.column("ids")
            plain = decoder.plain(ids.cast(pa.large_binary()).fill_null(b""))
            return pa.record_batch([piece.column("doc_id"), ids, plain.cast(pa.binary())], ["doc_id", "ids", "decoded"])

        return step

    return map_pieces(encoded.select("doc_id", "ids"), "ids", task, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """:func:`decode` of :func:`encode` in one pass, so that a task needs one Python process: (doc_id, ids, decoded)."""
    ranks, key = read_ranks(path), (_sum(path), pattern)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))

    def task():
        encoder = kept("bpe", key, lambda: Encoder(*shared.value, pattern))
        decoder = kept("bpe tokens", key, lambda: Decoder(_tokens(encoder.ranks)))

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.texts(piece.column("text").to_pylist())
            columns = [piece.column("doc_id"), ids.cast(pa.binary()), decoder.plain(ids).cast(pa.binary())]
            return pa.record_batch(columns, ["doc_id", "ids", "decoded"])

        return step

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_pieces(source, "text", task, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    """Counts and SHA-256 sums of ids and decoded bytes per row, and more of its columns."""
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
