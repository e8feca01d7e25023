"""Operator 9: token ids in Arrow files of equal-length sequences, and reading them back.

Documents are dealt by ranges of doc_id and encoded where they land; each task lays the ids of its documents
end to end and writes them as Arrow files: ``ids`` is a fixed-size list of 16-bit ids (32-bit where the
vocabulary needs it) and ``mask`` a fixed-size list of bits that are false where the last sequence is filled
up. A second small file holds each document's place. Sequence ``i`` lies at a computable place, so a reader
that maps the file gets it without copying (:func:`read_sequence`).

Files get names of their own for each attempt of a task and count only once they stand in the manifest that
Spark commits, so lost executors and repeated tasks leave no wrong file behind. Null text counts as empty (its
ids are the end id alone); rows with the same doc_id stay in the order of their texts; a null doc_id comes first.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from folioscope.llm.common import pieces
from folioscope.llm.pretokens import Splitter, kept
from folioscope.session import cut_lineage, shared_folder

#: How byte-level vocabularies write a space, and unknown words encoded in one call.
SPACE, LINE_WORDS = "\u0120", 2000
_SPACED = re.compile(r" \S+")
#: Ids a file holds before the next one is begun, and sequences in one record batch.
FILE_IDS = 32 << 20
BATCH_SEQUENCES = 64


class LibraryEncoder:
    """The tokenizers library over distinct segments: what it has encoded once is remembered."""

    def __init__(self, model: str, pattern: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(model)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it meets a word once; its own memory of words only costs time
        #: Strings the library gives one id wherever they stand; a text that holds one is encoded in one piece.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = dtype
        self.texts = Splitter(pattern, self.segments, self.added)
        vocabulary = self.tokenizer.get_vocab()
        #: By id: whether the token begins with a space, as only the first token of a spaced word does.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def one(self, segment: str) -> bytes:
        return self.ids(segment).tobytes()

    def segments(self, segments: list[bytes]) -> list[bytes]:
        """Ids of each segment. Words with a space before them are encoded together."""
        texts = [s.decode() for s in segments]
        spaced = [i for i, t in enumerate(texts) if _SPACED.fullmatch(t)]
        if any(x in "".join(texts) for x in self.added):
            spaced = [i for i in spaced if not any(x in texts[i] for x in self.added)]
        out: list[bytes | None] = [None] * len(texts)
        for i, ids in zip(spaced, self.spaced_words([texts[i][1:] for i in spaced]), strict=True):
            out[i] = ids
        return [self.one(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def spaced_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word with a space before it, encoded as one line and cut where a token begins with a space."""
        for at in range(0, len(words), LINE_WORDS):
            line = words[at : at + LINE_WORDS]
            ids = self.ids(" " + " ".join(line))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(line):
                yield from (self.one(" " + w) for w in line)
                continue
            raw, size = ids.tobytes(), ids.itemsize
            bounds = [*(starts * size).tolist(), len(raw)]
            yield from (raw[i:j] for i, j in zip(bounds, bounds[1:]))


def _schema(length: int, dtype: str) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


_PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, seq int, path string, places string, n_ids long, n_docs long"


class _File:
    """One file of sequences and its file of places, while they are written."""

    def __init__(self, root: str, name: str, length: int, dtype: str) -> None:
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        self.path, self.places = f"{root}/{name}.arrow", f"{root}/{name}-places.arrow"
        self.length, self.dtype, self.schema = length, dtype, _schema(length, dtype)
        self.sinks = [store.open_output_stream(f"{folder}/{name}{end}.arrow") for end in ("", "-places")]
        self.data = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], _PLACES)
        self.held, self.size, self.n_ids, self.n_docs = [], 0, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.n_docs += 1
        self.held.append(ids)
        self.size += len(ids)
        full = self.length * BATCH_SEQUENCES
        if self.size >= full:
            ids = np.concatenate(self.held)
            for at in range(0, len(ids) - full + 1, full):
                self._batch(ids[at : at + full], full)
            self.held = [ids[len(ids) // full * full :]]
            self.size = len(self.held[0])
        if len(self.rows) >= 4096:
            self._index()

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.data.write_batch(pa.record_batch(lists, schema=self.schema))

    def _index(self) -> None:
        columns = [pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)]
        self.index.write_batch(pa.record_batch(columns, schema=_PLACES))
        self.rows = []

    def close(self) -> tuple:
        if self.size:
            ids = np.concatenate(self.held)
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        if self.rows:
            self._index()
        for x in (self.data, self.index, *self.sinks):
            x.close()
        return self.path, self.places, self.n_ids, self.n_docs


def write_files(
    docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 2, length: int = 1024, folder: str | None = None
) -> DataFrame:
    """Encode and write all documents; returns the manifest, one row a file with ``base``: ids before it."""
    spark = docs.sparkSession
    root = f"{folder or shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    vocabulary = max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    shared, key = spark.sparkContext.broadcast(model), (len(model), zlib.crc32(model.encode()), pattern, dtype)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, name = task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = kept("library", key, lambda: LibraryEncoder(shared.value, pattern, dtype))
        end = np.array([end_id], dtype)
        done: list[tuple] = []
        file: _File | None = None
        for piece in pieces(batches, "text"):
            for doc_id, raw in zip(piece.column("doc_id").to_pylist(), encoder.texts(piece.column("text").to_pylist()), strict=True):
                file = file or _File(root, f"{name}-{len(done)}", length, dtype)
                file.add(doc_id, np.concatenate([np.frombuffer(raw.as_buffer(), dtype), end]))
                if file.n_ids >= FILE_IDS:
                    done.append((part, len(done), *file.close()))
                    file = None
        if file:
            done.append((part, len(done), *file.close()))
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, [c.split()[0] for c in _MANIFEST.split(", ")])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    written = cut_lineage(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, _MANIFEST))
    # One row a file, so this order is over files, not documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    store, inner = fs.FileSystem.from_uri(path)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(inner) if local else store.open_input_file(inner))


def read_sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``i`` of a file and its mask; the ids are a view of the mapped file."""
    batch = _open(path).get_batch(i // BATCH_SEQUENCES)
    ids, mask = (batch.column(k)[i % BATCH_SEQUENCES].values for k in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def _stream(path: str) -> Iterator[np.ndarray]:
    reader = _open(path)
    for b in range(reader.num_record_batches):
        ids, mask = (reader.get_batch(b).column(k).flatten() for k in (0, 1))
        yield ids.to_numpy()[: mask.true_count]


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as little-endian 32 bits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row["path"], row["places"], row["base"])

    # One task a file: a row stands for up to FILE_IDS ids.
    files = manifest.select("path", "places", "base")
    return files.repartition(_files(manifest), "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _files(manifest: DataFrame) -> int:
    return max(1, min(manifest.count(), 100_000))


def _documents(path: str, places: str, base: int) -> Iterator[pa.RecordBatch]:
    stream, buffer = _stream(path), np.empty(0, "<u2")
    index = _open(places)
    for b in range(index.num_record_batches):
        batch = index.get_batch(b)
        sums = []
        for n in batch.column("n_tokens").to_pylist():
            crc = 0
            while n:
                if not len(buffer):
                    buffer = next(stream)
                take, buffer = buffer[:n], buffer[n:]
                crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                n -= len(take)
            sums.append(crc)
        start = pa.compute.add(batch.column("start"), base)
        yield pa.record_batch(
            [batch.column("doc_id"), start, batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
