"""Operator 13: spelling variants of a corpus' words, found in Bloom-guided neighbourhoods.

1. Words are counted over all documents. A run is a maximal row of the letters A-Z, a-z and U+00C0 to U+00FF, of which
   only A-Z are lower-cased. Where ``every`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the run loses its code
   point h % length. Words are results of at least ``least_length`` code points that occur ``least_count`` times.
2. Words are filed by length, long lists further by hash, into shards of at most ``SHARD_WORDS``; each shard becomes a
   blocked Bloom filter (a key sets ``BITS`` bits of one 64-bit block). Filters are broadcast in rounds of at most
   ``ROUND_BYTES``; a larger vocabulary takes further rounds over the words.
3. Tasks generate the edits of every word: all deletions, and all replacements by a later letter that words of this
   length use. (An insertion is the other word's deletion.) An edit is never spelt out: its key follows from the word's
   key, a polynomial over its letters, so a word of any length costs its length times the letters. Edits that a
   filter lets through leave the task as (word's key, place, letter, edit's key).
4. They meet the vocabulary in a join by key, and both words are compared letter by letter, so that neither false
   positives nor equal keys of different words remain. All else are aggregates by word.

A word's form is its near word of largest n (ties: the smallest) if that is at least ``factor`` times its own; the
root follows forms to the last. n grows by the factor at every step, so doubling ends after a few rounds.

A null text has no runs; a null doc_id counts as an empty one. Each row is a document, also where ids or texts repeat.
No words, no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import pieces, slices
from folioscope.llm.transducer import LOWER
from folioscope.llm.words import mix
from folioscope.session import cut_lineage

#: Words of one filter, filter bits a word, bits that a key sets, bytes of filters broadcast at once.
SHARD_WORDS, BITS_A_WORD, BITS, ROUND_BYTES = 1 << 14, 16, 4, 64 << 20
#: Distinct words a task counts, bytes of long words it holds, edits generated at once.
HELD, HELD_BYTES, EDITS = 400_000, 32 << 20, 1 << 18

#: Letters by number: a to z, then U+00C0 to U+00FF.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_NUMBER = np.zeros(256, np.int64)
_NUMBER[97:123], _NUMBER[192:256] = np.arange(26), np.arange(26, 90)
_U = np.uint64
_CODE = mix(np.arange(1, len(LETTERS) + 1, dtype=_U) * _U(0xD1342543DE82EF95))
_BASE = 0xF1357AEA2E62A9C5  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(_BASE, -1, 1 << 64))
_POSITIVE = "key long, at int, letter int, edit long"


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + _U(length) * _U(0xA24BAED4963EE407))


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n) over all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
        small, met, long_words = LOWER.tobytes(), Counter(), 0

        def rows_out() -> Iterator[pa.RecordBatch]:
            words, n = pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())
            for at in range(0, len(words), 50_000):
                yield pa.record_batch([words[at : at + 50_000], n[at : at + 50_000]], ["word", "n"])
            met.clear()

        for piece in pieces(batches, "text"):
            for doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                if not text:
                    continue
                name = b"%d:" % doc_id if doc_id is not None else b":"
                runs: Counter[str] = Counter()
                for part in slices(text):
                    runs.update(run.findall(part.translate(small).decode(errors="replace")))
                for word, n in runs.items():
                    h = zlib.crc32(name + word.encode())
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    met[word] += n
                    if len(word) > 64:
                        long_words += len(word)
                if len(met) > HELD or long_words > HELD_BYTES:
                    yield from rows_out()
                    long_words = 0
        yield from rows_out()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = slim.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _numbers(word: str) -> np.ndarray:
    return _NUMBER[np.frombuffer(word.encode("latin-1"), np.uint8)]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letter numbers of the words of each length, in blocks of at most EDITS letters but one word."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, EDITS // length)
        for at in range(0, len(places), step):
            block = places[at : at + step]
            letters = np.frombuffer("".join(words[i] for i in block).encode("latin-1"), np.uint8)
            yield block, _NUMBER[letters].reshape(len(block), length)


def with_keys(words: DataFrame) -> DataFrame:
    """(word, n) with ``key`` and the length in ``size`` and, as bits, the letters used."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "word"):
            words = piece.column("word").to_pylist()
            keys = np.zeros(len(words), _U)
            used = np.zeros((len(words), 2), np.int64)
            for places, letters in _by_length(words):
                length = letters.shape[1]
                keys[places] = _key((_CODE[letters] * _powers(length)).sum(axis=1, dtype=_U), length)
                for half in (0, 1):
                    bits = np.where(letters // 45 == half, np.int64(1) << (letters % 45), 0)
                    used[places, half] = np.bitwise_or.reduce(bits, axis=1)
            columns = [pa.array(keys.view(np.int64)), pa.array([len(w) for w in words], pa.int32()), *(pa.array(used[:, i].copy()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *columns], ["word", "n", "key", "size", "low", "high"])

    return words.select("word", "n").mapInArrow(task, "word string, n long, key long, size int, low long, high long")


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(32)) % _U(shards)).astype(np.int64)


def _blocks(keys: np.ndarray, blocks: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each key in a filter of so many; both from a second mix, as the first chose the shard."""
    x = mix(keys ^ _U(0x9FB21C651E98DF25))
    bits = np.zeros(len(keys), _U)
    for i in range(BITS):
        bits |= _U(1) << ((x >> _U(6 * i)) & _U(63))
    return ((x >> _U(32)) * np.asarray(blocks, _U) >> _U(32)).astype(np.int64), bits


def _filters(words: DataFrame, shards: DataFrame) -> DataFrame:
    """(size, shard, bits): a filter for each shard of at most about SHARD_WORDS keys."""

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy().view(_U)
        bits = np.zeros(max(1, -(-len(keys) * BITS_A_WORD // 64)), _U)
        at, own = _blocks(keys, len(bits))
        np.bitwise_or.at(bits, at, own)
        return pa.table({"size": [key[0].as_py()], "shard": [key[1].as_py()], "bits": [bits.tobytes()]}, schema=pa.schema([("size", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())]))

    high = F.shiftrightunsigned("key", 32)
    filed = words.select("key", "size").join(shards.select("size", "shards"), "size")
    return filed.select("size", F.pmod(high, F.col("shards")).alias("shard"), "key").groupBy("size", "shard").applyInArrow(make, "size int, shard long, bits binary")


class _Probe:
    """Filters of one round and the letters of each length."""

    def __init__(self, lengths: list[tuple[int, int, list[int]]], filters: list[tuple[int, int, bytes]]) -> None:
        self.shards = {size: shards for size, shards, _ in lengths}
        self.letters = {size: np.array(letters) for size, _, letters in lengths}
        # A length's filters of this round one after the other, and each shard's first block and number of blocks.
        self.bits: dict[int, np.ndarray] = {}
        self.first, self.blocks = ({size: np.zeros(n, np.int64) for size, n in self.shards.items()} for _ in range(2))
        for size in {f[0] for f in filters}:
            own = [(shard, np.frombuffer(bits, _U)) for of, shard, bits in filters if of == size]
            self.bits[size] = np.concatenate([bits for _, bits in own])
            places = np.array([shard for shard, _ in own])
            self.blocks[size][places] = [len(bits) for _, bits in own]
            self.first[size][places] = np.cumsum([0] + [len(bits) for _, bits in own])[:-1]

    def passed(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Places of the keys that a filter of this round lets through."""
        shard = _shard_of(keys, self.shards[size])
        blocks = self.blocks[size][shard]
        at, own = _blocks(keys, blocks)
        return np.flatnonzero(((self.bits[size][self.first[size][shard] + at] & own) == own) & (blocks > 0))

    def edits(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(word, place, letter or -1, key) of the edits let through, for words of one length."""
        n, length = letters.shape
        power = _powers(length)
        parts = _CODE[letters] * power
        whole = parts.sum(axis=1, dtype=_U)
        if length - 1 in self.bits:
            before = np.zeros(n, _U)
            for i in range(length):
                own = np.arange(n) if i == 0 else np.flatnonzero(letters[:, i] != letters[:, i - 1])
                keys = _key(before[own] + (whole[own] - before[own] - parts[own, i]) * _INVERSE, length - 1)
                hit = self.passed(keys, length - 1)
                yield own[hit], np.full(len(hit), i), np.full(len(hit), -1), keys[hit]
                before = before + parts[:, i]
        if length in self.bits:
            used = self.letters[length]
            for i in range(length):
                word, letter = np.nonzero(used[None, :] > letters[:, i, None])
                letter = used[letter]
                keys = _key(whole[word] - parts[word, i] + _CODE[letter] * power[i], length)
                hit = self.passed(keys, length)
                yield word[hit], np.full(len(hit), i), letter[hit], keys[hit]


def _positives(words: DataFrame, lengths: list, filters: list) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast((lengths, filters))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(*shared.value)
        for piece in pieces(batches, "word"):
            texts, keys = piece.column("word").to_pylist(), piece.column("key").to_numpy()
            for places, letters in _by_length(texts):
                step = max(1, EDITS // (len(LETTERS) * 4))
                for start in range(0, len(places), step):
                    held, size = [], 0
                    for word, at, letter, edit in probe.edits(letters[start : start + step]):
                        held.append((keys[places[start + word]], at, letter, edit.view(np.int64)))
                        size += len(word)
                        if size > EDITS:
                            yield _batch(held)
                            held, size = [], 0
                    if size:
                        yield _batch(held)

    return words.select("word", "key").mapInArrow(task, _POSITIVE)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    key, at, letter, edit = (np.concatenate(x) for x in zip(*held, strict=True))
    columns = [pa.array(key), pa.array(at, pa.int32()), pa.array(letter, pa.int32()), pa.array(edit)]
    return pa.record_batch(columns, ["key", "at", "letter", "edit"])


def near_words(words: DataFrame, round_bytes: int = ROUND_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words of a table of :func:`with_keys` once."""
    spark = words.sparkSession
    shards = words.groupBy("size").agg(F.count("*").alias("n"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    shards = shards.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_words)))
    listed = shards.orderBy("size").collect()  # one row a word length
    letters = lambda r: [i for i in range(len(LETTERS)) if (r["low"], r["high"])[i // 45] >> (i % 45) & 1]
    lengths = [(r["size"], r["shards"], letters(r)) for r in listed]
    filters = cut_lineage(_filters(words, spark.createDataFrame([(s, k) for s, k, _ in lengths], "size int, shards long")))
    rounds, held = [], round_bytes
    for r in filters.select("size", "shard", F.length("bits").alias("bytes")).orderBy("size", "shard").collect():  # one row a filter
        if held + r["bytes"] > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append((r["size"], r["shard"]))
        held += r["bytes"]
    positives = []
    for names in rounds:
        wanted = spark.createDataFrame(names, "size int, shard long")
        own = filters.join(F.broadcast(wanted), ["size", "shard"], "left_semi").collect()  # at most round_bytes and a filter
        positives.append(_positives(words, lengths, [(r["size"], r["shard"], bytes(r["bits"])) for r in own]))
    if not positives:
        return spark.createDataFrame([], "a string, n_a long, b string, n_b long")
    found = positives[0]
    for more in positives[1:]:
        found = found.unionAll(more)
    known = words.select(F.col("key").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = found.join(known, "edit").join(words.select("key", F.col("word").alias("a"), F.col("n").alias("n_a")), "key")
    return met.where(_edited(F.col("a"), F.col("at"), F.col("letter")) == F.col("b")).select("a", "n_a", "b", "n_b")


def _edited(word: Column, at: Column, letter: Column) -> Column:
    """The word with its letter at ``at`` replaced, or left out for letter -1."""
    new = F.when(letter >= 0, F.substring(F.lit(LETTERS), letter + 1, F.lit(1))).otherwise("")
    return F.concat(F.substring(word, F.lit(1), at), new, F.substring(word, at + 2, F.length(word)))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: each round follows the way found so far twice."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut_lineage(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = now.select("word", "root")
        if not now.where("moved").limit(1).count():
            return roots


def variants(docs: DataFrame, factor: int = 10, round_bytes: int = ROUND_BYTES, shard_words: int = SHARD_WORDS, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus."""
    words = cut_lineage(with_keys(cut_lineage(count_words(docs, **counting))))
    pairs = near_words(words, round_bytes, shard_words)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))))
    both = pairs.select(ways.alias("w")).select("w.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), "other")).alias("best"))
    near = words.select("word", "n").join(best, "word", "left")
    strong = -F.col("best.m") >= F.col("n") * factor
    judged = cut_lineage(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
