"""Cuts texts into segments whose tokens do not depend on what stands around them.

The pattern of the byte-level vocabularies lets a space begin a token only directly after another white space
or as the single space before a word, and no token reaches over a line feed between two words. A text whose
white space is single spaces and line feeds between words can thus be cut there; every other text is given
as its single pre-tokens.

The segments of many texts are cut, told apart and laid out again as Arrow arrays; Python sees each distinct
one of them once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

#: White space that is not one space or line feed between two words.
_IRREGULAR = re.compile(r"\s(?:(?<![ \n])|(?=\s)|\Z|(?<=\A\s))")

#: Segments kept in each of two generations, and the bytes of the longest that is kept; both only bound memory.
CACHE_ENTRIES = 300_000
CACHE_BYTES = 128


class Segments(dict):
    """Bytes of the ids by segment. ``encode`` gives those of segments that are not held."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def ids(self, segments: list[bytes]) -> list[bytes]:
        """Ids of each of some distinct segments."""
        out = list(map(self.get, segments))
        missing = [i for i, ids in enumerate(out) if ids is None]
        unknown = []
        for i in missing:
            out[i] = self.old.get(segments[i])
            if out[i] is None:
                unknown.append(i)
        for i, ids in zip(unknown, self.encode([segments[i] for i in unknown]), strict=True):
            out[i] = ids
        self.keep({segments[i]: out[i] for i in missing if len(segments[i]) <= CACHE_BYTES})
        return out

    def keep(self, more: dict[bytes, bytes]) -> None:
        """Add segments; a full generation becomes the old one, so that frequent ones move on."""
        if len(self) + len(more) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self.update(more)


class Splitter:
    """Whole texts to the bytes of their ids, through the ids of their segments."""

    def __init__(self, pattern: str, encode: Callable[[list[bytes]], list[bytes]], uncut: list[str] = ()) -> None:
        """A text that holds one of the strings ``uncut`` is one segment."""
        self.pattern, self.uncut = regex.compile(pattern), uncut
        self.segments = Segments(encode)

    def __call__(self, texts: list[str | None]) -> pa.LargeBinaryArray:
        """The bytes of each text's ids; null counts as empty."""
        data, cuts, at = self._cut(texts)
        if not data:
            return pa.array([b""] * len(texts), pa.large_binary())
        buffers = [None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(data)]
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        ids = pa.array(self.segments.ids(cut.dictionary.to_pylist()), pa.large_binary())
        return joined(ids.take(cut.indices), np.searchsorted(cuts, at))

    def _cut(self, texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all segments, where each begins (and the last ends), and where each text begins in them."""
        parts: list[bytes] = []
        single: dict[int, list[int] | None] = {}
        for i, text in enumerate(texts):
            text = text or ""
            if any(x in text for x in self.uncut):
                single[i] = []
            elif _IRREGULAR.search(text):
                words = [m.group().encode() for m in self.pattern.finditer(text)]
                single[i] = list(map(len, words))
                parts.append(b"".join(words))
                continue
            parts.append(text.encode())
        data = b"".join(parts)
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        begins = np.zeros(len(data) + 1, bool)
        raw = np.frombuffer(data, np.uint8)
        feeds = np.flatnonzero(raw == 10)
        begins[:-1] = raw == 32
        begins[feeds] = begins[feeds + 1] = True
        for i, sizes in single.items():
            begins[at[i] : at[i + 1]] = False
            if sizes:
                begins[at[i] + np.cumsum(sizes[:-1], dtype=np.int64)] = True
        begins[at] = True
        return data, np.flatnonzero(begins), at


def joined(values: pa.LargeBinaryArray, at: np.ndarray) -> pa.LargeBinaryArray:
    """The values ``at[i]`` to ``at[i + 1]`` of an array without nulls as one value each."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, "<i8")[at + values.offset]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends), data])


_kept: dict[str, tuple] = {}


def kept(kind: str, key: tuple, make: Callable[[], object]) -> object:
    """``make()`` once a worker process: what one task has encoded is known to the next. One object a kind is kept."""
    if kind not in _kept or _kept[kind][0] != key:
        _kept[kind] = (key, make())
    return _kept[kind][1]
