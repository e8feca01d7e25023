"""Words and hashed word runs of whole texts, vectorised over bounded pieces of bytes.

A word is a run of bytes outside space and ``\\t\\n\\v\\f\\r``. Word hashes are 64-bit linear forms over the
bytes, finished with a bijective mix; runs of words are hashed the same way over their words' hashes. Two
different runs meet with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; bounds the temporary arrays (about 80 bytes each) whatever the text's length.
PIECE_BYTES = 1 << 18

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = max(n, PIECE_BYTES + 64)
        _POW["up"], _POW["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW["up"], _POW["down"]


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words of letters alone: every ASCII byte that is no letter ends a word.
_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[128:] = _NO_LETTER[65:91] = _NO_LETTER[97:123] = False


def _hash_piece(buf: np.ndarray, codes: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in one piece of bytes."""
    word = np.empty(len(buf) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~gaps[buf]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, _U), starts, ends
    up, down = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(codes[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + _U(1)), starts, ends


def word_hashes(text: bytes, fold: bool) -> np.ndarray:
    """Hashes of a whole text's words; ``fold`` lower-cases A-Z."""
    codes, out, at = (_FOLDED if fold else _BYTE), [], 0
    while at < len(text):
        end = min(len(text), at + PIECE_BYTES)
        buf = np.frombuffer(text, np.uint8, end - at, at)
        if end < len(text):  # cut before a word that may go on
            gaps = np.flatnonzero(_SPACE[buf[-4096:]])
            if not len(gaps):
                gaps = np.flatnonzero(_SPACE[buf])
                base = 0
            else:
                base = len(buf) - min(4096, len(buf))
            if len(gaps):
                end = at + base + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                end = at + _word_end(text, at)
            buf = np.frombuffer(text, np.uint8, end - at, at)
        out.append(_hash_piece(buf, codes)[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, _U)


def _word_end(text: bytes, at: int) -> int:
    """Bytes from ``at`` to the first white space after it."""
    size = PIECE_BYTES
    while at + size < len(text):
        gaps = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, size, at)])
        if len(gaps):
            return int(gaps[0]) + 1
        size *= 2
    return len(text) - at


def batches(texts: list[bytes | None], fold: bool) -> Iterator[np.ndarray]:
    """Word hashes of each text in order; small texts are hashed together."""
    codes, group, held = (_FOLDED if fold else _BYTE), [], 0
    for text in texts:
        text = text or b""
        if len(text) > PIECE_BYTES // 2:
            yield from _together(group, codes)
            group, held = [], 0
            yield word_hashes(text, fold)
            continue
        if held + len(text) + 1 > PIECE_BYTES:
            yield from _together(group, codes)
            group, held = [], 0
        group.append(text)
        held += len(text) + 1
    yield from _together(group, codes)


def _together(group: list[bytes], codes: np.ndarray) -> Iterator[np.ndarray]:
    if not group:
        return
    hashes, starts, _ = _hash_piece(np.frombuffer(b" ".join(group), np.uint8), codes)
    at = np.cumsum([0] + [len(t) + 1 for t in group])
    cut = np.searchsorted(starts, at)
    for i in range(len(group)):
        yield hashes[cut[i] : cut[i + 1]]


def letter_words(text: bytes, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes of a text's lower-cased words of letters, and of the longer ones' first so many bytes.

    Taken in pieces cut at any byte, so at most one word a piece is split.
    """
    out = []
    for at in range(0, len(text), PIECE_BYTES):
        buf = np.frombuffer(text, np.uint8, min(PIECE_BYTES, len(text) - at), at)
        hashes, starts, ends = _hash_piece(buf, _FOLDED, _NO_LETTER)
        out.append(hashes)
        codes = _FOLDED[np.r_[buf, np.zeros(8, np.uint8)]]
        for n in prefixes:
            first = starts[ends - starts > n]
            total = np.full(len(first), n, _U)
            for i in range(n):
                total += codes[first + i] * _tables(n)[0][i]
            out.append(mix(total))
    return np.concatenate(out) if out else np.empty(0, _U)


def runs(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words; none when there are fewer."""
    n = len(words)
    if n < k:
        return np.empty(0, _U)
    if k <= 8:
        out, up = np.zeros(n - k + 1, _U), _tables(k)[0]
        for i in range(k):
            out += words[i : n - k + 1 + i] * up[i]
    else:
        up, down = _tables(n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(words * up[:n], out=total[1:])
        out = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
    return mix(out + _U(2 * salt + 1))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles: runs of ``k`` words, or the whole sequence when it is shorter."""
    if not len(words):
        return np.empty(0, _U)
    return np.unique(runs(words, min(k, len(words)), salt=min(k, len(words))))
