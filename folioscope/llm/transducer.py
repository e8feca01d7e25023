"""Minimal acyclic transducers over UTF-8 bytes: a term to its place among the sorted terms, and back.

Built in one pass over sorted terms: a state that no later term can reach any more is merged with an equal one.
Every arc carries the number of terms that come before those behind it, so the sum along a term's path is its
lexicographic ordinal. Arcs lie in an open-addressing table, so that all words of a text walk at the same time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of a term: letters, and every byte of a character beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Transducer:
    #: Rows of (state, byte, next state, terms before); the start is the last state.
    arcs: np.ndarray
    final: np.ndarray

    def __post_init__(self) -> None:
        bits = max(4, int(2 * len(self.arcs)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._next, self._before = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int64)
        keys = self.arcs[:, 0].astype(np.int64) << 8 | self.arcs[:, 1]
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # of several arcs at one free place one stays, the others look on
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[left[free]]
            done = self._keys[at] == keys[left]
            self._next[at[done]], self._before[at[done]] = self.arcs[left[done], 2], self.arcs[left[done], 3]
            at, left = (at[~done] + 1) & self._mask, left[~done]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self._shift).astype(np.int64)

    def _follow(self, keys: np.ndarray) -> np.ndarray:
        """Table places of the arcs, -1 where there is none."""
        at = self._slots(keys)
        met = self._keys[at]
        out = np.where(met == keys, at, -1)
        open_ = np.flatnonzero((met != keys) & (met != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            met = self._keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (met != -1)]
        return out

    def ordinals(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of each word text[start:end], -1 for words that are no terms."""
        out = np.full(len(starts), -1, np.int64)
        word, at = np.arange(len(starts)), starts
        state, place = np.full(len(starts), len(self.final) - 1, np.int64), np.zeros(len(starts), np.int64)
        while len(word):
            over = at == ends[word]
            if over.any():
                hit = over & self.final[state]
                out[word[hit]] = place[hit]
                word, at, state, place = word[~over], at[~over], state[~over], place[~over]
            arc = self._follow(state << 8 | text[at])
            on = arc >= 0
            arc = arc[on]
            word, at, state, place = word[on], at[on] + 1, self._next[arc].astype(np.int64), place[on] + self._before[arc]
        return out

    def terms(self) -> Iterator[bytes]:
        """All terms in order."""
        bounds = np.searchsorted(self.arcs[:, 0], np.arange(len(self.final) + 1))
        stack = [(len(self.final) - 1, b"")]
        while stack:
            state, term = stack.pop()
            if self.final[state]:
                yield term
            for _, byte, to, _ in self.arcs[bounds[state] : bounds[state + 1]][::-1].tolist():
                stack.append((to, term + bytes([byte])))


def build(terms: Iterable[bytes]) -> Transducer:
    """From distinct terms in byte order."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    sizes: list[int] = []  # terms accepted from a state on
    path: list[list] = [[False, [], []]]  # final, bytes, next states; of the last term's prefixes
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth:
            final, labels, to = path.pop()
            state = (final, tuple(labels), tuple(to))
            number = known.get(state)
            if number is None:
                number = known[state] = len(states)
                states.append(state)
                sizes.append(final + sum(sizes[x] for x in to))
            path[-1][2].append(number)

    for term in terms:
        same = 0
        for a, b in zip(last, term):
            if a != b:
                break
            same += 1
        fold(same + 1)
        for byte in term[same:]:
            path[-1][1].append(byte)
            path.append([False, [], []])
        path[-1][0] = True
        last = term
    fold(1)
    final, labels, to = path[0]
    states.append((final, tuple(labels), tuple(to)))
    arcs = []
    for number, (final, labels, to) in enumerate(states):
        before = int(final)
        for byte, x in zip(labels, to, strict=True):
            arcs.append((number, byte, x, before))
            before += sizes[x]
    return Transducer(np.array(arcs, np.int32).reshape(-1, 4), np.array([s[0] for s in states], bool))


def words_in(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of term bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = IN_TERM[text]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
