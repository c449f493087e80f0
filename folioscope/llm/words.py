"""Vectorised 64-bit hashes of words and shingles over UTF-8 bytes.

Words are the runs of bytes that are not ASCII white space (9-13 and 32); upper-case ASCII letters
are lowered. A word's hash is a polynomial over its bytes modulo 2**64, finished by a mixer, so it
is the same wherever the word stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 18
_SPACES = [bytes([c]) for c in (9, 10, 11, 12, 13, 32)]
_NEXT_SPACE = re.compile(rb"[\t-\r ]")
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_buffer(data: bytes, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer, and of the first bytes of longer words."""
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    up, down = _tables(len(b))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
        starts, hashes = [start], [mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))]
        for n in prefixes:
            at = start[end - start > n]
            starts.append(at)
            hashes.append(mix((total[at + n] - total[at]) * down[at] + np.uint64(n)))
        if not prefixes:
            return start, hashes[0]
        every = np.concatenate(starts)
        order = np.argsort(every, kind="stable")
        return every[order], np.concatenate(hashes)[order]


def _long_word(data: bytes, at: int, end: int) -> np.uint64:
    """The hash of one word of any length, a piece at a time."""
    up, _ = _tables(_PIECE + 1)
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(at, end, _PIECE):
            b = np.frombuffer(data, np.uint8, min(_PIECE, end - i), i).astype(np.uint64) + np.uint64(1)
            total += (b * up[: len(b)]).sum(dtype=np.uint64) * scale
            scale *= up[_PIECE]
        return mix(np.array([total + np.uint64(end - at)]))[0]


def _hashed(data: bytes, prefixes: tuple[int, ...], heads: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and first two bytes (if wanted) of a buffer's words."""
    start, hashes = _hash_buffer(data, prefixes)
    if not heads:
        return start, hashes, start
    b = np.frombuffer(data + b"\n", np.uint8)
    second = b[start + 1]
    return start, hashes, b[start].astype(np.uint16) * np.uint16(256) + np.where(_SPACE[second], 0, second).astype(np.uint16)


def _long_text(data: bytes, prefixes: tuple[int, ...], heads: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first two bytes of a long text's words. It is cut at white space; only the hashes of
    the whole text are held at once, and a word longer than a piece is summed up by pieces."""
    found, at = [], 0
    while at < len(data):
        to = at + _PIECE
        if to < len(data):
            space = max(data.rfind(c, at, to) for c in _SPACES)
            if space < 0:
                after = _NEXT_SPACE.search(data, to)
                to = after.start() if after else len(data)
                # The word itself, then its first bytes as words of their own.
                hashes = [_long_word(data, at, to), *(_hash_buffer(data[at : at + n])[1][0] for n in prefixes)]
                found.append((np.array(hashes, np.uint64), np.full(len(hashes), data[at] * 256 + data[at + 1], np.uint16)))
                at = to
                continue
            to = space + 1
        found.append(_hashed(data[at:to], prefixes, heads)[1:])
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_hashes(texts: list[bytes], lower: bool = True, prefixes: tuple[int, ...] = (), heads: bool = False) -> Iterator:
    """The hashes of each text's words, in order; a quarter of a megabyte of text at a time, also inside
    of longer texts.

    With prefixes, the first so many bytes of longer words follow each word. With heads, each text
    gives a pair: the hashes and the words' first two bytes (the second is 0 in a word of one).
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) >= _PIECE:
            hashes, first_two = _long_text(texts[at].lower() if lower else texts[at], prefixes, heads)
            yield (hashes, first_two) if heads else hashes
            at += 1
            continue
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) < _PIECE):
            size += len(texts[to]) + 1
            to += 1
        data = b"\n".join(texts[at:to])
        start, hashes, first_two = _hashed(data.lower() if lower else data, prefixes, heads)
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        cuts = np.searchsorted(start, ends)
        before = 0
        for cut in cuts.tolist():
            yield (hashes[before:cut], first_two[before:cut]) if heads else hashes[before:cut]
            before = cut
        at = to


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words; a shorter text is one run; no words, none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < k:
            k = len(words)
        out = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            out = out * _BASE + words[j : len(words) - k + 1 + j]
        return mix(out)
