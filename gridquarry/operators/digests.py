"""First four bytes of MD5 digests of many short texts at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = np.array([math.floor(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Bytes that a block takes beside its padding.
BLOCK = 55


def _first_word(words: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The digests' first words, of one block each; words that are not there are 0."""
    a, b, c, d = (np.full(n, s) for s in START)
    t, high = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        f = np.empty_like(t) if k == 0 else a_free
        if k < 16:
            at = k
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k < 32:
            at = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k < 48:
            at = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * k % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, SINES[k], out=f)
        if at in words:
            np.add(f, words[at], out=f)
        np.right_shift(f, np.uint32(32 - TURNS[k]), out=high), np.left_shift(f, np.uint32(TURNS[k]), out=f)
        np.bitwise_or(f, high, out=f), np.add(f, b, out=f)
        a_free, a, d, c, b = a, d, c, b, f
    return a + START[0]


def heads(texts: np.ndarray, ends: list[str]) -> Iterator[np.ndarray]:
    """For each of ``ends`` the first 8 hex digits, as an integer, of the MD5 digests of each text (bytes) followed by it."""
    lengths = np.array([len(t) for t in texts])
    room = np.zeros((len(texts), 64), np.uint8)
    groups = [(int(length), np.flatnonzero(lengths == length)) for length in np.unique(lengths)]
    for length, at in groups:
        if length <= BLOCK:
            room[at, :length] = np.frombuffer(b"".join(texts[at]), np.uint8).reshape(len(at), length)
    for end in (e.encode() for e in ends):
        long = []
        for length, at in groups:
            whole = length + len(end)
            if whole > BLOCK:
                long.append(at)
                continue
            tail = np.zeros(64 - length, np.uint8)
            tail[: len(end) + 1] = np.frombuffer(end + b"\x80", np.uint8)
            tail[-8:-6] = [whole * 8 & 255, whole * 8 >> 8]
            room[at, length:] = tail
        words = room.view("<u4").T
        out = _first_word({k: np.ascontiguousarray(w) for k, w in enumerate(words) if w.any()}, len(texts)).byteswap()
        for at in long:
            out[at] = [int.from_bytes(hashlib.md5(t + end).digest()[:4], "big") for t in texts[at]]
        yield out
