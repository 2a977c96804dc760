"""Draws from md5 of 'seed|draw|key' for all draws of a key at once, equal to ``fixtures.u`` of that text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np

_SHIFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Draws hashed together: the state then stays in a core's cache.
CHUNK = 8192


def _md5_first(words: list[np.ndarray | int], size: int) -> np.ndarray:
    """The first four bytes of the digests of single md5 blocks; a word that is the same in all blocks is an int."""
    a, b, c, d = (np.full(size, x, dtype=np.uint32) for x in _START)
    t = np.empty(size, dtype=np.uint32)
    for i in range(64):
        r = i >> 4
        if r == 0:
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif r == 1:
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif r == 2:
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            np.bitwise_not(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        m = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[r] % 16]
        if isinstance(m, int):
            np.add(t, np.uint32((m + _SINE[i]) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, m, out=t), np.add(t, np.uint32(_SINE[i]), out=t)
        s = _SHIFT[r][i % 4]
        f = a  # its place is free now
        np.left_shift(t, np.uint32(s), out=f), np.right_shift(t, np.uint32(32 - s), out=t), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b = d, c, b, f
    return (a + np.uint32(_START[0])).byteswap()


@cache
def _digits(n: int) -> list[tuple[int, int, np.ndarray]]:
    """(first draw, digits, their characters) in chunks of draws with as many digits."""
    out, k = [], 1
    while k == 1 or 10 ** (k - 1) < n:
        low, high = (0 if k == 1 else 10 ** (k - 1)), min(10**k, n)
        for at in range(low, high, CHUNK):
            d = np.arange(at, min(at + CHUNK, high))
            out.append((at, k, np.stack([d // 10 ** (k - 1 - j) % 10 + 48 for j in range(k)], axis=1).astype(np.uint8)))
        k += 1
    return out


def draws(seed: str, key: str, n: int) -> np.ndarray:
    """The first eight hexadecimal digits of md5('seed|d|key') as numbers, for d from 0 to ``n`` - 1."""
    head, tail = f"{seed}|".encode(), f"|{key}".encode()
    out = np.empty(n, dtype=np.uint32)
    for at, k, chars in _digits(n):
        size, length = len(chars), len(head) + k + len(tail)
        if length > 55:  # more than one block
            out[at : at + size] = [int.from_bytes(hashlib.md5(head + row.tobytes() + tail).digest()[:4]) for row in chars]
            continue
        first, last = len(head) // 4, (len(head) + k - 1) // 4
        block = head + b"0" * k + tail + b"\x80" + bytes(55 - length) + (8 * length).to_bytes(8, "little")
        words: list[np.ndarray | int] = [int.from_bytes(block[4 * i : 4 * i + 4], "little") for i in range(16)]
        part = np.tile(np.frombuffer(block[4 * first : 4 * last + 4], dtype=np.uint8), (size, 1))
        part[:, len(head) - 4 * first : len(head) - 4 * first + k] = chars
        for i in range(first, last + 1):
            words[i] = np.ascontiguousarray(part[:, 4 * (i - first) : 4 * (i - first) + 4]).view("<u4").ravel()
        out[at : at + size] = _md5_first(words, size)
    return out


def chunks(values: np.ndarray, size: int = 1000) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(values), size):
        yield at // size, values[at : at + size]
