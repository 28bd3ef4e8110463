"""Pseudo-random draws from hashes of keys: the same on every run and partitioning, and in any engine that has MD5."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = float(1 << 32)


def _word(key: Column, at: int) -> Column:
    return (F.conv(F.substring(key, at, 8), 16, 10).cast("double") + 0.5) / F.lit(WORD)


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 32 bits of the hash of the parts."""
    return _word(hashed(*parts), 1)


def normal(*parts: Column) -> Column:
    """A standard normal by the Box-Muller transform of 64 bits."""
    key = hashed(*parts)
    return F.sqrt(-2 * F.log(_word(key, 1))) * F.cos(2 * math.pi * _word(key, 9))


def uniform_sql(*parts: str) -> str:
    """``uniform`` for DuckDB."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint + 0.5) / {WORD})"


def normal_sql(*parts: str) -> str:
    key = f"md5(concat_ws('|', {', '.join(parts)}))"
    word = lambda at: f"((('0x' || substr({key}, {at}, 8))::bigint + 0.5) / {WORD})"
    return f"(sqrt(-2 * ln({word(1)})) * cos(2 * pi() * {word(9)}))"


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_PICKED = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16] for i in range(64)]


def md5_words(before: bytes, middles: np.ndarray, after: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words, as their hex digits read, of the MD5 of before + middle + after for middles of equal length
    (rows of bytes), all rows at once. Messages of more than one block are hashed one by one."""
    n, size = len(middles), len(before) + middles.shape[1] + len(after)
    if size > 55:
        keys = [hashlib.md5(before + m.tobytes() + after, usedforsecurity=False).digest() for m in middles]
        words = np.frombuffer(b"".join(keys), ">u4").reshape(n, 4)
        return words[:, 0], words[:, 1]
    fixed = bytearray(before + bytes(middles.shape[1]) + after + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    block = [np.uint32(w) for w in np.frombuffer(bytes(fixed), "<u4")]
    for i in range(middles.shape[1]):
        word, byte = divmod(len(before) + i, 4)
        block[word] = block[word] | (middles[:, i].astype(np.uint32) << np.uint32(8 * byte))
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v, np.uint32) for v in start)
    for i in range(64):
        kind = i // 16
        mixed = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
        mixed += a
        mixed += block[_PICKED[i][kind]] + np.array(_SINES[i], np.uint32)
        turn = int(_TURNS[kind, i % 4])
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn)))
    return (a + start[0]).byteswap(), (b + start[1]).byteswap()


def normals(before: bytes, middles: np.ndarray, after: bytes) -> np.ndarray:
    """``normal`` of keys that are alike but for their middles."""
    one, two = md5_words(before, middles, after)
    return np.sqrt(-2 * np.log((one + 0.5) / WORD)) * np.cos(2 * math.pi * ((two + 0.5) / WORD))
