"""Repeatable randomness: every draw is a hash of the row's own keys, so retries change nothing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of more letters than this are hashed by Spark's own expressions, so that a batch of long rows stays small.
BULK_PLACES = 4096
# Places hashed at a time: about what fits a core's cache.
BULK_CELLS = 1 << 14


def hash_uniform(*keys: Column, seed: int = 0) -> Column:
    """A double in [0, 1): the first 32 bits of md5 over ``k1:k2:...:seed``."""
    parts = [k.cast("string") for k in keys] + [F.lit(str(seed))]
    head = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(n: Column, *keys: Column, seed: int = 0) -> Column:
    """A uniform integer in [0, n)."""
    return F.floor(hash_uniform(*keys, seed=seed) * n).cast("long")


def hash_gauss(*keys: Column, seed: int = 0) -> Column:
    """A standard normal draw (Box-Muller over two uniforms; the first is kept above zero)."""
    u1 = hash_uniform(*keys, F.lit("r"), seed=seed)
    u2 = hash_uniform(*keys, F.lit("a"), seed=seed)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def key_prefix(*keys: Column) -> Column:
    """What precedes the next key in the text that :func:`hash_uniform` hashes."""
    return F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(""))


# --- Many draws per row ---------------------------------------------------------------------------

_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(messages: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of each row of an (n, length) matrix of bytes, as numbers."""
    n, length = messages.shape
    blocks = (length + 8) // 64 + 1
    padded = np.zeros((n, blocks * 64), np.uint8)
    padded[:, :length] = messages
    padded[:, length] = 0x80
    padded[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    if not n:
        return np.empty(0, np.uint32)
    words = np.ascontiguousarray(padded.view("<u4").T)
    same = (words == words[:, :1]).all(axis=1)
    state, mixed, turned = [np.full(n, x, np.uint32) for x in _START], np.empty(n, np.uint32), np.empty(n, np.uint32)
    for block in range(blocks):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=mixed)
                mixed &= b
                mixed ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=mixed)
                mixed &= d
                mixed ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=mixed)
                mixed ^= d
            else:
                np.invert(d, out=mixed)
                mixed |= b
                mixed ^= c
            at = block * 16 + _WORDS[i]
            mixed += a
            # Words that all messages share go with the step's constant.
            mixed += np.uint32((_SINES[i] + (int(words[at, 0]) if same[at] else 0)) & 0xFFFFFFFF)
            if not same[at]:
                mixed += words[at]
            np.left_shift(mixed, np.uint32(_TURNS[i]), out=turned)
            mixed >>= np.uint32(32 - _TURNS[i])
            mixed |= turned
            np.add(mixed, b, out=a)
            a, b, c, d = d, a, b, c
        for x, y in zip(state, (a, b, c, d), strict=True):
            x += y
    return state[0].byteswap()


def single_uniform(message: str) -> float:
    return int.from_bytes(hashlib.md5(message.encode()).digest()[:4], "big") / 4294967296.0


def _place_heads(prefixes: np.ndarray, suffix: bytes, lo: int, hi: int) -> np.ndarray:
    """(rows, hi - lo) heads of prefix + place + suffix; all places have the same number of digits."""
    digits = np.array([list(str(i).encode()) for i in range(lo, hi)], np.uint8)
    (n, ahead), (m, d) = prefixes.shape, digits.shape
    text = np.empty((n, m, ahead + d + len(suffix)), np.uint8)
    text[:, :, :ahead] = prefixes[:, None, :]
    text[:, :, ahead : ahead + d] = digits
    text[:, :, ahead + d :] = np.frombuffer(suffix, np.uint8)
    return md5_heads(text.reshape(n * m, -1)).reshape(n, m)


def place_draws(prefixes: np.ndarray, rows: np.ndarray, places: np.ndarray, suffix: str) -> np.ndarray:
    """The uniforms of prefix + place + suffix for single places, each of a row of the (n, length) matrix of prefix bytes."""
    tail = np.frombuffer(suffix.encode(), np.uint8)
    out, ahead = np.empty(len(places)), prefixes.shape[1]
    digits = np.searchsorted(10 ** np.arange(1, 19), places, side="right") + 1
    for d in np.unique(digits):
        at = np.flatnonzero(digits == d)
        text = np.empty((len(at), ahead + d + len(tail)), np.uint8)
        text[:, :ahead] = prefixes[rows[at]]
        for k in range(d):
            text[:, ahead + k] = places[at] // 10 ** int(d - 1 - k) % 10 + ord("0")
        text[:, ahead + d :] = tail
        out[at] = md5_heads(text) / 4294967296.0
    return out


def place_groups(prefixes: list[str], counts: np.ndarray, suffix: str) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of alike rows: their numbers, the bytes of their prefixes, and the uniforms of prefix + place + suffix for the
    places from 0 to the largest count among them."""
    encoded, tail = [p.encode() for p in prefixes], suffix.encode()
    order = sorted(range(len(encoded)), key=lambda r: (len(encoded[r]), counts[r]))
    at = 0
    while at < len(order):
        # Rows of equal prefix length and similar count go through together.
        size, least, end = len(encoded[order[at]]), max(int(counts[order[at]]), 1), at + 1
        while end < len(order) and len(encoded[order[end]]) == size and counts[order[end]] <= 2 * least and (end - at) * least < BULK_CELLS:
            end += 1
        rows, at = order[at:end], end
        most = int(counts[rows[-1]])
        heads = np.frombuffer(b"".join(encoded[r] for r in rows), np.uint8).reshape(len(rows), size)
        cuts = [0, *[10**k for k in range(1, 19) if 10**k < most], most]
        found = [_place_heads(heads, tail, lo, hi) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]
        yield rows, heads, np.concatenate(found, axis=1) / 4294967296.0 if found else np.empty((len(rows), 0))


def place_uniforms(prefixes: list[str], counts: np.ndarray, suffix: str) -> list[np.ndarray]:
    """Per row the uniforms of prefix + place + suffix for the places from 0 to its count."""
    out: list[np.ndarray] = [np.empty(0)] * len(prefixes)
    for rows, _, drawn in place_groups(prefixes, counts, suffix):
        for r, values in zip(rows, drawn):
            out[r] = values[: counts[r]]
    return out


def place_gauss(prefixes: list[str], counts: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Per row the draws of :func:`hash_gauss` for the keys of its prefix and the places from 0 to its count."""
    length, angle = (place_uniforms(prefixes, counts, f":{c}:{seed}") for c in "ra")
    return [np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(2.0 * math.pi * v) for u, v in zip(length, angle, strict=True)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gauss_udf(prefix: pd.Series, count: pd.Series, seed: pd.Series) -> pd.Series:
    # The seed is the same for all.
    return pd.Series(place_gauss(prefix.tolist(), count.to_numpy(np.int64), int(seed.iloc[0])) if len(prefix) else [], dtype=object)
