"""Sorted fingerprints as Golomb codes, sent by batches to the owners of hash ranges.

A batch cuts its sorted distinct keys by their leading bits into one message per owner. In a message the
gaps between keys are Golomb-coded with a power of two as divisor: the quotients as one unary bit stream, the
remainders as one stream of fixed width, so that both are read and written by array steps. The owner answers in
the order sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_HEAD = np.dtype([("count", "<u4"), ("unary", "<u4"), ("shift", "<u4")])

MESSAGE = "bucket int, batch long, keys binary, extra binary"


def encode(keys: np.ndarray, width: int) -> bytes:
    """Sorted distinct keys below 2^width as count, lengths and the two streams."""
    n = len(keys)
    if not n:
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    # 0.69 of the mean gap is the best divisor for random keys.
    shift = max(0, width - 1 - (n.bit_length() - 1))
    quotient = (gaps >> np.uint64(shift)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    ones = np.packbits(unary)
    head = np.array([(n, len(ones), shift)], _HEAD)
    body = b""
    if shift:
        low = gaps & np.uint64((1 << shift) - 1)
        bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - shift :]
        body = np.packbits(bits).tobytes()
    return head.tobytes() + ones.tobytes() + body


def decode(message: bytes) -> np.ndarray:
    if not message:
        return np.zeros(0, np.uint64)
    n, length, shift = (int(x) for x in np.frombuffer(message, _HEAD, 1)[0])
    at = _HEAD.itemsize
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(message, np.uint8, length, at)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    if shift:
        bits = np.unpackbits(np.frombuffer(message, np.uint8, -1, at + length), count=n * shift).reshape(n, shift)
        full = np.zeros((n, 64), np.uint8)
        full[:, 64 - shift :] = bits
        gaps = (gaps << np.uint64(shift)) | np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def owners(keys: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(owner, from, to): the ranges of sorted keys below 2^width that go to each of 2^bits owners, empty ones left out."""
    owner = (keys >> np.uint64(width - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(begin, len(keys))[1:]
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        yield int(owner[a]), a, b


def messages(batch: int, keys: np.ndarray, width: int, bits: int, counts: np.ndarray | None = None) -> pa.Table:
    """Rows that send sorted distinct keys; ``counts`` gives each a number below 2^32."""
    low = np.uint64((1 << (width - bits)) - 1)
    bucket, body, extra = [], [], []
    for owner, a, b in owners(keys, width, bits):
        bucket.append(owner)
        body.append(encode(keys[a:b] & low, width - bits))
        extra.append(None if counts is None else pa.compress(counts[a:b].astype("<u4").tobytes(), "zstd", asbytes=True))
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int32()),
            "batch": pa.array([batch] * len(bucket), pa.int64()),
            "keys": pa.array(body, pa.binary()),
            "extra": pa.array(extra, pa.binary()),
        }
    )


def counts_of(extra: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(extra, 4 * n, "zstd", asbytes=True), "<u4").astype(np.int64)


def owner_bits(n: int, per_owner: int, least: int = 64) -> int:
    """Owners are a power of two with about ``per_owner`` keys each."""
    return max(least - 1, n // per_owner).bit_length()
