"""Byte-matrix helpers used inside Arrow tasks."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


CUT_BYTES = 1 << 20  # bytes of texts that are cut together


def to_matrix(seqs: list[str]) -> np.ndarray:
    """Equal-length strings as an (N, L) matrix of character codes."""
    joined = "".join(seqs)
    try:
        flat = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
    except UnicodeEncodeError:
        flat = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    return flat.reshape(len(seqs), -1)


def _planes(rows: np.ndarray, codes: np.ndarray, count: int) -> list[np.ndarray]:
    """Bit planes of the rows' letter codes, 64 columns a word: (words, n) each."""
    coded = codes[rows] if rows.dtype == np.uint8 else np.searchsorted(codes, rows)
    wide = np.zeros((len(rows), -(-rows.shape[1] // 64) * 64), np.uint8)
    out = []
    for p in range(count):
        wide[:, : rows.shape[1]] = (coded >> p) & 1
        out.append(np.ascontiguousarray(np.packbits(wide, axis=1).view(np.uint64).T))
    return out


def pair_matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(n, m) counts of equal columns.

    Letters are numbered and cut into bit planes; a word of each plane compares 64 columns of a pair at once.
    """
    width = left.shape[1]
    if left.dtype == np.uint8 and right.dtype == np.uint8:
        used = (np.bincount(left.ravel(), minlength=256) + np.bincount(right.ravel(), minlength=256)) > 0
        codes, letters = np.cumsum(used) - 1, int(used.sum())
    else:
        left, right = left.astype(np.uint32), right.astype(np.uint32)
        codes = np.unique(np.concatenate((left.ravel(), right.ravel())))
        letters = len(codes)
    count = max(letters - 1, 1).bit_length()
    a, b = _planes(left, codes, count), _planes(right, codes, count)
    unequal = np.zeros((len(left), len(right)), np.uint16 if width < 65536 else np.uint32)
    differ, part = np.empty(unequal.shape, np.uint64), np.empty(unequal.shape, np.uint64)
    for w in range(len(a[0])):
        np.bitwise_xor(a[0][w][:, None], b[0][w][None, :], out=differ)
        for x, y in zip(a[1:], b[1:], strict=True):
            np.bitwise_xor(x[w][:, None], y[w][None, :], out=part)
            differ |= part
        unequal += np.bitwise_count(differ)
    return width - unequal


def row_matches(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Equal characters of aligned pairs of equal-length strings, any mix of lengths across rows."""
    sizes = left.str.len().to_numpy(dtype=np.int64)
    if len(sizes) == 0:
        return np.zeros(0, dtype=np.int64)
    both = to_matrix([left.str.cat(), right.str.cat()])
    equal = (both[0] == both[1]).astype(np.int64)
    ends = np.cumsum(sizes)
    running = np.concatenate([[0], np.cumsum(equal)])
    return running[ends] - running[ends - sizes]


@F.pandas_udf(T.LongType())
def matches_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Equal columns of two equal-length strings (bulk form of the Hamming expression)."""
    return pd.Series(row_matches(left, right))


@F.pandas_udf(T.DoubleType())
def ratio_udf(left: pd.Series, right: pd.Series, floor: pd.Series) -> pd.Series:
    """``difflib`` similarity ratio, for pairs of unequal length only (it has no SQL form).

    Where the letters that both have in common keep the ratio from exceeding ``floor``, that bound is the result.
    """
    matcher, out = SequenceMatcher(None, "", ""), []
    for a, b, least in zip(left, right, floor):
        if not a or not b:
            out.append(0.0)
            continue
        matcher.set_seqs(a, b)
        bound = matcher.quick_ratio()
        out.append(matcher.ratio() if bound > least else bound)
    return pd.Series(out, dtype="float64")


def similarity(left: Column, right: Column, floor: float = -1.0) -> Column:
    """Identity in [0, 1] for equal lengths, the difflib ratio otherwise (a bound up to ``floor`` where it cannot exceed that)."""
    same = F.length(left) == F.length(right)
    blank = F.lit("")
    fast = matches_udf(F.when(same, left).otherwise(blank), F.when(same, right).otherwise(blank))
    slow = ratio_udf(F.when(same, blank).otherwise(left), F.when(same, blank).otherwise(right), F.lit(floor))
    return F.when(same, F.try_divide(fast.cast("double"), F.length(left))).otherwise(slow)


# Capitals for letters, the line feed for itself, 0 for all that goes.
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = _CAPITAL[97:123] = np.arange(65, 91)
_CAPITAL[10] = 10


def cut_texts(texts: pa.Array, width: int) -> pa.Array:
    """Per text the stretches of up to ``width`` letters of its lines: A to Z in capitals, all else but line feeds left out."""
    missing, texts = texts.is_null(), texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lists, pieces, lo = [np.zeros(1, np.int64)], [pa.array([], pa.string())], 0
    while lo < len(texts):
        hi = max(int(np.searchsorted(ends, ends[lo] + CUT_BYTES, side="right")) - 1, lo + 1)
        found = _CAPITAL[data[ends[lo] : ends[hi]]]
        # Letters and line feeds before each place; a stretch begins with a text, behind a line feed and every ``width`` letters.
        is_letter, feeds = found > 10, np.flatnonzero(found == 10)
        before = np.append(0, np.cumsum(is_letter, dtype=np.int64))
        texts_at = before[ends[lo : hi + 1] - ends[lo]]
        runs = np.unique(np.concatenate((texts_at, before[feeds])))
        counts = -(-np.diff(runs) // width)
        starts = np.repeat(runs[:-1], counts) + width * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        offsets = np.append(starts, before[-1]).astype(np.int32)
        pieces.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(found[is_letter])))
        lists.append(lists[-1][-1] + np.searchsorted(starts, texts_at[1:]))
        lo = hi
    made = pa.ListArray.from_arrays(pa.array(np.concatenate(lists).astype(np.int32)), pa.concat_arrays(pieces))
    return made.take(pa.array(np.arange(len(made)), mask=missing.to_numpy(zero_copy_only=False))) if missing.true_count else made


def letter_pieces(text: Column, width: int) -> Column:
    """:func:`cut_texts` as an expression."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return cut_texts(texts, width)

    return cut(text)
