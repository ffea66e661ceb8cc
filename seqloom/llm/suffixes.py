"""Removing repeated byte strings by blockwise suffix grouping over a difference cover.

Every text position starts a suffix. Two suffixes that agree on ``length`` bytes have a common shift below
the cover's period at which both lie on cover positions, and agree there on ``length - period + 1`` bytes
at least. So cover positions (one in eleven) are ranked first; a cover suffix whose rank is its own cannot lie in
a repeat. Only suffixes with a tied cover position ahead are then gathered, bucket by bucket, and
sorted within their bucket to find those equal over the full length. Ranks and sort keys are 61-bit
fingerprints: removal needs equality of suffixes, not their alphabetical order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm import exchange as X
from seqloom.llm import kernels as K

#: A perfect difference set: every shift modulo PERIOD is the difference of exactly one pair (fixed values).
PERIOD = 133
COVER = [1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121]
RANKS, SUFFIXES = 1, 2
SUFFIX_BYTES = 7


def cover_positions(offsets: np.ndarray, use: np.ndarray, width: int) -> np.ndarray:
    """Cover positions of the chosen texts at which ``width`` bytes follow within the text."""
    size = np.diff(offsets)
    last = np.where(use, size - width + 1, 0).clip(0)
    rounds = -(-last // PERIOD)
    text = np.repeat(np.arange(len(size)), rounds * len(COVER))
    base = np.repeat(K.ragged(np.zeros(len(size), np.int64), rounds) * PERIOD, len(COVER))
    at = base + np.tile(np.array(COVER), len(base) // len(COVER)) if len(base) else base
    inside = at < last[text]
    return (at + offsets[text])[inside]


class Batch:
    """A batch's rows with the state that its steps rebuild: cover ranks, then candidate suffixes."""

    def __init__(self, rows: pa.Table, answers: pa.Table, length: int, bits: int):
        self.rows, self.answers, self.length, self.bits = X.ordered(rows), answers, length, bits
        self.number = self.rows.column("batch")[0].as_py()
        copies = X.copied(answers)
        ids = list(zip(self.rows.column("rk").to_pylist(), self.rows.column("doc").to_pylist(), strict=True))
        size = np.asarray(K.pc.binary_length(self.rows.column("text"))).astype(np.int64)
        self.long = size >= length
        self.copied = np.fromiter((i in copies for i in ids), bool, len(ids))
        # Of equal texts only the first stands for its suffixes.
        self.stands = self.long & np.fromiter((i not in copies or copies[i][1] == i[0] for i in ids), bool, len(ids))
        self.chunks = X.text_chunks(self.rows)

    def texts(self, a: int, b: int) -> K.Texts:
        return K.Texts(self.rows.column("text").slice(a, b - a))

    def seeds(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Cover positions per chunk, their fingerprints end to end, and the number of each chunk's first."""
        width = self.length - PERIOD + 1
        places, prints = [], []
        for a, b in self.chunks:
            texts = self.texts(a, b)
            at = cover_positions(texts.offsets, self.stands[a:b], width)
            places.append(at)
            prints.append(K.span_prints(K.prefix_sums(K.byte_values(texts.data)), at, at + width))
        return places, np.concatenate([np.zeros(0, np.uint64), *prints]), np.cumsum([0, *map(len, places)])

    def tied(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        places, prints, first = self.seeds()
        keys, which, count = np.unique(prints, return_inverse=True, return_counts=True)
        return places, ((count > 1) | X.answered(self.answers, RANKS, keys, self.bits))[which], first

    def suffixes(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Candidate suffixes per chunk, their fingerprints over the full length, and each chunk's first."""
        places, tied, first = self.tied()
        found, prints = [], []
        for i, (a, b) in enumerate(self.chunks):
            texts = self.texts(a, b)
            at = places[i][tied[first[i] : first[i + 1]]]
            text = np.searchsorted(texts.offsets, at, side="right") - 1
            low = np.maximum(at - PERIOD + 1, texts.offsets[text])
            high = np.minimum(at + 1, texts.offsets[text + 1] - self.length + 1)
            keep = high > low
            n = len(texts.data) + 1
            marks = np.bincount(low[keep], minlength=n) - np.bincount(high[keep], minlength=n)
            start = np.flatnonzero(np.cumsum(marks) > 0)
            found.append(start)
            prints.append(K.span_prints(K.prefix_sums(K.byte_values(texts.data)), start, start + self.length))
        return found, np.concatenate([np.zeros(0, np.uint64), *prints]), np.cumsum([0, *map(len, found)])

    def removed(self) -> list[tuple[K.Texts, np.ndarray]]:
        """Per chunk its texts and the mask of removed bytes."""
        found, prints, first = self.suffixes()
        keys, which, count = np.unique(prints, return_inverse=True, return_counts=True)
        repeated = ((count > 1) | X.answered(self.answers, SUFFIXES, keys, self.bits))[which]
        out = []
        for i, (a, b) in enumerate(self.chunks):
            texts = self.texts(a, b)
            at = found[i][repeated[first[i] : first[i + 1]]]
            whole = np.repeat(self.copied[a:b] & self.long[a:b], np.diff(texts.offsets))
            out.append((texts, K.cover_counts(len(texts.data), at, self.length) | whole))
        return out


def remove_repeats(docs: DataFrame, carry: list[str], length: int = 200, with_text: bool = False) -> DataFrame:
    """``carry`` with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    A byte goes if some string of ``length`` bytes over it also starts elsewhere, in the same text or another;
    strings are judged on the input and never cross texts. Null texts count as empty; texts shorter than
    ``length`` stay whole. Repeated rows are copies of each other, so their text goes. What is left of a
    character that loses some of its bytes is dropped from kept_text, not from kept_sha256.
    """
    if length < PERIOD + 16:
        raise ValueError("the repeat length must leave 17 bytes or more beyond the cover's period")
    texts = X.batched(docs, carry)
    bits, width = texts.bucket_bits, texts.filter_bytes

    def ask_ranks(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, length, bits)
        return X.request(batch.number, RANKS, np.unique(batch.seeds()[1]), bits, width)

    def ask_suffixes(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, length, bits)
        return X.request(batch.number, SUFFIXES, np.unique(batch.suffixes()[1]), bits, SUFFIX_BYTES)

    schema = docs.select(*carry).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept_text string"] * with_text)

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, length, bits)
        n_bytes, n_removed, n_spans, sha, kept_text = [], [], [], [], []
        for texts_, gone in batch.removed():
            upto = np.concatenate(([0], np.cumsum(gone)))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = texts_.offsets[:-1][np.diff(texts_.offsets) > 0]
            begins[edge] = gone[edge]
            runs = np.concatenate(([0], np.cumsum(begins)))
            o = texts_.offsets
            n_bytes.append(np.diff(o))
            n_removed.append(np.diff(upto[o]))
            n_spans.append(np.diff(runs[o]))
            kept = texts_.data[~gone].tobytes()
            k = (o - upto[o]).tolist()
            parts = [kept[a:b] for a, b in zip(k[:-1], k[1:], strict=True)]
            sha += [hashlib.sha256(p).hexdigest() for p in parts]
            if with_text:
                kept_text += [p.decode("utf-8", "ignore") for p in parts]
        none = np.zeros(0, np.int64)
        columns = dict(zip(schema.names, batch.rows.column("row").combine_chunks().flatten(), strict=True))
        columns |= {"n_bytes": np.concatenate([none, *n_bytes]), "n_removed": np.concatenate([none, *n_removed]), "n_spans": np.concatenate([none, *n_spans]), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept_text, pa.string())
        return pa.table(columns)

    ranks = X.seen_by_others(X.ask(texts, texts.copies, ask_ranks, X.REQUEST), RANKS, width)
    known = texts.copies.unionByName(ranks)
    suffixes = X.seen_by_others(X.ask(texts, known, ask_suffixes, X.REQUEST), SUFFIXES, SUFFIX_BYTES)
    return X.ask(texts, known.unionByName(suffixes), cut, fields)
