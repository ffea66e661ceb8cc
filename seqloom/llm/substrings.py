"""Removing repeated word passages by fixed-block anchors.

With blocks of (window + 1) / 2 words, a window of any text holds a whole block of that text's fixed grid. So
the grid blocks are the index, and every rolling run of block length is a probe. Where a probe meets an
index block of another text, both places are anchors. Around the anchors all runs of the full window
length are gathered; a run that a text with a smaller doc_id also has is a repeat, and successive
repeats join to the maximal exact repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm import exchange as X
from seqloom.llm import kernels as K

INDEX, PROBE, WINDOWS = 1, 2, 3
WINDOW_BYTES = 8


class Runs:
    """Sorted distinct keys of a batch with the least and greatest value among each key's occurrences."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        run = keys[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(run), 1), bool), run[1:] != run[:-1])))
        self.keys = run[begin]
        self.which = np.empty(len(keys), np.int64)
        self.which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(run))))
        self.least = np.minimum.reduceat(values[order], begin) if len(begin) else values
        self.most = np.maximum.reduceat(values[order], begin) if len(begin) else values

    def other(self, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether a key occurs here with another value than the one given."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return (self.keys[place] == keys) & ((self.least[place] != values) | (self.most[place] != values))


class Batch:
    """A batch's rows and their word fingerprints, with what each step rebuilds from the answers."""

    def __init__(self, rows: pa.Table, answers: pa.Table, window: int, bits: int):
        self.rows, self.answers, self.window, self.bits = X.ordered(rows), answers, window, bits
        self.block = (window + 1) // 2
        self.number = self.rows.column("batch")[0].as_py()
        copies = X.copied(answers)
        self.doc = np.asarray(self.rows.column("doc")).astype(np.int64)
        ids = list(zip(self.rows.column("rk").to_pylist(), self.doc.tolist(), strict=True))
        # A text that a smaller doc_id has as a whole: all its windows are repeats, and it need not be searched.
        self.later = np.fromiter((i in copies and copies[i][0] < i[1] for i in ids), bool, len(ids))
        self.chunks = []
        prints, first, done = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for a, b in X.text_chunks(self.rows):
            texts = K.Texts(self.rows.column("text").slice(a, b - a))
            start, end, begin = texts.words()
            self.chunks.append((a, b))
            prints.append(K.word_prints(texts.data, start, end))
            first.append(begin[1:] + done)
            done += len(start)
        self.prints, self.first = np.concatenate(prints), np.concatenate(first)
        self.n_words = np.diff(self.first)
        self.row = K.owner(self.first)

    def places(self, width: int) -> np.ndarray:
        """Words at which ``width`` words of a searched text begin."""
        n = np.where(self.later | (self.n_words < self.window), 0, self.n_words - width + 1).clip(0)
        return K.ragged(self.first[:-1], n)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probe places, probe keys, index places, index keys)."""
        sums = K.prefix_sums(self.prints)
        at = self.places(self.block)
        keys = K.span_prints(sums, at, at + self.block)
        grid = (at - self.first[self.row[at]]) % self.block == 0 if len(at) else np.zeros(0, bool)
        return at, keys, at[grid], keys[grid]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of the windows that hold an anchor."""
        at, keys, grid_at, grid_keys = self.blocks()
        probe, index = Runs(keys, self.row[at]), Runs(grid_keys, self.row[grid_at])
        hit = index.other(keys, self.row[at]) | X.answered(self.answers, PROBE, probe.keys, self.bits)[probe.which]
        grid_hit = probe.other(grid_keys, self.row[grid_at]) | X.answered(self.answers, INDEX, index.keys, self.bits)[index.which]
        anchors = np.concatenate((at[hit], grid_at[grid_hit]))
        row = self.row[anchors]
        low = np.maximum(anchors - (self.window - self.block), self.first[row])
        high = np.minimum(anchors + 1, self.first[row + 1] - self.window + 1)
        keep = high > low
        n = len(self.prints) + 1
        marks = np.bincount(low[keep], minlength=n) - np.bincount(high[keep], minlength=n)
        start = np.flatnonzero(np.cumsum(marks) > 0)
        return start, K.span_prints(K.prefix_sums(self.prints), start, start + self.window)

    def removed(self) -> np.ndarray:
        """Mask of the removed words."""
        start, prints = self.windows()
        doc = self.doc[self.row[start]] if len(start) else np.zeros(0, np.int64)
        runs = Runs(prints, doc)
        smaller = X.answered(self.answers, WINDOWS, runs.keys, self.bits)[runs.which] | (doc > runs.least[runs.which])
        whole = np.repeat(self.later & (self.n_words >= self.window), self.n_words)
        return K.cover_counts(len(self.prints), start[smaller], self.window) | whole


def _meet(table: pa.Table, width: int) -> pa.Table:
    """Of one bucket: which probes are index blocks of another batch, and which index blocks it probes."""
    parts = list(zip(table.column("batch").to_pylist(), table.column("kind").to_pylist(), table.column("bucket").to_pylist(), [X.unpack(k, width) for k in table.column("keys").to_pylist()], strict=True))
    index = [(b, k) for b, kind, _, k in parts if kind == INDEX]
    top = np.iinfo(np.int64).max
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for _, k in index]]))

    def spread(sets: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        least, most = np.full(len(known), top), np.full(len(known), -1, np.int64)
        for batch, place, _ in sets:
            least[place] = np.minimum(least[place], batch)
            most[place] = np.maximum(most[place], batch)
        return least, most

    def locate(kind: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        out = []
        for batch, what, bucket, keys in parts:
            if what == kind:
                place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
                out.append((batch, bucket, place, hit))
        return out

    sides = {kind: locate(kind) for kind in (INDEX, PROBE)}
    bounds = {kind: spread([(batch, np.unique(place[hit]), hit) for batch, _, place, hit in rows]) for kind, rows in sides.items()}
    replies = []
    for kind, rows in sides.items():
        least, most = bounds[INDEX + PROBE - kind]
        for batch, bucket, place, hit in rows:
            flags = np.zeros(len(hit), bool)
            met = place[hit]
            flags[hit] = (most[met] >= 0) & ((least[met] != batch) | (most[met] != batch))
            replies.append((batch, kind, bucket, flags))
    return X.answer(replies)


def _least_elsewhere(table: pa.Table) -> pa.Table:
    """Of one bucket: which windows another batch holds in a text with a smaller doc_id."""
    parts = [X.unpack(k, WINDOW_BYTES) for k in table.column("keys").to_pylist()]
    docs = [np.frombuffer(e, "<i8") for e in table.column("extra").to_pylist()]
    keys, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(keys, kind="stable")
    run = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.minimum.reduceat(doc[order], begin)
    flags = np.zeros(len(keys), bool)
    flags[order] = doc[order] > np.repeat(least, np.diff(np.append(begin, len(run))))
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return X.answer([(b, WINDOWS, bucket, f) for b, bucket, f in zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), np.split(flags, cuts), strict=True)])


def remove_passages(docs: DataFrame, carry: list[str], window: int = 13, with_text: bool = False, untouched: bool = False) -> DataFrame:
    """``carry`` with n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by blanks).

    With ``untouched`` kept_text is the text as it was where nothing is removed.

    A word goes if some run of ``window`` words over it also begins in a document with a smaller doc_id; runs
    are judged on the input. Null texts have no words; texts of fewer words than a window stay whole. A row
    without doc_id counts as later than all others. Rows that share their doc_id take nothing from each
    other. An empty table gives no rows; further columns of any name play no part.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window is an odd number of words, 3 or more")
    texts = X.batched(docs, carry)
    bits, width = texts.bucket_bits, texts.filter_bytes
    schema = docs.select(*carry).schema
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_words long, n_removed long, kept_sha256 string"] + ["kept_text string"] * with_text)

    def ask_blocks(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, window, bits)
        _, keys, _, grid_keys = batch.blocks()
        return pa.concat_tables([X.request(batch.number, PROBE, np.unique(keys), bits, width), X.request(batch.number, INDEX, np.unique(grid_keys), bits, width)])

    def ask_windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, window, bits)
        start, prints = batch.windows()
        runs = Runs(prints, batch.doc[batch.row[start]] if len(start) else np.zeros(0, np.int64))
        return X.request(batch.number, WINDOWS, runs.keys, bits, WINDOW_BYTES, runs.least)

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows, answers, window, bits)
        gone = batch.removed()
        upto = np.concatenate(([0], np.cumsum(gone)))
        sha, kept_text = [], []
        for a, b in batch.chunks:
            part = K.Texts(batch.rows.column("text").slice(a, b - a))
            start, end, first = part.words()
            left = ~gone[batch.first[a] : batch.first[b]]
            size = (end - start)[left] + 1
            # Each kept word with a blank after it; the last blank of a text is left off below.
            begin = np.concatenate(([0], np.cumsum(size)))
            source = K.ragged(start[left], size)
            body = part.data[np.minimum(source, len(part.data) - 1)] if len(source) else np.zeros(0, np.uint8)
            body[begin[1:] - 1] = 32
            text_first = np.concatenate(([0], np.cumsum(left)))[first]
            at = begin[text_first].tolist()
            joined = body.tobytes()
            parts = [joined[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]
            sha += [hashlib.sha256(p).hexdigest() for p in parts]
            if with_text:
                same = upto[batch.first[a + 1 : b + 1]] == upto[batch.first[a:b]] if untouched else np.zeros(b - a, bool)
                whole = batch.rows.column("text")
                kept_text += [whole[a + i].as_py() if same[i] else p.decode("utf-8") for i, p in enumerate(parts)]
        columns = dict(zip(schema.names, batch.rows.column("row").combine_chunks().flatten(), strict=True))
        columns |= {"n_words": batch.n_words, "n_removed": np.diff(upto[batch.first]), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            columns["kept_text"] = pa.array(kept_text, pa.string())
        return pa.table(columns)

    anchors = X.ask(texts, texts.copies, ask_blocks, X.REQUEST).groupBy("bucket").applyInArrow(K.tidy_groups(lambda t: _meet(t, width)), X.ANSWER)
    known = texts.copies.unionByName(anchors)
    windows = X.ask(texts, known, ask_windows, X.REQUEST).groupBy("bucket").applyInArrow(K.tidy_groups(_least_elsewhere), X.ANSWER)
    return X.ask(texts, known.unionByName(windows), cut, fields)
