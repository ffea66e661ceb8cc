"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacities.

Pieces of equal length are interchangeable, so the packing is planned on the histogram of lengths, which
has at most ``capacity`` rows whatever the corpus: whole runs of equal pieces go to whole runs of bins of
equal remaining capacity. The plan is exactly what placing piece by piece would give. Rows then find their
place in the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm import kernels as K
from seqloom.session import cut_lineage

CAPACITY = 4096
#: Units kept in a task's table of encoded units before it is begun anew, and slots of that table.
KNOWN_UNITS, SLOT_BITS = 1 << 19, 20
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


def text_units(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, whole, first): the runs of bytes that are encoded on their own.

    Words of plain ASCII and Latin-1 letters are lower-cased here and cut into letter runs, digits and other
    runs, as the vocabulary's own rule cuts them. Any other word is a unit as it stands (``whole``) and
    goes through the tokenizer with its own rules.
    """
    raw = texts.data
    start, end, first = texts.words()
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(0, bool), first
    after_c3 = np.zeros(len(raw), bool)
    after_c3[1:] = raw[:-1] == 0xC3
    odd = ((raw >= 0x80) & (raw != 0xC3) & ~after_c3) | (after_c3 & ((raw == 0x97) | (raw == 0xB7)))
    odd |= ((raw < 0x20) & ~K.is_space()[raw]) | (raw == 0x7F) | (raw == ord("'"))
    odd[1:] |= (raw[1:] == ord("|")) & (raw[:-1] == ord("<"))
    upto = np.concatenate(([0], np.cumsum(odd)))
    whole_word = upto[end] > upto[start]
    in_whole = np.zeros(len(raw) + 1, np.int8)
    in_whole[start[whole_word]] += 1
    in_whole[end[whole_word]] -= 1
    plain = np.cumsum(in_whole[:-1], dtype=np.int8) == 0
    lower = K.lower_ascii(raw)
    lower[after_c3 & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
    data = np.where(plain, lower, raw)
    kind = np.full(256, 3, np.int8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[0x80:] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kinds = kind[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    begins &= plain & (kinds > 0)
    begins[start] = True
    at = np.flatnonzero(begins)
    word_end = np.zeros(len(data) + 1, bool)
    word_end[end] = True
    # A unit ends where the next one of its word begins, or with the word.
    ends = np.flatnonzero((np.append(begins, False) & np.append(False, kinds > 0)) | word_end)
    ends = ends[ends > 0] if len(at) else ends
    count = np.concatenate(([0], np.cumsum(begins)))
    return data, at, ends, ~plain[at] if len(at) else np.zeros(0, bool), count[np.append(start, len(data))][first] if len(start) else np.zeros(len(first), np.int64)


class UnitIds:
    """Token ids of units, each encoded once per task and found again by fingerprint."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.full = path, None
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.clear()

    def clear(self) -> None:
        self.bits = SLOT_BITS
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.where = np.zeros(1 << SLOT_BITS, np.int32)
        self.n = 0
        self.at = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def find(self, prints: np.ndarray) -> np.ndarray:
        """Number of each fingerprint in the table, or -1."""
        out = np.full(len(prints), -1, np.int64)
        slot = (prints >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == prints
        out[hit] = self.where[slot[hit]]
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            key = self.keys[slot[open_]]
            hit = key == prints[open_]
            out[open_[hit]] = self.where[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def insert(self, prints: np.ndarray) -> None:
        if self.n + len(prints) > len(self.keys) // 2:
            # Only a chunk with more distinct units than the usual table holds comes here; the table is empty then.
            self.bits = (2 * len(prints)).bit_length()
            self.keys, self.where = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        number = np.arange(self.n, self.n + len(prints), dtype=np.int32)
        slot = (prints >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(prints))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = prints[free]
            won = free[self.keys[slot[free]] == prints[free]]
            self.where[slot[won]] = number[won]
            left = left[self.keys[slot[left]] != prints[left]]
            slot[left] = (slot[left] + 1) % len(self.keys)
        self.n += len(prints)

    def learn(self, prints: np.ndarray, units: list[bytes], whole: np.ndarray) -> None:
        if self.full is None and whole.any():
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        found = [(self.full if w else self.bare).encode(u.decode("utf-8"), add_special_tokens=False).ids for u, w in zip(units, whole.tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        for name, need in (("at", self.n + len(size)), ("size", self.n + len(size)), ("ids", self.used + len(ids))):
            if len(getattr(self, name)) < need:
                setattr(self, name, np.concatenate((getattr(self, name), np.zeros(need, getattr(self, name).dtype))))
        self.at[self.n : self.n + len(size)] = self.used + np.concatenate(([0], np.cumsum(size)[:-1]))
        self.size[self.n : self.n + len(size)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.insert(prints)

    def encode(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts end to end, and where each text's ids begin."""
        data, start, end, whole, first = text_units(texts)
        prints = np.maximum(K.word_prints(data, start, end), np.uint64(1))
        number = self.find(prints)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, example = np.unique(prints[missing], return_index=True)
            example = missing[example]
            if self.n + len(fresh) > KNOWN_UNITS and self.n:
                self.clear()
                return self.encode(texts)
            body = data.tobytes()
            self.learn(fresh, [body[a:b] for a, b in zip(start[example].tolist(), end[example].tolist(), strict=True)], whole[example])
            number[missing] = self.find(prints[missing])
        size = self.size[number]
        ids = self.ids[K.ragged(self.at[number], size)]
        before = np.concatenate(([0], np.cumsum(size)))
        return ids, before[first]


def token_pieces(docs: DataFrame, carry: list[str], tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: ``carry``, piece, start, length, ids_crc32 (and ids).

    A text's tokens are its ids and ``end_id``; a null text is an empty one, hence one piece of one token.
    Longer texts are cut at multiples of the capacity.
    """
    rows = docs.select(*[F.col(c) for c in carry], F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), PIECE_SCHEMA] + ["ids array<int>"] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a task's life: a worker that goes on to other work does not keep the tables.
        encoder = UnitIds(tokenizer)
        for batch in K.chunks(batches, "__text"):
            ids, first = encoder.encode(K.Texts(batch.column("__text")))
            n = batch.num_rows
            total = np.diff(first) + 1
            full = np.insert(ids, first[1:], np.uint32(end_id)) if n else ids
            begins = first[:-1] + np.arange(n)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(n), pieces)
            piece = K.ragged(np.zeros(n, np.int64), pieces)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            body = memoryview(full.astype("<u4").tobytes())
            at = begins[row] + start
            crc = [zlib.crc32(body[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(c).take(pa.array(row)) for c in carry]
            columns += [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = [*carry, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate((at, [len(full)])).astype(np.int32)), pa.array(full.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(K.tidy(cut), schema)


class CapacityTree:
    """Counts of open bins by remaining capacity; finds the tightest that still fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that some open bin has."""
        node = need + self.leaves
        if self.count[node]:
            return need
        # Up to the first right neighbour that holds bins, then down to its least leaf.
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset) of best-fit decreasing over a histogram."""
    tree, groups, bins, plan = CapacityTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[remaining].pop()
                tree.add(remaining, -n)
            each = min(remaining // length, left)
            used = min(n, left // each)
            plan.append((length, rank, first, each, capacity - remaining))
            rank += used * each
            left -= used * each
            for rest, start, m in ((remaining - each * length, first, used), (remaining, first + used, n - used)):
                if m and rest:
                    groups.setdefault(rest, []).append((start, m))
                    tree.add(rest, m)
    return np.array(plan, np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Equal rows may change places with each other. Only the length histogram (at most ``capacity`` rows)
    and its plan come to the driver.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    keys = (plan[:, 0] << 44) + plan[:, 1]
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], plan[order]))
    # Pieces of one length are ranked in salted parts, which the offsets of the parts put end to end.
    salts = max(64, sum(counts.values()) // 1_000_000)
    names = pieces.columns
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    )
    inside = Window.partitionBy("length", "__salt").orderBy(*names)
    ranked = (
        salted.withColumn("__rank", F.row_number().over(inside)).join(parts, ["length", "__salt"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__before"))
    ).select(*names, "__rank")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, plan = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            k = rank - row[:, 1]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(K.tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, carry: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Documents cut into pieces and packed into sequences of at most ``capacity`` tokens.

    Repeated rows are packed as often as they occur; an empty table gives no rows. ``carry`` names the
    columns kept beside the piece; others, whatever their names, play no part.
    """
    return pack_pieces(cut_lineage(token_pieces(docs, list(carry), tokenizer, capacity, end_id)), capacity)
