"""Language identification with a bit-sliced Bloom filter of character n-grams.

A slot of the filter is a row of bits, one per language; the AND of an n-gram's slots tells all languages
whose frequent n-grams hold it. A text's hits are counted per language, and the share that a filter of
that fill would hit by chance is taken off.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm import kernels as K
from seqloom.session import cut_lineage

ORDER = 4
#: Bounds of the fit: labelled texts per language, n-grams per language, slots and probes of the filter.
SAMPLE_TEXTS, GRAMS, SLOT_BITS, PROBES = 2000, 20_000, 20, 3
#: With fewer hits than this share nothing is known of the text and all languages are equal.
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    cache = K.worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return cache["letters"]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, first): hashes of the n-grams of lower-cased letters, and each text's first one (n + 1 long).

    Whatever stands between letters counts as one blank; a text begins and ends with blanks.
    """
    gap = " " * (ORDER - 1)
    lowered = [x.lower() for x in texts]
    points = np.frombuffer((gap + gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + len(gap)
    begin = np.concatenate(([0], np.cumsum(size)))
    letter = letter_table()[points]
    # Blanks stay at the start of a text and where a letter stands before them.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begin[:-1]] = True
    if len(keep):
        keep[-1] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    symbols = np.where(letter, points, 32).astype(np.uint64)[keep]
    first = kept[begin]
    n = len(symbols) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    value = np.zeros(n, np.uint64)
    for i in range(ORDER):
        value = (value << np.uint64(16)) * np.uint64(3) + symbols[i : i + n]
    # N-grams that reach over into the next text are dropped.
    last = np.maximum(first[1:] + 1 - (ORDER - 1), first[:-1])
    count = np.minimum(last, n) - np.minimum(first[:-1], n)
    index = K.ragged(first[:-1], count)
    return K.mix(value[index]), np.concatenate(([0], np.cumsum(count)))


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # uint64 (2 ** SLOT_BITS, words)
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Per n-gram the bits of the languages that hold it."""
        found = None
        for slot in _slots(grams):
            row = self.slots[slot]
            found = row if found is None else found & row
        return found

    def shares(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, languages): share of a text's n-grams in each filter, less what chance would give."""
        masks, n = self.masks(grams), np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for i in range(len(self.languages)):
            hit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            upto = np.concatenate(([0], np.cumsum(hit.astype(np.int64))))
            out[:, i] = (upto[first[1:]] - upto[first[:-1]]) / np.maximum(n, 1)
        return np.clip((out - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    step = np.uint64(SLOT_BITS)
    return [((grams >> (step * np.uint64(i))) & mask).astype(np.int64) for i in range(PROBES)]


def build_filters(grams: dict[str, np.ndarray]) -> Filters:
    languages = sorted(grams)
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    for i, name in enumerate(languages):
        for slot in _slots(grams[name]):
            slots[np.unique(slot), i // 64] |= np.uint64(1 << (i % 64))
    fill = [float(((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return Filters(languages, slots, np.array(fill) ** PROBES)


def least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """(lang, text) of the ``n`` rows of least (h, length of text) per language, from (lang, text, h).

    Counts per 12 bits, then per 12 more bits of the hash say which rows can be among them; only those meet.
    """
    hashes = cut_lineage(rows.select("lang", "h"))
    near, full = hashes, None
    for bits in (12, 24):
        bucket = F.shiftright("h", 64 - bits)
        counts = near.groupBy("lang", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
        if full is not None:
            counts = counts.join(F.broadcast(full.select("lang", "before")), "lang")
        else:
            counts = counts.withColumn("before", F.lit(0).cast("long"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy("lang").orderBy("bucket"))
        # The bucket that fills the sample; languages of fewer rows have none.
        full = counts.withColumn("upto", upto).where((F.col("upto") >= n) & (F.col("upto") - F.col("c") < n))
        full = cut_lineage(full.select("lang", F.col("bucket").alias("last"), (F.col("upto") - F.col("c")).alias("before")))
        near = hashes.join(F.broadcast(full), "lang").where(bucket == F.col("last")).select("lang", "h")
    within = hashes.join(F.broadcast(full), "lang", "left").where(F.col("last").isNull() | (F.shiftright("h", 40) <= F.col("last"))).select("lang", "h")
    placed = within.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= n)
    end = placed.groupBy("lang").agg(F.max(F.struct("h", -F.col("r"))).alias("end"), F.max("r").alias("all"))
    # Rows that share the last hash (copies of a row) have so many places left.
    bounds = end.select("lang", F.col("end.h").alias("upto"), (F.col("all") + F.col("end.col2") + 1).alias("places"))
    found = rows.join(F.broadcast(bounds), "lang").where("h <= upto")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("lang", "h").orderBy(F.length("text"))))
    return found.where("h < upto or r <= places").select("lang", "text")


def learn_filters(labelled: DataFrame, texts_per_language: int = SAMPLE_TEXTS, grams_per_language: int = GRAMS) -> Filters:
    """Filters of the most frequent n-grams per language, from (key, text, lang).

    At most ``texts_per_language`` texts, those of least key hash, are read per language; rows with a null
    text or language are left out.
    """
    sample = least_hashed(labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("key").alias("h")), texts_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            lang = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for name in sorted(set(lang)):
                grams, n = np.unique(text_grams([t for t, x in zip(texts, lang, strict=True) if x == name])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("r", rank).where(F.col("r") <= grams_per_language).select("lang", "gram").toPandas()
    return build_filters({str(k): g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in top.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, carry: list[str]) -> DataFrame:
    """``carry`` with ``lang_pred`` and ``score`` (share of the best language among the best two).

    ``und`` with score 0 is given where the text is null or has no letters, and everywhere if no language was
    learned. A text none of whose n-grams are known gets the first language with score 0.
    """
    # Plain arrays: a broadcast is read back by module name, and workers need not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.false_rate))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "lang_pred string, score double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(*shared.value)
        for batch in K.chunks(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            known = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts)) & bool(f.languages)
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if f.languages:
                share = f.shares(*text_grams(texts))
                best = share.argmax(1)
                top = share[np.arange(len(texts)), best]
                second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(texts))
                pred[known] = np.array(f.languages, object)[best[known]]
                score[known] = (top / np.maximum(top + second, 1e-12))[known]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(pred, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(predict, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents whose crc32(doc_id as text) mod 4 is not 2, and predicts all.

    Returns doc_id, held_out (that remainder is 2), lang_pred, score. A row without doc_id is never held out
    and is not learned from. Repeated rows get equal answers; further columns play no part.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    train = docs.where(~held & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), "text", "lang")
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(rows, learn_filters(train), ["doc_id", "held_out"])
