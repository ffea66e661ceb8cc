"""Exact dedup: compressed fingerprints are exchanged, only suspects' texts travel.

Each batch of rows sends its sorted distinct fingerprints, Golomb-coded, to the owners of hash ranges. An owner
answers with a bitmap of the fingerprints that another batch sent too. Rows behind such a bit, and rows whose
fingerprint occurs twice in their own batch, are suspects: their texts are shuffled and grouped by their
bytes. All other texts are read once and go nowhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import golomb
from seqloom.llm import kernels as K
from seqloom.session import cut_lineage, written

#: Rows per batch and fingerprints per owner; messages are (rows / 2^22)^2 beyond 64 of each.
BATCH_ROWS, OWNER_KEYS, LEAST_BATCHES = 1 << 22, 1 << 22, 64
#: Bits of a fingerprint beyond those that number the rows: one other text in 2^12 is a false suspect.
SPARE_BITS = 12
#: The bitmap that picks suspects' texts has 64 bits a suspect, and 16 MB at most; beyond, more texts travel, with the same result.
LEAST_BITS, MOST_BITS = 16, 27
SEGMENT_WORDS = 512

ANSWER = "batch long, bucket int, bits binary"


def _key(text: Column) -> Column:
    """What a row is found again by in the second reading."""
    return F.xxhash64(F.col("doc_id").cast("long"), text)


def _keys(prints: pa.Table, width: int) -> np.ndarray:
    return prints.column("print").to_numpy().view(np.uint64) >> np.uint64(64 - width)


def _suspects(prints: DataFrame, n: int) -> DataFrame:
    """Rows of ``prints`` whose fingerprint occurs more than once."""
    batches = max(LEAST_BATCHES, -(-n // BATCH_ROWS))
    bits = golomb.owner_bits(n, OWNER_KEYS)
    width = min(64, max(n.bit_length() + SPARE_BITS, bits + 1))
    dealt = prints.withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)))

    def send(rows: pa.Table) -> pa.Table:
        return golomb.messages(rows.column("batch")[0].as_py(), np.unique(_keys(rows, width)), width, bits)

    def reply(table: pa.Table) -> pa.Table:
        parts = [golomb.decode(k) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        run = keys[order]
        again = np.zeros(len(keys), bool)
        again[order[1:]] = run[1:] == run[:-1]
        again[order[:-1]] |= run[1:] == run[:-1]
        first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        bodies = [np.packbits(again[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(bodies, pa.binary())})

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, which, count = np.unique(_keys(rows, width), return_inverse=True, return_counts=True)
        hit = count > 1
        bodies = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for owner, a, b in golomb.owners(keys, width, bits):
            hit[a:b] |= np.unpackbits(np.frombuffer(bodies[owner], np.uint8), count=b - a).astype(bool)
        return rows.filter(pa.array(hit[which])).drop_columns(["batch"])

    answers = dealt.select("batch", "print").groupBy("batch").applyInArrow(K.tidy_groups(send), golomb.MESSAGE).groupBy("bucket").applyInArrow(K.tidy_groups(reply), ANSWER)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(K.tidy_groups(mark), prints.schema)


def _among(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` (key, ...) whose key is among the ``n`` wanted ones.

    A bitmap of the wanted keys goes to the rows first, so that few others reach the exact join.
    """
    size = min(max((64 * n).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("key", 64 - size)
    inside = F.shiftright(place, 6) % SEGMENT_WORDS
    marked = wanted.select(F.floor(place / (64 * SEGMENT_WORDS)).cast("int").alias("segment"), (place % (64 * SEGMENT_WORDS)).cast("int").alias("bit"))

    def segment(table: pa.Table) -> pa.Table:
        bits = np.zeros(64 * SEGMENT_WORDS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pa.table({"segment": table.column("segment").slice(0, 1), "words": pa.array([words], pa.list_(pa.int64()))})

    bitmap = marked.distinct().groupBy("segment").applyInArrow(segment, "segment int, words array<long>")
    near = docs.withColumn("segment", F.floor(place / (64 * SEGMENT_WORDS)).cast("int")).join(F.broadcast(bitmap), "segment")
    shift = (place % 64).cast("int")
    maybe = F.expr("shiftright(words[cast(w as int)], s) & 1") == 1
    few = near.withColumn("w", inside).withColumn("s", shift).where(maybe).select(*docs.columns)
    return few.join(wanted.select("key").distinct(), "key", "left_semi")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs`` (doc_id, text).

    Rows with byte-identical texts are a group; a null text is an empty one, and empty texts are a group like
    others. The row with the largest doc_id stays, ``keep_id`` is its doc_id. A row without doc_id stays only if no row
    of its group has one (``keep_id`` is null then), and of rows that share the largest doc_id exactly one
    stays. A text of any length is one value of a row, compared whole. An empty table gives no rows; further columns
    of any name play no part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    prints = written(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"),
            F.unhex(sha).alias("sha"), F.xxhash64(F.lit(1), text).alias("print"),
        )
    )
    n = prints.count()
    suspects = written(_suspects(prints, n))
    # Byte verification: equal texts meet as they are.
    texts = docs.select(_key(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("body"))
    groups = (
        _among(texts, suspects, suspects.count()).groupBy("body").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "group_size", "keep_id")
    )
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("doc"), (-F.col("uid")).alias("first"))
    stays = suspects.groupBy("sha").agg((-F.max(place)["first"]).alias("stays"))
    # Cut off from their aggregates, the joins stand on plain exchanges, and Spark can split a group with many rows.
    named = cut_lineage(groups.join(stays, "sha"))
    found = suspects.join(named, "sha", "left").select(
        "uid", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "keep_id", (F.col("group_size").isNull() | (F.col("uid") == F.col("stays"))).alias("kept")
    )
    grouped = F.col("group_size").isNotNull()
    return prints.join(found, "uid", "left").select(
        "doc_id",
        F.when(F.coalesce(F.col("group_size") > 1, F.lit(False)), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("kept")).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
