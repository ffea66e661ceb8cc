"""Asking all texts about all texts: batches of texts send packed fingerprints and get bits back.

Texts are dealt to batches by a hash of the row. A batch sends each of its distinct fingerprints once, cut by
the leading bits into buckets and packed into one binary per bucket, so a fingerprint reaches the
bucket's task at most once per batch however often it occurs. The task answers with one bit per
fingerprint in the order sent; the batch, whose rows stand in a fixed order, lines the bits up again.
All steps read the same exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import kernels as K
from seqloom.session import cut_lineage

#: Text bytes per batch, and per bucket of fingerprints; buckets are a power of two.
BATCH_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 16 << 20, 64

REQUEST = "bucket int, batch int, kind int, keys binary, extra binary"
ANSWER = "batch int, kind int, bucket int, bits binary"
#: Kind of the rows that name copies of whole texts.
COPY = 0


@dataclass
class Texts:
    """The batched texts: ``rows`` (batch, rk, doc_id, text, row), ``copies`` in the shape of answers."""

    rows: DataFrame
    copies: DataFrame
    bucket_bits: int
    filter_bytes: int


def order_key() -> Column:
    """doc_id with null after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def batched(docs: DataFrame, carry: list[str]) -> Texts:
    """Deals the rows to batches and finds the copies of whole texts.

    ``copies`` has one row per batch that holds copied texts: ``bits`` packs (rk, least order key of the texts'
    group) pairs of the rows whose text occurs more than once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.xxhash64(order_key(), text).alias("rk"), order_key().alias("doc"), text.alias("text"), F.struct(*[F.col(c) for c in carry]).alias("row")
    )
    small = cut_lineage(keyed.select("rk", "doc", F.md5("text").alias("digest"), F.octet_length("text").alias("size")))
    total = small.agg(F.sum("size").cast("long")).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    batch = F.pmod(F.col("rk"), F.lit(batches)).cast("int").alias("batch")
    groups = small.where("size > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"), F.min_by("rk", "doc").alias("first")).where("n > 1")
    # Cut off from its aggregate, the join stands on two plain exchanges, and Spark can split a digest with many rows.
    pairs = small.join(cut_lineage(groups.drop("n")), "digest").select(batch, F.struct("rk", "doc", "least", "first").alias("p"))
    packed = pairs.groupBy("batch").agg(F.collect_list("p").alias("p"))
    copies = packed.select("batch", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.array_join(F.transform("p", lambda p: F.concat_ws(",", p.rk, p.doc, p.least, p.first)), ";").cast("binary").alias("bits"))
    bits = max(LEAST_BUCKETS.bit_length() - 1, (total // BUCKET_BYTES).bit_length())
    # A chance hit of one in 2^8 per fingerprint or rarer.
    width = max(4, -(-(max(total, 1).bit_length() + 8 - bits) // 8))
    rows = keyed.select(batch, "rk", "doc", "text", "row").repartition(batches, "batch")
    return Texts(rows, copies, bits, width)


def ordered(table: pa.Table) -> pa.Table:
    """A batch's rows in the order that all steps use."""
    return table.take(pc.sort_indices(table, [("rk", "ascending"), ("doc", "ascending")])).combine_chunks()


def copied(answers: pa.Table) -> dict[tuple[int, int], tuple[int, int]]:
    """(rk, doc) -> (least doc, rk of the first) of the batch's rows whose text occurs more than once."""
    out = {}
    for kind, bits in zip(answers.column("kind").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if kind == COPY:
            for pair in bits.split(b";"):
                rk, doc, least, first = map(int, pair.split(b","))
                out[rk, doc] = least, first
    return out


def _pack(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The ``width`` bytes of each key that follow its bucket bits."""
    low = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width) if 8 * width + bits <= 64 else keys
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpack(body: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return full.view("<u8").ravel()


def request(batch: int, kind: int, keys: np.ndarray, bits: int, width: int, extra: np.ndarray | None = None) -> pa.Table:
    """Rows that send sorted distinct keys, one per bucket; ``extra`` holds an int64 per key."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if len(keys) else np.zeros((1 << bits) + 1, np.int64)
    body = np.ascontiguousarray(_pack(keys, bits, width))
    used = np.flatnonzero(np.diff(edges))
    more = None if extra is None else extra.astype("<i8")
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "batch": pa.array(np.full(len(used), batch), pa.int32()),
            "kind": pa.array(np.full(len(used), kind), pa.int32()),
            "keys": pa.array([body[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
            "extra": pa.array([b"" if more is None else more[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
        }
    )


def answer(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.Table:
    """Answer rows from (batch, kind, bucket, flags)."""
    return pa.table(
        {
            "batch": pa.array([r[0] for r in rows], pa.int32()),
            "kind": pa.array([r[1] for r in rows], pa.int32()),
            "bucket": pa.array([r[2] for r in rows], pa.int32()),
            "bits": pa.array([np.packbits(r[3]).tobytes() for r in rows], pa.binary()),
        }
    )


def answered(answers: pa.Table, kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The flags of a batch's sorted distinct keys, as sent."""
    flags = np.zeros(len(keys), bool)
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    mine = answers.filter(pc.equal(answers.column("kind"), kind))
    for bucket, body in zip(mine.column("bucket").to_pylist(), mine.column("bits").to_pylist(), strict=True):
        a, b = edges[bucket], edges[bucket + 1]
        flags[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
    return flags


def seen_by_others(requests: DataFrame, kind: int, width: int) -> DataFrame:
    """Answers whether another batch sent the key too."""

    def reply(table: pa.Table) -> pa.Table:
        parts = [unpack(k, width) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        run = keys[order]
        same = run[1:] == run[:-1]
        flags = np.zeros(len(keys), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        meta = zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), np.split(flags, cuts), strict=True)
        return answer([(batch, kind, bucket, f) for batch, bucket, f in meta])

    return requests.groupBy("bucket").applyInArrow(K.tidy_groups(reply), ANSWER)


def ask(texts: Texts, answers: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs ``step(rows, answers)`` for every batch."""
    return texts.rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(K.tidy_groups(step), schema)


def text_chunks(rows: pa.Table, limit: int = K.CHUNK_BYTES) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` text bytes."""
    size = np.asarray(pc.binary_length(rows.column("text"))).astype(np.int64)
    total = np.cumsum(size)
    out, at = [], 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        out.append((at, to))
        at = to
    return out
