"""Alignment depth: identity neighbours within an alignment and the effective sequence count."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.text import pair_matches, to_matrix
from seqloom.operators.groups import over_tasks

KEY = ["msa_id"]
STEP = 512  # rows of one block compared at a time


def alignment_shape(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Row count and shortest / longest row per alignment."""
    size = F.length("seq")
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("min_len"), F.max(size).alias("max_len")
    )


def rejects(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Alignments that have no depth: zero-width or ragged."""
    shape = alignment_shape(df, key)
    return shape.where((F.col("min_len") == 0) | (F.col("min_len") != F.col("max_len"))).withColumn(
        "reason", F.when(F.col("max_len") == 0, F.lit("zero length")).otherwise(F.lit("unequal lengths"))
    )


def _check_threshold(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("identity threshold must be between 0 and 1")


def _pair_tasks(df: DataFrame, key: list[str], block_rows: int, strict: bool) -> DataFrame:
    # Exact copies collapse to one row with a multiplicity before anything is compared; each distinct
    # row then lives in one block and meets every block of its alignment once.
    distinct = df.groupBy(*key, "seq").agg(
        F.count(F.lit(1)).alias("copies"), F.min("seq_idx").alias("rid")
    )
    shape = alignment_shape(distinct, key)
    valid = (F.col("min_len") == F.col("max_len")) & (F.col("min_len") > 0)
    if strict:
        problem = F.raise_error(F.lit("alignment rows must share one length above zero")).cast("boolean")
        shape = shape.where(F.when(valid, F.lit(True)).otherwise(problem))
    shape = shape.where(valid).select(*key, F.ceil(F.col("n_rows") / block_rows).cast("int").alias("nb"))
    block = F.pmod(F.xxhash64("seq"), F.col("nb")).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda x: F.struct(F.least(x, F.col("blk")).alias("p"), F.greatest(x, F.col("blk")).alias("q")),
    )
    return (
        distinct.join(shape, key)
        .withColumn("blk", block)
        .withColumn("task", F.explode(partners))
        .select(*key, "seq", "copies", "rid", "blk", "nb", F.col("task.p").alias("p"), F.col("task.q").alias("q"))
    )


@F.pandas_udf(T.StructType([T.StructField("near", T.ArrayType(T.LongType())), T.StructField("weight", T.DoubleType())]))
def _compare(seqs: pd.Series, copies: pd.Series, in_p: pd.Series, in_q: pd.Series, threshold: pd.Series, fold: pd.Series) -> pd.DataFrame:
    """Per block pair: for each row, the copies of rows near it in the other block (itself included).

    With ``fold`` (the alignment is one block) only the summed weight leaves the task.
    """
    near_out, weight_out = [], []
    for text, m, p, q, t, one in zip(seqs, copies, in_p, in_q, threshold, fold):
        rows, m = to_matrix(list(text)), np.asarray(m)
        left, right = np.flatnonzero(p), np.flatnonzero(q)
        near = np.zeros(len(rows), dtype=np.int64)
        same = one or np.array_equal(left, right)
        for i in range(0, len(left), STEP):
            part = left[i : i + STEP]
            hit = pair_matches(rows[part], rows[right]) / rows.shape[1] >= t
            near[part] += hit @ m[right]
            if not same:
                near[right] += m[part] @ hit
        near_out.append(None if one else near)
        weight_out.append(float((m / near).sum()) if one else None)
    return pd.DataFrame({"near": near_out, "weight": weight_out})


def _near_counts(df: DataFrame, key: list[str], threshold: float, block_rows: int, strict: bool, fold: bool) -> DataFrame:
    tasks = _pair_tasks(df, key, block_rows, strict)
    group = [*key, "nb", "p", "q"]
    packed = over_tasks(tasks, group).groupBy(*group).agg(
        F.collect_list(F.struct("seq", "copies", "rid", "blk")).alias("rows")
    )
    one = F.lit(fold) & (F.col("nb") == 1)
    in_p = F.transform(F.col("rows.blk"), lambda x: x == F.col("p"))
    in_q = F.transform(F.col("rows.blk"), lambda x: x == F.col("q"))
    measured = packed.withColumn(
        "out", _compare(F.col("rows.seq"), F.col("rows.copies"), in_p, in_q, F.lit(threshold), one)
    ).withColumn("width", F.length(F.col("rows")[0]["seq"]))
    total = F.aggregate("rows.copies", F.lit(0).cast("long"), lambda acc, c: acc + c)
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("rid"), total.alias("copies"), F.lit(0).cast("long").alias("near")))
    each = F.zip_with("rows", "out.near", lambda r, n: F.struct(r["rid"].alias("rid"), r["copies"].alias("copies"), n.alias("near")))
    parts = measured.select(
        *key, "width", F.col("out.weight").alias("weight"), F.explode(F.when(one, whole).otherwise(each)).alias("r")
    )
    return parts.groupBy(*key, F.col("r.rid").alias("rid")).agg(
        F.max("r.copies").alias("copies"),
        F.sum("r.near").alias("near"),
        F.max("width").alias("width"),
        F.sum("weight").alias("weight"),
    )


def neighbour_counts(
    df: DataFrame, threshold: float = 0.5, key: list[str] = KEY, block_rows: int = 2048
) -> DataFrame:
    """Per row, the number of other rows of its alignment with identity >= ``threshold``.

    Blocks of one alignment are compared pairwise; only counts leave a task, never pairs.
    """
    _check_threshold(threshold)
    near = _near_counts(df, key, threshold, block_rows, strict=False, fold=False)
    owner = df.groupBy(*key, "seq").agg(F.min("seq_idx").alias("rid"))
    per_text = near.select(*key, "rid", "near").join(owner, [*key, "rid"])
    return df.join(per_text.select(*key, "seq", "near"), [*key, "seq"]).select(
        *key, "seq_idx", (F.col("near") - 1).alias("n_neighbours")
    )


def neff(
    df: DataFrame,
    threshold: float = 0.5,
    key: list[str] = KEY,
    block_rows: int = 2048,
    strict: bool = False,
) -> DataFrame:
    """Effective sequence count per alignment: sum of 1 / (1 + neighbours), over sqrt(width).

    Zero-width or ragged alignments are left out (see :func:`rejects`), or raise when ``strict``.
    """
    _check_threshold(threshold)
    near = _near_counts(df, key, threshold, block_rows, strict, fold=True)
    weight = F.when(F.col("rid") < 0, F.col("weight")).otherwise(F.col("copies") / F.col("near"))
    return near.groupBy(*key).agg(
        F.sum("copies").alias("n_rows"),
        (F.sum(weight) / F.sqrt(F.max("width").cast("double"))).alias("neff"),
    )


def neff_before_after(before: DataFrame, after: DataFrame, threshold: float = 0.5, key: list[str] = KEY) -> DataFrame:
    """Depth of every alignment before and after a selection."""
    b = neff(before, threshold, key).select(*key, F.col("n_rows").alias("n_before"), F.col("neff").alias("neff_before"))
    a = neff(after, threshold, key).select(*key, F.col("n_rows").alias("n_after"), F.col("neff").alias("neff_after"))
    return b.join(a, key, "left")


def neff_table(df: DataFrame, threshold: float = 0.5, key: list[str] = KEY) -> DataFrame:
    """The project report: one row per alignment, two decimals, ordered by name then value.

    Alignments read from files are told apart by ``key=["path", "msa_id"]``: a folder may hold several.
    """
    raw = neff(df, threshold, key)
    return raw.select(
        F.col("msa_id").cast("string").alias("pdb"), F.col("neff").alias("__n")
    ).orderBy("pdb", "__n").select("pdb", F.format_string("%.2f", "__n").alias("NAD"))
