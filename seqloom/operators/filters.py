"""Row filters, the filter job and its stage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clean_repeats, sequence_entropy
from seqloom.operators.dedup import distinct_ordered, near_dedup
from seqloom.session import MAX_GROUP_ROWS

KEY = ["msa_id"]


def _length(expected: int | str | Column) -> Column:
    if isinstance(expected, Column):
        return expected
    return F.col(expected) if isinstance(expected, str) else F.lit(expected)


def exact_length(df: DataFrame, expected: int | str | Column) -> DataFrame:
    return df.where(F.length("seq") == _length(expected))


def entropy_above(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    return df.where(sequence_entropy(F.col("seq")) > threshold)


def allow_list(df: DataFrame, column: str, allowed: DataFrame | None) -> DataFrame:
    """Rows whose id is listed; no list means all rows."""
    return df if allowed is None else df.join(allowed.select(column).distinct(), column, "left_semi")


def completed(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ok")


def valid_chunks(df: DataFrame, coverage: str = "coverage", full_len: str = "full_len") -> DataFrame:
    """Adds ``chunk_len`` and leaves out chunks that are empty or longer than the sequence."""
    sized = df.withColumn("chunk_len", F.floor(F.col(coverage) * F.col(full_len)).cast("long"))
    return sized.where(F.col("chunk_len").between(F.lit(1), F.col(full_len)))


def repeat_counts(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """How many sequences the repeat cleaner changes."""
    changed = clean_repeats(F.col("seq")) != F.col("seq")
    return df.groupBy(*key).agg(F.count_if(changed).alias("n_modified"), F.count(F.lit(1)).alias("n_rows"))


def exact_length_rows(
    df: DataFrame, expected: int | str | Column, dedupe: bool = True, key: list[str] = KEY
) -> DataFrame:
    rows = exact_length(df, expected)
    return distinct_ordered(rows, key) if dedupe else rows


def exact_length_counts(df: DataFrame, expected: int | str | Column, key: list[str] = KEY) -> DataFrame:
    """Raw and valid counts before de-duplication, and the number of distinct valid rows."""
    fits = F.length("seq") == _length(expected)
    per_text = df.withColumn("__fits", fits).groupBy(*key, "__fits", F.when(F.col("__fits"), F.col("seq")).alias("__s")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    return per_text.groupBy(*key).agg(
        F.sum("__c").alias("raw_count"),
        F.sum(F.when(F.col("__fits"), F.col("__c")).otherwise(0)).alias("valid_count"),
        F.count_if("__fits").alias("distinct_count"),
    )


def _before_dedup(df: DataFrame, expected, entropy_threshold: float) -> DataFrame:
    # Cleaning never changes a length, so the cheap length test runs first.
    cleaned = exact_length(df, expected).withColumn("seq", clean_repeats(F.col("seq")))
    return entropy_above(cleaned, entropy_threshold)


def filter_rows(
    df: DataFrame,
    expected: int | str | Column,
    entropy_threshold: float = 2.0,
    similarity_threshold: float = 0.95,
    key: list[str] = KEY,
    protect_query: bool = False,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Clean repeats, keep the exact length, keep entropy > threshold, drop near-duplicates.

    The query takes part like any other row and can be altered or lost; with ``protect_query`` the
    row ``seq_idx = 0`` is added back unchanged.
    """
    # Groups are counted before the filters, which would otherwise be worked out once more for the count.
    rich = _before_dedup(df, expected, entropy_threshold)
    kept = near_dedup(rich, similarity_threshold, key, max_group_rows, counted=df.select(*key))
    if not protect_query:
        return kept
    query = df.where(F.col("seq_idx") == 0)
    return query.unionByName(kept.where(F.col("seq_idx") != 0))


def filter_report(
    df: DataFrame,
    expected: int | str | Column,
    entropy_threshold: float = 2.0,
    similarity_threshold: float = 0.95,
    key: list[str] = KEY,
) -> DataFrame:
    """Removed and remaining rows per alignment and step."""
    fits = F.length("seq") == _length(expected)
    rich = sequence_entropy(clean_repeats(F.col("seq"))) > entropy_threshold
    early = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n0"), F.count_if(fits).alias("n2"), F.count_if(fits & rich).alias("n3")
    )
    late = filter_rows(df, expected, entropy_threshold, similarity_threshold, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n4")
    )
    flat = early.join(late, key, "left").withColumn("n4", F.coalesce("__n4", F.lit(0)).cast("long"))
    steps = F.expr(
        "stack(4, 1L, 'Clean Repeats', 0L, n0, 2L, 'Length Match', n0 - n2, n2,"
        " 3L, 'Entropy Filter', n2 - n3, n3, 4L, 'Deduplicate', n3 - n4, n4)"
        " as (step_no, step, removed, remaining)"
    )
    return flat.select(*key, steps)
