"""Helpers that keep large groups spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.session import MAX_GROUP_ROWS, cut_lineage

NUMBERING_BUCKET = 65536
OUTER_BUCKET = 4096  # numbering buckets that are summed up together
SALTS = 128  # parts over which a large group is dealt


def row_numbers(
    df: DataFrame, key: list[str], bucket: Column, order: list[Column], name: str = "row_no", outer: Column | None = None
) -> DataFrame:
    """0-based position of each row inside its group, without sorting a whole group in one task.

    ``bucket`` must be non-decreasing in ``order``. Rows are numbered inside (group, bucket) and
    shifted by the row count of the earlier buckets, so one task never holds more than a bucket.
    Where a group may have very many buckets, ``outer``, non-decreasing in ``bucket``, names stretches of them: the counts of a
    stretch meet in a task, and then one count per stretch.
    """
    tagged = df.withColumns({"__b": bucket} if outer is None else {"__b": bucket, "__o": outer})

    def earlier(counts: DataFrame, within: list[str], by: str, total: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(total, F.coalesce(F.sum("__c").over(before), F.lit(0)))

    if outer is None:
        counts = tagged.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__c"))
        offsets = earlier(counts, key, "__b", "__off").drop("__c")
    else:
        counts = tagged.groupBy(*key, "__o", "__b").agg(F.count(F.lit(1)).alias("__c"))
        stretches = earlier(counts.groupBy(*key, "__o").agg(F.sum("__c").alias("__c")), key, "__o", "__ahead").drop("__c")
        within = earlier(counts, [*key, "__o"], "__b", "__near").join(stretches, [*key, "__o"])
        offsets = within.select(*key, "__b", (F.col("__near") + F.col("__ahead")).alias("__off"))
        tagged = tagged.drop("__o")
    inside = Window.partitionBy(*key, "__b").orderBy(*order)
    return (
        tagged.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*key, "__b"])
        .withColumn(name, (F.col("__off") + F.col("__r") - 1).cast("long"))
        .drop("__b", "__r", "__off")
    )


def index_bucket(col: str = "seq_idx") -> Column:
    """Numbering bucket for an integer order column."""
    return F.floor(F.col(col) / F.lit(NUMBERING_BUCKET))


def salt(col: str = "seq_idx") -> Column:
    """Deals stretches of an integer order column over SALTS parts; small groups are one part."""
    return F.pmod(F.xxhash64(index_bucket(col)), F.lit(SALTS))


def with_group_values(df: DataFrame, key: list[str], values: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """``df`` with values of the whole group: each an aggregate of its parts and the one that takes these together.

    A large group is counted and joined by parts of its rows, so that it never meets in one task.
    """
    dealt = df.withColumn("__salt", salt())
    parts = dealt.groupBy(*key, "__salt").agg(*[part.alias(name) for name, (part, _) in values.items()])
    whole = Window.partitionBy(*key)
    found = parts.select(*key, "__salt", *[total(F.col(name)).over(whole).alias(name) for name, (_, total) in values.items()])
    return dealt.join(found.hint("merge"), [*key, "__salt"]).drop("__salt")


def first_n(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with a 0-based rank.

    A literal limit on row_number lets Spark cut every group to ``n`` rows per map task before the
    shuffle (window group limit), so a hot group never travels whole.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= F.lit(n))
        .withColumn(rank, (F.col("__rn") - 1).cast("long"))
        .drop("__rn")
    )


def split_by_size(
    df: DataFrame, key: list[str], limit: int = MAX_GROUP_ROWS, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``limit``, rows of larger groups or None when there are none).

    Where ``df`` is dear, ``counted`` names rows of which it holds a part and whose groups are counted in its place.
    """
    large = cut_lineage(
        (df if counted is None else counted).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*key)
    )
    if large.isEmpty():
        return df, None
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi")


def by_size(
    df: DataFrame,
    key: list[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    limit: int = MAX_GROUP_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Bounded groups go through ``small``, larger ones through ``large``; both give the same rows."""
    few, many = split_by_size(df, key, limit, counted)
    return small(few) if many is None else small(few).unionByName(large(many))


def over_tasks(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows hashed by key over the session's full number of shuffle partitions.

    Kernels do far more work per byte than a relational operator, so partitions must not be merged by
    size alone. The grouping that follows needs no further shuffle.
    """
    # Rows that a join or a grouping has dealt by this key into as many partitions would be left as they are, and these merged.
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *key)


def pack_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per bounded group: ``rows``, an array of its records sorted by ``order``."""
    rest = [c for c in df.columns if c not in key and c not in order]
    rows = F.sort_array(F.collect_list(F.struct(*order, *rest)))
    return over_tasks(df, key).groupBy(*key).agg(rows.alias("rows"))


def picked_rows(packed: DataFrame, key: list[str], picks: Column, columns: list[str]) -> DataFrame:
    """The records of ``rows`` named by an array of positions, with their place in it as ``rank``."""
    chosen = F.transform(picks, lambda i: F.get(F.col("rows"), i))
    out = packed.select(*key, F.posexplode(chosen).alias("__rank", "__row"))
    return out.select(*key, "__row.*", F.col("__rank").cast("long").alias("rank")).select(*columns, "rank")


def key_fields(df: DataFrame, key: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in key]
