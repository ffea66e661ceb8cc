"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.session import cut_lineage, written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 2
#: Up to so many sources the plan (some 50 bytes a source) goes to every task; beyond, the join is left to Spark.
MOST_BROADCAST_SOURCES = 100_000


def row_hash() -> Column:
    """60 bits of md5 over the doc_id; rows without one take the hash of their text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources in code point order, null last, take the weights in turn. A source stops at ``max_repeats``
    times its size and the excess is shared by weight among the rest; the fixed point of that is one
    water level, found by adding sources in order of the level at which they are full.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(rest)
    return (
        totals.withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * max_repeats)
        .withColumn("level", level)
        .withColumn("open", ~(F.col("weight") * F.col("level") > F.col("full")))
        .withColumn("place", F.row_number().over(by_fill))
        .withColumn("water", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"])
        .select(
            "source",
            "source_size",
            F.when(F.col("open"), F.col("weight") * F.col("water")).otherwise(F.col("full").cast("double")).alias("target"),
        )
    )


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows of the source with ``h`` up to it sum to about ``budget``.

    Words are summed by source and hash bucket; only the bucket in which the budget ends is cut into
    finer ones. What is left of it is summed by hash, and the hash in which the budget ends is taken if
    half of it or more still fits. Rows are never sorted.
    """
    found = budgets.select("source", "budget", F.lit(0).cast("long").alias("low"))
    inside = sized.select("source", "h", "size")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        order = Window.partitionBy("source").orderBy("low")
        sums = (
            inside.groupBy("source", F.shiftleft(F.shiftright("h", shift), shift).alias("low"))
            .agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(order))
        )
        edge = (
            sums.join(found.withColumnRenamed("source", "s").withColumnRenamed("low", "from"), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("budget") < F.col("upto")))
            .select("source", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget"), "low")
        )
        found = cut_lineage(edge)
        inside = inside.join(
            found.select(F.col("source").alias("s"), "low"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftleft(F.shiftright("h", shift), shift) == F.col("low")),
            "left_semi",
        )
    order = Window.partitionBy("source").orderBy("h")
    last = (
        inside.groupBy("source", "h").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(order))
    )
    cut = (
        last.join(found.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("source")
        .agg(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("budget"), F.col("h"))).alias("within"))
    )
    return found.select(F.col("source").alias("s"), "low").join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
        F.col("s").alias("source"), F.coalesce("within", F.col("low") - 1).alias("threshold")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How many words of each row the mix takes: ``size, source_size, target, taken`` beside ``carry``.

    Needs ``doc_id, text, source``. A row's size is its number of words (null text: 0). All rows of a
    source are taken floor(target / size) times, and rows whose hash lies under the source's threshold once
    more. Rows that share doc_id (or, without one, the text) share the hash, hence are taken alike. An
    empty table gives no rows; a source without words has the target 0. Further columns play no part.
    """
    sized = docs.select(
        F.struct(*carry).alias("row"),
        F.col("source").alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash().alias("h"),
    )
    # Sources, sizes and hashes are written; the rows themselves are read again at the end.
    plain = written(sized.select(F.col("src").alias("source"), "size", "h"))
    targets = cut_lineage(source_targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budgets = targets.withColumn("rounds", rounds.cast("long")).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    limits = hash_thresholds(plain, budgets)
    plan = (
        budgets.alias("b")
        .join(limits.select(F.col("source").alias("s"), "threshold"), F.col("b.source").eqNullSafe(F.col("s")), "left")
        .select(F.col("b.source").alias("of"), "source_size", "target", "rounds", "threshold")
    )
    # A source may hold a third of all rows: sent to the rows, the plan does not gather them.
    if targets.limit(MOST_BROADCAST_SOURCES + 1).count() <= MOST_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    once_more = F.coalesce((F.col("h") <= F.col("threshold")).cast("long"), F.lit(0))
    return sized.join(plan, F.col("src").eqNullSafe(F.col("of"))).select(
        "row.*", "size", "source_size", "target", (F.col("size") * (F.col("rounds") + once_more)).alias("taken")
    )
