"""Quality rules whose cutoffs are certified on labelled rows.

Every rule turns a text into a measure divided by a usual limit; a text's strictness score is the largest
of these. Per stratum a cutoff on the score is chosen from a fixed ladder. Going down the ladder, a step
is certified if the exact binomial tail shows, at the level ``delta`` divided by the number of strata,
that at most ``risk`` of the good texts are rejected there; the first step that fails ends the walk, so
all certified steps hold together. Of these the one that tells bad from good best is used. A stratum
without a certified step rejects nothing by the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.session import new_folder

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Usual limits of the measures: a text at the limit scores 1.
LIMITS = {"symbols": 0.1, "shouts": 0.1, "dup_lines": 0.3, "repeats": 0.3, "long_words": 15.0}
#: Cutoffs on the score, from lenient to strict.
LADDER = [round(8 * 0.8**i, 4) for i in range(16)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``n_lines`` and ``n_shouts`` (all long; null text counts as empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({"__text": body, "__words": F.array_remove(F.split(body, SPACES), "")})
    words = F.col("__words")
    n = F.size(words)
    prints = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = counted.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_shouts": F.regexp_count("__text", F.lit("!")).cast("long"),
            "__lines": lines,
            "__prints": prints,
        }
    ).drop("__text", "__words")
    # Only texts in which some window recurs go on to sort their windows.
    recurs = F.size(F.array_distinct("__prints")) < F.size("__prints")
    counted = counted.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__sorted": F.when(recurs, F.sort_array(F.transform("__prints", lambda x, i: F.struct(x.alias("x"), i.alias("at"))))),
        }
    ).drop("__lines", "__prints")
    near = F.col("__sorted")
    twice = F.filter(near, lambda r, i: (r.x == F.get(near, i - 1).x).eqNullSafe(True) | (r.x == F.get(near, i + 1).x).eqNullSafe(True))
    counted = counted.withColumn("__at", F.sort_array(F.transform(twice, lambda r: r.at))).drop("__sorted")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto")),
        lambda a, p: F.struct((a.total + p + WINDOW - F.greatest(a.upto, p)).alias("total"), (p + WINDOW).alias("upto")),
        lambda a: a.total,
    )
    return counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")


def _share(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def strictness() -> Column:
    """The largest of the rule measures over their limits."""
    measures = {
        "symbols": _share("n_symbols", "word_chars"),
        "shouts": _share("n_shouts", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "long_words": _share("word_chars", "n_words"),
    }
    return F.greatest(*[measures[k] / F.lit(v) for k, v in LIMITS.items()])


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, less the factors in between."""
    z = n.cast("double") + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5)))
    step = F.lit(1.0)
    for i in range(1, 9):
        step = step * (n.cast("double") + float(i))
    return series - F.log(step)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed from the term of k downwards until terms no longer count."""
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    # Below the mean the terms fall off within a few standard deviations.
    reach = F.least(k, F.ceil(60 * F.sqrt(k.cast("double"))) + 60)
    odds = (1 - p) / p
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), reach.cast("long")),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - i) / (n - k + i + 1) * odds).alias("term")),
        lambda a: a["sum"],
    )
    return F.when(k >= n, F.lit(1.0)).when(k > n * p, F.lit(0.5)).otherwise(F.exp(first) * sums)


def certified_cutoffs(scored: DataFrame, risk: float, delta: float, cost: float) -> DataFrame:
    """(stratum, cutoff) from rows of (stratum, good, score); see the module's head."""
    steps = F.array(*[F.lit(c) for c in LADDER])
    totals = scored.groupBy("stratum").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    # The number of leading (lenient) steps that a score does not pass tells all its rejections.
    level = F.size(F.filter(steps, lambda c: F.col("score") <= c))
    counts = scored.groupBy("stratum", level.alias("level")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    ladder = F.explode(F.transform(steps, lambda c, i: F.struct(i.alias("step"), c.alias("cutoff"))))
    walk = (
        totals.where("n_good > 0")
        .withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
        .withColumn("at", ladder)
        .join(counts.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")))
        .groupBy("stratum", "strata", "n_good", "n_bad", "at")
        .agg(
            F.coalesce(F.sum(F.when(F.col("level") <= F.col("at.step"), F.col("good"))), F.lit(0)).alias("false_rejections"),
            F.coalesce(F.sum(F.when(F.col("level") <= F.col("at.step"), F.col("bad"))), F.lit(0)).alias("true_rejections"),
        )
    )
    tested = walk.withColumn("holds", binomial_tail(F.col("false_rejections"), F.col("n_good"), risk) <= delta / F.col("strata"))
    gain = F.col("true_rejections") / F.greatest("n_bad", F.lit(1)) - cost * F.col("false_rejections") / F.col("n_good")
    lenient_first = Window.partitionBy("stratum").orderBy("at.step")
    return (
        tested.withColumn("all_hold", F.min("holds").over(lenient_first))
        .where("all_hold")
        .groupBy("stratum")
        .agg(F.max(F.struct(gain.alias("gain"), F.col("at.cutoff").alias("cutoff"))).alias("best"))
        .select("stratum", F.col("best.cutoff").alias("cutoff"))
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    carry: list[str],
    stratum: str = "lang",
    risk: float = 0.01,
    delta: float = 0.05,
    cost: float = 100.0,
) -> DataFrame:
    """Columns ``carry`` of ``docs`` with the base counts, ``base_failed``, ``score``, ``cutoff`` and ``kept``.

    ``docs`` needs ``doc_id, text`` and the stratum column; ``labels`` has (doc_id, quality 0/1). Null texts
    count as empty and fail the base rules. A document with several labels is good only if all of them are;
    null labels count for nothing; rows without doc_id take no part in calibration. A null stratum is one
    of its own. Repeated rows are judged alike. Empty tables of either kind give no rows, respectively
    no cutoffs. The measures are written once to the shared folder and read for calibration and verdict.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("row"), F.col("doc_id"), F.col("text"), F.col(stratum).alias("stratum"))
    folder = new_folder(spark)
    text_measures(rows).drop("text").write.parquet(folder)
    measured = spark.read.parquet(folder).withColumn("base_failed", base_failed()).withColumn("score", strictness())
    given = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    scored = measured.where(~F.col("base_failed")).select("doc_id", "stratum", "score").join(given, "doc_id").select("stratum", "good", "score")
    cutoffs = certified_cutoffs(scored, risk, delta, cost).withColumnRenamed("stratum", "of")
    judged = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    passes = F.coalesce(F.col("score") <= F.col("cutoff"), F.lit(True))
    return judged.select("row.*", *BASE, "n_lines", "n_shouts", "base_failed", "score", "cutoff", (~F.col("base_failed") & passes).alias("kept"))
