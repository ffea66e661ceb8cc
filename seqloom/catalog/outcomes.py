"""Result tables and progress streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog import bindings as b
from seqloom.catalog.registry import query
from seqloom.operators import filters, results
from seqloom.schemas import SUMMARY_FIELDS
from seqloom.session import new_folder
from seqloom.streaming import streams

_M = ["n_sequences", "neff", "gen_time_s", "peak_vram_gb", "ptm", "mean_plddt", "rmsd", "tm_score"]
_SHOWN = ", ".join(f"coalesce(printf('%.3f', avg({m}::DOUBLE)), '—') AS {m}" for m in _M)


@query("AGG3", f"WITH {b.OUTCOMES} SELECT strategy, {_SHOWN} FROM outcomes GROUP BY strategy")
def strategy_summary(spark, sf_dir):
    return results.strategy_summary(b.outcomes(spark, sf_dir))


def _runs(spark, sf_dir):
    o = b.outcomes(spark, sf_dir)
    k = F.col("n_sequences")
    return o.select(
        F.col("strategy").alias("precision"), "run_idx", (F.col("gen_time_s") / 4).alias("load_time_s"), "gen_time_s", "peak_vram_gb",
        F.lit(100).alias("raw_seqs"), k.alias("filtered_seqs"), results.filter_rate(k, F.lit(100)).alias("filter_rate"), "neff",
    )


_RUN_SQL = (
    f"{b.OUTCOMES}, runs AS (SELECT strategy AS precision, run_idx, gen_time_s / 4 AS load_time_s, gen_time_s, peak_vram_gb, 100 AS raw_seqs, "
    "n_sequences AS filtered_seqs, n_sequences / 100::DOUBLE AS filter_rate, neff FROM outcomes), "
    "means AS (SELECT precision, "
    + ", ".join(f"round(avg({m}::DOUBLE), 4) AS {m}" for m in results.RUN_METRICS)
    + " FROM runs WHERE run_idx > 0 GROUP BY precision)"
)


@query("AGG4 AGG6", f"WITH {_RUN_SQL} SELECT * FROM means")
def precision_means(spark, sf_dir):
    return results.precision_means(_runs(spark, sf_dir))


@query(
    "AGG5",
    f"WITH {_RUN_SQL} SELECT *, "
    + ", ".join(f"{m} = (SELECT min({m}) FROM means) AS best_{m}" for m in results.LOWER_IS_BETTER)
    + ", neff = (SELECT max(neff) FROM means) AS best_neff FROM means",
)
def best_marks(spark, sf_dir):
    return results.best_marks(results.precision_means(_runs(spark, sf_dir)))


@query(
    "AGG6",
    f"WITH {b.READS} SELECT msa_id, round(count(*) FILTER (len(seq) = 60) / count(*)::DOUBLE, 6) AS filter_rate FROM reads GROUP BY msa_id",
)
def filter_rates(spark, sf_dir):
    fits = F.count_if(F.length("seq") == 60)
    rate = results.filter_rate(fits, F.count(F.lit(1)))
    return b.reads(spark, sf_dir).groupBy("msa_id").agg(F.round(rate, 6).alias("filter_rate"))


@query(
    "JN8",
    f"WITH {b.OUTCOMES}, sc AS (SELECT protein_id, strategy, max(ptm) AS ptm, max(mean_plddt) AS mean_plddt FROM outcomes WHERE n_sequences > 60 GROUP BY ALL) "
    "SELECT event_id, o.protein_id, o.strategy, neff, sc.ptm, sc.mean_plddt, NULL::DOUBLE AS rmsd, NULL::DOUBLE AS tm_score FROM outcomes o LEFT JOIN sc USING (protein_id, strategy)",
)
def joined_scores(spark, sf_dir):
    o = b.outcomes(spark, sf_dir)
    scores = o.where(F.col("n_sequences") > 60).groupBy("protein_id", "strategy").agg(
        F.max("ptm").alias("ptm"), F.max("mean_plddt").alias("mean_plddt")
    )
    return results.with_scores(o.select("event_id", "protein_id", "strategy", "neff"), scores)


def _sweep(spark, sf_dir):
    o = b.outcomes(spark, sf_dir)
    return o.select(
        "protein_id", "strategy", "variant_param", "cache_implementation", "target_n", "selected_sequences", "neff", "gen_time_s",
        "peak_vram_gb", "ptm", "mean_plddt", "rmsd", "tm_score", F.when(F.col("run_idx") < 20, "ok").otherwise("skipped").alias("status"),
    )


_SWEEP_COLS = (
    "protein_id, strategy, variant_param, cache_implementation, target_n, selected_sequences, neff, gen_time_s, peak_vram_gb, ptm, mean_plddt, rmsd, tm_score"
)
_TIE = _SWEEP_COLS.replace("neff, ", "").replace("strategy, ", "")


@query(
    "WIN2 FLT7",
    f"WITH {b.OUTCOMES} SELECT strategy, protein_id, neff FROM outcomes WHERE neff IS NOT NULL AND run_idx < 20 ORDER BY neff, strategy, {_TIE} LIMIT 1",
)
def lowest_neff_result(spark, sf_dir):
    ok = filters.completed(_sweep(spark, sf_dir))
    return results.lowest_neff_row(ok).select("strategy", "protein_id", "neff")


_BEST = f"SELECT '{{o}}' AS objective, {_SWEEP_COLS} FROM (SELECT * FROM fixed WHERE neff IS NOT NULL AND {{w}} ORDER BY neff, strategy, {_TIE} LIMIT 1)"


@query(
    "WIN3 SET4",
    f"WITH {b.OUTCOMES}, fixed AS (SELECT * FROM outcomes WHERE selected_sequences = target_n) "
    + " UNION ALL ".join(
        _BEST.format(o=o, w=w)
        for o, w in (
            ("fixed_count_best", "TRUE"),
            ("fold_aware_best", "(mean_plddt IS NOT NULL OR tm_score IS NOT NULL) AND mean_plddt >= 75 AND tm_score >= 0.4"),
            ("vram_aware_best", "peak_vram_gb <= 8.0"),
        )
    ),
)
def best_rows(spark, sf_dir):
    best = results.best_rows(_sweep(spark, sf_dir), 8.0, 75.0, 0.4)
    return best.select(*[c for c in SUMMARY_FIELDS if c in best.columns and c != "status"])


# --- Progress --------------------------------------------------------------------------------------

_LINE_SQL = (
    "lines AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'retry ' || event_id ELSE event_type || '_model_' || (event_id % 5) || '_seed_' || user_id || ' took ' || value || 's' END AS value FROM events), "
    "done AS (SELECT ts, regexp_extract(value, '(\\S*?)_seed_\\d+\\s+took', 1) AS job, regexp_extract(value, 'took\\s+([\\d.]+)s', 1)::DOUBLE AS seconds FROM lines "
    "WHERE regexp_matches(value, '_seed_\\d+\\s+took\\s+[\\d.]+s'))"
)


def _lines(events):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    done = F.concat(
        "event_type", F.lit("_model_"), (i % 5).cast("string"), F.lit("_seed_"), u, F.lit(" took "), F.col("value").cast("string"), F.lit("s")
    )
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("retry "), i.cast("string"))).otherwise(done)
    return events.select("ts", text.alias("value"))


@query("STR2", f"WITH {_LINE_SQL} SELECT job, count(*) AS n_done, round(avg(seconds), 6) AS mean_seconds FROM done GROUP BY job")
def progress(spark, sf_dir):
    out = streams.progress(_lines(b.table(spark, sf_dir, "events")))
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("STR2", f"WITH {_LINE_SQL} SELECT job, count(*) AS n_done, round(avg(seconds), 6) AS mean_seconds FROM done GROUP BY job")
def streamed_progress(spark, sf_dir):
    """The same as a stream: each micro-batch's totals go to a table, the last ones are the answer."""
    schema = b.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = new_folder(spark)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    run = (
        streams.progress(_lines(stream)).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("job").agg(F.max_by(F.struct("n_done", "mean_seconds"), "batch").alias("r"))
    return last.select("job", "r.n_done", F.round("r.mean_seconds", 6).alias("mean_seconds"))


@query(
    "STR2",
    f"WITH {_LINE_SQL} SELECT date_trunc('hour', ts) AS window_start, job, count(*) AS n_done, round(avg(seconds), 6) AS mean_seconds FROM done GROUP BY ALL",
)
def windowed_progress(spark, sf_dir):
    out = streams.windowed_progress(_lines(b.table(spark, sf_dir, "events")), "ts")
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))
