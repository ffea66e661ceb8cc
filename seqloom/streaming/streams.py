"""Incremental jobs: depth of alignments as their files arrive, and progress from log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.neff import neff
from seqloom.sources.fasta import _decoded, _fields, _records, alignment_text, parent_name

DONE_LINE = "_seed_\\d+\\s+took\\s+[\\d.]+s"


def stream_neff(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, once: bool = True, files_per_batch: int = 10_000, glob: str = "*.a3m",
) -> StreamingQuery:
    """Appends the depth of every arriving A3M file to a Parquet table.

    One file is one whole alignment, so a micro-batch needs no state. The batch number is the
    partition it writes, so a repeated batch replaces itself.
    """
    files = (
        spark.readStream.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .text(in_path, wholetext=True)
        .select(_decoded(F.col("_metadata.file_path")).alias("path"), "value")
    )

    def measure(batch: DataFrame, batch_id: int) -> None:
        rows = _fields(_records(batch)).select(
            F.col("path").alias("path"),
            parent_name(F.col("path")).alias("msa_id"),
            F.col("file_pos").cast("long").alias("seq_idx"),
            alignment_text(F.col("body")).alias("seq"),
        )
        neff(rows, key=["path", "msa_id"]).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def parse_progress(lines: DataFrame) -> DataFrame:
    """Completed model evaluations from log lines (column ``value``): adds ``job`` and ``seconds``."""
    hit = lines.where(F.col("value").rlike(DONE_LINE))
    return hit.select(
        "*",
        F.regexp_extract("value", "(\\S*?)_seed_\\d+\\s+took", 1).alias("job"),
        F.regexp_extract("value", "took\\s+([\\d.]+)s", 1).try_cast("double").alias("seconds"),
    )


def progress(lines: DataFrame, expected: int | None = None) -> DataFrame:
    """Evaluations done and mean time per job; with ``expected``, the share completed.

    Works on a batch table or, in update or complete mode, on a stream.
    """
    agg = parse_progress(lines).groupBy("job").agg(
        F.count(F.lit(1)).alias("n_done"), F.avg("seconds").alias("mean_seconds")
    )
    return agg if expected is None else agg.withColumn("share", F.col("n_done") / F.lit(expected))


def windowed_progress(lines: DataFrame, event_time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Evaluations per job and tumbling event-time window; later lines than ``late`` are left out."""
    timed = parse_progress(lines).withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window).alias("w"), "job").agg(
        F.count(F.lit(1)).alias("n_done"), F.avg("seconds").alias("mean_seconds")
    ).select(F.col("w.start").alias("window_start"), "job", "n_done", "mean_seconds")
