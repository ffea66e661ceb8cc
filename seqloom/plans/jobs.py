"""The jobs users run, composed from the operators. All alignments of a job share one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.alphabets import (
    DEFAULT_COVERAGE,
    DEFAULT_DECODING,
    DEFAULT_DEPTH,
    DEFAULT_MULTIPLIER,
    DEFAULT_MUTATION_RATES,
    DEFAULT_RETURNS,
)
from seqloom.functions.scalar import pad_sequence
from seqloom.operators import augment, filters, pairing, results, select
from seqloom.operators.groups import index_bucket, over_tasks, row_numbers
from seqloom.operators.neff import neff, neff_before_after, neff_table, rejects
from seqloom.plans.requests import generation_requests, multimer_requests, strategy_requests
from seqloom.schemas import RESULT_FIELDS, SWEEP_FIELDS
from seqloom.session import cut_lineage
from seqloom.sources import sinks
from seqloom.sources.fasta import FILE_KEY, named_by_file, read_a3m, read_fasta, read_project

# candidates(requests) -> requests with ``seq`` (the generated text for ``chunk``)
Candidates = Callable[[DataFrame], DataFrame]


# --- Alignment building ---------------------------------------------------------------------------


def candidate_alignments(
    queries: DataFrame,
    candidates: Candidates,
    params: dict | None = None,
    coverages: list[float] | None = None,
    num_returns: int = DEFAULT_RETURNS,
    multiplier: int = DEFAULT_MULTIPLIER,
    n_runs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """Query and padded candidates per (msa_id, run_idx). ``queries``: query_id, seq."""
    requests = generation_requests(
        queries, params or DEFAULT_DECODING, coverages or DEFAULT_COVERAGE, num_returns, multiplier, n_runs, seed
    )
    # A few queries fan out to many requests, and a request costs far more than its bytes.
    padded = padded_rows(candidates(over_tasks(requests, ["query_id", "run_idx", "seq_idx"])))
    own = queries.select(
        F.col("query_id").alias("msa_id"),
        F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run_idx"),
        F.lit(0).cast("long").alias("seq_idx"),
        "seq",
        F.length("seq").cast("long").alias("full_len"),
    )
    return own.unionByName(padded)


def padded_rows(generated: DataFrame) -> DataFrame:
    text = pad_sequence(F.col("seq"), F.col("start").cast("int"), F.col("full_len").cast("int"))
    return generated.where(F.col("seq").isNotNull()).select(
        F.col("query_id").alias("msa_id"), "run_idx", "seq_idx", text.alias("seq"), "full_len"
    )


def merge_runs(filtered: DataFrame, evolved: DataFrame | None) -> DataFrame:
    """All filtered rows by run, then all evolved rows by run; nothing is de-duplicated.

    ``seq_idx`` is re-numbered per alignment over (kind, run, old index).
    """
    parts = filtered.withColumn("kind", F.lit(0))
    if evolved is not None:
        parts = parts.unionByName(evolved.withColumn("kind", F.lit(1)))
    bucket = F.struct("kind", "run_idx", index_bucket())
    numbered = row_numbers(parts, ["msa_id"], bucket, [F.col("seq_idx")], "__at")
    return numbered.withColumn("seq_idx", F.col("__at")).drop("__at")


def build_alignments(
    queries: DataFrame,
    candidates: Candidates,
    matrix: DataFrame | None = None,
    rates: dict[str, float] | None = None,
    fraction: float = 1.0,
    **request_options,
) -> DataFrame:
    """Monomer job: generate, filter, optionally evolve, merge the runs.

    Evolved rows are not filtered again, and rows that were not sampled for evolution appear in both
    parts. Result: msa_id, kind (0 filtered, 1 evolved), run_idx, seq_idx, label, seq.
    """
    # Generator output is computed once: the filter, the numbering and the evolution all read it.
    raw = cut_lineage(candidate_alignments(queries, candidates, **request_options))
    key = ["msa_id", "run_idx"]
    kept = cut_lineage(filters.filter_rows(raw, "full_len", key=key))
    labelled = sinks.positional_labels(kept, "filtered", key).drop("full_len")
    evolved = None
    if matrix is not None:
        evolved = augment.evolve(labelled, matrix, rates or DEFAULT_MUTATION_RATES, fraction, key)
    return merge_runs(labelled, evolved).select("msa_id", "kind", "run_idx", "seq_idx", "label", "seq")


def build_complexes(
    queries: DataFrame,
    candidates: Candidates,
    matrix: DataFrame | None = None,
    rates: dict[str, float] | None = None,
    fraction: float = 1.0,
    mode: str = "concat+per_chain",
    n_subsets: int = 20,
    subset_size: int = 175,
    top_k: int = 5,
    threshold: float = 0.8,
    **request_options,
) -> DataFrame:
    """Multimer job: joined and per-chain blocks, each filtered at its own width, then paired.

    ``queries``: complex_id, query (chains joined with ``:``). Result: the layout rows of
    :func:`seqloom.operators.pairing.paired_layout`.
    """
    inputs = multimer_requests(queries, mode)
    # One text key per block: the complex, a separator that no id holds, the chain number.
    block_id = F.to_json(F.struct(F.col("complex_id").alias("c"), F.col("chain_idx").alias("i")))
    blocks = inputs.select(block_id.alias("query_id"), "seq")
    raw = cut_lineage(candidate_alignments(blocks, candidates, **request_options))
    kept = cut_lineage(filters.filter_rows(raw, "full_len", key=["msa_id", "run_idx"]).drop("full_len"))
    rows = kept
    if matrix is not None:
        labelled = sinks.positional_labels(kept, "filtered", ["msa_id", "run_idx"])
        evolved = augment.evolve(labelled, matrix, rates or DEFAULT_MUTATION_RATES, fraction, ["msa_id", "run_idx"])
        rows = merge_block_runs(kept, evolved.select(*kept.columns))
    else:
        rows = merge_block_runs(kept, None)
    # Both are read many times by what follows, and the evolution and the numbering behind them are dear.
    rows = cut_lineage(rows)
    complex_type = dict(queries.dtypes)["complex_id"]
    parsed = rows.withColumn("b", F.from_json("msa_id", f"c {complex_type}, i int")).select(
        F.col("b.c").alias("complex_id"), F.col("b.i").alias("chain_idx"), "kind", "seq_idx", "seq"
    )
    concat = parsed.where((F.col("chain_idx") == -1) & (F.col("kind") == 0)).select("complex_id", "seq_idx", "seq")
    chains = cut_lineage(pairing.dense_rows(parsed.where(F.col("chain_idx") >= 0).select("complex_id", "chain_idx", "seq_idx", "seq")))
    wanted = queries.select("complex_id", F.size(F.split("query", ":")).alias("n"))
    paired = pairing.paired_block(chains, n_subsets, subset_size, top_k, threshold, n_chains=wanted)
    dense = row_numbers(paired, ["complex_id"], index_bucket(), [F.col("seq_idx")], "__at")
    return pairing.paired_layout(queries, concat, dense.withColumn("seq_idx", F.col("__at")).drop("__at"))


def merge_block_runs(filtered: DataFrame, evolved: DataFrame | None) -> DataFrame:
    """Run blocks of a complex in order: per run, the filtered rows, then the evolved ones."""
    parts = filtered.withColumn("kind", F.lit(0))
    if evolved is not None:
        parts = parts.unionByName(evolved.withColumn("kind", F.lit(1)))
    bucket = F.struct("run_idx", "kind", index_bucket())
    numbered = row_numbers(parts, ["msa_id"], bucket, [F.col("seq_idx")], "__at")
    return numbered.withColumn("seq_idx", F.col("__at")).drop("__at")


# --- File jobs --------------------------------------------------------------------------------------


def msa_job(spark: SparkSession, fasta_path: str, out_path: str, candidates: Candidates, recursive: bool = False, **options) -> None:
    """FASTA queries to one alignment folder per query."""
    queries = read_fasta(spark, fasta_path, recursive).select("query_id", "seq")
    rows = build_alignments(queries, candidates, **options)
    sinks.write_records(sinks.folder_headers(rows), out_path)


def neff_job(spark: SparkSession, root: str, out_path: str) -> DataFrame:
    """Depth of every alignment of a project as a CSV report; returns the alignments left out."""
    rows = read_project(spark, root)
    sinks.write_csv(neff_table(rows, key=FILE_KEY), out_path, ["pdb", "NAD"], mode="overwrite")
    return rejects(rows, FILE_KEY)


def mask_job(spark: SparkSession, in_path: str, out_path: str, fraction: float, seed: int = 0, glob: str = "*.a3m") -> None:
    """Masked copies of alignments."""
    rows = named_by_file(read_a3m(spark, in_path, glob, raw=True))
    sinks.write_records(augment.mask_rows(rows, fraction, seed=seed), out_path)


def subsample_job(
    spark: SparkSession, in_path: str, out_path: str, n: int, strategy: str = "farthest_first", include_query: bool = True, glob: str = "*.a3m"
) -> DataFrame:
    """Thinned alignments with generic labels; returns the depth before and after."""
    rows = named_by_file(read_a3m(spark, in_path, glob))
    picked = select.select_subset(rows, n, strategy)
    sinks.write_records(sinks.subset_labels(picked, include_query), out_path, order="rank")
    return neff_before_after(rows, picked)


def depth_ladder_job(rows: DataFrame, ladder: list[tuple[int, int]] | None = None) -> DataFrame:
    return select.neff_by_depth(rows, ladder or DEFAULT_DEPTH)


# --- Strategy evaluation ----------------------------------------------------------------------------


def evaluate_strategies(candidates: DataFrame, jobs: DataFrame, target_n: int = 128, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(result rows, alignments) of all (protein, strategy) jobs at once.

    ``jobs``: protein_id, strategy, variant_param, query. ``candidates``: protein_id, strategy,
    seq_idx, seq. Rows of the query's length are kept, thinned to ``target_n``, and measured together
    with the query; a job without rows has depth 0.
    """
    key = ["protein_id", "strategy"]
    fits = candidates.select(*key, "seq_idx", "seq").join(jobs.select(*key, "query"), key).where(F.length("seq") == F.length("query"))
    kept = select.random_subset(fits.select(*key, "seq_idx", "seq"), target_n, key, seed)
    own = jobs.select(*key, F.lit(-1).cast("long").alias("seq_idx"), F.col("query").alias("seq"))
    filled = kept.select(*key).distinct()
    depth = neff(own.join(filled, key, "left_semi").unionByName(kept), key=key)
    table = jobs.join(depth, key, "left").select(
        *key,
        "variant_param",
        F.coalesce(F.col("n_rows") - 1, F.lit(0)).cast("int").alias("n_sequences"),
        F.round(F.coalesce("neff", F.lit(0.0)), 4).alias("neff"),
    )
    return table, own.unionByName(kept)


def strategy_job(
    proteins: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    strategies: list[str],
    target_n: int = 128,
    scores: DataFrame | None = None,
    configs: dict[str, dict] | None = None,
    structures: tuple[DataFrame, DataFrame] | None = None,
    out_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results with scores, summary per strategy). ``proteins``: protein_id, query.

    ``configs`` overrides settings per strategy. ``scores`` holds protein_id, strategy and fold scores;
    ``structures`` is (pairs, atoms) as for ``structure_metrics`` with pair_id ``<protein_id>__<strategy>``.
    Generated rows may carry gen_time_s and peak_vram_gb, of which the sum and the maximum are
    reported. With ``out_path`` the alignments, ``results`` and ``summary`` are written below it.
    """
    from seqloom.operators.structure import structure_metrics
    from seqloom.plans.requests import STRATEGY_CONFIGS, job_table, registered_requests, strategy_labels

    key = ["protein_id", "strategy"]
    jobs = strategy_labels(job_table(proteins, strategies), configs or {})
    wanted = registered_requests(proteins, [s for s in strategies if s in STRATEGY_CONFIGS], configs or {})
    made = cut_lineage(generate(wanted))
    # A request may give several rows, so rows are numbered per job.
    extra = [F.col(c) for c in ("request_no", "seq") if c in made.columns]
    rows = row_numbers(made.where(F.col("seq").isNotNull()), key, index_bucket("request_no"), extra, "seq_idx")
    table, alignments = evaluate_strategies(cut_lineage(rows), jobs, target_n)
    costs = [
        (F.sum("gen_time_s") if "gen_time_s" in made.columns else F.lit(None)).cast("double").alias("gen_time_s"),
        (F.max("peak_vram_gb") if "peak_vram_gb" in made.columns else F.lit(None)).cast("double").alias("peak_vram_gb"),
    ]
    full = table.join(made.groupBy(*key).agg(*costs), key, "left")
    if scores is None:
        scores = proteins.select("protein_id", F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("double").alias("ptm")).where(F.lit(False))
    if structures is not None:
        compared = structure_metrics(*structures).join(jobs.select(*key, F.concat_ws("__", *key).alias("pair_id")), "pair_id").drop("pair_id")
        scores = scores.drop("rmsd", "tm_score").join(compared, key, "full")
    # Few rows, and read by the summary, the writers and the caller.
    scored = cut_lineage(results.with_scores(full, scores).select(*RESULT_FIELDS))
    summary = results.strategy_summary(scored)
    if out_path is not None:
        named = alignments.withColumn("msa_id", F.concat_ws("__", *key)).withColumn("seq_idx", F.col("seq_idx") + 1)
        sinks.write_records(sinks.generated_labels(named, F.col("protein_id")), f"{out_path}/msa")
        sinks.write_csv(scored, f"{out_path}/results", RESULT_FIELDS)
        sinks.write_csv(summary, f"{out_path}/summary", summary.columns)
    return scored, summary


SWEEP_IDS = ["protein_id", "strategy", "variant_param", "cache_implementation"]


def sweep_job(
    candidates: DataFrame, jobs: DataFrame, target_n: int, candidate_n: int, mode: str = "lowest_neff", dedupe: bool = True
) -> DataFrame:
    """Result rows of the low-depth sweep; see :func:`sweep_parts`."""
    return sweep_parts(candidates, jobs, target_n, candidate_n, mode, dedupe)[0]


def sweep_parts(
    candidates: DataFrame, jobs: DataFrame, target_n: int, candidate_n: int, mode: str = "lowest_neff", dedupe: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(result rows, alignments) of the low-depth sweep.

    ``jobs``: protein_id, strategy, variant_param, cache_implementation, query. ``candidates`` carry
    the same ids, seq_idx and seq, and may carry status and error as the generator runner gives them. All
    candidates count; ``candidate_n`` is how many were asked for. A job's status is the worst of its
    requests (oom, then skipped).
    """
    ids = SWEEP_IDS
    # A missing cache mode is a mode of its own; joins need a value for it.
    named = [*ids[:3], F.coalesce("cache_implementation", F.lit("None")).alias("cache_implementation")]
    jobs = jobs.select(*named, "query")
    given = {c: F.col(c) if c in candidates.columns else F.lit(v) for c, v in (("status", "ok"), ("error", ""))}
    every = candidates.select(*named, "seq_idx", "seq", *[x.alias(c) for c, x in given.items()])
    severity = F.when(F.col("status") == "oom", 2).when(F.col("status") == "ok", 0).otherwise(1)
    worst = every.groupBy(*ids).agg(F.max(F.struct(severity.alias("k"), "status", "error")).alias("w"))
    outcome = worst.select(*ids, "w.status", "w.error")
    pool = every.where(F.col("seq").isNotNull()).select(*ids, "seq_idx", "seq")
    sized = pool.join(jobs, ids)
    counts = filters.exact_length_counts(sized, F.length("query"), ids)
    valid = filters.exact_length_rows(sized, F.length("query"), dedupe, ids).select(*ids, "seq_idx", "seq")
    if mode == "first_valid":
        picked = select.first_valid(valid, target_n, ids).select(*ids, "seq_idx", "seq", "rank")
    else:
        picked = select.lowest_neff(valid, jobs, target_n, dedupe=dedupe, key=ids).select(*ids, "seq_idx", "seq", "rank")
    chosen = picked.groupBy(*ids).agg(F.count(F.lit(1)).cast("int").alias("selected_sequences"))
    own = jobs.join(chosen.select(*ids), ids, "left_semi").select(*ids, F.lit(-1).cast("long").alias("seq_idx"), F.col("query").alias("seq"))
    whole = own.withColumn("rank", F.lit(-1).cast("long")).unionByName(picked)
    depth = neff(whole.drop("rank"), key=ids).select(*ids, F.round("neff", 4).alias("neff"))
    table = jobs.join(counts, ids, "left").join(chosen, ids, "left").join(depth, ids, "left").join(outcome, ids, "left")
    filled = table.select(
        *ids,
        F.lit(target_n).alias("target_n"),
        F.lit(candidate_n).alias("candidate_n_requested"),
        F.coalesce("raw_count", F.lit(0)).cast("int").alias("raw_candidates"),
        F.coalesce("valid_count", F.lit(0)).cast("int").alias("valid_candidates"),
        F.coalesce("selected_sequences", F.lit(0)).alias("selected_sequences"),
        F.coalesce("neff", F.lit(0.0)).alias("neff"),
        F.coalesce("status", F.lit("ok")).alias("status"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    missing = [F.lit(None).cast("double").alias(c) for c in SWEEP_FIELDS if c not in filled.columns]
    return filled.select("*", *missing).select(*SWEEP_FIELDS), whole


def sweep_files_job(
    candidates: DataFrame, jobs: DataFrame, out_path: str, target_n: int, candidate_n: int, mode: str = "lowest_neff", **limits
) -> tuple[DataFrame, DataFrame]:
    """The sweep with its files: one alignment per variant, all result rows, the best row per objective.

    ``limits`` are those of ``results.best_rows``. Returns (result rows, best rows) as written.
    """
    from seqloom.functions.scalar import safe_variant_key
    from seqloom.operators.results import best_rows

    table, alignments = sweep_parts(candidates, jobs, target_n, candidate_n, mode)
    table = cut_lineage(table)
    variant = safe_variant_key(F.col("strategy"), F.col("variant_param"), F.col("cache_implementation"))
    named = alignments.withColumn("msa_id", F.concat_ws("__", "protein_id", variant)).withColumn("seq_idx", F.col("rank") + 1)
    sinks.write_records(sinks.generated_labels(named, F.col("protein_id")), f"{out_path}/msa")
    sinks.write_csv(table, f"{out_path}/results", SWEEP_FIELDS)
    best = best_rows(table.where(F.col("status") == "ok"), **limits)
    sinks.write_csv(best, f"{out_path}/summary", best.columns)
    return table, best


def strategy_plan_sizes(queries: DataFrame, strategies: list[str]) -> DataFrame:
    """How many candidates each strategy asks for per query."""
    out = None
    for s in strategies:
        part = strategy_requests(queries, s).groupBy("query_id", "strategy").agg(F.count(F.lit(1)).alias("n_requests"))
        out = part if out is None else out.unionByName(part)
    return out
