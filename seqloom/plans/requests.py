"""Request tables: which candidates to generate, as rows. Grids are exploded literals, never cross joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import pad_sequence, variant_label
from seqloom.operators.augment import coverage_chunks


def _doubles(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _conf(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def with_decoding_grid(df: DataFrame, params: dict) -> DataFrame:
    """Every combination of the matrix values over the base, as ``config_id`` and ``decode_conf``.

    Without a matrix there is the base alone; with neither there are no rows.
    """
    base, matrix = params.get("base") or {}, params.get("matrix") or {}
    if not base and not matrix:
        return df.withColumn("config_id", F.lit(0).cast("long")).withColumn(
            "decode_conf", _conf({"": F.lit(0.0)})
        ).where(F.lit(False))
    out, config_id = df, F.lit(0).cast("long")
    for name, values in matrix.items():
        out = out.select("*", F.posexplode(_doubles(values)).alias(f"__i_{name}", f"__v_{name}"))
        config_id = config_id * len(values) + F.col(f"__i_{name}")
    conf = {k: F.lit(float(v)) for k, v in base.items() if k not in matrix}
    conf.update({k: F.col(f"__v_{k}") for k in matrix})
    added = out.withColumn("config_id", config_id).withColumn("decode_conf", _conf(conf))
    return added.drop(*[f"__{x}_{k}" for k in matrix for x in "iv"])


def generation_requests(
    queries: DataFrame,
    params: dict,
    coverages: list[float],
    num_returns: int,
    multiplier: int,
    n_runs: int = 1,
    seed: int = 0,
    per_config_chunks: bool = False,
) -> DataFrame:
    """One row per wanted candidate: query x run x coverage x configuration x return x multiplier.

    ``queries``: query_id, seq. The chunk is drawn per query, run and coverage and shared by all
    configurations, unless ``per_config_chunks``. ``seq_idx`` is the candidate's place in its run's
    alignment, the query being 0.
    """
    runs = queries.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run_idx"))
    if per_config_chunks:
        grid = with_decoding_grid(runs, params)
        chunks = coverage_chunks(grid, coverages, ["run_idx", "config_id"], seed)
    else:
        chunks = with_decoding_grid(coverage_chunks(runs, coverages, ["run_idx"], seed), params)
    many = chunks.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_returns - 1))).alias("return_no")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))).alias("copy_no")
    )
    place = (F.col("config_id") * len(coverages) + F.col("coverage_no")) * num_returns + F.col("return_no")
    return many.withColumn("seq_idx", (place * multiplier + F.col("copy_no") + 1).cast("long"))


def placed_candidates(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Generator output joined back to its request by key and padded to the query's width.

    ``keys`` may name what several requests share, such as their chunk: each of them then gets the output, which travels once.
    """
    # Size estimates do not see how far queries fan out into requests: without the hint they could be broadcast.
    back = requests.hint("merge").join(results.select(*keys, F.col("seq").alias("__out")), keys)
    padded = pad_sequence(F.col("__out"), F.col("start").cast("int"), F.col("full_len").cast("int"))
    return back.withColumn("seq", padded).drop("__out")


# --- Strategy plans -------------------------------------------------------------------------------


def _counted(n: int) -> list[float]:
    return [float(i) for i in range(n)]


# Defaults of the strategy benchmark (fixed values).
STRATEGY_CONFIGS: dict[str, dict] = {
    "baseline": {"coverage_values": [1.0], "num_return_sequences": 100},
    "temperature_sweep": {"temperatures": [0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0], "num_return_sequences": 20},
    "round_trip": {"n_rounds": 9, "n_seeds": 16},
    "3di_perturb": {
        "n_3di_seeds": 4, "mutation_rates": [0.05, 0.10, 0.15, 0.20, 0.30, 0.40], "num_return_sequences": 6,
    },
    "encoder_perturb": {
        "noise_scales": [0.03, 0.07, 0.12, 0.18, 0.25, 0.35, 0.50, 0.70], "num_return_sequences": 17,
    },
    "embedding_walk_full": {"noise_scales": [0.03, 0.07, 0.12, 0.20, 0.35], "num_return_sequences": 25},
    "embedding_walk_encoder": {
        "n_pca_components": 10, "step_sizes": [-2.0, -1.0, -0.5, 0.5, 1.0, 2.0], "num_return_sequences": 15,
    },
    "encoder_only_3di_sub": {
        "mutation_rates": [0.05, 0.10, 0.20, 0.30, 0.40], "variants_per_rate": 10, "num_return_sequences": 3,
    },
    "cnn_3di_predict": {
        "mutation_rates": [0.05, 0.10, 0.20, 0.30, 0.40], "n_perturbations": 4, "num_return_sequences": 7,
    },
    "cnn_aa_predict": {"n_3di_seeds": 128},
    "single_sequence": {},
}
# Not among the registered strategies; its plan exists all the same.
EXTRA_CONFIGS: dict[str, dict] = {"diverse_beam": {"num_beams": 48}}

# Loop order of each strategy: setting -> axis name. A number means that many repeats.
_AXES: dict[str, list[tuple[str, str]]] = {
    "baseline": [("coverage_values", "coverage"), ("num_return_sequences", "return_no")],
    "temperature_sweep": [("temperatures", "temperature"), ("num_return_sequences", "return_no")],
    "round_trip": [("n_rounds", "round"), ("n_seeds", "seed_no")],
    "3di_perturb": [("n_3di_seeds", "seed_no"), ("mutation_rates", "rate"), ("num_return_sequences", "return_no")],
    "encoder_perturb": [("noise_scales", "sigma"), ("num_return_sequences", "return_no")],
    "embedding_walk_full": [("noise_scales", "sigma"), ("num_return_sequences", "return_no")],
    "embedding_walk_encoder": [
        ("n_pca_components", "component"), ("step_sizes", "step"), ("num_return_sequences", "return_no"),
    ],
    "encoder_only_3di_sub": [
        ("mutation_rates", "rate"), ("variants_per_rate", "variant_no"), ("num_return_sequences", "return_no"),
    ],
    "cnn_3di_predict": [
        ("mutation_rates", "rate"), ("n_perturbations", "variant_no"), ("num_return_sequences", "return_no"),
    ],
    "cnn_aa_predict": [("n_3di_seeds", "seed_no")],
    "single_sequence": [],
    "diverse_beam": [("num_beams", "beam_no")],
}


def strategy_requests(queries: DataFrame, strategy: str, config: dict | None = None) -> DataFrame:
    """The candidates one strategy asks for: one row per request with its axis values.

    ``request_no`` follows the strategy's loop order; ``params`` maps axis name to value.
    """
    if strategy not in _AXES:
        raise ValueError(f"unknown strategy '{strategy}'")
    cfg = {**{**STRATEGY_CONFIGS, **EXTRA_CONFIGS}[strategy], **(config or {})}
    out, number, params = queries.withColumn("strategy", F.lit(strategy)), F.lit(0).cast("long"), {}
    for setting, axis in _AXES[strategy]:
        values = cfg[setting] if isinstance(cfg[setting], list) else _counted(int(cfg[setting]))
        out = out.select("*", F.posexplode(_doubles(values)).alias(f"__i_{axis}", f"__v_{axis}"))
        number, params[axis] = number * len(values) + F.col(f"__i_{axis}"), F.col(f"__v_{axis}")
    if not params:
        empty = out.withColumn("request_no", number).withColumn("params", _conf({"": F.lit(0.0)}))
        return empty.where(F.lit(False))
    done = out.withColumn("request_no", number).withColumn("params", _conf(params))
    return done.drop(*[f"__{x}_{a}" for a in params for x in "iv"])


def all_strategy_requests(queries: DataFrame, strategies: list[str]) -> DataFrame:
    """Requests of several strategies; names that are not registered are skipped."""
    known = [s for s in strategies if s in STRATEGY_CONFIGS]
    out = strategy_requests(queries, "single_sequence")
    for s in known:
        out = out.unionByName(strategy_requests(queries, s))
    return out


def registered_requests(queries: DataFrame, strategies: list[str], configs: dict[str, dict]) -> DataFrame:
    """Requests of registered strategies with settings of the caller's."""
    out = strategy_requests(queries, "single_sequence")
    for s in strategies:
        out = out.unionByName(strategy_requests(queries, s, configs.get(s)))
    return out


def strategy_labels(jobs: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Adds ``variant_param``, the label of each strategy's settings."""
    label = F.lit("")
    for s, own in STRATEGY_CONFIGS.items():
        settings = {k: str(v) for k, v in {**own, **configs.get(s, {})}.items()}
        if settings:
            conf = F.create_map(*[F.lit(x) for pair in settings.items() for x in pair])
            label = F.when(F.col("strategy") == s, variant_label(F.lit(s), conf)).otherwise(label)
    return jobs.withColumn("variant_param", label)


def job_table(proteins: DataFrame, strategies: list[str]) -> DataFrame:
    """Protein x registered strategy."""
    known = [s for s in strategies if s in STRATEGY_CONFIGS]
    names = F.array(*[F.lit(s) for s in known]) if known else F.array().cast("array<string>")
    return proteins.select("*", F.explode(names).alias("strategy"))


# --- Sampling grids of the low-depth sweep ----------------------------------------------------------

# Grid values (fixed values).
SWEEP_BASE = {"repetition_penalty": 1.15}
SWEEP_TEMPERATURES = [0.3, 0.5, 0.7, 0.9]
SWEEP_TOP_K = [1, 3, 5, 10]
SWEEP_TOP_P = [0.70, 0.80, 0.90]
SWEEP_KNOBS = [("min_p", "0.05"), ("typical_p", "0.8"), ("eta_cutoff", "0.0006"), ("epsilon_cutoff", "0.0006")]
SWEEP_KNOB_CONF = {"temperature": 0.5, "top_k": 5.0, "top_p": 0.80}
WALK_SIGMAS = ["0.005", "0.01", "0.02", "0.03", "0.05", "0.07", "0.1"]
WALK_CONF = {"temperature": 0.5, "top_k": 5.0, "top_p": 0.85, "repetition_penalty": 1.15}
WALK_DECAY = 0.8


def _literals(conf: dict[str, float]) -> dict[str, Column]:
    return {k: F.lit(float(v)) for k, v in conf.items()}


def temperature_variants(df: DataFrame, cache: Column) -> DataFrame:
    """Adds the temperature grid (48 combinations and 4 single knobs) per cache mode.

    ``cache`` is an array column of modes (see ``functions.scalar.cache_modes``).
    """
    modes = df.select("*", F.posexplode_outer(cache).alias("__c", "cache_implementation"))
    grid = modes
    for name, values in (("t", SWEEP_TEMPERATURES), ("k", SWEEP_TOP_K), ("p", SWEEP_TOP_P)):
        grid = grid.select("*", F.posexplode(_doubles(values)).alias(f"__i{name}", f"__{name}"))
    number = (F.col("__it") * len(SWEEP_TOP_K) + F.col("__ik")) * len(SWEEP_TOP_P) + F.col("__ip")
    label = F.format_string("temperature=%.1f,top_k=%d,top_p=%.2f", F.col("__t"), F.col("__k").cast("int"), F.col("__p"))
    conf = _conf({"temperature": F.col("__t"), "top_k": F.col("__k"), "top_p": F.col("__p"), **_literals(SWEEP_BASE)})
    n_grid = len(SWEEP_TEMPERATURES) * len(SWEEP_TOP_K) * len(SWEEP_TOP_P)
    cols = [c for c in df.columns]
    full = grid.select(
        *cols, "__c", "cache_implementation", number.cast("long").alias("__no"), label.alias("variant_param"), conf.alias("decode_conf")
    )
    knobs = F.array(
        *[
            F.struct(
                F.lit(n_grid + i).cast("long").alias("no"),
                F.lit(f"temperature=0.5,top_k=5,top_p=0.80,{k}={v}").alias("label"),
                _conf({**_literals(SWEEP_KNOB_CONF), **_literals(SWEEP_BASE), k: F.lit(float(v))}).alias("conf"),
            )
            for i, (k, v) in enumerate(SWEEP_KNOBS)
        ]
    )
    special = modes.select(*cols, "__c", "cache_implementation", F.explode(knobs).alias("s")).select(
        *cols, "__c", "cache_implementation", F.col("s.no").alias("__no"), F.col("s.label").alias("variant_param"), F.col("s.conf").alias("decode_conf")
    )
    size = n_grid + len(SWEEP_KNOBS)
    return (
        full.unionByName(special)
        .withColumn("strategy", F.lit("temperature_low_neff"))
        .withColumn("variant_no", F.col("__c") * size + F.col("__no"))
        .withColumn("extra", F.lit(None).cast("map<string,double>"))
        .drop("__c", "__no")
    )


def embedding_variants(df: DataFrame, cache: Column) -> DataFrame:
    """Adds the seven noise levels per cache mode."""
    modes = df.select("*", F.posexplode_outer(cache).alias("__c", "cache_implementation"))
    spread = modes.select("*", F.posexplode(F.array(*[F.lit(s) for s in WALK_SIGMAS])).alias("__no", "__s"))
    return (
        spread.withColumn("variant_param", F.concat(F.lit("sigma="), F.col("__s")))
        .withColumn("decode_conf", _conf(_literals(WALK_CONF)))
        .withColumn("strategy", F.lit("embedding_walk_low_neff"))
        .withColumn("variant_no", (F.col("__c") * len(WALK_SIGMAS) + F.col("__no")).cast("long"))
        .withColumn("extra", _conf({"sigma": F.col("__s").cast("double"), "depth_decay": F.lit(WALK_DECAY)}))
        .drop("__c", "__no", "__s")
    )


def multimer_requests(queries: DataFrame, mode: str = "concat+per_chain") -> DataFrame:
    """Inputs of a complex: the joined chains, and each chain unless ``mode`` is ``concat``.

    ``queries``: complex_id, query. Gives complex_id, block, chain_idx (-1 for the joined one), seq.
    """
    chains = F.split(F.col("query"), ":")
    joined = F.struct(F.lit("concat").alias("block"), F.lit(-1).alias("chain_idx"), F.array_join(chains, "").alias("seq"))
    single = F.transform(
        chains,
        lambda c, i: F.struct(F.concat(F.lit("chain_"), i.cast("string")).alias("block"), i.alias("chain_idx"), c.alias("seq")),
    )
    blocks = F.array(joined) if mode == "concat" else F.concat(F.array(joined), single)
    return queries.select("complex_id", F.explode(blocks).alias("b")).select("complex_id", "b.*")
