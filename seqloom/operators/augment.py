"""Sampling and augmentation. All randomness is a hash of row keys and a seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.alphabets import FALLBACK_MUTATION_RATE, MUTABLE_ALPHABET
from seqloom.functions.scalar import bind, letters
from seqloom.functions.uniform import BULK_PLACES, hash_gauss, hash_index, hash_uniform, key_prefix, place_draws, place_gauss, place_groups, place_uniforms, single_uniform
from seqloom.operators.filters import valid_chunks
from seqloom.operators.groups import key_fields, row_numbers

KEY = ["msa_id"]
MAX_MATRIX_ROWS = 100_000  # substitution tables above this size are not treated as small
WALK_ROWS = 256  # vectors whose noisy copies are held at a time
# Per matrix: letter code -> (cumulative bounds, codes of the substitutes).
Tables = dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]


# --- Chunks ---------------------------------------------------------------------------------------


def coverage_chunks(
    queries: DataFrame, coverages: list[float], per: list[str] | None = None, seed: int = 0
) -> DataFrame:
    """One random chunk per query and coverage: length ``int(c * L)``, start uniform in [0, L - len].

    ``per`` names further columns (for example a configuration id) that get their own start; by
    default all configurations share it. Invalid chunk lengths are left out.
    """
    spread = F.posexplode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage_no", "coverage")
    sized = valid_chunks(queries.withColumn("full_len", F.length("seq").cast("long")).select("*", spread))
    keys = [F.col("query_id"), F.col("coverage_no")] + [F.col(c) for c in per or []]
    start = hash_index(F.col("full_len") - F.col("chunk_len") + 1, *keys, seed=seed)
    return sized.withColumn("start", start).withColumn(
        "chunk", F.substr("seq", (F.col("start") + 1).cast("int"), F.col("chunk_len").cast("int"))
    )


# --- Masking --------------------------------------------------------------------------------------


def mask_rows(df: DataFrame, fraction: float, key: list[str] = KEY, seed: int = 0) -> DataFrame:
    """Uppercase residues of every row but the first become X with probability ``fraction``.

    Gaps and lowercase letters stay. The query is the row ``seq_idx = 0``.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("mask fraction must be between 0 and 1")
    if fraction == 0.0:
        return df
    keys = [F.col(k) for k in key] + [F.col("seq_idx")]

    def cell(c: Column, i: Column) -> Column:
        return F.when(c.rlike("^[A-Z]$") & (hash_uniform(*keys, i, seed=seed) < fraction), F.lit("X")).otherwise(c)

    masked = F.array_join(F.transform(letters(F.col("seq")), cell), "")
    return df.withColumn("seq", F.when(F.col("seq_idx") == 0, F.col("seq")).otherwise(masked))


# --- Substitution matrices --------------------------------------------------------------------------


def grouped_matrix(
    spark: SparkSession, name: str, groups: list[str], same: float = 4.0, near: float = 1.0, far: float = -2.0
) -> DataFrame:
    """A substitution matrix by rule: ``same`` on the diagonal, ``near`` inside a group, else ``far``."""
    letter = "".join(groups)
    home = {c: g for g, members in enumerate(groups) for c in members}
    rows = [
        (name, a, b, same if a == b else near if home[a] == home[b] else far) for a in letter for b in letter
    ]
    return spark.createDataFrame(rows, "matrix string, from_aa string, to_aa string, score double")


def symmetric_scores(matrix: DataFrame) -> DataFrame:
    """Adds (b, a) for every (a, b) that has no entry of its own."""
    flipped = matrix.select("matrix", F.col("to_aa").alias("from_aa"), F.col("from_aa").alias("to_aa"), "score")
    own = matrix.withColumn("__p", F.lit(0)).unionByName(flipped.withColumn("__p", F.lit(1)))
    first = F.min(F.struct("__p", "score")).alias("__s")
    return own.groupBy("matrix", "from_aa", "to_aa").agg(first).select(
        "matrix", "from_aa", "to_aa", F.col("__s.score").alias("score")
    )


def substitution_probs(matrix: DataFrame, alphabet: str = MUTABLE_ALPHABET) -> DataFrame:
    """Softmax of each matrix row over the letters of ``alphabet``, with cumulative bounds."""
    known = list(alphabet)
    scores = symmetric_scores(matrix).where(F.col("to_aa").isin(known))
    whole = Window.partitionBy("matrix", "from_aa")
    upto = whole.orderBy("to_aa").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.exp("score")
    p = scores.withColumn("prob", weight / F.sum(weight).over(whole))
    high = F.sum("prob").over(upto)
    return p.withColumn("cum_hi", high).withColumn("cum_lo", F.col("cum_hi") - F.col("prob"))


def _matrix_maps(matrix: DataFrame, alphabet: str) -> DataFrame:
    """One row per matrix: letter -> ordered (cumulative bound, substitute)."""
    probs = substitution_probs(matrix, alphabet).where(F.col("from_aa").isin(list(alphabet)))
    options = probs.groupBy("matrix", "from_aa").agg(
        F.sort_array(F.collect_list(F.struct("cum_hi", "to_aa"))).alias("options")
    )
    return options.groupBy("matrix").agg(
        F.map_from_entries(F.collect_list(F.struct("from_aa", "options"))).alias("table")
    )


def _is_small(matrix: DataFrame) -> bool:
    # The table is small by construction (letters^2 rows per matrix); the size is still looked at.
    return matrix.limit(MAX_MATRIX_ROWS + 1).count() <= MAX_MATRIX_ROWS


def _collected_tables(maps: DataFrame) -> Tables:
    """The rows of :func:`_matrix_maps` for tasks: per matrix and letter code the cumulative bounds and the substitutes' codes."""
    out: Tables = {}
    for row in maps.collect():
        for letter, options in row["table"].items():
            # A bound that is missing is never met.
            bounds = np.array([-1.0 if o["cum_hi"] is None else o["cum_hi"] for o in options])
            out.setdefault(row["matrix"], {})[ord(letter)] = bounds, np.array([ord(o["to_aa"]) for o in options], np.uint32)
    return out


def _drawn(c: Column, pick: Column) -> Column:
    hit = F.filter(pick["options"], lambda o: pick["u"] < o["cum_hi"])
    # The last bound can fall short of 1 by rounding; the last letter takes what is left.
    last = F.element_at(pick["options"], -1)
    return F.coalesce(F.get(hit, F.lit(0))["to_aa"], last["to_aa"], c)


def changed_places(prefix: str, seq: str, uniforms: np.ndarray, n: int, alphabet: str, seed: int) -> np.ndarray:
    """The ``n`` mutable places of lowest uniforms, each with the uniform of its substitute added."""
    at = np.array([i for i, c in enumerate(seq) if c in alphabet], dtype=np.int64)
    at = at[np.lexsort((at, uniforms[at]))[:n]]
    return at + np.array([single_uniform(f"{prefix}{i}:s:{seed}") for i in at])


def _bulk_places(keys: list[Column], n_change: Column, alphabet: str, seed: int) -> Column:
    """What to change in rows of up to BULK_PLACES letters (see :func:`changed_places`); nothing in longer ones."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def places(prefix: pd.Series, seq: pd.Series, n: pd.Series) -> pd.Series:
        drawn = place_uniforms(prefix.tolist(), seq.str.len().to_numpy(dtype=np.int64), f":p:{seed}")
        rows = zip(prefix, seq, drawn, n, strict=True)
        return pd.Series([changed_places(p, s, u, k, alphabet, seed) for p, s, u, k in rows], dtype=object)

    few = F.when((n_change > 0) & (F.length("seq") <= BULK_PLACES), F.col("seq")).otherwise("")
    return places(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit("")), few, F.coalesce(n_change, F.lit(0)))


def _with_substitutes(found: Column) -> Column:
    """``seq`` with a substitute at each of the places found."""

    def put(text: Column, x: Column) -> Column:
        at = F.floor(x).cast("int") + 1
        c = F.substr(text, at, F.lit(1))
        options = F.struct((x - F.floor(x)).alias("u"), F.col("table")[c].alias("options"))
        return F.overlay(text, bind(options, lambda pick: _drawn(c, pick)), at)

    return F.aggregate(found, F.col("seq"), put)


def substituted(prefixes: list[str], seqs: list[str], counts: np.ndarray, matrices: list, tables: Tables, alphabet: str, seed: int) -> list[str]:
    """Each row with its ``counts`` mutable places of lowest uniforms substituted by its matrix, alike rows together."""
    out, sizes = list(seqs), np.array([len(s) for s in seqs], np.int64)
    mutable = np.array([ord(c) for c in alphabet], np.uint32)
    # Rows without work to do need no draws.
    busy = [i for i, n in enumerate(counts) if n > 0 and sizes[i] and matrices[i] in tables]
    for rows, heads, uniforms in place_groups([prefixes[i] for i in busy], sizes[busy], f":p:{seed}"):
        at, most = [busy[r] for r in rows], uniforms.shape[1]
        text = "".join(seqs[i].ljust(most, "\0") for i in at)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(at), most).copy()
        open_ = np.isin(codes, mutable)
        order = np.argsort(np.where(open_, uniforms, np.inf), axis=1, kind="stable")
        drawn = np.minimum(counts[at], open_.sum(axis=1))
        row, k = np.nonzero(np.arange(most) < drawn[:, None])
        place = order[row, k]
        draws, old = place_draws(heads, row, place, f":s:{seed}"), codes[row, place]
        new, names = old.copy(), np.array([matrices[i] for i in at], object)[row]
        for name in set(matrices[i] for i in at):
            mine = names == name
            for letter, (bounds, letters_) in tables[name].items():
                hit = np.flatnonzero(mine & (old == letter))
                # The last bound can fall short of 1 by rounding; the last letter takes what is left.
                new[hit] = letters_[np.minimum(np.searchsorted(bounds, draws[hit], side="right"), len(bounds) - 1)]
        codes[row, place] = new
        text = codes.tobytes().decode("utf-32-le")
        for r, i in enumerate(at):
            out[i] = text[r * most : r * most + sizes[i]]
    return out


def _bulk_rows(keys: list[Column], n_change: Column, tables: Tables, alphabet: str, seed: int) -> Column:
    """:func:`substituted` for rows of up to BULK_PLACES letters; empty for others and for those without work to do."""

    @F.pandas_udf(T.StringType())
    def rows(prefix: pd.Series, seq: pd.Series, n: pd.Series, matrix: pd.Series) -> pd.Series:
        names = [None if pd.isna(m) else m for m in matrix]
        return pd.Series(substituted(prefix.tolist(), seq.tolist(), n.to_numpy(np.int64), names, tables, alphabet, seed), dtype=object)

    few = F.when((n_change > 0) & (F.length("seq") <= BULK_PLACES), F.col("seq")).otherwise("")
    return rows(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit("")), few, F.coalesce(n_change, F.lit(0)), F.col("matrix"))


def _mutated(keys: list[Column], n_change: Column, alphabet: str, seed: int) -> Column:
    """Draws distinct mutable positions (lowest hashes first) and one substitute for each."""

    def ticket(c: Column, i: Column) -> Column:
        own = F.struct(hash_uniform(*keys, i, F.lit("p"), seed=seed).alias("u"), i.alias("i"))
        return F.when(F.instr(F.lit(alphabet), c) > 0, own)

    def cell(highest: Column, c: Column, own: Column) -> Column:
        u = hash_uniform(*keys, own["i"], F.lit("s"), seed=seed)
        options = F.struct(u.alias("u"), F.col("table")[c].alias("options"))
        return F.when(own <= highest, bind(options, lambda pick: _drawn(c, pick))).otherwise(c)

    def changed(tickets: Column) -> Column:
        # The highest ticket drawn decides every position on its own, so long rows cost no more per letter.
        drawn = F.slice(F.sort_array(F.array_compact(tickets)), 1, F.greatest(n_change, F.lit(0)).cast("int"))
        return bind(F.array_max(drawn), lambda highest: F.array_join(F.zip_with(letters(F.col("seq")), tickets, lambda c, own: cell(highest, c, own)), ""))

    # Bound, a letter's ticket is hashed once.
    return bind(F.transform(letters(F.col("seq")), ticket), changed)


def mutate_rows(
    df: DataFrame, matrix: DataFrame, n_change: Column, keys: list[str], alphabet: str = MUTABLE_ALPHABET, seed: int = 0
) -> DataFrame:
    """Substitutes ``n_change`` distinct mutable positions per row by the row's ``matrix``.

    Rows of up to BULK_PLACES letters are changed in Arrow batches with a small table at hand, others inside the row (arrays
    and a broadcast table), without exploding residues.
    A residue the matrix does not know stays, and so does a row without work to do.
    """
    on, maps, small = [F.col(k) for k in keys], _matrix_maps(matrix, alphabet), _is_small(matrix)
    n, short = F.col("__changes"), F.length("seq") <= BULK_PLACES
    # The Python step comes before the table, which would otherwise go through it with every row.
    if small:
        tables = _collected_tables(maps)
        found = df.withColumns({"__changes": n_change, "__found": _bulk_rows(on, n_change, tables, alphabet, seed)})
        # Only rows that the step leaves need the table at their side.
        found = found.withColumn("__matrix", F.when(~short, F.col("matrix")))
        maps = F.broadcast(maps)
        done = F.col("__found")
    else:
        found = df.withColumns({"__changes": n_change, "__found": _bulk_places(on, n_change, alphabet, seed), "__matrix": F.col("matrix")})
        done = _with_substitutes(F.col("__found"))
    out = found.join(maps.withColumnRenamed("matrix", "__matrix"), "__matrix", "left")
    text = F.when(short, done).otherwise(_mutated(on, n, alphabet, seed))
    return out.withColumn("seq", F.when(n > 0, text).otherwise(F.col("seq"))).select(*df.columns)


def percent_changes(rate: Column) -> Column:
    """``int(L * rate / 100)`` with the rate in percent and the count from the full length."""
    return F.floor(F.length("seq") * rate / F.lit(100.0)).cast("int")


def fraction_changes(rate: Column, alphabet: str) -> Column:
    """``max(1, int(mutable * rate))`` with the rate as a fraction; none at rate 0."""
    mutable = F.length(F.regexp_replace("seq", f"[^{alphabet}]", ""))
    return F.when(rate > 0, F.greatest(F.lit(1), F.floor(mutable * rate).cast("int"))).otherwise(F.lit(0))


def evolve(
    df: DataFrame,
    matrix: DataFrame,
    rates: dict[str, float],
    fraction: float = 0.5,
    key: list[str] = KEY,
    seed: int = 0,
) -> DataFrame:
    """Mutates ``max(1, int(n * fraction))`` rows per alignment, passes the others through.

    Each sampled row draws one of the matrices present in ``matrix``; its rate (percent) comes from
    ``rates``. Labels get the suffix ``_evolved_<matrix>``.
    """
    names = matrix.select("matrix").distinct().withColumn("__at", F.row_number().over(Window.orderBy("matrix")) - 1)
    n_names = names.count()
    keys = [F.col(k) for k in key] + [F.col("seq_idx")]
    size = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    drawn = df.join(size, key).withColumn("__u", hash_uniform(*keys, F.lit("pick"), seed=seed))
    buckets = F.ceil(F.col("__n") / F.lit(65536))
    ranked = row_numbers(drawn, key, F.floor(F.col("__u") * buckets), [F.col("__u"), F.col("seq_idx")], "__rank")
    sampled = F.col("__rank") < F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))
    if not n_names:
        return df
    draw = F.when(sampled, hash_index(F.lit(n_names), *keys, F.lit("matrix"), seed=seed).cast("int"))
    if n_names <= MAX_MATRIX_ROWS:
        names = F.broadcast(names)
    rate_of = F.create_map(*[F.lit(x) for m, rate in rates.items() for x in (m, float(rate))]) if rates else F.create_map()
    rate = F.coalesce(rate_of[F.col("matrix")], F.lit(float(FALLBACK_MUTATION_RATE))) if rates else F.lit(float(FALLBACK_MUTATION_RATE))
    marked = ranked.withColumn("__at", draw).join(names, "__at", "left").withColumn(
        "__n_change", F.when(F.col("matrix").isNotNull(), percent_changes(rate)).otherwise(F.lit(0))
    )
    changed = mutate_rows(marked, matrix, F.col("__n_change"), [*key, "seq_idx"], seed=seed)
    label = F.when(
        F.col("matrix").isNotNull(), F.concat("label", F.lit("_evolved_"), F.replace("matrix", F.lit(" "), F.lit("_")))
    ).otherwise(F.col("label"))
    return changed.withColumn("label", label).select(*df.columns)


def mutate_structural(
    df: DataFrame, matrix: DataFrame, rate: Column, keys: list[str], alphabet: str, seed: int = 0
) -> DataFrame:
    """Mutation of structure-token sequences: rate is a fraction of the mutable tokens."""
    return mutate_rows(df, matrix, fraction_changes(rate, alphabet), keys, alphabet, seed)


# --- Vectors --------------------------------------------------------------------------------------


def noise_at_scales(df: DataFrame, sigmas: list[float], keys: list[str], vector: str = "vector", seed: int = 0) -> DataFrame:
    """One noisy copy of every vector per sigma."""
    spread = df.select("*", F.posexplode(F.array(*[F.lit(float(s)) for s in sigmas])).alias("sigma_no", "sigma"))
    cols = [F.col(k) for k in keys] + [F.col("sigma_no")]
    noisy = F.transform(F.col(vector), lambda x, i: x + F.col("sigma") * hash_gauss(*cols, i, seed=seed))
    return spread.withColumn(vector, noisy)


def layer_noise(
    df: DataFrame, sigmas: list[float], decay: float, n_layers: int, keys: list[str], vector: str = "vector", seed: int = 0
) -> DataFrame:
    """Noise per layer: ``sigma * decay ** (n_layers - 1 - layer)``."""
    grid = df.select(
        "*", F.posexplode(F.array(*[F.lit(float(s)) for s in sigmas])).alias("sigma_no", "sigma")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("layer"))
    scale = F.col("sigma") * F.pow(F.lit(decay), F.lit(n_layers - 1) - F.col("layer"))
    cols = [F.col(k) for k in keys] + [F.col("sigma_no"), F.col("layer")]
    scaled = grid.withColumn("scale", scale)
    noisy = F.transform(F.col(vector), lambda x, i: x + F.col("scale") * hash_gauss(*cols, i, seed=seed))
    return scaled.withColumn(vector, noisy)


def principal_walk(
    df: DataFrame,
    n_components: int,
    steps: list[float],
    n_samples: int,
    sigma: float,
    keys: list[str],
    vector: str = "vector",
    seed: int = 0,
) -> DataFrame:
    """Every vector moved along the principal directions of its own noisy copies.

    The noisy copies are drawn from the row's keys, so one row yields components x steps vectors
    inside one Arrow task; rows are independent of each other. The sign of a direction is fixed by
    making its largest entry positive.
    """
    schema = T.StructType(
        key_fields(df, keys)
        + [
            T.StructField("component", T.IntegerType()),
            T.StructField("step", T.DoubleType()),
            T.StructField(vector, T.ArrayType(T.DoubleType())),
        ]
    )

    def walk(batches):
        # Vectors of one length go through together, some at a time.
        alike = (part for batch in batches for _, part in batch.groupby(batch[vector].str.len()))
        for pdf in (part.iloc[at : at + WALK_ROWS] for part in alike for at in range(0, len(part), WALK_ROWS)):
            base = np.stack(pdf[vector].to_numpy()).astype(float)
            draws = place_gauss([f"{p}{k}:" for p in pdf["__prefix"] for k in range(n_samples)], np.full(len(base) * n_samples, base.shape[1]), seed)
            clouds = sigma * np.array(draws, dtype=float).reshape(len(base), n_samples, -1)
            # All rows of the batch at once: the right singular vectors of every centred cloud.
            axes = np.linalg.svd(clouds - clouds.mean(axis=1, keepdims=True), full_matrices=False)[2][:, :n_components]
            peak = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[..., None], axis=2)
            moved = base[:, None, None, :] + np.asarray(steps)[None, None, :, None] * (axes * np.sign(peak))[:, :, None, :]
            rows, found, _, _ = moved.shape
            each = found * len(steps)
            yield pd.DataFrame(
                {k: np.repeat(pdf[k].to_numpy(), each) for k in keys}
                | {
                    "component": np.tile(np.repeat(np.arange(found), len(steps)), rows),
                    "step": np.tile(np.asarray(steps, dtype=float), rows * found),
                    vector: list(moved.reshape(rows * each, -1)),
                }
            )

    return df.select(*keys, vector, key_prefix(*[F.col(k) for k in keys]).alias("__prefix")).mapInPandas(walk, schema)
