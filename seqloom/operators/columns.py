"""Column statistics of alignments: counts, entropy, rarity, coverage, covariance, coevolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.alphabets import COLUMN_ALPHABET, RESIDUES_ONLY
from seqloom.functions.scalar import column_letter, letters, strip_gaps
from seqloom.functions.text import matches_udf, to_matrix
from seqloom.operators.groups import NUMBERING_BUCKET, OUTER_BUCKET, key_fields, over_tasks, row_numbers, salt, with_group_values
from seqloom.operators.neff import alignment_shape
from seqloom.operators.tiles import N_LETTERS, count_tiles, coupling_norms, covariance_tiles, letter_codes, negative_inverse, one_hot, product_corrected
from seqloom.session import MAX_GROUP_ROWS, written

KEY = ["msa_id"]
# A system is solved in one task up to so many columns (39 MB), or on the side of the rows up to so many cells (256 MB).
TASK_COLUMNS = 100
TASK_CELLS = 1 << 25
# On the side of the rows, a position's n x n product is used where these hold so many values at most (32 MB) and n is at most so
# many times a position's letters.
FEW_VALUES = 1 << 22
FEW_RATIO = 4
# Rows of one matrix product of joint counts, and partial sums of a position that are added up last.
PRODUCT_ROWS = 4096
JOINT_PARTS = 64
# Positions of the coupling matrix that are put together at a time.
STRIP = 16


def cells(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Long form: one row per residue, 0-based position."""
    return df.select(*key, "seq_idx", F.posexplode(letters(F.col("seq"))).alias("pos", "aa"))


def recoded_cells(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    return cells(df, key).withColumn("aa", column_letter(F.col("aa")))


def column_counts(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Letters per column; counted map-side first, so a hot alignment shuffles L x 22 rows per task."""
    return cells(df, key).groupBy(*key, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))


def column_entropy(counts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Entropy per column from :func:`column_counts`; every row has a letter, so rows = sum of counts."""
    rows = F.sum("n").over(Window.partitionBy(*key, "pos"))
    p = F.col("n") / F.col("n_rows")
    return (
        counts.withColumn("n_rows", rows)
        .groupBy(*key, "pos")
        .agg(
            F.max("n_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_letters"),
            F.sum(-p * F.log2(p + 1e-12)).alias("entropy"),
        )
    )


def rarity_scores(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Per row, the sum over columns of entropy / count of the row's own letter.

    Columns where a letter is universal add nothing. The per-column table is folded to one map per
    alignment, so rows join once on the alignment instead of once per residue.
    """
    by_column = Window.partitionBy(*key, "pos")
    p = F.col("n") / F.col("n_rows")
    scored = (
        column_counts(df, key)
        .withColumn("n_rows", F.sum("n").over(by_column))
        .withColumn("entropy", F.sum(-p * F.log2(p + 1e-12)).over(by_column))
        .withColumn("gain", F.when(F.col("n") < F.col("n_rows"), F.col("entropy") / F.col("n")).otherwise(0.0))
    )
    profile = scored.groupBy(*key, "pos").agg(
        F.map_from_entries(F.collect_list(F.struct("aa", "gain"))).alias("gains")
    ).groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "gains")), lambda x, y: x["pos"] - y["pos"]), lambda s: s["gains"]
        ).alias("profile")
    )
    gains = F.zip_with(letters(F.col("seq")), "profile", lambda aa, g: F.coalesce(g[aa], F.lit(0.0)))
    score = F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)
    # A large alignment is split by stretches of seq_idx, dealt to at most so many copies of the profile, so
    # that its rows are scored in many tasks; a small one has a single copy. Size estimates do not see
    # how far texts fan out into rows: without the hint a small file's rows could be broadcast.
    salted = df.withColumn("__salt", salt())
    copies = salted.select(*key, "__salt").distinct().join(profile, key)
    return salted.join(copies.hint("merge"), [*key, "__salt"]).withColumn("score", score).drop("profile", "__salt")


def position_coverage(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows without a gap per column."""
    return cells(df, key).groupBy(*key, "pos").agg(F.count_if(F.col("aa") != "-").alias("covered"))


def query_rows(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The first row of every alignment."""
    first = F.min(F.struct("seq_idx", "seq")).alias("__q")
    return df.groupBy(*key).agg(first).select(*key, F.col("__q.seq_idx").alias("query_idx"), F.col("__q.seq").alias("query"))


def identity_to_query(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Adds the query and the row's identity to it; rows of another length are left out."""
    first = with_group_values(df, key, {"__q": (F.min(F.struct("seq_idx", "seq")), F.min)})
    joined = first.select(*df.columns, F.col("__q.seq_idx").alias("query_idx"), F.col("__q.seq").alias("query")).where(F.length("seq") == F.length("query"))
    return joined.withColumn("identity", F.try_divide(matches_udf("seq", "query").cast("double"), F.length("seq")))


def coverage_rows(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Plot order of the coverage matrix: query first, then most residues first, ties by ``seq_idx``.

    Alignments of fewer than two rows are left out. Numbering is done per residue count, so a large
    alignment is never sorted in one task.
    """
    base = identity_to_query(df, key).withColumn("residues", F.length(strip_gaps(F.col("seq"))).cast("long"))
    pairs = with_group_values(base, key, {"__n": (F.count(F.lit(1)), F.sum)}).where(F.col("__n") >= 2).drop("__n")
    is_query = F.col("seq_idx") == F.col("query_idx")
    kind = F.when(is_query, 0).otherwise(1).alias("a")
    filled = F.when(is_query, F.lit(0).cast("long")).otherwise(-F.col("residues")).alias("b")
    stretch = F.floor(F.col("seq_idx") / NUMBERING_BUCKET)
    place, outer = F.struct(kind, filled, stretch.alias("c")), F.struct(kind, filled, F.floor(stretch / OUTER_BUCKET).alias("c"))
    return row_numbers(pairs, key, place, [F.col("seq_idx")], "row_rank", outer)


def coverage_cells(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The coverage matrix in long form: identity to the query where the row has a residue, else null."""
    rows = coverage_rows(df, key)
    long = rows.select(*key, "row_rank", "identity", F.posexplode(letters(F.col("seq"))).alias("pos", "aa"))
    return long.select(*key, "row_rank", "pos", F.when(F.col("aa") != "-", F.col("identity")).alias("value"))


# --- Column-pair covariance -------------------------------------------------------------------------


def _joint_kernel(key: list[str]):
    """A block of rows to a row per position: counts of its letters with those of the positions from there on, as an array."""

    def run(table: pa.Table) -> pa.Table:
        codes = letter_codes(table.column("seq").to_pylist())
        width = codes.shape[1]
        both = np.zeros((width * N_LETTERS, width * N_LETTERS), np.int32)
        for at in range(0, len(codes), PRODUCT_ROWS):
            y = one_hot(codes[at : at + PRODUCT_ROWS], np.float32)
            both += (y.T @ y).astype(np.int32)
        head = table.select([*key, "__part"]).take(pa.array(np.zeros(width, np.int64)))
        strips = [both[p * N_LETTERS : (p + 1) * N_LETTERS, p * N_LETTERS :].astype(np.int64).tobytes() for p in range(width)]
        return head.append_column("pos", pa.array(range(width), pa.int32())).append_column("data", pa.array(strips, pa.binary()))

    return run


def _added(table: pa.Table) -> np.ndarray:
    data = table.column("data")
    total = np.frombuffer(data[0].as_py(), np.int64).copy()
    for at in range(1, len(data)):
        total += np.frombuffer(data[at].as_py(), np.int64)
    return total


def joint_counts(df: DataFrame, key: list[str] = KEY, block_rows: int = 65536) -> DataFrame:
    """How often two (position, letter) states occur in one row; states are ``pos * 22 + letter``.

    Each block of rows becomes matrix products of ``PRODUCT_ROWS`` rows, added up in the task. What leaves it is an array per position;
    these are added up in two steps, and only the sums become rows.
    """
    shape = alignment_shape(df, key).where((F.col("min_len") == F.col("max_len")) & (F.col("min_len") > 0))
    blocks = F.ceil(F.col("n_rows") / block_rows)
    blocked = df.join(shape, key).withColumn("__blk", F.pmod(F.xxhash64("seq_idx"), blocks)).withColumn("__part", F.col("__blk") % JOINT_PARTS)
    strip = [T.StructField("pos", T.IntegerType()), T.StructField("data", T.BinaryType())]
    partial = T.StructType([*key_fields(df, key), T.StructField("__part", T.LongType()), *strip])

    def add(table: pa.Table) -> pa.Table:
        return table.select([*key, "__part", "pos"]).slice(0, 1).append_column("data", pa.array([_added(table).tobytes()], pa.binary()))

    def spread(table: pa.Table) -> pa.Table:
        total = _added(table).reshape(N_LETTERS, -1)
        total[:, :N_LETTERS] = np.triu(total[:, :N_LETTERS])
        a, b = np.nonzero(total)
        first = table.column("pos")[0].as_py() * N_LETTERS
        head = table.select(key).take(pa.array(np.zeros(len(a), np.int64)))
        for name, values in (("a", a + first), ("b", b + first), ("n", total[a, b])):
            head = head.append_column(name, pa.array(values.astype(np.int64)))
        return head

    schema = T.StructType(key_fields(df, key) + [T.StructField(c, T.LongType()) for c in ("a", "b", "n")])
    rows = over_tasks(blocked.select(*key, "seq", "__blk", "__part"), [*key, "__blk"])
    strips = rows.groupBy(*key, "__blk").applyInArrow(_joint_kernel(key), partial)
    return strips.groupBy(*key, "pos", "__part").applyInArrow(add, partial).groupBy(*key, "pos").applyInArrow(spread, schema)


def _state(col: str, prefix: str) -> list[Column]:
    aa = F.substr(F.lit(COLUMN_ALPHABET), (F.col(col) % N_LETTERS + 1).cast("int"), F.lit(1))
    return [F.floor(F.col(col) / N_LETTERS).cast("long").alias("pos_" + prefix), aa.alias("aa_" + prefix)]


def column_covariance(df: DataFrame, key: list[str] = KEY, block_rows: int = 65536) -> DataFrame:
    """Covariance of the one-hot columns (N - 1 denominator) for every observed pair of states.

    Upper triangle including the diagonal; a pair never seen together has ``-n_a n_b / (N (N - 1))``.
    """
    joint = joint_counts(df, key, block_rows)
    single = joint.where(F.col("a") == F.col("b"))
    one = single.select(*key, F.col("a"), F.col("n").alias("n_a"))
    two = single.select(*key, F.col("a").alias("b"), F.col("n").alias("n_b"))
    # Every row has one letter in the first column.
    rows = single.where(F.col("a") < N_LETTERS).groupBy(*key).agg(F.sum("n").alias("n_rows")).where(F.col("n_rows") > 1)
    cov = (F.col("n") - F.col("n_a") * F.col("n_b") / F.col("n_rows")) / (F.col("n_rows") - 1)
    return (
        joint.join(one, [*key, "a"]).join(two, [*key, "b"]).join(rows, key)
        .select(*key, *_state("a", "i"), *_state("b", "j"), "n", cov.alias("cov"))
    )


# --- Coevolution ------------------------------------------------------------------------------------


def _corrected(raw: np.ndarray) -> np.ndarray:
    """Average-product correction; the means include the zero diagonal."""
    np.fill_diagonal(raw, 0.0)
    mean = raw.mean()
    out = raw - (np.outer(raw.mean(axis=1), raw.mean(axis=0)) / mean if mean else 0.0)
    np.fill_diagonal(out, 0.0)
    return out


def _block_norms(inverse_rows, diag: np.ndarray, width: int) -> np.ndarray:
    """Frobenius norm of each 20 x 20 block of the normalised inverse, a strip of positions at a time."""
    scale = 1.0 / np.sqrt(diag)
    raw = np.zeros((width, width))
    strip = 16
    for lo in range(0, width, strip):
        hi = min(width, lo + strip)
        part = inverse_rows(slice(lo * N_LETTERS, hi * N_LETTERS))
        part = part * scale[lo * N_LETTERS : hi * N_LETTERS, None] * scale[None, :]
        blocks = part.reshape(hi - lo, N_LETTERS, width, N_LETTERS)[:, :RESIDUES_ONLY, :, :RESIDUES_ONLY]
        raw[lo:hi] = np.sqrt((blocks**2).sum(axis=(1, 3)))
    return raw


def _norms_by_products(side: np.ndarray, scaled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Block norms off the diagonal as scalar products of n x n matrices: the squares of a block of X' K X sum up to that of G_i and
    K G_j K, where K is ``side`` and G sums the outer products of a position's columns of ``scaled``.
    """
    outer = np.stack([part @ part.T for part in np.split(scaled, starts[1:], axis=1)])
    turned = (side @ outer @ side).reshape(len(outer), -1)
    return np.sqrt(np.maximum(outer.reshape(len(outer), -1) @ turned.T, 0.0))


def _norms_by_blocks(rows, size: int, starts: np.ndarray) -> np.ndarray:
    """Block norms of the matrix whose ``columns``-th rows ``rows(columns)`` gives, a strip of positions at a time."""
    ends, out = np.append(starts[1:], size), np.empty((len(starts), len(starts)))
    for at in range(0, len(starts), STRIP):
        lo, hi = starts[at], ends[min(at + STRIP, len(ends)) - 1]
        squares = np.add.reduceat(np.square(rows(slice(lo, hi))), starts, axis=1)
        out[at : at + STRIP] = np.add.reduceat(squares, starts[at : at + STRIP] - lo, axis=0)
    return np.sqrt(out)


def _coevolution_from_rows(seqs: list[str]) -> np.ndarray:
    y = one_hot(letter_codes(seqs))
    n, size = y.shape
    width, seen, shrink = size // N_LETTERS, y.sum(axis=0), 4.5 / np.sqrt(n)
    # A letter that a column has in no row or in all has no covariance: it stands alone in the inverse too.
    live = np.flatnonzero((seen > 0) & (seen < n))
    x = (y[:, live] - seen[live] / n) / np.sqrt(n - 1)
    residues = np.flatnonzero(live % N_LETTERS < RESIDUES_ONLY)
    places, starts = np.unique(live[residues] // N_LETTERS, return_index=True)
    raw = np.zeros((width, width))
    if not len(places):
        return raw
    if n < len(live):
        # Fewer rows than states: invert the n x n side of the same matrix (Woodbury identity); shrink cancels out.
        side, x = np.linalg.inv(shrink * np.eye(n) + x @ x.T), x[:, residues]
        core = side @ x
        scale = 1.0 / np.sqrt(1.0 - (x * core).sum(axis=0))
        x *= scale
        if n * n * len(places) <= min(FEW_VALUES, n * len(residues) * FEW_RATIO):
            norms = _norms_by_products(side, x, starts)
        else:
            core *= scale
            norms = _norms_by_blocks(lambda part: x[:, part].T @ core, len(residues), starts)
    else:
        inverse = np.linalg.inv(x.T @ x + shrink * np.eye(len(live)))[np.ix_(residues, residues)]
        scale = 1.0 / np.sqrt(np.diag(inverse))
        norms = _norms_by_blocks(lambda part: inverse[part] * scale[part, None] * scale, len(residues), starts)
    raw[np.ix_(places, places)] = norms
    return _corrected(raw)


def _coevolution_from_counts(pdf: pd.DataFrame, width: int, n: int) -> np.ndarray:
    size = width * N_LETTERS
    both = np.zeros((size, size))
    a, b, c = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy()
    both[a, b] = c
    both[b, a] = c
    single = np.diag(both).copy()
    cov = (both - np.outer(single, single) / n) / (n - 1)
    inverse = np.linalg.inv(cov + 4.5 / np.sqrt(n) * np.eye(size))
    return _corrected(_block_norms(lambda part: inverse[part], np.diag(inverse), width))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(seqs: pd.Series) -> pd.Series:
    return pd.Series([_coevolution_from_rows(list(s)).ravel() for s in seqs])


def _long(matrix: np.ndarray, head: dict) -> pd.DataFrame:
    i, j = np.indices(matrix.shape)
    return pd.DataFrame({**head, "i": i.ravel(), "j": j.ravel(), "score": matrix.ravel()})


def coevolution(
    df: DataFrame,
    key: list[str] = KEY,
    max_group_rows: int = MAX_GROUP_ROWS,
    task_columns: int = TASK_COLUMNS,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """APC-corrected coupling of every column pair, as ``(i, j, score)`` rows.

    One-hot covariance, shrinkage 4.5 / sqrt(N), inverse, normalised 20 x 20 block norms, average
    product correction. Ragged, zero-width and one-row alignments are left out. Alignments of up to ``max_group_rows`` rows
    and ``task_cells`` one-hot cells are solved on the side of the rows, deeper ones of up to ``task_columns`` columns
    from joint counts, each in one task; all others as tiles over many tasks, whatever their depth and width.
    """
    shape = alignment_shape(df, key).where(
        (F.col("min_len") == F.col("max_len")) & (F.col("n_rows") >= 2) & (F.col("min_len") > 0)
    )
    way = F.when((F.col("n_rows") <= max_group_rows) & (F.col("n_rows") * F.col("max_len") * N_LETTERS <= task_cells), "rows")
    way = way.when(F.col("max_len") <= task_columns, "counts").otherwise("tiles")
    fit = written(shape.select(*key, "n_rows", F.col("max_len").cast("long").alias("width"), way.alias("way")))
    schema = T.StructType(
        key_fields(df, key)
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("score", T.DoubleType())]
    )

    def solve_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = _coevolution_from_counts(pdf, int(pdf["width"].iloc[0]), int(pdf["n_rows"].iloc[0]))
        return _long(matrix, {k: pdf[k].iloc[0] for k in key})

    def from_rows(part: DataFrame, sizes: DataFrame) -> DataFrame:
        packed = over_tasks(part, key).groupBy(*key).agg(F.collect_list("seq").alias("seqs"))
        solved = packed.select(*key, F.length(F.col("seqs")[0]).alias("width"), F.posexplode(_solve("seqs")).alias("at", "score"))
        return solved.select(
            *key, F.floor(F.col("at") / F.col("width")).cast("int").alias("i"), (F.col("at") % F.col("width")).alias("j"), "score"
        )

    def from_counts(part: DataFrame, sizes: DataFrame) -> DataFrame:
        return over_tasks(joint_counts(part, key).join(sizes, key), key).groupBy(*key).applyInPandas(solve_counts, schema)

    def from_tiles(part: DataFrame, sizes: DataFrame) -> DataFrame:
        inverse, _ = negative_inverse(covariance_tiles(count_tiles(part, sizes, key), key), key)
        return product_corrected(written(coupling_norms(inverse, key)), sizes, key)

    ways = {"rows": from_rows, "counts": from_counts, "tiles": from_tiles}
    out = None
    for name in [r["way"] for r in fit.select("way").distinct().collect()] or ["rows"]:
        sizes = fit.where(F.col("way") == name).select(*key, "n_rows", "width")
        part = ways[name](df.join(sizes.select(*key), key, "left_semi"), sizes)
        out = part if out is None else out.unionByName(part)
    return out
