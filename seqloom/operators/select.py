"""Representative subsets. Every result carries ``rank`` (0 is the query)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.text import matches_udf, pair_matches, to_matrix
from seqloom.functions.uniform import hash_uniform
from seqloom.operators.columns import rarity_scores
from seqloom.operators.dedup import distinct_ordered
from seqloom.operators.groups import by_size, first_n, key_fields, pack_rows, picked_rows, with_group_values
from seqloom.session import MAX_GROUP_ROWS, cut_lineage, written

KEY = ["msa_id"]
TIE = 12  # decimals at which two gains count as equal
STEP = 512  # rows compared with all others at a time

class Rule:
    """A greedy rule over the rows of a matrix, some of which are picked one after the other.

    The value that the next pick maximises (equal values go to the first row in order) depends on the picks so far. For
    alignments that no task holds, a row carries a small array of whole numbers (``carried``), and what it shares with all others
    is one array per alignment (``shared``); both follow from the picks.
    """

    #: No value ever exceeds it.
    ceiling = np.inf

    def start(self, rows: np.ndarray, n: int) -> None:
        """Begins with no picks, of which there will be up to n."""
        raise NotImplementedError

    def absorb(self, i: int) -> None:
        """Picks row i."""
        raise NotImplementedError

    def value(self, open_: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def gain(self) -> float:
        """By how much the value of a row can have grown since ``mark`` was called."""
        return 0.0

    def mark(self) -> None:
        pass

    def shared(self) -> np.ndarray:
        return np.zeros(0)

    def carried(self, rows: np.ndarray, held: list, picks: np.ndarray, first: int) -> list:
        """What the rows carry after the picks from number ``first`` on."""
        return held

    def worth(self, rows: np.ndarray, held: list, shared: np.ndarray) -> np.ndarray:
        """The value of rows from what they carry."""
        raise NotImplementedError


class Farthest(Rule):
    """The most columns in which a row equals any pick is to be least."""

    def start(self, rows, n):
        self.rows, self.most = rows, np.zeros(len(rows), np.int64)

    def absorb(self, i):
        self.most = np.maximum(self.most, (self.rows == self.rows[i]).sum(axis=1))

    def value(self, open_):
        return -self.most[open_].astype(float)

    def carried(self, rows, held, picks, first):
        most = np.array([h[0] if len(h) else 0 for h in held])
        for row in picks:
            most = np.maximum(most, (rows == row).sum(axis=1))
        return [[int(m)] for m in most]

    def worth(self, rows, held, shared):
        return -np.array([h[0] for h in held], float)


class Coverage(Rule):
    """Columns that no pick has filled yet, shared by all rows."""

    def start(self, rows, n):
        self.filled, self.open = rows != ord("-"), np.ones(rows.shape[1])

    def absorb(self, i):
        self.open = self.open * ~self.filled[i]

    def value(self, open_):
        return self.filled[open_] @ self.open

    def shared(self):
        return self.open

    def worth(self, rows, held, shared):
        return (rows != ord("-")) @ shared


class Depth(Rule):
    """How many picks are near each pick (shared), and which picks are near a row (carried).

    A candidate adds its own weight and lowers that of the picks near it.
    """

    def __init__(self, threshold: float = 0.5, sign: float = 1.0):
        self.threshold, self.sign = threshold, sign
        self.ceiling = 1.0 if sign > 0 else np.inf

    def _close(self, rows: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (rows == row).mean(axis=1) >= self.threshold

    def start(self, rows, n):
        self.rows, self.near, self.among, self.k = rows, np.zeros((len(rows), n), bool), np.zeros(n), 0
        self.mark()

    def absorb(self, i):
        k = self.k
        self.among[:k] += self.near[i, :k]
        self.among[k] = self.near[i, :k].sum()
        self.near[:, k] = self._close(self.rows, self.rows[i])
        self.k += 1

    def _loss(self, among: np.ndarray) -> np.ndarray:
        return 1.0 / (2.0 + among) - 1.0 / (1.0 + among)

    def _rounded(self, near: np.ndarray, among: np.ndarray) -> np.ndarray:
        return self.sign * np.round(1.0 / (1.0 + near.sum(axis=1)) + near @ self._loss(among), TIE)

    def value(self, open_):
        return self._rounded(self.near[open_, : self.k], self.among[: self.k])

    def mark(self):
        self.before = self.among[: self.k].copy()

    def gain(self):
        if self.sign < 0:
            return np.inf if self.k > len(self.before) else 0.0
        # Only the loss of earlier picks can shrink; a new pick near a row lowers its value.
        return float((self._loss(self.among[: len(self.before)]) - self._loss(self.before)).sum())

    def shared(self):
        return self.among[: self.k]

    def carried(self, rows, held, picks, first):
        out = [list(h) for h in held]
        for k, row in enumerate(picks, first):
            for i in np.flatnonzero(self._close(rows, row)):
                out[i].append(k)
        return out

    def worth(self, rows, held, shared):
        near = np.zeros((len(rows), len(shared)), bool)
        size = [len(h) for h in held]
        near[np.repeat(np.arange(len(rows)), size), np.concatenate([np.zeros(0, np.int64), *[np.asarray(h, np.int64) for h in held]])] = True
        return self._rounded(near, shared)


_RULES: dict[str, Callable[[], Rule]] = {"farthest_first": Farthest, "max_coverage": Coverage, "neff_contribution": Depth}
STRATEGIES = [*_RULES, "column_entropy", "random"]


def greedy_order(rule: Rule, rows: np.ndarray, n: int, window: int | None = None) -> list[int]:
    """Positions of row 0 and the picks after it; with a ``window`` each is one of so many first rows left."""
    rule.start(rows, min(n, len(rows)))
    left, order = np.arange(1, len(rows)), [0]
    while len(order) < n and len(left):
        rule.absorb(order[-1])
        open_ = left[:window]
        order.append(int(open_[np.argmax(rule.value(open_))]))
        left = left[left != order[-1]]
    return order


def safe_picks(rule: Rule, rows: np.ndarray, done: int, n: int, last: tuple[float, int] | None) -> list[int]:
    """Next picks among rows of which the first ``done`` are picked already, as long as no row that is not here can be better.

    The others stand in their order; ``last`` is the value that the worst of them had when they were chosen and its place among
    them, or None if there are no rows besides. Rows elsewhere had no better value, and at an equal one come later in order.
    """
    rule.start(rows, n)
    for i in range(done):
        rule.absorb(i)
    rule.mark()
    left, found = np.arange(done, len(rows)), []
    while done + len(found) < n and len(left):
        values = rule.value(left)
        at = int(np.argmax(values))
        pick = int(left[at])
        if last is not None and found:
            bound = min(last[0] + rule.gain(), rule.ceiling)
            if values[at] < bound or (values[at] == bound and (bound > last[0] or pick - done > last[1])):
                break
        found.append(pick)
        rule.absorb(pick)
        left = np.delete(left, at)
    return found


def _greedy_udf(rule: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(seqs: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([greedy_order(_RULES[rule](), to_matrix(list(s)), min(int(k), len(s))) for s, k in zip(seqs, n)])

    return run


def _small(df: DataFrame, key: list[str], rule: str, n: int) -> DataFrame:
    columns = [c for c in df.columns if c not in ("__first", "__cap")]
    # The query sorts first, the others by seq_idx.
    ordered = df.withColumn("__place", F.when(F.col("__first"), 0).otherwise(1))
    packed = pack_rows(ordered, key, ["__place", "seq_idx"])
    limit = F.least(F.lit(n).cast("long"), F.col("rows")[0]["__cap"])
    return picked_rows(packed, key, _greedy_udf(rule)(F.col("rows.seq"), limit), columns)


#: Rows of an alignment that meet in a task for its next picks.
POOL = 4096


def spread_order(base: DataFrame, first: DataFrame, rule: Callable[[], Rule], key: list[str], n: int, order: list[str], window: int | None = None) -> DataFrame:
    """(key, rank, seq_idx) of greedy picks over alignments that no task holds.

    ``base``: key, seq_idx, seq and the tie columns ``order``; ``first``: key, seq_idx, seq of what is picked
    beforehand (seq_idx may be null). Greedy by bounds: values only fall, so the rows of highest value are gathered, a bounded
    number per alignment, and give picks until a row left outside could be better. All rows then take in these picks, and the
    next are gathered. With a ``window``, only the first ``window + n`` rows in order can ever be picked: they meet in one task.
    """
    ties = [c for c in order if c not in ("seq_idx", "seq")]
    rows = base.select(*key, "seq_idx", "seq", *ties, F.array().cast("array<int>").alias("held"), F.lit(None).cast("double").alias("value"))
    zero = F.array().cast("array<double>").alias("shared")
    picks = written(first.select(*key, F.array("seq_idx").alias("ids"), F.array("seq").alias("seqs"), zero, F.lit(0).alias("since")))
    by_value = [F.col("value").desc(), *[F.col(c) for c in order]]
    fields = [*key_fields(base, key), *[picks.schema[c] for c in ("ids", "seqs", "shared", "since")]]

    def choose(pool: pd.DataFrame, so_far: pd.DataFrame) -> pd.DataFrame:
        if so_far.empty:
            return so_far
        row = so_far.iloc[0]
        ids, seqs = [None if pd.isna(i) else int(i) for i in row["ids"]], list(row["seqs"])
        pool = pool.sort_values(order, kind="stable").reset_index(drop=True)
        size = POOL if window is None else window + n
        last = None
        if window is None and len(pool) >= size:
            worst = int(pool.index[pool["value"] == pool["value"].min()].max())
            last = float(pool["value"][worst]), worst
        texts = [*seqs, *pool["seq"]]
        mine = rule()
        if window is None:
            found = safe_picks(mine, to_matrix(texts), len(seqs), n, last)
        else:
            found = greedy_order(mine, to_matrix(texts), n, window)[1:]
            mine.start(to_matrix(texts[:1]), 1)
        ids += [int(pool["seq_idx"][i - len(seqs)]) for i in found]
        out = {**{k: row[k] for k in key}, "ids": ids, "seqs": seqs + [texts[i] for i in found], "shared": mine.shared().tolist(), "since": len(seqs)}
        return pd.DataFrame([out])

    def gathered(rows: DataFrame, by: list, size: int) -> DataFrame:
        pool = first_n(rows, key, by, size).select(*key, "seq_idx", "seq", *ties, "value")
        return pool.groupBy(*key).cogroup(picks.groupBy(*key)).applyInPandas(choose, T.StructType(fields))

    step = T.StructType([T.StructField("held", T.ArrayType(T.IntegerType())), T.StructField("value", T.DoubleType())])

    @F.pandas_udf(step)
    def advance(seq: pd.Series, held: pd.Series, seqs: pd.Series, shared: pd.Series, since: pd.Series, whose: pd.Series) -> pd.DataFrame:
        held_out, values = np.empty(len(seq), object), np.zeros(len(seq))
        mine = rule()
        # Rows of one alignment go through the rule together.
        for at in whose.groupby(whose).indices.values():
            matrix = to_matrix(seq.iloc[at].tolist())
            new, first = list(seqs.iloc[at[0]]), int(since.iloc[at[0]])
            now = mine.carried(matrix, list(held.iloc[at]), to_matrix(new) if new else matrix[:0], first)
            values[at] = mine.worth(matrix, now, np.asarray(shared.iloc[at[0]], float))
            for i, x in zip(at, now):
                held_out[i] = x
        return pd.DataFrame({"held": held_out, "value": values})

    if window is not None:
        picks = written(gathered(rows, [F.col(c) for c in order], window + n))
    else:
        # The first picks are taken in before anything is gathered.
        todo = picks.withColumn("shared", _shared_udf(rule)("seqs"))
        while True:
            new = F.slice("seqs", F.col("since") + 1, F.size("seqs"))
            met = rows.join(todo.select(*key, F.col("ids").alias("__ids"), new.alias("__new"), "shared", "since"), key)
            met = met.where(~F.coalesce(F.array_contains("__ids", F.col("seq_idx")), F.lit(False)))
            done = met.withColumn("__s", advance("seq", "held", "__new", "shared", "since", F.xxhash64(*key)))
            rows = written(done.select(*[c for c in rows.columns if c not in ("held", "value")], "__s.held", "__s.value"))
            picks = written(gathered(rows, by_value, POOL))
            todo = picks.where((F.size("ids") < n) & (F.size("ids") > F.col("since")))
            if todo.isEmpty():
                break
    return picks.select(*key, F.posexplode("ids").alias("rank", "seq_idx")).withColumn("rank", F.col("rank").cast("long"))


def _shared_udf(rule: Callable[[], Rule]):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(seqs: pd.Series) -> pd.Series:
        out = []
        for s in seqs:
            mine = rule()
            mine.start(to_matrix(list(s)), len(s))
            for i in range(len(s)):
                mine.absorb(i)
            out.append(mine.shared().tolist())
        return pd.Series(out, dtype=object)

    return run


def _large(df: DataFrame, key: list[str], rule: Callable[[], Rule], n: int) -> DataFrame:
    base = cut_lineage(df)
    first = base.where("__first").select(*key, "seq_idx", "seq")
    cap = base.groupBy(*key).agg(F.max("__cap").alias("__cap"))
    order = spread_order(base, first, rule, key, n, ["seq_idx"]).join(cap, key).where(F.col("rank") < F.col("__cap"))
    return base.drop("__first", "__cap").join(order.select(*key, "seq_idx", "rank"), [*key, "seq_idx"])


def _with_query(df: DataFrame, key: list[str], query: DataFrame | None) -> DataFrame:
    """Marks the query row; a query that is not a row of its alignment is put in front (seq_idx -1)."""
    if query is None:
        marks = with_group_values(df, key, {"__q": (F.min("seq_idx"), F.min), "__cap": (F.count(F.lit(1)), F.sum)})
        return marks.withColumn("__first", F.col("seq_idx") == F.col("__q")).drop("__q")
    extra = [c for c in df.columns if c not in (*key, "seq_idx", "seq")]
    given = query.select(*key, F.col("query").alias("__query"))
    size = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__cap"))
    held = (
        df.join(given, key).where(F.col("seq") == F.col("__query")).groupBy(*key).agg(F.min("seq_idx").alias("__q"))
    )
    marks = size.join(held, key, "left")
    rows = df.join(marks, key).withColumn("__first", F.coalesce(F.col("seq_idx") == F.col("__q"), F.lit(False)))
    absent = given.join(marks.where(F.col("__q").isNull()), key).select(
        *key,
        F.lit(-1).cast("long").alias("seq_idx"),
        F.col("__query").alias("seq"),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in extra],
        "__cap",
        F.lit(True).alias("__first"),
    )
    return rows.drop("__q").unionByName(absent)


def select_subset(
    df: DataFrame,
    n: int,
    strategy: str = "farthest_first",
    query: DataFrame | None = None,
    key: list[str] = KEY,
    seed: int = 0,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``n`` representative rows per alignment, the query first.

    ``n`` is capped at the row count before a missing ``query`` (columns key + ``query``) is put in
    front. With ``n <= 1`` only the query is returned. Strategies: farthest_first, max_coverage,
    neff_contribution, column_entropy, random.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}', choose from {', '.join(STRATEGIES)}")
    marked = _with_query(df, key, query)
    limit = max(n, 1)
    if limit == 1:
        return marked.where("__first").drop("__first", "__cap").withColumn("rank", F.lit(0).cast("long"))
    if strategy in _RULES:
        return by_size(
            marked,
            key,
            lambda part: _small(part, key, strategy, limit),
            lambda part: _large(part, key, _RULES[strategy], limit),
            max_group_rows,
        )
    if strategy == "column_entropy":
        scored = rarity_scores(marked, key)
        order = [F.col("__first").desc(), F.round("score", TIE).desc(), F.col("seq_idx")]
    else:
        scored = marked.withColumn("__u", hash_uniform(*[F.col(k) for k in key], F.col("seq_idx"), seed=seed))
        order = [F.col("__first").desc(), F.col("__u"), F.col("seq_idx")]
    ranked = first_n(scored, key, order, limit).where(F.col("rank") < F.col("__cap"))
    return ranked.drop("__first", "__cap", "__u", "score")


def first_valid(df: DataFrame, n: int, key: list[str] = KEY) -> DataFrame:
    """The first ``n`` rows by ``seq_idx``."""
    return first_n(df, key, [F.col("seq_idx")], n)


def random_subset(df: DataFrame, target: int, key: list[str] = KEY, seed: int = 0) -> DataFrame:
    """``target`` rows per alignment by hash order; alignments already small enough are unchanged."""
    u = hash_uniform(*[F.col(k) for k in key], F.col("seq_idx"), seed=seed)
    return first_n(df.withColumn("__u", u), key, [F.col("__u"), F.col("seq_idx")], target).drop("__u", "rank")


def lowest_groups(df: DataFrame, key: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` groups of lowest ``value`` per key (stable: ties by ``tie``)."""
    return first_n(df, key, [F.col(value), F.col(tie)], k)


# --- Lowest depth ----------------------------------------------------------------------------------


def set_depth(rows: np.ndarray, threshold: float = 0.5) -> float:
    """Effective number of the rows of one small set."""
    near = (pair_matches(rows, rows) >= threshold * rows.shape[1]).sum(axis=1)
    return float((1.0 / near).sum()) / np.sqrt(rows.shape[1])


class Measured(Rule):
    """Any measure of the query and the picks, which are kept as texts."""

    def __init__(self, measure: Callable):
        self.measure = measure

    def start(self, rows, n):
        self.texts, self.picked = [r.astype("<u4").tobytes().decode("utf-32-le") for r in rows], []

    def absorb(self, i):
        self.picked.append(self.texts[i])

    def value(self, open_):
        return -np.round([float(self.measure([*self.picked, self.texts[i]])) for i in open_], TIE)


def measured_order(base: DataFrame, first: DataFrame, measure: Callable, key: list[str], n: int, order: list[str]) -> DataFrame:
    """Like :func:`spread_order` for a measure that says nothing about values to come: a pass over all rows per pick.

    The picked texts go to the rows of their alignment, each row is measured with them, and the least is found per bucket of
    rows and then among buckets.
    """
    picks = written(first.select(*key, F.array("seq_idx").alias("ids"), F.array("seq").alias("seqs")))
    buckets = F.pmod(F.xxhash64("seq_idx"), F.greatest(F.ceil(F.col("__n") / POOL), F.lit(1)))
    rows = base.join(base.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), key).select(*key, *order, buckets.alias("__bucket"))
    rows = written(rows if "seq" in order else rows.join(base.select(*key, "seq_idx", "seq"), [*key, "seq_idx"]))

    @F.pandas_udf(T.DoubleType())
    def value(seq: pd.Series, seqs: pd.Series) -> pd.Series:
        return pd.Series([round(float(measure([*p, s])), TIE) for s, p in zip(seq, seqs)], dtype="float64")

    for _ in range(1, n):
        open_ = rows.join(picks, key).where(~F.coalesce(F.array_contains("ids", F.col("seq_idx")), F.lit(False)))
        best = F.min(F.struct("value", *order, *["seq"] * ("seq" not in order))).alias("b")
        found = open_.withColumn("value", value("seq", "seqs")).groupBy(*key, "__bucket").agg(best).groupBy(*key).agg(F.min("b").alias("b"))
        grown = [F.when(F.col("b").isNull(), F.col(c)).otherwise(F.concat(c, F.array(f"b.{v}"))).alias(c) for c, v in (("ids", "seq_idx"), ("seqs", "seq"))]
        picks = written(picks.join(found, key, "left").select(*key, *grown))
    return picks.select(*key, F.posexplode("ids").alias("rank", "seq_idx")).withColumn("rank", F.col("rank").cast("long"))


def _lowest_small(df: DataFrame, key: list[str], n: int, window: int | None, measure: Callable | None) -> DataFrame:
    out = T.StructType([T.StructField("picks", T.ArrayType(T.IntegerType())), T.StructField("neff", T.DoubleType())])

    @F.pandas_udf(out)
    def run(query: pd.Series, seqs: pd.Series) -> pd.DataFrame:
        done = []
        for q, s in zip(query, seqs):
            texts = [q, *s]
            rows = to_matrix(texts)
            order = greedy_order(Measured(measure) if measure else LOWEST(), rows, n + 1, window)
            value = float(measure([texts[i] for i in order])) if measure else set_depth(rows[order])
            done.append(([i - 1 for i in order[1:]], value))
        return pd.DataFrame(done, columns=["picks", "neff"])

    columns = [c for c in df.columns if c not in ("distance", "query")]
    packed = pack_rows(df, key, ["distance", "seq", "seq_idx"]).withColumn("o", run(F.col("rows")[0]["query"], F.col("rows.seq")))
    with_depth = packed.withColumn("rows", F.transform("rows", lambda r: r.withField("neff", F.col("o.neff"))))
    return picked_rows(with_depth, key, F.col("o.picks"), [*columns, "neff"])


LOWEST = partial(Depth, sign=-1.0)


def _lowest_large(df: DataFrame, key: list[str], n: int, window: int | None, measure: Callable | None) -> DataFrame:
    """The same greedy choice over spread rows."""
    base = cut_lineage(df)
    first = base.groupBy(*key).agg(F.max("query").alias("seq")).select(*key, F.lit(None).cast("long").alias("seq_idx"), "seq")
    ties = ["distance", "seq", "seq_idx"]
    if measure is not None and window is None:
        order = measured_order(base, first, measure, key, n + 1, ties)
    else:
        rule = LOWEST if measure is None else partial(Measured, measure)
        order = spread_order(base.drop("query"), first, rule, key, n + 1, ties, window)
    joined = base.join(order.where("rank > 0"), [*key, "seq_idx"])

    @F.pandas_udf(T.DoubleType())
    def value(rows: pd.Series) -> pd.Series:
        return pd.Series([float(measure(list(c))) if measure else set_depth(to_matrix(list(c))) for c in rows], dtype="float64")

    picked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "seq"))), lambda x: x["seq"])
    sets = joined.groupBy(*key).agg(F.concat(F.array(F.max("query")), picked).alias("rows"))
    chosen = sets.select(*key, value("rows").alias("neff"))
    return joined.drop("distance", "query").join(chosen, key).withColumn("rank", F.col("rank") - 1)


def lowest_neff(
    df: DataFrame,
    queries: DataFrame,
    n: int,
    window: int | None = None,
    dedupe: bool = True,
    measure: Callable[[list[str]], float] | None = None,
    key: list[str] = KEY,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Greedy choice of ``n`` rows that keep the depth of query + selection lowest.

    Candidates are ordered by (distance to the query, sequence); each step takes, from the first
    ``window`` of them, the least (depth, distance, sequence). ``queries`` has the key and ``query``.
    ``measure`` replaces the depth function. Adds ``rank`` and the final ``neff``.
    """
    pool = distinct_ordered(df, key) if dedupe else df
    joined = pool.join(queries.select(*key, "query"), key)
    unequal = F.raise_error(F.lit("Hamming distance needs sequences of equal length")).cast("long")
    same = F.length("seq") == F.length("query")
    gap = F.when(same, F.length("seq") - matches_udf(F.when(same, F.col("seq")).otherwise(""), F.when(same, F.col("query")).otherwise("")))
    ready = joined.withColumn("distance", gap.otherwise(unequal))
    return by_size(
        ready,
        key,
        lambda part: _lowest_small(part, key, n, window, measure),
        lambda part: _lowest_large(part, key, n, window, measure),
        max_group_rows,
    )


def neff_by_depth(df: DataFrame, ladder: list[tuple[int, int]], strategy: str = "farthest_first", threshold: float = 0.5) -> DataFrame:
    """Depth of every alignment after thinning to each level of a (max, extra) ladder.

    The greedy orders are prefixes of one another: one selection serves all levels, and one comparison of its rows, in which a
    pair counts from the level on that holds its later row. An alignment's rows that are compared are no more than the deepest
    level's.
    """
    deepest = max(a + b for a, b in ladder)
    out = T.ArrayType(T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("neff", T.DoubleType())]))

    @F.pandas_udf(out)
    def depths(seqs: pd.Series) -> pd.Series:
        found = []
        for s in seqs:
            rows = to_matrix(list(s))
            sizes = np.minimum([a + b for a, b in ladder], len(rows))
            cuts, level = np.unique(sizes, return_inverse=True)
            begin = np.append(0, cuts[:-1])
            weight = np.zeros(len(cuts))
            for at in range(0, len(rows), STEP):
                near = pair_matches(rows[at : at + STEP], rows) / rows.shape[1] >= threshold
                counts = np.cumsum(np.add.reduceat(near[:, : cuts[-1]], begin, axis=1, dtype=np.int64), axis=1)
                inside = np.arange(at, at + len(near))[:, None] < cuts[None, :]
                weight += (inside / np.maximum(counts, 1)).sum(axis=0)
            found.append([{"n_rows": int(sizes[k]), "neff": float(weight[i] / np.sqrt(rows.shape[1]))} for k, i in enumerate(level)])
        return pd.Series(found, dtype=object)

    ranked = select_subset(df, deepest, strategy).where(F.length("seq") > 0).select("msa_id", "rank", "seq")
    measured = pack_rows(ranked, ["msa_id"], ["rank"]).select("msa_id", F.posexplode(depths(F.col("rows.seq"))).alias("at", "d"))
    level = F.array(*[F.struct(F.lit(a).alias("max_seq"), F.lit(b).alias("max_extra_seq")) for a, b in ladder])[F.col("at")]
    return measured.select("msa_id", level["max_seq"].alias("max_seq"), level["max_extra_seq"].alias("max_extra_seq"), "d.n_rows", "d.neff")
