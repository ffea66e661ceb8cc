"""Representative subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog import bindings as b
from seqloom.catalog.columns import RARITY_SQL
from seqloom.catalog.registry import query
from seqloom.operators import columns, select

N = 8


def _greedy_sql(start: str, state: str, gain: str, rows: str = "seqs", first: str = "seq_idx = 0") -> str:
    """Step-by-step selection: ``state`` is carried, ``gain`` ranks the rows not yet picked."""
    return (
        f"sel AS (SELECT msa_id, 0::BIGINT AS step, [seq_idx] AS ids, [seq] AS picked, {start} FROM {rows} WHERE {first} UNION ALL "
        "SELECT msa_id, step + 1, list_append(ids, seq_idx), list_append(picked, seq), " + state + " FROM (SELECT s.*, r.seq_idx, r.seq, "
        f"row_number() OVER (PARTITION BY s.msa_id ORDER BY {gain} DESC, r.seq_idx) AS place FROM sel s JOIN {rows} r ON r.msa_id = s.msa_id "
        f"AND NOT list_contains(s.ids, r.seq_idx) WHERE s.step < {N} - 1) t WHERE place = 1), "
        "final AS (SELECT msa_id, arg_max(ids, step) AS ids FROM sel GROUP BY msa_id), "
        "chosen AS (SELECT msa_id, unnest(ids) AS seq_idx, unnest(range(len(ids)))::BIGINT AS rank FROM final)"
    )


_FAR_RULE = ("0 AS extra", "0", "list_min(list_transform(s.picked, lambda x: hamming(x, r.seq)))")
_COVER_RULE = (
    "list_transform(string_split(seq, ''), lambda c: c <> '-') AS extra",
    "list_transform(range(1, 61), lambda p: extra[p] OR seq[p] <> '-')",
    "len(list_filter(range(1, 61), lambda p: r.seq[p] <> '-' AND NOT s.extra[p]))",
)
_NEAR = "list_transform(s.picked, lambda x: ((60 - hamming(x, r.seq)) / 60.0::DOUBLE >= 0.5)::INT)"
_DEPTH_RULE = (
    "[0] AS extra",
    "list_append(list_transform(range(1, len(extra) + 1), lambda k: extra[k] + ((60 - hamming(picked[k], seq)) / 60.0::DOUBLE >= 0.5)::INT), "
    "list_sum(list_transform(picked, lambda x: ((60 - hamming(x, seq)) / 60.0::DOUBLE >= 0.5)::INT))::INT)",
    f"round(1.0::DOUBLE / (1 + list_sum({_NEAR})) + list_sum(list_transform(range(1, len(s.extra) + 1), lambda k: "
    "((60 - hamming(s.picked[k], r.seq)) / 60.0::DOUBLE >= 0.5)::INT * (1.0::DOUBLE / (2 + s.extra[k]) - 1.0::DOUBLE / (1 + s.extra[k])))), 12)",
)
_FAR, _COVER, _DEPTH = (_greedy_sql(*rule) for rule in (_FAR_RULE, _COVER_RULE, _DEPTH_RULE))


def _by_lang_sql(rule: tuple[str, str, str]) -> str:
    first = "(msa_id, seq_idx) IN (SELECT (msa_id, min(seq_idx)) FROM corpus GROUP BY msa_id)"
    return f"WITH RECURSIVE {b.BY_LANG}, {_greedy_sql(*rule, 'corpus', first)} SELECT * FROM chosen"


def _select_by_lang(spark, sf_dir, strategy):
    """One large alignment per language, its rows spread over many tasks."""
    rows = b.by_lang(b.seqs(spark, sf_dir))
    return select.select_subset(rows, N, strategy, max_group_rows=1000).select("msa_id", "seq_idx", "rank")


def _select(spark, sf_dir, strategy, **kw):
    rows = b.rows_only(b.seqs(spark, sf_dir))
    return select.select_subset(rows, N, strategy, **kw).select("msa_id", "seq_idx", "rank")


@query("SEL0 SEL1", f"WITH RECURSIVE {b.SEQS}, {_FAR} SELECT * FROM chosen")
def select_farthest_first(spark, sf_dir):
    return _select(spark, sf_dir, "farthest_first")


@query("SEL0 SEL2", f"WITH RECURSIVE {b.SEQS}, {_COVER} SELECT * FROM chosen")
def select_max_coverage(spark, sf_dir):
    return _select(spark, sf_dir, "max_coverage")


@query("SEL0 SEL4", f"WITH RECURSIVE {b.SEQS}, {_DEPTH} SELECT * FROM chosen")
def select_neff_contribution(spark, sf_dir):
    return _select(spark, sf_dir, "neff_contribution")


@query(
    "SEL0 SEL3",
    f"WITH {RARITY_SQL}, q AS (SELECT msa_id, min(seq_idx) AS q FROM corpus_cells GROUP BY msa_id) SELECT msa_id, seq_idx, rank FROM "
    "(SELECT msa_id, seq_idx, row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx = q DESC, round(score, 12) DESC, seq_idx) - 1 AS rank "
    "FROM scores JOIN q USING (msa_id)) WHERE rank < 32",
)
def select_column_entropy(spark, sf_dir):
    rows = b.by_lang(b.seqs(spark, sf_dir))
    return select.select_subset(rows, 32, "column_entropy").select("msa_id", "seq_idx", "rank")



@query(
    "SEL0 SEL5",
    f"WITH {b.BY_LANG}, q AS (SELECT msa_id, min(seq_idx) AS q FROM corpus GROUP BY msa_id) SELECT msa_id, seq_idx, rank FROM "
    f"(SELECT msa_id, seq_idx, row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx = q DESC, {b.uniform_sql('msa_id', 'seq_idx')}, seq_idx) - 1 AS rank "
    "FROM corpus JOIN q USING (msa_id)) WHERE rank < 100",
)
def select_random(spark, sf_dir):
    rows = b.by_lang(b.seqs(spark, sf_dir))
    return select.select_subset(rows, 100, "random").select("msa_id", "seq_idx", "rank")


@query("SEL0", f"WITH {b.SEQS}, q AS (SELECT msa_id, arg_max(seq, seq_idx) AS query FROM seqs GROUP BY msa_id), "
    "h AS (SELECT s.msa_id, min(seq_idx) AS seq_idx FROM seqs s JOIN q ON q.msa_id = s.msa_id AND seq = query GROUP BY s.msa_id) "
    "SELECT msa_id, seq_idx, 0::BIGINT AS rank FROM h")
def select_given_query(spark, sf_dir):
    """A query given by text (here each alignment's last row) takes slot 0."""
    rows = b.rows_only(b.seqs(spark, sf_dir))
    last = rows.groupBy("msa_id").agg(F.max_by("seq", "seq_idx").alias("query"))
    return select.select_subset(rows, 1, "random", last).select("msa_id", "seq_idx", "rank")


@query("SEL6", f"WITH {b.SEQS} SELECT msa_id, seq_idx, seq_idx AS rank FROM seqs WHERE seq_idx < 16")
def select_first_valid(spark, sf_dir):
    return select.first_valid(b.rows_only(b.seqs(spark, sf_dir)), 16).select("msa_id", "seq_idx", "rank")


@query(
    "SEL8",
    f"WITH {b.SEQS} SELECT msa_id, seq_idx FROM (SELECT msa_id, seq_idx, row_number() OVER (PARTITION BY msa_id ORDER BY "
    f"{b.uniform_sql('msa_id', 'seq_idx')}, seq_idx) AS place FROM seqs) WHERE place <= 20",
)
def random_subset(spark, sf_dir):
    return select.random_subset(b.rows_only(b.seqs(spark, sf_dir)), 20).select("msa_id", "seq_idx")


_GAIN = (
    f"round(1.0::DOUBLE / (1 + list_sum({_NEAR})) + list_sum(list_transform(range(1, len(s.extra) + 1), lambda k: "
    "((60 - hamming(s.picked[k], r.seq)) / 60.0::DOUBLE >= 0.5)::INT * (1.0::DOUBLE / (2 + s.extra[k]) - 1.0::DOUBLE / (1 + s.extra[k])))), 12)"
)
LOWEST_SQL = (
    f"WITH RECURSIVE {b.SEQS}, qs AS (SELECT msa_id, seq AS query FROM seqs WHERE seq_idx = 0), "
    "pool AS (SELECT s.msa_id, seq, min(seq_idx) AS seq_idx, min(hamming(seq, query)) AS distance FROM seqs s JOIN qs USING (msa_id) "
    "WHERE seq_idx > 0 GROUP BY s.msa_id, seq), "
    "sel AS (SELECT msa_id, 0::BIGINT AS step, []::BIGINT[] AS ids, [query] AS picked, [0] AS extra FROM qs UNION ALL "
    "SELECT msa_id, step + 1, list_append(ids, seq_idx), list_append(picked, seq), "
    "list_append(list_transform(range(1, len(extra) + 1), lambda k: extra[k] + ((60 - hamming(picked[k], seq)) / 60.0::DOUBLE >= 0.5)::INT), "
    "list_sum(list_transform(picked, lambda x: ((60 - hamming(x, seq)) / 60.0::DOUBLE >= 0.5)::INT))::INT) "
    "FROM (SELECT s.*, r.seq_idx, r.seq, row_number() OVER (PARTITION BY s.msa_id ORDER BY "
    f"{_GAIN}, r.distance, r.seq, r.seq_idx) AS place FROM sel s JOIN pool r ON r.msa_id = s.msa_id AND NOT list_contains(s.ids, r.seq_idx) "
    f"WHERE s.step < {N}) t WHERE place = 1), "
    "final AS (SELECT msa_id, arg_max(ids, step) AS ids, arg_max(extra, step) AS extra FROM sel GROUP BY msa_id), "
    "depth AS (SELECT msa_id, ids, round(list_sum(list_transform(extra, lambda c: 1.0::DOUBLE / (1 + c))) / sqrt(60), 6) AS neff FROM final) "
    "SELECT msa_id, unnest(ids) AS seq_idx, unnest(range(len(ids)))::BIGINT AS rank, neff FROM depth"
)


@query("SEL7", LOWEST_SQL)
def select_lowest_neff(spark, sf_dir):
    rows = b.rows_only(b.seqs(spark, sf_dir))
    queries = columns.query_rows(rows).select("msa_id", "query")
    picked = select.lowest_neff(rows.where(F.col("seq_idx") > 0), queries, N)
    return picked.select("msa_id", "seq_idx", "rank", F.round("neff", 6).alias("neff"))


@query("JOB8 SEL0 AGG1")
def neff_by_depth(spark, sf_dir):
    """Depth after thinning every document alignment to each level of the ladder."""
    from seqloom.alphabets import DEPTH_LADDER
    from seqloom.plans.jobs import depth_ladder_job

    return depth_ladder_job(b.rows_only(b.seqs(spark, sf_dir)), DEPTH_LADDER)


@query(
    "JOB8 SEL5 AGG1",
    f"WITH {b.BY_LANG}, q AS (SELECT msa_id, min(seq_idx) AS q FROM corpus GROUP BY msa_id), ranked AS (SELECT msa_id, seq, "
    f"row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx = q DESC, {b.uniform_sql('msa_id', 'seq_idx')}, seq_idx) - 1 AS rank FROM corpus JOIN q USING (msa_id)), "
    "lv(max_seq, max_extra_seq) AS (VALUES (16, 32), (32, 64), (64, 128), (128, 256)), "
    "level AS (SELECT msa_id, seq, rank, max_seq, max_extra_seq FROM ranked JOIN lv ON rank < max_seq + max_extra_seq), "
    "w AS (SELECT l.msa_id, l.max_seq, l.max_extra_seq, l.rank, count(*) AS near FROM level l JOIN level r ON l.msa_id = r.msa_id AND l.max_seq = r.max_seq "
    "AND (60 - hamming(l.seq, r.seq)) / 60.0::DOUBLE >= 0.5 GROUP BY ALL) "
    "SELECT msa_id, max_seq, max_extra_seq, count(*) AS n_rows, round(sum(1.0::DOUBLE / near) / sqrt(60), 6) AS neff FROM w GROUP BY ALL",
)
def random_depth_ladder(spark, sf_dir):
    """Depth of the large alignments after random thinning to each level of the ladder, in one comparison."""
    from seqloom.alphabets import DEPTH_LADDER

    out = select.neff_by_depth(b.by_lang(b.seqs(spark, sf_dir)), DEPTH_LADDER, "random")
    return out.withColumn("neff", F.round("neff", 6))


@query("SEL1", _by_lang_sql(_FAR_RULE))
def select_farthest_first_by_lang(spark, sf_dir):
    return _select_by_lang(spark, sf_dir, "farthest_first")


@query("SEL2", _by_lang_sql(_COVER_RULE))
def select_max_coverage_by_lang(spark, sf_dir):
    return _select_by_lang(spark, sf_dir, "max_coverage")


@query("SEL4", _by_lang_sql(_DEPTH_RULE))
def select_neff_contribution_by_lang(spark, sf_dir):
    return _select_by_lang(spark, sf_dir, "neff_contribution")
