"""Filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog import bindings as b
from seqloom.catalog.registry import query
from seqloom.catalog.sequences import ENTROPY_CTE, cleaned_sql
from seqloom.operators import dedup, filters


@query("FLT1", f"WITH {b.READS} SELECT msa_id, seq_idx, seq FROM reads WHERE len(seq) = 60")
def exact_length(spark, sf_dir):
    return filters.exact_length(b.rows_only(b.reads(spark, sf_dir)), 60)


@query(
    "FLT2",
    f"WITH {b.READS}, {ENTROPY_CTE.format(src='reads')} SELECT msa_id, seq_idx, seq FROM reads JOIN entropy USING (seq) WHERE entropy > 3.2",
)
def entropy_filter(spark, sf_dir):
    return filters.entropy_above(b.rows_only(b.reads(spark, sf_dir)), 3.2)


@query(
    "FLT3",
    f"WITH {b.READS} SELECT lang AS msa_id, count(*) AS raw_count, count(*) FILTER (len(seq) = 60) AS valid_count, "
    "count(DISTINCT seq) FILTER (len(seq) = 60) AS distinct_count FROM reads GROUP BY lang",
)
def exact_length_counts(spark, sf_dir):
    rows = b.reads(spark, sf_dir).select(F.col("lang").alias("msa_id"), "seq_idx", "seq")
    return filters.exact_length_counts(rows, 60)


@query(
    "FLT3 DED1",
    f"WITH {b.READS} SELECT lang AS msa_id, seq, min(msa_id * 1000000 + seq_idx) AS seq_idx FROM reads WHERE len(seq) = 60 GROUP BY lang, seq",
)
def exact_length_distinct(spark, sf_dir):
    return filters.exact_length_rows(b.by_lang(b.reads(spark, sf_dir)), 60)


@query("DED1", f"WITH {b.BY_LANG} SELECT msa_id, seq, min(seq_idx) AS seq_idx FROM corpus GROUP BY msa_id, seq")
def distinct_rows(spark, sf_dir):
    return dedup.distinct_ordered(b.by_lang(b.seqs(spark, sf_dir)))


def greedy_sql(src: str, threshold: float, width: str = "60") -> str:
    """The sequential scan as a recursive CTE over ``src(msa_id, seq_idx, seq)``."""
    hit = f"len(list_filter(s.kept, lambda k: ({width} - hamming(k, r.seq)) / {width}.0::DOUBLE > {threshold})) > 0"
    return (
        f"placed AS (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY seq_idx) AS place FROM {src}), "
        "scan AS (SELECT msa_id, place, [seq] AS kept, [seq_idx] AS ids FROM placed WHERE place = 1 UNION ALL "
        "SELECT msa_id, place, CASE WHEN hit THEN kept ELSE list_append(kept, seq) END AS kept, "
        "CASE WHEN hit THEN ids ELSE list_append(ids, seq_idx) END AS ids FROM "
        f"(SELECT s.msa_id, s.kept, s.ids, r.place, r.seq, r.seq_idx, {hit} AS hit "
        "FROM scan s JOIN placed r ON r.msa_id = s.msa_id AND r.place = s.place + 1) step), "
        "final AS (SELECT msa_id, arg_max(ids, place) AS ids FROM scan GROUP BY msa_id), "
        "survivors AS (SELECT msa_id, unnest(ids) AS seq_idx FROM final)"
    )


@query("DED2", f"WITH RECURSIVE {b.SEQS}, {greedy_sql('seqs', 0.8)} SELECT msa_id, seq_idx FROM survivors")
def near_dedup(spark, sf_dir):
    """Greedy near-de-duplication inside every document."""
    return dedup.near_dedup(b.rows_only(b.seqs(spark, sf_dir)), 0.8).select("msa_id", "seq_idx")


@query("DED2")
def near_dedup_by_lang(spark, sf_dir):
    """The same over one large alignment per language, by rounds of joins."""
    rows = dedup.near_dedup(b.by_lang(b.seqs(spark, sf_dir)), 0.9, max_group_rows=2000)
    return rows.select("msa_id", "seq_idx")


@query("DED3 FN9")
def near_dedup_ragged(spark, sf_dir):
    """Rows of unequal length compare by the difflib ratio."""
    return dedup.near_dedup(b.chain_rows_ragged(spark, sf_dir), 0.8).select("msa_id", "seq_idx")


@query(
    "JN2",
    f"WITH {b.BY_LANG}, u AS (SELECT msa_id, seq, min(seq_idx) AS idx, count(*) AS copies FROM corpus GROUP BY msa_id, seq), "
    # Any two rows at most six apart agree on one of seven groups of columns.
    "bands AS (SELECT *, unnest(range(7)) AS band, unnest(list_transform(range(7), lambda x: array_to_string(list_filter(string_split(seq, ''), "
    "lambda c, i: (i - 1) % 7 = x), ''))) AS part FROM u), "
    "pairs AS (SELECT DISTINCT l.msa_id, l.idx AS i, r.idx AS j, (60 - hamming(l.seq, r.seq))::BIGINT AS matches, "
    "l.copies AS copies_i, r.copies AS copies_j FROM bands l JOIN bands r ON l.msa_id = r.msa_id AND l.band = r.band "
    "AND l.part = r.part AND l.idx < r.idx WHERE (60 - hamming(l.seq, r.seq)) / 60.0::DOUBLE > 0.9) SELECT * FROM pairs",
)
def near_duplicate_pairs(spark, sf_dir):
    return dedup.near_duplicate_pairs(b.by_lang(b.seqs(spark, sf_dir)), 0.9)


FILTER_SQL = (
    f"WITH RECURSIVE {b.READS}, fit AS (SELECT msa_id, seq_idx, seq FROM reads WHERE len(seq) = 60), "
    f"{cleaned_sql('fit', 'clean')}, {ENTROPY_CTE.format(src='clean')}, "
    "rich AS (SELECT msa_id, seq_idx, seq FROM clean JOIN entropy USING (seq) WHERE entropy > 2.0), "
)


@query(
    "FLT4",
    FILTER_SQL + greedy_sql("rich", 0.95) + " SELECT msa_id, seq_idx, seq FROM rich JOIN survivors USING (msa_id, seq_idx)",
)
def filter_rows(spark, sf_dir):
    return filters.filter_rows(b.rows_only(b.reads(spark, sf_dir)), 60)


@query(
    "FLT5",
    FILTER_SQL + greedy_sql("rich", 0.95) + ", n AS (SELECT msa_id, count(*) AS n0, count(*) FILTER (len(seq) = 60) AS n2 FROM reads GROUP BY msa_id), "
    "n3 AS (SELECT msa_id, count(*) AS n3 FROM rich GROUP BY msa_id), n4 AS (SELECT msa_id, count(*) AS n4 FROM survivors GROUP BY msa_id), "
    "f AS (SELECT n.*, coalesce(n3, 0) AS n3, coalesce(n4, 0) AS n4 FROM n LEFT JOIN n3 USING (msa_id) LEFT JOIN n4 USING (msa_id)) "
    "SELECT msa_id, 1::BIGINT AS step_no, 'Clean Repeats' AS step, 0::BIGINT AS removed, n0 AS remaining FROM f "
    "UNION ALL SELECT msa_id, 2, 'Length Match', n0 - n2, n2 FROM f UNION ALL SELECT msa_id, 3, 'Entropy Filter', n2 - n3, n3 FROM f "
    "UNION ALL SELECT msa_id, 4, 'Deduplicate', n3 - n4, n4 FROM f",
)
def filter_report(spark, sf_dir):
    return filters.filter_report(b.rows_only(b.reads(spark, sf_dir)), 60)


@query(
    "FLT6",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def allow_list(spark, sf_dir):
    good = b.table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return filters.allow_list(b.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", good)


@query(
    "FLT8",
    f"WITH {b.READS}, c AS (SELECT msa_id, seq_idx, len(seq)::BIGINT AS full_len, unnest([0.01::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE]) AS coverage FROM reads) "
    "SELECT msa_id, seq_idx, full_len, coverage, floor(coverage * full_len)::BIGINT AS chunk_len FROM c WHERE floor(coverage * full_len) BETWEEN 1 AND full_len",
)
def valid_chunks(spark, sf_dir):
    spread = F.explode(F.array(*[F.lit(c) for c in (0.01, 0.5, 1.0, 1.5)]))
    rows = b.reads(spark, sf_dir).select("msa_id", "seq_idx", F.length("seq").cast("long").alias("full_len"), spread.alias("coverage"))
    return filters.valid_chunks(rows)


@query(
    "FLT9",
    f"WITH {b.READS} SELECT msa_id, count(*) AS n_rows, min(len(seq))::BIGINT AS min_len, max(len(seq))::BIGINT AS max_len, "
    "'unequal lengths' AS reason FROM reads GROUP BY msa_id HAVING min(len(seq)) <> max(len(seq))",
)
def rejected_alignments(spark, sf_dir):
    from seqloom.operators.neff import rejects

    r = rejects(b.rows_only(b.reads(spark, sf_dir)))
    return r.withColumns({c: F.col(c).cast("long") for c in ("min_len", "max_len")})
