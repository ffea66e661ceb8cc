"""Alignment depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog import bindings as b
from seqloom.catalog.registry import query
from seqloom.operators import neff as depth
from seqloom.operators import select

NEIGHBOURS_SQL = (
    f"{b.SEQS}, near AS (SELECT l.msa_id, l.seq_idx, count(r.seq_idx) AS n FROM seqs l LEFT JOIN seqs r ON l.msa_id = r.msa_id "
    "AND l.seq_idx <> r.seq_idx AND (60 - hamming(l.seq, r.seq)) / 60.0::DOUBLE >= 0.5 GROUP BY ALL)"
)


@query(
    "AGG1 JN1 FLT9",
    f"WITH {NEIGHBOURS_SQL} SELECT msa_id, count(*) AS n_rows, round(sum(1.0::DOUBLE / (1 + n)) / sqrt(60), 6) AS neff FROM near GROUP BY msa_id",
)
def neff(spark, sf_dir):
    """Depth of every document alignment."""
    rows = b.rows_only(b.seqs(spark, sf_dir))
    return depth.neff(rows).select("msa_id", "n_rows", F.round("neff", 6).alias("neff"))


@query("JN1", f"WITH {NEIGHBOURS_SQL} SELECT msa_id, seq_idx, n AS n_neighbours FROM near")
def identity_neighbours(spark, sf_dir):
    return depth.neighbour_counts(b.rows_only(b.seqs(spark, sf_dir)))


@query(
    "AGG2 SNK6",
    f"WITH {NEIGHBOURS_SQL} SELECT msa_id::VARCHAR AS pdb, printf('%.2f', sum(1.0::DOUBLE / (1 + n)) / sqrt(60)) AS \"NAD\" FROM near GROUP BY msa_id",
)
def neff_table(spark, sf_dir):
    return depth.neff_table(b.rows_only(b.seqs(spark, sf_dir)))


@query(
    "AGG17",
    f"WITH {NEIGHBOURS_SQL}, keep AS (SELECT * FROM seqs WHERE seq_idx < 12), "
    "near2 AS (SELECT l.msa_id, l.seq_idx, count(r.seq_idx) AS n FROM keep l LEFT JOIN keep r ON l.msa_id = r.msa_id "
    "AND l.seq_idx <> r.seq_idx AND (60 - hamming(l.seq, r.seq)) / 60.0::DOUBLE >= 0.5 GROUP BY ALL), "
    "a AS (SELECT msa_id, count(*) AS n_before, round(sum(1.0::DOUBLE / (1 + n)) / sqrt(60), 6) AS neff_before FROM near GROUP BY msa_id), "
    "c AS (SELECT msa_id, count(*) AS n_after, round(sum(1.0::DOUBLE / (1 + n)) / sqrt(60), 6) AS neff_after FROM near2 GROUP BY msa_id) "
    "SELECT * FROM a LEFT JOIN c USING (msa_id)",
)
def neff_before_after(spark, sf_dir):
    """Depth before and after keeping the first twelve rows."""
    rows = b.rows_only(b.seqs(spark, sf_dir))
    both = depth.neff_before_after(rows, select.first_valid(rows, 12))
    return both.withColumns({c: F.round(c, 6) for c in ("neff_before", "neff_after")})
