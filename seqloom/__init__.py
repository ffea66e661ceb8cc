"""Sequence-alignment analytics on Spark DataFrames keyed by ``(msa_id, seq_idx)``."""

__version__ = "0.1.0"
