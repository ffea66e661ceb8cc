"""Candidates of the strategies that disturb a query's states: plan rows drive noise or walks, a decoder gives letters.

The states and their decoder are the caller's; what happens between them (draws, scales, directions, the length filter, one row
per request of the plan) is done here for requests of several strategies in one table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.scalar import argmax_letter
from seqloom.functions.uniform import gauss_udf, key_prefix
from seqloom.operators.augment import principal_walk

NOISY = ("encoder_perturb", "embedding_walk_full")
WALKED = "embedding_walk_encoder"
# Defaults of the walks (fixed values).
DEPTH_DECAY, NOISE_SIGMA, NOISE_SAMPLES = 0.8, 0.1, 50
DECODED_ROWS = 1024  # vectors decoded at a time


def window_letters(vectors: list[np.ndarray], alphabet: str) -> list[str]:
    """For each position of a vector the letter of the largest of the values from there on, as many as there are letters (circular)."""
    out, sizes = [""] * len(vectors), np.array([len(v) for v in vectors], np.int64)
    names = np.array(list(alphabet))
    for n in np.unique(sizes[sizes > 0]).tolist():
        found = np.flatnonzero(sizes == n)
        for at in np.split(found, range(DECODED_ROWS, len(found), DECODED_ROWS)):
            values = np.stack([vectors[i] for i in at]).astype(float)[:, np.arange(n + len(alphabet) - 1) % n]
            best = sliding_window_view(values, len(alphabet), axis=1).argmax(axis=2)
            for i, row in zip(at, names[best]):
                out[i] = "".join(row)
    return out


def window_decoder(alphabet: str) -> Callable[[Column], Column]:
    """A decoder for vectors whose circular windows are letter scores: position p takes the values p, p + 1, ..."""

    @F.pandas_udf(T.StringType())
    def bulk(vector: pd.Series) -> pd.Series:
        held = vector.notna()
        out = pd.Series([None] * len(vector), index=vector.index, dtype=object)
        out[held] = window_letters(vector[held].tolist(), alphabet)
        return out

    # Nothing random: so marked, a filter on the letters is not pushed below the step, where it would be worked out once more.
    bulk = bulk.asNondeterministic()

    def with_gaps(vector: Column) -> Column:
        n = F.size(vector)
        scores = lambda i: F.transform(F.sequence(F.lit(0), F.lit(len(alphabet) - 1)), lambda k: F.get(vector, F.pmod(i + k, n)))
        return F.array_join(F.transform(vector, lambda x, i: argmax_letter(scores(i), alphabet)), "")

    def decode(vector: Column) -> Column:
        # A value that is null is no score; in the Arrow step it would be taken for one that is not a number.
        return F.when(F.exists(vector, lambda x: x.isNull()), with_gaps(vector)).otherwise(bulk(vector))

    return decode


def _noise(layers: int) -> Column:
    """Noise at the request's sigma; with several layers the sum of their draws, damped towards the first."""
    sigma, out = F.col("params")["sigma"], F.col("vector")
    for layer in range(layers):
        prefix = key_prefix(F.col("query_id"), F.col("request_no"), F.lit(layer))
        drawn = gauss_udf(prefix, F.coalesce(F.size("vector"), F.lit(0)), F.lit(0))
        out = F.zip_with(out, drawn, lambda x, g: x + sigma * F.lit(DEPTH_DECAY ** (layers - 1 - layer)) * g)
    return out


def disturbed_states(requests: DataFrame, states: DataFrame, layers: int = 2, samples: int = NOISE_SAMPLES) -> DataFrame:
    """``requests`` (query_id, strategy, request_no, params) with the ``vector`` each of them decodes.

    ``encoder_perturb`` adds noise once, ``embedding_walk_full`` per layer, ``embedding_walk_encoder`` moves along a principal
    direction of noisy copies. As decoding has no chance in it, every return of a setting has noise of its own; returns of a
    walk are equal. Requests of other strategies, of queries without states, and of directions that do not exist give no rows.
    """
    met = requests.where(F.col("strategy").isin(*NOISY)).join(states.select("query_id", "vector"), "query_id")
    noisy = None
    for name, n in zip(NOISY, (1, layers), strict=True):
        part = met.where(F.col("strategy") == name).withColumn("vector", _noise(n))
        noisy = part if noisy is None else noisy.unionByName(part)
    steps = F.col("params")["step"]
    walks = requests.where(F.col("strategy") == WALKED).withColumn("component", F.col("params")["component"].cast("int")).withColumn("step", steps)
    extent = walks.agg(F.max("component").alias("most"), F.collect_set("step").alias("steps")).first()
    if extent["most"] is None:
        return noisy
    asked = states.join(walks.select("query_id").distinct(), "query_id", "left_semi")
    moved = principal_walk(asked, extent["most"] + 1, sorted(extent["steps"]), samples, NOISE_SIGMA, ["query_id"])
    return noisy.unionByName(walks.join(moved, ["query_id", "component", "step"]).select(*noisy.columns))


def vector_candidates(requests: DataFrame, states: DataFrame, decode: Callable[[Column], Column], expected: Column, layers: int = 2, samples: int = NOISE_SAMPLES) -> DataFrame:
    """(query_id, strategy, request_no, seq): decoded states of the ``expected`` length, a row per request."""
    seq = decode(F.col("vector")).alias("seq")
    return disturbed_states(requests, states, layers, samples).select("query_id", "strategy", "request_no", seq).where(F.length("seq") == expected)
