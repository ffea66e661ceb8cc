"""Scalar functions on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.alphabets import COLUMN_ALPHABET, ENTROPY_ALPHABET
from seqloom.catalog import bindings as b
from seqloom.catalog.registry import query
from seqloom.functions import scalar as fn
from seqloom.functions.text import similarity

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MONO = "|".join(c + "{%d,}" for c in LETTERS)
PAIRS = "|".join(f"(?:{x}{y})" + "{%d,}" for x in LETTERS for y in LETTERS)


def _masked(src: str, out: str, pattern: str) -> str:
    return (
        f"{out}_cut AS (SELECT *, regexp_split_to_array(seq, '{pattern}') AS p, regexp_extract_all(seq, '{pattern}') AS m FROM {src}), "
        f"{out} AS (SELECT * EXCLUDE (seq, p, m), array_to_string(list_transform(range(1, len(p) + 1), "
        f"lambda i: p[i] || repeat('X', coalesce(len(m[i]), 0))), '') AS seq FROM {out}_cut)"
    )


def cleaned_sql(src: str, out: str, mono: int = 5, pair: int = 3) -> str:
    return _masked(src, out + "_mono", MONO.replace("%d", str(mono))) + ", " + _masked(out + "_mono", out, PAIRS.replace("%d", str(pair)))


@query("FN1 FN2", f"WITH {b.READS}, {cleaned_sql('reads', 'clean', 2, 2)} SELECT msa_id, seq_idx, seq FROM clean")
def masked_repeats(spark, sf_dir):
    clean = fn.clean_repeats(F.col("seq"), 2, 2)
    return b.reads(spark, sf_dir).select("msa_id", "seq_idx", clean.alias("seq"))


ENTROPY_CTE = (
    "letters AS (SELECT DISTINCT seq, unnest(string_split(seq, '')) AS aa, len(seq) AS n, unnest(range(len(seq))) AS at FROM {src}), "
    f"freq AS (SELECT seq, count(*)::DOUBLE / max(n) AS p FROM letters WHERE contains('{ENTROPY_ALPHABET}', aa) GROUP BY seq, aa), "
    "entropy AS (SELECT seq, -sum(p * log2(p)) AS entropy FROM freq GROUP BY seq)"
)


@query(
    "FN4",
    f"WITH {b.READS}, {ENTROPY_CTE.format(src='reads')} SELECT msa_id, seq_idx, round(coalesce(entropy, 0) + 0.0, 6) AS entropy "
    "FROM reads LEFT JOIN entropy USING (seq)",
)
def sequence_entropy(spark, sf_dir):
    e = F.round(fn.sequence_entropy(F.col("seq")), 6) + F.lit(0.0)
    return b.reads(spark, sf_dir).select("msa_id", "seq_idx", e.alias("entropy"))


@query(
    "FN5",
    f"WITH {b.READS} SELECT msa_id, seq_idx, repeat('-', msa_id % 11) || seq || repeat('-', 71 - msa_id % 11 - len(seq)) AS seq FROM reads",
)
def padded_sequences(spark, sf_dir):
    start = (F.col("msa_id") % 11).cast("int")
    return b.reads(spark, sf_dir).select(
        "msa_id", "seq_idx", fn.pad_sequence(F.col("seq"), start, F.lit(71)).alias("seq")
    )


@query("FN6", f"WITH {b.SEQS} SELECT msa_id, seq_idx, replace(seq, '-', '') AS seq FROM seqs WHERE replace(seq, '-', '') <> ''")
def ungapped_sequences(spark, sf_dir):
    bare = b.seqs(spark, sf_dir).withColumn("seq", fn.strip_gaps(F.col("seq")))
    return b.rows_only(bare.where(F.col("seq") != ""))


@query(
    "FN7 FN8",
    f"WITH {b.SEQS}, nxt AS (SELECT msa_id, seq_idx - 1 AS seq_idx, seq AS other FROM seqs WHERE seq_idx > 0) "
    "SELECT msa_id, seq_idx, hamming(seq, other)::BIGINT AS distance, round(hamming(seq, other) / 60.0::DOUBLE, 6) AS fraction "
    "FROM seqs JOIN nxt USING (msa_id, seq_idx)",
)
def neighbour_distance(spark, sf_dir):
    """Distance of every row to the next row of its alignment."""
    s = b.rows_only(b.seqs(spark, sf_dir))
    nxt = s.where(F.col("seq_idx") > 0).select("msa_id", (F.col("seq_idx") - 1).alias("seq_idx"), F.col("seq").alias("other"))
    pair = s.join(nxt, ["msa_id", "seq_idx"])
    a, o = F.col("seq"), F.col("other")
    return pair.select(
        "msa_id", "seq_idx", fn.hamming_distance(a, o).alias("distance"),
        F.round(fn.fractional_distance(a, o), 6).alias("fraction"),
    )


@query("FN9")
def neighbour_similarity(spark, sf_dir):
    """Similarity test of every ragged piece against the next one of its document."""
    s = b.rows_only(b.reads(spark, sf_dir))
    nxt = s.where(F.col("seq_idx") > 0).select("msa_id", (F.col("seq_idx") - 1).alias("seq_idx"), F.col("seq").alias("other"))
    pair = s.join(nxt, ["msa_id", "seq_idx"])
    return pair.select("msa_id", "seq_idx", (similarity(F.col("seq"), F.col("other")) > 0.3).alias("is_similar"))


@query(
    "FN10 JN12",
    f"WITH {b.SEQS}, q AS (SELECT msa_id, seq AS query FROM seqs WHERE seq_idx = 0) "
    "SELECT msa_id, seq_idx, round((60 - hamming(seq, query)) / 60.0::DOUBLE, 6) AS identity FROM seqs JOIN q USING (msa_id)",
)
def identity_to_query(spark, sf_dir):
    from seqloom.operators.columns import identity_to_query as run

    return run(b.rows_only(b.seqs(spark, sf_dir))).select("msa_id", "seq_idx", F.round("identity", 6).alias("identity"))


@query(
    "FN11",
    f"WITH {b.READS} SELECT msa_id, seq_idx, '<AA2fold> ' || array_to_string(string_split(seq, ''), ' ') AS model_input, seq AS decoded FROM reads",
)
def model_inputs(spark, sf_dir):
    spaced = fn.spaced_input(F.col("seq"), "<AA2fold>")
    back = fn.strip_spaces(F.array_join(fn.letters(F.col("seq")), " "))
    return b.reads(spark, sf_dir).select("msa_id", "seq_idx", spaced.alias("model_input"), back.alias("decoded"))


@query(
    "FN12",
    f"WITH {b.ATOMS} SELECT structure_id, pos, round(CASE WHEN y > 0.2 THEN 0.0 WHEN z > 0.2 THEN 1e9 "
    "ELSE greatest(least(x * 1e10, 1e9), -1e9) END, 3) AS score FROM atoms",
)
def finite_scores(spark, sf_dir):
    """Scores with planted NaN and infinity, cleaned and clamped."""
    wild = (
        F.when(F.col("y") > 0.2, F.lit(float("nan"))).when(F.col("z") > 0.2, F.lit(float("inf"))).otherwise(F.col("x") * 1e10)
    )
    a = b.atoms(spark, sf_dir)
    return a.select("structure_id", "pos", F.round(fn.finite_scores(F.array(wild))[0], 3).alias("score"))


DECODED_SQL = (
    f"WITH {b.ATOMS}, win AS (SELECT vec_id, pos, list_transform(range(20), lambda k: v[(pos + k) % len(v) + 1]) AS w FROM spread) "
    "SELECT vec_id, string_agg(substr('acdefghiklmnpqrstvwy', list_position(w, list_max(w)), 1), '' ORDER BY pos) AS letters FROM win GROUP BY vec_id"
)


@query("FN13", DECODED_SQL)
def argmax_letters(spark, sf_dir):
    """20 circular scores per position, decoded to the best letter."""
    v = b.vectors(spark, sf_dir)
    n = F.size("vector")
    best = F.transform(
        "vector",
        lambda x, i: fn.argmax_letter(
            F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.get(F.col("vector"), F.pmod(i + k, n))),
            "acdefghiklmnpqrstvwy",
        ),
    )
    return v.select("vec_id", F.array_join(best, "").alias("letters"))


LABEL_NAMES = {"view": "encoder_perturb", "click": "diverse_beam", "signup": "round_trip", "purchase": "3di_perturb", "error": "baseline"}


@query(
    "FN15",
    f"WITH {b.OUTCOMES} SELECT event_id, CASE strategy WHEN 'view' THEN 'sigmas=[' || k || ']' "
    "WHEN 'click' THEN 'beams=' || k || ',dp=1.0' WHEN 'signup' THEN 'rounds=4,seeds=' || k "
    "WHEN 'purchase' THEN 'rates=[]' ELSE '' END AS variant_param FROM (SELECT *, n_sequences AS k FROM outcomes)",
)
def variant_labels(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in LABEL_NAMES.items() for x in kv])
    k = F.col("n_sequences").cast("string")
    conf = F.create_map(
        F.lit("noise_scales"), F.concat(F.lit("["), k, F.lit("]")), F.lit("num_beams"), k, F.lit("n_seeds"), k
    )
    return b.outcomes(spark, sf_dir).select(
        "event_id", fn.variant_label(names[F.col("strategy")], conf).alias("variant_param")
    )


@query(
    "FN16",
    "SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT > 9 THEN json_extract_string(props, '$.k')::DOUBLE END AS number FROM events",
)
def text_to_number(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.when(k.cast("int") > 9, k).otherwise(F.lit(""))
    return b.table(spark, sf_dir, "events").select("event_id", fn.as_double(text).alias("number"))


@query(
    "FN17",
    "SELECT event_id, 'temperature=' || json_extract_string(props, '$.k') || "
    "CASE WHEN event_type = 'error' OR event_type = 'view' THEN '' ELSE ';cache_implementation=' || event_type END AS kwargs FROM events",
)
def generation_kwargs(spark, sf_dir):
    conf = F.create_map(F.lit("temperature"), F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    cache = F.when(kind == "view", F.lit("default")).when(kind != "error", kind)
    entries = F.map_entries(fn.generation_kwargs(conf, cache))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return b.table(spark, sf_dir, "events").select("event_id", text.alias("kwargs"))


@query(
    "FN18",
    "WITH p AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) "
    "SELECT event_id, unnest(CASE WHEN k < 20 THEN [NULL] ELSE [event_type, 'static'] END) AS cache_implementation FROM p",
)
def cache_mode_lists(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    modes = F.when(k < 10, F.lit(None).cast("array<string>")).when(k < 20, F.array().cast("array<string>")).otherwise(
        F.array("event_type", F.lit("static"))
    )
    return b.table(spark, sf_dir, "events").select("event_id", F.explode_outer(fn.cache_modes(modes)).alias("cache_implementation"))


@query(
    "FN19",
    f"WITH {b.READS}, c AS (SELECT lang, unnest(string_split(seq, '')) AS raw FROM reads) "
    f"SELECT lang, CASE WHEN contains('{COLUMN_ALPHABET}', raw) THEN raw ELSE 'X' END AS aa, count(*) AS n FROM c GROUP BY ALL",
)
def recoded_letters(spark, sf_dir):
    long = b.reads(spark, sf_dir).select("lang", F.explode(fn.letters(F.col("seq"))).alias("raw"))
    return long.groupBy("lang", fn.column_letter(F.col("raw")).alias("aa")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SNK9 SNK10",
    "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') AS path_key, "
    "regexp_replace('walk__' || url || '__cache=None', '[^\\p{L}\\p{N}._=-]', '_', 'g') AS variant_key FROM pages",
)
def safe_path_keys(spark, sf_dir):
    none = F.lit(None).cast("string")
    return b.table(spark, sf_dir, "pages").select(
        "page_id", fn.safe_key(F.col("url")).alias("path_key"),
        fn.safe_variant_key(F.lit("walk"), F.col("url"), none).alias("variant_key"),
    )


@query(
    "FN3",
    f"WITH {b.READS}, {cleaned_sql('reads', 'clean', 3, 2)} SELECT c.msa_id, sum((c.seq <> r.seq)::INT)::BIGINT AS n_modified, count(*) AS n_rows "
    "FROM clean c JOIN reads r USING (msa_id, seq_idx) GROUP BY c.msa_id",
)
def modified_counts(spark, sf_dir):
    changed = fn.clean_repeats(F.col("seq"), 3, 2) != F.col("seq")
    return b.reads(spark, sf_dir).groupBy("msa_id").agg(F.count_if(changed).alias("n_modified"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "JSON",
    "SELECT event_id, 'k' AS matrix, json_extract_string(props, '$.k')::DOUBLE AS rate FROM events",
)
def parsed_rates(spark, sf_dir):
    """Rates given as JSON text."""
    rates = F.from_json("props", "map<string,double>")
    return b.table(spark, sf_dir, "events").select("event_id", F.explode(rates).alias("matrix", "rate"))
