"""Sequence, chain, structure and result views over the shared test tables, in Spark and in SQL.

Whole tables and whole texts are used. An alignment is a document: each line of its text is cut into
pieces of at most 60 letters, the last piece of a line is padded with gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import letter_pieces
from seqloom.operators.augment import grouped_matrix

WIDTH = 60
# Letters that share a class in the rule-built substitution matrix of the queries.
CLASSES = ["AST", "C", "DE", "FWY", "G", "HKR", "ILMV", "NQ", "P"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than that; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged pieces: msa_id (document), seq_idx, lang, seq."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select(
        F.col("doc_id").alias("msa_id"), "lang", F.posexplode(letter_pieces(F.col("text"), WIDTH)).alias("at", "seq")
    ).select("msa_id", "lang", F.col("at").cast("long").alias("seq_idx"), "seq")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned rows of 60 columns; letters that are no amino acid become gaps."""
    gapped = F.translate(F.rpad("seq", WIDTH, "-"), "BJOUZ", "-----")
    return reads(spark, sf_dir).withColumn("seq", gapped)


def by_lang(df: DataFrame) -> DataFrame:
    """The same rows as one large alignment per language; one of them holds most rows."""
    index = F.col("msa_id") * 1000000 + F.col("seq_idx")
    return df.select(F.col("lang").alias("msa_id"), index.alias("seq_idx"), "seq")


def rows_only(df: DataFrame) -> DataFrame:
    return df.select("msa_id", "seq_idx", "seq")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a complex, a turn is a chain: all letters of its text."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return conv.select(F.col("conv_id").alias("complex_id"), F.col("turn").alias("chain_idx"), letters.alias("chain"))


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows per chain: the pieces of the turn's text, 60 columns each."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return conv.select(
        F.col("conv_id").alias("complex_id"), F.col("turn").alias("chain_idx"),
        F.posexplode(letter_pieces(F.col("text"), WIDTH)).alias("at", "piece"),
    ).select("complex_id", "chain_idx", F.col("at").cast("long").alias("row_idx"), F.rpad("piece", WIDTH, "-").alias("seq"))


def chain_rows_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a conversation as rows of one alignment, at their own lengths."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    lines = F.filter(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z\n]", "")), "\n"), lambda x: x != "")
    long = conv.select(F.col("conv_id").alias("msa_id"), "turn", F.posexplode(lines).alias("at", "seq"))
    return long.select("msa_id", (F.col("turn") * 100000 + F.col("at")).cast("long").alias("seq_idx"), "seq")


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex queries: chains joined with ``:``."""
    ordered = F.sort_array(F.collect_list(F.struct("chain_idx", "chain")))
    joined = F.array_join(F.transform(ordered, lambda s: s["chain"]), ":")
    return chains(spark, sf_dir).groupBy("complex_id").agg(joined.alias("query"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a structure of 64 positions: each value with the two that follow it (circular)."""
    emb = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    points = F.transform(
        "v",
        lambda x, i: F.struct(
            x.alias("x"), F.get(F.col("v"), F.pmod(i + 1, n)).alias("y"), F.get(F.col("v"), F.pmod(i + 2, n)).alias("z")
        ),
    )
    return emb.withColumn("v", v).select(F.col("vec_id").alias("structure_id"), F.posexplode(points).alias("pos", "p")).select(
        "structure_id", "pos", "p.x", "p.y", "p.z"
    )


def structure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a reference, the next one as its prediction."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("pred_id"))
    return emb.join(nxt, "vec_id").select(
        F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("ref_id"), "pred_id"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a result row: the user is the protein, the type is the strategy."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("protein_id"),
        F.col("event_type").alias("strategy"),
        F.lit("").alias("variant_param"),
        F.lit("None").alias("cache_implementation"),
        k.alias("selected_sequences"),
        F.when(k >= 50, k).otherwise(F.lit(128)).alias("target_n"),
        k.alias("n_sequences"),
        F.when(k > 9, v).alias("neff"),
        (v / 2).alias("gen_time_s"),
        (k / 8.0).alias("peak_vram_gb"),
        F.when(k > 80, k / 100.0).alias("ptm"),
        F.when(k > 60, k.cast("double")).alias("mean_plddt"),
        F.when(k > 70, v / 10).alias("rmsd"),
        F.when(k > 75, k / 200.0).alias("tm_score"),
        F.hour("ts").alias("run_idx"),
    )


def matrices(spark: SparkSession) -> DataFrame:
    """Two rule-built matrices."""
    return grouped_matrix(spark, "close", CLASSES, 4.0, 1.0, -2.0).unionByName(
        grouped_matrix(spark, "wide", CLASSES, 2.0, 1.0, -1.0)
    )


# --- The same views in SQL ----------------------------------------------------------------------------

_PIECES = "regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z\\n]', '', 'g')), '[A-Z]{1,60}')"

READS = (
    f"tiles AS (SELECT doc_id AS msa_id, lang, {_PIECES} AS t FROM documents), "
    "reads AS (SELECT msa_id, lang, unnest(range(len(t)))::BIGINT AS seq_idx, unnest(t) AS seq FROM tiles)"
)
SEQS = READS + (
    ", seqs AS (SELECT msa_id, lang, seq_idx, translate(rpad(seq, 60, '-'), 'BJOUZ', '-----') AS seq FROM reads)"
)
BY_LANG = SEQS + ", corpus AS (SELECT lang AS msa_id, msa_id * 1000000 + seq_idx AS seq_idx, seq FROM seqs)"
CELLS = SEQS + (
    ", cells AS (SELECT msa_id, lang, seq_idx, unnest(range(60))::BIGINT AS pos, unnest(string_split(seq, '')) AS aa FROM seqs)"
)
LANG_CELLS = CELLS + (
    ", corpus_cells AS (SELECT lang AS msa_id, msa_id * 1000000 + seq_idx AS seq_idx, pos, aa FROM cells)"
)
CHAINS = (
    "chains AS (SELECT conv_id AS complex_id, turn AS chain_idx, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS chain "
    "FROM conversations)"
)
CHAIN_ROWS = (
    f"turns AS (SELECT conv_id AS complex_id, turn AS chain_idx, {_PIECES} AS t FROM conversations), "
    "chain_rows AS (SELECT complex_id, chain_idx, unnest(range(len(t)))::BIGINT AS row_idx, rpad(unnest(t), 60, '-') AS seq FROM turns)"
)
ATOMS = (
    "vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), "
    "spread AS (SELECT vec_id, v, unnest(range(len(v)))::INT AS pos FROM vec), "
    "atoms AS (SELECT vec_id AS structure_id, pos, v[pos + 1] AS x, v[(pos + 1) % len(v) + 1] AS y, "
    "v[(pos + 2) % len(v) + 1] AS z FROM spread)"
)
OUTCOMES = (
    "parsed AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events), "
    "outcomes AS (SELECT event_id, user_id::VARCHAR AS protein_id, event_type AS strategy, '' AS variant_param, "
    "'None' AS cache_implementation, k AS selected_sequences, CASE WHEN k >= 50 THEN k ELSE 128 END AS target_n, "
    "k AS n_sequences, CASE WHEN k > 9 THEN value END AS neff, value / 2 AS gen_time_s, k / 8.0::DOUBLE AS peak_vram_gb, "
    "CASE WHEN k > 80 THEN k / 100.0::DOUBLE END AS ptm, CASE WHEN k > 60 THEN k::DOUBLE END AS mean_plddt, "
    "CASE WHEN k > 70 THEN value / 10 END AS rmsd, CASE WHEN k > 75 THEN k / 200.0::DOUBLE END AS tm_score, "
    "extract(hour FROM ts)::INT AS run_idx FROM parsed)"
)


def uniform_sql(*keys: str, seed: int = 0) -> str:
    """The hash uniform of ``functions.uniform`` in SQL."""
    parts = ", ':', ".join([*keys, f"'{seed}'"])
    return f"(('0x' || substr(md5(concat({parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def matrix_sql() -> str:
    """The rule-built matrices as a CTE named ``matrices``."""
    classes = ", ".join(f"'{c}'" for c in CLASSES)
    return (
        f"cls AS (SELECT unnest([{classes}]) AS members, unnest(range({len(CLASSES)})) AS home), "
        "letter AS (SELECT unnest(string_split(members, '')) AS aa, home FROM cls), "
        "matrices AS (SELECT m.matrix, a.aa AS from_aa, b.aa AS to_aa, "
        "CASE WHEN a.aa = b.aa THEN m.same WHEN a.home = b.home THEN 1.0 ELSE m.far END::DOUBLE AS score "
        "FROM letter a, letter b, (VALUES ('close', 4.0, -2.0), ('wide', 2.0, -1.0)) m(matrix, same, far))"
    )
