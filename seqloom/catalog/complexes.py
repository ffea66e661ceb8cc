"""Complexes: chains, sampled products, pairing, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog import bindings as b
from seqloom.catalog.registry import query
from seqloom.operators import pairing
from seqloom.plans import requests

QUERY_SQL = f"{b.CHAINS}, complexes AS (SELECT complex_id, string_agg(chain, ':' ORDER BY chain_idx) AS query FROM chains GROUP BY complex_id)"
_ONE = "(SELECT complex_id, count(DISTINCT chain) = 1 AND count(*) > 1 AS is_homo, count(*) AS n FROM chains GROUP BY complex_id)"


@query(
    "FN14",
    f"WITH {b.CHAINS} SELECT complex_id, is_homo, (row_number() OVER (PARTITION BY complex_id ORDER BY chain_idx) - 1)::INT AS chain_idx, chain "
    f"FROM chains JOIN {_ONE} USING (complex_id)",
)
def exploded_chains(spark, sf_dir):
    return pairing.explode_chains(b.complexes(spark, sf_dir))


@query(
    "PAIR1",
    f"WITH {b.CHAINS} SELECT complex_id, 'concat' AS block, -1 AS chain_idx, string_agg(chain, '' ORDER BY chain_idx) AS seq FROM chains GROUP BY complex_id "
    "UNION ALL SELECT complex_id, 'chain_' || i, i, chain FROM (SELECT *, (row_number() OVER (PARTITION BY complex_id ORDER BY chain_idx) - 1)::INT AS i FROM chains)",
)
def multimer_requests(spark, sf_dir):
    return requests.multimer_requests(b.complexes(spark, sf_dir))


@query(
    "WIN4",
    f"WITH {b.CHAINS} SELECT complex_id, chain_idx, len(chain)::BIGINT AS size, "
    "coalesce(sum(len(chain)) OVER (PARTITION BY complex_id ORDER BY chain_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, "
    "coalesce(sum(len(chain)) OVER (PARTITION BY complex_id ORDER BY chain_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS after FROM chains",
)
def chain_offsets(spark, sf_dir):
    out = pairing.chain_offsets(b.chains(spark, sf_dir))
    return out.select("complex_id", "chain_idx", F.length("chain").cast("long").alias("size"), "before", "after")


@query(
    "WIN5",
    f"WITH {b.CHAINS} SELECT complex_id, chain_idx, "
    "coalesce(sum(len(chain)) OVER (PARTITION BY complex_id ORDER BY chain_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, chain FROM chains",
)
def chain_slices(spark, sf_dir):
    lengths = b.chains(spark, sf_dir).select("complex_id", "chain_idx", F.length("chain").cast("long").alias("len"))
    joined = b.complexes(spark, sf_dir).select("complex_id", F.replace("query", F.lit(":"), F.lit("")).alias("query"))
    return pairing.chain_slices(joined, lengths)


_PICK = b.uniform_sql("complex_id", "subset_id", "d", "c")
_SHUF = b.uniform_sql("complex_id", "subset_id", "i")


def product_sql(k: int, n_subsets: int) -> str:
    """Sampled products over ``chain_rows`` as the CTE ``sampled(complex_id, subset_id, draw, seq)``."""
    return (
        "cn AS (SELECT complex_id, chain_idx, count(*) AS n FROM chain_rows GROUP BY ALL), "
        "cs AS (SELECT complex_id, list(n ORDER BY chain_idx) AS sizes, product(n) AS total FROM cn GROUP BY complex_id), "
        f"plan AS (SELECT *, unnest(range({n_subsets})) AS subset_id FROM cs), "
        # Small products: all indexes, in order or in hash order.
        f"idx AS (SELECT *, unnest(range(total::BIGINT)) AS i FROM plan WHERE total <= {4 * k}), "
        f"few AS (SELECT *, row_number() OVER (PARTITION BY complex_id, subset_id ORDER BY CASE WHEN total <= {k} THEN 0 ELSE {_SHUF} END, i) - 1 AS draw FROM idx), "
        "decoded AS (SELECT complex_id, subset_id, draw, list_transform(range(1, len(sizes) + 1), lambda c: "
        "((i // coalesce(list_product(sizes[c + 1:]), 1)::BIGINT) % sizes[c])::BIGINT) AS rows FROM few WHERE draw < " + str(k) + "), "
        f"dc AS (SELECT *, unnest(range({4 * k})) AS d FROM plan WHERE total > {4 * k}), "
        "cc AS (SELECT *, unnest(range(len(sizes))) AS c FROM dc), "
        f"drawn AS (SELECT complex_id, subset_id, d, list(floor({_PICK} * sizes[c + 1])::BIGINT ORDER BY c) AS rows FROM cc GROUP BY complex_id, subset_id, d), "
        "uniq AS (SELECT complex_id, subset_id, rows, min(d) AS d FROM drawn GROUP BY ALL), "
        "many AS (SELECT complex_id, subset_id, row_number() OVER (PARTITION BY complex_id, subset_id ORDER BY d) - 1 AS draw, rows FROM uniq), "
        f"combos AS (SELECT * FROM decoded UNION ALL SELECT * FROM many WHERE draw < {k}), "
        "flat AS (SELECT complex_id, subset_id, draw, unnest(range(len(rows))) AS chain_idx, unnest(rows) AS row_idx FROM combos), "
        "sampled AS (SELECT complex_id, subset_id::INT AS subset_id, draw::INT AS draw, string_agg(seq, '' ORDER BY chain_idx) AS seq FROM flat "
        "JOIN chain_rows USING (complex_id, chain_idx, row_idx) GROUP BY ALL)"
    )


@query("SMP3 JN3", f"WITH {b.CHAIN_ROWS}, {product_sql(25, 2)} SELECT complex_id, subset_id, draw, md5(seq) AS seq FROM sampled")
def sampled_products(spark, sf_dir):
    out = pairing.sample_product(b.chain_rows(spark, sf_dir), 25, 2)
    return out.withColumn("seq", F.md5("seq"))


_SUBSET_NEFF = (
    "w AS (SELECT l.complex_id, l.subset_id, l.draw, len(l.seq) AS width, 1 + count(r.draw) AS near FROM sampled l LEFT JOIN sampled r ON l.complex_id = r.complex_id "
    "AND l.subset_id = r.subset_id AND l.draw <> r.draw AND (len(l.seq) - hamming(l.seq, r.seq)) / len(l.seq)::DOUBLE >= 0.8 GROUP BY ALL), "
    "nf AS (SELECT complex_id, subset_id, count(*) AS n_rows, sum(1.0::DOUBLE / near) / sqrt(max(width)) AS neff FROM w GROUP BY ALL), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY complex_id ORDER BY round(neff, 9), subset_id) - 1 AS rank FROM nf)"
)


@query(
    "SEL9 PAIR2",
    f"WITH {b.CHAIN_ROWS}, {product_sql(20, 6)}, {_SUBSET_NEFF} SELECT complex_id, subset_id, n_rows, round(neff, 6) AS neff, rank FROM best WHERE rank < 2",
)
def lowest_depth_subsets(spark, sf_dir):
    from seqloom.operators.select import lowest_groups

    depth = pairing.subset_depths(b.chain_rows(spark, sf_dir), 6, 20, 0.8)
    best = lowest_groups(depth.withColumn("neff", F.round("neff", 9)), ["complex_id"], "neff", "subset_id", 2)
    return best.select("complex_id", "subset_id", "n_rows", F.round("neff", 6).alias("neff"), "rank")


@query("PAIR2 SET3 SMP3 SEL9 DED2")
def paired_blocks(spark, sf_dir):
    """Paired rows per complex with the default parameters."""
    out = pairing.paired_block(b.chain_rows(spark, sf_dir))
    return out.select("complex_id", "seq_idx", F.md5("seq").alias("seq"))


_LABEL = "CASE WHEN is_homo THEN '{k}_' || i ELSE array_to_string(list_transform(range(n), lambda x: '{k}_' || i), chr(9)) END"
LAYOUT_SQL = (
    f"WITH {b.CHAINS}, {b.CHAIN_ROWS}, shape AS {_ONE}, "
    "off AS (SELECT *, coalesce(sum(len(chain)) OVER (PARTITION BY complex_id ORDER BY chain_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before, "
    "coalesce(sum(len(chain)) OVER (PARTITION BY complex_id ORDER BY chain_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::INT AS after FROM chains), "
    "agg AS (SELECT complex_id, list(chain ORDER BY chain_idx) AS c FROM chains GROUP BY complex_id), "
    "cat AS (SELECT complex_id, row_number() OVER (PARTITION BY complex_id ORDER BY chain_idx, row_idx) - 1 AS i, seq FROM chain_rows), "
    "one AS (SELECT complex_id, row_idx AS i, seq FROM chain_rows WHERE chain_idx = 0) "
    "SELECT complex_id, 0 AS ord, 0::BIGINT AS seq_idx, 'info' AS row_kind, CASE WHEN is_homo THEN '#' || len(c[1]) || chr(9) || n ELSE "
    "'#' || array_to_string(list_transform(c, lambda x: len(x)::VARCHAR), ',') || chr(9) || array_to_string(list_transform(c, lambda x: '1'), ',') END AS label, NULL AS seq FROM shape JOIN agg USING (complex_id) "
    "UNION ALL SELECT complex_id, 1, 0, 'query', CASE WHEN is_homo THEN 'query' ELSE array_to_string(range(1, n + 1)::VARCHAR[], chr(9)) END, CASE WHEN is_homo THEN c[1] ELSE array_to_string(c, '') END FROM shape JOIN agg USING (complex_id) "
    f"UNION ALL SELECT complex_id, 2, i, 'concat', {_LABEL.format(k='concat')}, seq FROM cat JOIN shape USING (complex_id) "
    f"UNION ALL SELECT complex_id, 3, i, 'paired', {_LABEL.format(k='paired')}, seq FROM one JOIN shape USING (complex_id) "
    "UNION ALL SELECT complex_id, 4, chain_idx, 'chain_query', 'chain' || chain_idx || '_query', repeat('-', before) || chain || repeat('-', after) FROM off JOIN shape USING (complex_id) WHERE NOT is_homo"
)


@query("PAIR3 SNK5 WIN1", LAYOUT_SQL)
def paired_layout(spark, sf_dir):
    """File layout of every complex, with its chain rows standing in for the two blocks."""
    from seqloom.operators.groups import row_numbers

    rows = b.chain_rows(spark, sf_dir)
    concat = row_numbers(rows, ["complex_id"], F.col("chain_idx"), [F.col("row_idx")], "seq_idx")
    single = rows.where(F.col("chain_idx") == 0).withColumn("seq_idx", F.col("row_idx"))
    return pairing.paired_layout(b.complexes(spark, sf_dir), concat, single)


@query("JOB7 PAIR1 PAIR2 PAIR3 PAIR4 SET2")
def built_complexes(spark, sf_dir):
    """The multimer job over all complexes with the built-in mutation generator."""
    from seqloom.plans import generate, jobs

    queries = b.complexes(spark, sf_dir)
    matrix = b.matrices(spark)
    grid = {"base": {"top_p": 0.9}, "matrix": {"temperature": [0.5, 1.0]}}

    def candidates(r):
        marked = r.withColumn("matrix", F.lit("close"))
        return generate.mutation_candidates(marked, matrix, F.lit(30.0), ["query_id", "run_idx", "seq_idx"])

    rows = jobs.build_complexes(
        queries, candidates, matrix, {"close": 10.0, "wide": 20.0}, 0.5, n_subsets=4, subset_size=20, top_k=2,
        params=grid, num_returns=2, multiplier=1,
    )
    return rows.select("complex_id", "ord", "seq_idx", "row_kind", "label", F.md5("seq").alias("seq"))
