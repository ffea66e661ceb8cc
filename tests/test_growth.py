"""Steps whose cost once grew too fast: same results, done the cheaper way."""

import contextlib
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.catalog import plans
from seqloom.functions import uniform
from seqloom.functions.scalar import argmax_letter
from seqloom.functions.text import cut_texts, letter_pieces
from seqloom.operators import augment, bands, columns, dedup, filters, groups, pairing, select
from seqloom.operators.tiles import letter_codes, one_hot
from seqloom.plans import requests, vectors
from seqloom.sources import fasta, sinks, structures


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(1, "Ab, cdE" * 9, "en"), (2, "x", "en"), (3, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_outputs_travel_once_per_chunk(spark, documents, capsys):
    out = plans.placed_candidates(spark, documents)
    out.explain()
    join = next(line for line in capsys.readouterr().out.splitlines() if "Join" in line)
    assert "SortMergeJoin" in join and "coverage_no" in join and "seq_idx" not in join
    got = {(r["query_id"], r["run_idx"], r["seq_idx"]): r["seq"] for r in out.collect()}
    assert len(got) == 96 + 48  # a text of one letter has no half
    assert {got[1, 2, s] for s in range(1, 49) if (s - 1) // 4 % 2} == {hashlib.md5(("ABCDE" * 9)[::-1].encode()).hexdigest()}


@pytest.mark.parametrize("n", [2, 9, 60, 150, 700])
def test_coupling_of_rows_leaves_the_full_inverse_alone(monkeypatch, n):
    rng = np.random.default_rng(n)
    rows = ["A-" + "".join(r) for r in rng.choice(list("ACDEFGHIKLMNPQRSTVWY-X?"), (n, 25))]
    y = one_hot(letter_codes(rows))
    both = np.triu(y.T @ y)
    a, b = np.nonzero(both)
    want = columns._coevolution_from_counts(pd.DataFrame({"a": a, "b": b, "n": both[a, b]}), 27, n)
    monkeypatch.setattr(columns, "_block_norms", None)
    assert columns._coevolution_from_rows(rows) == pytest.approx(want, abs=1e-12)


def test_coupling_of_equal_rows_is_zero():
    assert not columns._coevolution_from_rows(["ACD-"] * 5).any()


def test_md5_of_many_messages():
    rng = np.random.default_rng(1)
    for length in (0, 1, 7, 54, 55, 56, 63, 64, 119, 130):
        texts = rng.integers(0, 256, (5, length), np.uint8)
        want = [int.from_bytes(hashlib.md5(t.tobytes()).digest()[:4], "big") for t in texts]
        assert uniform.md5_heads(texts).tolist() == want


def test_draws_per_place_are_the_single_draws(monkeypatch):
    monkeypatch.setattr(uniform, "BULK_CELLS", 150)
    prefixes = ["é" * (i % 5) + f"{i * 10**i}:" for i in range(18)]
    counts = np.array([[0, 1, 9, 10, 11, 130, 513, 1001, 60][i % 9] for i in range(18)])
    got = uniform.place_uniforms(prefixes, counts, ":p:3")
    assert [g.tolist() for g in got] == [[uniform.single_uniform(f"{p}{i}:p:3") for i in range(n)] for p, n in zip(prefixes, counts)]


def test_mutations_hash_in_bulk(spark, msa, monkeypatch):
    """No draw of a short row goes through a hash of its own; a long row draws the same."""
    df = msa(["ACDE-fgX", "ACDEACDE", "", "CD" * 300])
    matrix = augment.grouped_matrix(spark, "m", ["AC", "DE"]).unionByName(augment.grouped_matrix(spark, "w", ["ACDE"]))
    marked = df.withColumn("matrix", F.lit("m"))

    def rows():
        return augment.mutate_rows(marked, matrix, augment.percent_changes(F.lit(40.0)), ["msa_id", "seq_idx"]).orderBy("seq_idx").collect()

    want = rows()
    for places in (-1, 10_000):
        monkeypatch.setattr(augment, "BULK_PLACES", places)
        assert rows() == want
    monkeypatch.setattr(augment, "hash_uniform", lambda *keys, seed=0: F.lit(2.0))
    assert rows() == want


def test_substitutes_are_put_in_bulk(spark, msa, monkeypatch):
    """Short rows of a small table are changed in batches; a table that is not small gives the same rows."""
    seqs = ["ACDE-fgX", "", "é" + "ACDEFW" * 3, "AC" * 77, "ACDEACDE"]
    matrix = augment.grouped_matrix(spark, "m", ["AC", "DE"]).unionByName(augment.grouped_matrix(spark, "w", ["ACDE"]))
    names = F.element_at(F.array(F.lit("w"), F.lit("m"), F.lit("none"), F.lit(None)), (F.col("seq_idx") % 4 + 1).cast("int"))
    marked = msa(seqs, seqs[::-1]).withColumn("matrix", names)

    def rows():
        return augment.mutate_rows(marked, matrix, augment.percent_changes(F.lit(60.0)), ["msa_id", "seq_idx"]).orderBy("msa_id", "seq_idx").collect()

    with monkeypatch.context() as m:
        m.setattr(augment, "MAX_MATRIX_ROWS", 1)
        want = rows()
    monkeypatch.setattr(augment, "_with_substitutes", None)
    assert rows() == want and [r["seq"] for r in want] != seqs + seqs[::-1]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_small_groups_are_scanned_together(monkeypatch, threshold):
    rng = np.random.default_rng(5)
    groups = [["".join(r) for r in rng.choice(list("AC-é"), (n, width))] for n in (0, 1, 2, 3, 9, 16) for width in (1, 7) for _ in range(5)]
    groups += [["", ""], ["AC", "A", "AC"]]
    want = [dedup._scan(g, threshold) for g in groups]
    monkeypatch.setattr(dedup, "SCAN_CELLS", 40)
    monkeypatch.setattr(dedup, "_scan_even", None)
    assert dedup.scans(groups, threshold) == want


def test_groups_are_counted_before_the_filters(spark, msa, monkeypatch):
    """The count of rows per alignment does not work out the filters; large alignments keep the same rows."""
    rng = np.random.default_rng(2)
    rows = ["".join(r) for r in rng.choice(list("ACDEFGHIKL"), (30, 20))]
    df, plans_seen = msa(rows + rows[:5] + ["A" * 20] * 3, rows[:4]), []
    cut = groups.cut_lineage
    monkeypatch.setattr(groups, "cut_lineage", lambda x: plans_seen.append(x._jdf.queryExecution().toString()) or cut(x))
    got = [sorted(map(tuple, filters.filter_rows(df, 20, max_group_rows=limit).collect())) for limit in (4096, 10)]
    assert got[0] == got[1] and len(got[0]) == 34
    assert "regexp_replace" not in plans_seen[0]


@contextlib.contextmanager
def spark_conf(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


@pytest.fixture
def spread_msa(spark):
    """One large alignment whose seq_idx leaves wide gaps, and two small ones."""
    ids = spark.range(4000).select(F.lit("big").alias("msa_id"), (F.col("id") * 100000 + 7).alias("seq_idx"), "id")
    few = spark.range(3).select(F.when(F.col("id") < 2, "pair").otherwise("one").alias("msa_id"), F.col("id").alias("seq_idx"), "id")
    letter = F.element_at(F.split(F.lit("A,C,D,-"), ","), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    return ids.unionByName(few).select("msa_id", "seq_idx", F.concat(letter, F.lit("CD-E")).alias("seq"))


def test_profile_copies_are_bounded(spread_msa, capsys):
    """A large alignment has as many copies of its profile as there are parts, not one per stretch of seq_idx."""
    parts = spread_msa.groupBy("msa_id").agg(F.countDistinct(groups.salt()).alias("n"), F.countDistinct(groups.index_bucket()).alias("b")).collect()
    found = {r["msa_id"]: (r["n"], r["b"]) for r in parts}
    assert found["big"][0] <= groups.SALTS < found["big"][1] and found["pair"] == found["one"] == (1, 1)
    scored = columns.rarity_scores(spread_msa)
    scored.explain()
    assert "xxhash64" in capsys.readouterr().out
    assert scored.count() == 4003 and scored.where("score is null").count() == 0


@pytest.mark.parametrize("strategy", ["random", "column_entropy"])
def test_large_groups_are_joined_by_parts(spread_msa, capsys, strategy):
    """No join or count of a selection brings all rows of an alignment together."""
    out = select.select_subset(spread_msa, 3, strategy)
    out.explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line and "msa_id" in line]
    assert joins and all("__salt" in line for line in joins if "Sort" in line)
    got = out.groupBy("msa_id").agg(F.count("*").alias("n"), F.min_by("seq_idx", "rank").alias("q")).collect()
    assert {r["msa_id"]: (r["n"], r["q"]) for r in got} == {"big": (3, 7), "pair": (2, 0), "one": (1, 2)}


def test_coverage_numbers_by_stretches(spread_msa, monkeypatch, capsys):
    """The counts of many numbering buckets are summed by stretches; numbers stay those of a sort."""
    monkeypatch.setattr(columns, "OUTER_BUCKET", 16)
    out = columns.coverage_rows(spread_msa)
    out.explain()
    assert "__o" in capsys.readouterr().out
    rows = sorted(out.where("msa_id = 'big'").collect(), key=lambda r: (r["seq_idx"] != 7, -r["residues"], r["seq_idx"]))
    assert [r["row_rank"] for r in rows] == list(range(4000))
    assert {r["msa_id"] for r in out.select("msa_id").distinct().collect()} == {"big", "pair"}


@pytest.mark.parametrize("width, threshold", [(60, 0.9), (20, 0.5), (70, 0.9), (6, 0.3), (3, 0.95)])
def test_rows_that_end_in_gaps_meet_by_their_letters(msa, width, threshold):
    """Similar rows share a bucket and are found once each; rows of a few letters do not all meet in bands of gaps."""
    rng = np.random.default_rng(width)
    rows = []
    for _ in range(90):
        row = list("".join(rng.choice(list("ACDEFG-HIKLM"), rng.integers(0, width + 1))).ljust(width, "-"))
        rows.append("".join(row))
        for _ in range(rng.integers(0, 7)):
            row[rng.integers(0, width)] = str(rng.choice(list("AC-é\u0141m")))
        rows.append("".join(row))
    rows = list(dict.fromkeys(rows))
    found = [set(x) for x in bands.buckets(rows, threshold)]
    alike = {(i, j): sum(map(str.__eq__, rows[i], rows[j])) for j in range(len(rows)) for i in range(j)}
    want = {(*pair, n) for pair, n in alike.items() if n / width > threshold}
    assert all(found[i] & found[j] for i, j, _ in want)
    got = dedup.near_duplicate_pairs(msa(rows), threshold).select("i", "j", "matches").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_short_rows_have_few_candidates():
    rng = np.random.default_rng(4)
    rows = ["".join(r).ljust(60, "-") for r in rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), (300, 14))]
    found = [set(x) for x in bands.buckets(rows, 0.9)]
    met = sum(bool(found[i] & found[j]) for j in range(300) for i in range(j))
    assert met < 0.05 * 300 * 299 / 2


def test_disturbed_states_are_drawn_and_decoded_in_bulk(spark, monkeypatch, capsys):
    """No draw of noise has a hash expression of its own, and a vector is decoded once; the draws are those of the expressions."""
    states = spark.createDataFrame([(7, [1.0, -2.0, 0.5, 3.0, 0.0]), (8, [])], "query_id long, vector array<double>")
    conf = {"noise_scales": [0.5, 2.0], "num_return_sequences": 2}
    asked = requests.strategy_requests(states.select("query_id"), "embedding_walk_full", conf).unionByName(requests.strategy_requests(states.select("query_id"), "encoder_perturb", conf))
    key = [F.col("query_id"), F.col("request_no")]
    sigma, scale = F.col("params")["sigma"], [F.lit(vectors.DEPTH_DECAY ** (1 - k)) for k in range(2)]
    want = F.transform("vector", lambda x, i: x + sigma * scale[0] * uniform.hash_gauss(*key, F.lit(0), i) + sigma * scale[1] * uniform.hash_gauss(*key, F.lit(1), i))
    met = asked.where("strategy = 'embedding_walk_full'").join(states, "query_id").withColumn("vector", want)
    got = vectors.disturbed_states(asked, states)
    rows = {(r["query_id"], r["request_no"]): r["vector"] for r in got.where("strategy = 'embedding_walk_full'").collect()}
    assert len(rows) == 8 and all(rows[r["query_id"], r["request_no"]] == pytest.approx(r["vector"], abs=1e-12) for r in met.collect())
    out = vectors.vector_candidates(asked, states, vectors.window_decoder("acde"), F.lit(5))
    out.explain()
    plan = capsys.readouterr().out
    assert "md5" not in plan and plan.count("bulk(") <= 4
    assert out.count() == 8


def test_window_letters_are_the_largest_scores(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 3.0, 2.0, 3.0, -1.0],), ([0.0, -0.0, nan, inf, nan],), ([1.0, 2.0],), ([],), (None,), ([None, 1.0, nan, None],), ([None, None, None],)]
    df = spark.createDataFrame(rows, "v array<double>")
    scores = lambda i: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get("v", F.pmod(i + k, F.size("v"))))
    want = F.array_join(F.transform("v", lambda x, i: argmax_letter(scores(i), "acd")), "")
    for r in df.select(want.alias("want"), vectors.window_decoder("acd")(F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_walks_take_the_draws_of_the_expressions(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0, 0.0, 5.0])], "id long, vector array<double>")
    got = {r["component"]: r["vector"] for r in augment.principal_walk(df, 2, [1.0], 5, 0.5, ["id"], seed=4).collect()}
    cells = df.select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.transform("vector", lambda x, i: F.lit(0.5) * uniform.hash_gauss(F.col("id"), k, i, seed=4))).alias("d")).first()["d"]
    cloud = np.array(cells)
    axes = np.linalg.svd(cloud - cloud.mean(axis=0), full_matrices=False)[2][:2]
    for k, axis in enumerate(axes):
        assert got[k] == pytest.approx(np.array([1.0, 2.0, 0.0, 5.0]) + axis * np.sign(axis[np.abs(axis).argmax()]), abs=1e-9)


def test_a_large_alignment_has_several_writers(spark, spread_msa, tmp_path):
    sinks.write_parts(spread_msa.withColumn("label", F.concat(F.lit("r"), F.col("seq_idx").cast("string"))), f"{tmp_path}/out")
    files = {m: list(tmp_path.glob(f"out/msa_id={m}/*.txt")) for m in ("big", "pair", "one")}
    assert len(files["big"]) > 1 and len(files["pair"]) == len(files["one"]) == 1
    ids = [[int(line[2:]) for line in f.read_text().split() if line.startswith(">")] for f in files["big"]]
    assert all(x == sorted(x) for x in ids) and sorted(sum(ids, [])) == [i * 100000 + 7 for i in range(4000)]
    back = fasta.read_large_fasta(spark, f"{tmp_path}/out/msa_id=*", glob="*.txt").select("query_id", "seq")
    assert sorted(map(tuple, back.collect())) == sorted((f"r{r['seq_idx']}", r["seq"]) for r in spread_msa.collect())


def test_structures_share_files(spark, tmp_path):
    """Few files hold many structures; the first model and the first location of a residue count, as in a file of its own."""
    line = structures.atom_line(F.col("pos") + 1, F.col("id") / 4, F.col("pos") * -1.5, F.lit(7.0))
    rows = spark.range(200).select("id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos")).select(F.col("id").alias("structure_id"), "pos", line.alias("value"))
    later = rows.where("structure_id = 5").withColumn("pos", F.col("pos") + 20)
    ends = rows.where("structure_id = 5 AND pos = 0").select("structure_id", F.lit(15).alias("pos"), F.lit("ENDMDL").alias("value"))
    structures.write_bundles(rows.unionByName(later).unionByName(ends), f"{tmp_path}/out")
    assert len(list(tmp_path.glob("out/part-*"))) <= 8
    with spark_conf(spark, "spark.sql.files.maxPartitionBytes", "3000"):
        got = structures.read_bundles(spark, f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), p, i / 4, p * -1.5, 7.0) for i in range(200) for p in range(12))


def test_joint_counts_leave_a_block_as_arrays(msa, monkeypatch, capsys):
    """Many blocks give the counts of one; a block sends one array per column, not a row per pair of states."""
    rng = np.random.default_rng(6)
    rows = ["".join(r) for r in rng.choice(list("ACDEFGHIKL-?"), (300, 9))]
    df = msa(rows, rows[:1], ["AC", "ACD"], ["", ""])
    monkeypatch.setattr(columns, "PRODUCT_ROWS", 7)
    monkeypatch.setattr(columns, "JOINT_PARTS", 3)
    got = [sorted(map(tuple, columns.joint_counts(df, block_rows=n).select("msa_id", "a", "b", "n").collect())) for n in (65536, 11)]
    y = one_hot(letter_codes(rows))
    both = np.triu(y.T @ y)
    want = [("m0", int(a), int(b), int(both[a, b])) for a, b in zip(*np.nonzero(both))]
    assert got[0] == got[1] and [r for r in got[0] if r[0] == "m0"] == want and {r[0] for r in got[0]} == {"m0", "m1"}
    columns.joint_counts(df).explain()
    lines = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
    assert not any("a#" in line and "b#" in line for line in lines)
    counts = {(r["pos_i"], r["aa_i"], r["pos_j"], r["aa_j"]): (r["n"], r["cov"]) for r in columns.column_covariance(df).where("msa_id = 'm0'").collect()}
    a, z = next((r[0], r[8]) for r in rows if r[0].isalpha() and r[8].isalpha())
    first, last = [r[0] == a for r in rows], [r[8] == z for r in rows]
    assert a != "X" != z and counts[0, a, 8, z] == (sum(a and b for a, b in zip(first, last)), pytest.approx(np.cov(first, last)[0, 1]))


def test_texts_are_cut_in_bulk(spark, monkeypatch, capsys):
    """No pattern is matched letter by letter; the pieces are those of the patterns."""
    rng = np.random.default_rng(8)
    texts = ["", "\n\n", "a", " \t.,\u0130\u00df", "ab\nc\r\nd", "xyz" * 41 + "\n", "\u00e9a\n\n" * 9, None]
    texts += ["".join(rng.choice(list("aBz \n-\u0142"), n, p=[0.3, 0.3, 0.2, 0.1, 0.02, 0.04, 0.04])) for n in rng.integers(0, 400, 60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    plain = F.regexp_extract_all(F.upper(F.regexp_replace("text", "[^A-Za-z\n]", "")), F.lit("[A-Z]{1,7}"), F.lit(0))
    got = df.select("id", letter_pieces(F.col("text"), 7).alias("got"), plain.alias("want"))
    got.select("got").explain()
    assert "regexp" not in capsys.readouterr().out
    want = {r["id"]: r["want"] for r in got.collect()}
    assert {r["id"]: r["got"] for r in got.collect()} == want
    monkeypatch.setattr("seqloom.functions.text.CUT_BYTES", 100)
    assert cut_texts(pa.array(["?", *texts])[1:], 7).to_pylist() == [want[i] for i in range(len(texts))]


def _kept_by_scan(rows, threshold):
    kept = []
    for i, r in enumerate(rows):
        if not any(sum(map(str.__eq__, r, rows[k])) / len(r) > threshold for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("width, threshold, limit, heads", [(60, 0.9, 10, 2), (60, 0.9, 3, 64), (70, 0.9, 5, 1), (20, 0.8, 5, 2)])
def test_even_rows_are_decided_by_pairs(msa, monkeypatch, width, threshold, limit, heads):
    """Chains of close rows, buckets over many batches and rows of other letters: what is kept is what a scan keeps."""
    rng = np.random.default_rng(width + heads)
    rows = []
    for i in range(260):
        row = list(rows[rng.integers(len(rows))]) if rows and rng.random() < 0.7 else list("".join(rng.choice(list("ACDEFG-HIKLM"), rng.integers(0, width + 1))).ljust(width, "-"))
        for _ in range(rng.integers(0, 5)):
            row[rng.integers(0, width)] = str(rng.choice(list("ACLY-\u0141")))
        rows.append("".join(row))
    want = _kept_by_scan(rows, threshold)
    df = msa(rows, rows[:90])
    for few in (1 << 20, 0):
        monkeypatch.setattr(dedup, "FEW_EDGES", few)
        monkeypatch.setattr(bands, "MOST_LAG", 4 if few else 32)
        with spark_conf(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "17"):
            got = dedup.near_dedup(df, threshold, max_group_rows=limit, heads=heads).select("msa_id", "seq_idx").collect()
        assert sorted(r["seq_idx"] for r in got if r["msa_id"] == "m0") == want
        assert sorted(r["seq_idx"] for r in got if r["msa_id"] == "m1") == _kept_by_scan(rows[:90], threshold)


def test_rows_meet_the_first_of_a_bucket_within_a_pass(msa, capsys):
    """Pairs of a bucket never travel as candidates: no join files them, and later rows of a large bucket only meet its first ones."""
    rows = ["".join(r).ljust(60, "-") for r in np.random.default_rng(3).choice(list("ACDE"), (200, 4))]
    rows = list(dict.fromkeys(rows))
    df = msa(rows).withColumnRenamed("seq_idx", "idx")
    met = bands.near_heads(df, 0.9, ["msa_id"], 3)
    met.explain()
    assert "Join" not in capsys.readouterr().out
    got = {tuple(r) for r in met.select("h_idx", "idx").collect()}
    pairs = {x for x in got if x[0] is not None}
    assert pairs == {(h, i) for i in range(len(rows)) for h in range(min(i, 3))}
    assert got - pairs == {(None, i) for i in range(3, len(rows))}


@pytest.mark.parametrize("sizes, k", [([2, 3], 9), ([3, 2], 4), ([5, 1, 2], 3), ([40, 7, 3], 12), ([13] * 12, 30), ([9] * 70, 5)])
def test_combinations_are_drawn_in_bulk(sizes, k):
    """The draws of a hash per draw and chain, for many subsets at a time."""
    def uniform(keys):
        return int.from_bytes(hashlib.md5(keys.encode()).digest()[:4], "big") / 4294967296.0

    prefixes = [f"é{i}" for i in (0, 7, 12)]
    for prefix, got in zip(prefixes, pairing.combination_sets(prefixes, sizes, k, 3), strict=True):
        every = list(np.ndindex(*sizes)) if math.prod(sizes) <= 4 * k else None
        if every is None:
            drawn = [tuple(int(uniform(f"{prefix}:{d}:{c}:3") * n) for c, n in enumerate(sizes)) for d in range(4 * k)]
            want = list(dict.fromkeys(drawn))[:k]
        elif len(every) <= k:
            want = every
        else:
            want = [every[i] for i in sorted(range(len(every)), key=lambda i: uniform(f"{prefix}:{i}:3"))[:k]]
        assert list(map(tuple, got.tolist())) == want


def test_rows_of_a_chain_are_compared_once_for_all_subsets(monkeypatch):
    rng = np.random.default_rng(9)
    chains = [["".join(x) for x in rng.choice(list("AC-D"), (n, w))] for n, w in ((6, 20), (2, 0), (5, 70), (60, 3))]
    sets = [np.stack([rng.integers(0, len(c), 12) for c in chains], axis=1) for _ in range(7)]
    calls, plain = [], pairing.pair_matches
    monkeypatch.setattr(pairing, "pair_matches", lambda a, b: calls.append(1) or plain(a, b))
    for threshold in (0.0, 0.4, 0.8, 1.0, 1.5):
        want = []
        for combos in sets:
            texts = ["".join(c[i] for c, i in zip(chains, combo)) for combo in combos]
            near = np.array([sum(sum(map(str.__eq__, a, b)) / 93 >= threshold for b in texts) for a in texts])
            with np.errstate(divide="ignore"):
                want.append(float((1.0 / near).sum() / math.sqrt(93)))
        with np.errstate(divide="ignore"):
            assert pairing.set_depths(chains, sets, threshold) == want
    assert len(calls) == 5 * (2 + 7)  # the long chain has more pairs than the sets
    ragged = pairing.set_depths([["A", "CC"], ["DD", "E"]], [np.array([[0, 0], [1, 1]]), np.array([[0, 0], [1, 0]])], 0.5)
    assert ragged == [pytest.approx(2 / math.sqrt(3)), None] and pairing.set_depths([["", ""]], sets[:1], 0.5) == [None]


def test_kernels_keep_their_tasks_behind_a_join(spark, capsys):
    """Rows that a join has dealt by the key of a kernel are not merged into a few tasks by their size."""
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    joined = df.join(df.where("id % 3 > 0").select("id").hint("merge"), "id", "left_semi")
    groups.over_tasks(joined, ["id"]).groupBy("id").agg(F.collect_list("v")).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_rows_of_complexes_are_made_once(spark, capsys):
    """What a complex's layout, subsets and chosen draws read is written once; rows of some thousand letters hash in bulk."""
    from seqloom.plans import generate, jobs

    assert uniform.BULK_PLACES >= 4096
    queries = spark.createDataFrame([(1, "ACDEFGHIKL:" + "CDEFW" * 3), (2, "ACD")], "complex_id long, query string")
    matrix, calls = augment.grouped_matrix(spark, "m", ["AC", "DEF", "GHIKLW"]), spark.sparkContext.accumulator(0)

    def reversed_(part):
        calls.add(len(part))
        return part.assign(seq=part["chunk"].str[::-1])

    out = jobs.build_complexes(
        queries, lambda r: generate.run_generator(r, reversed_).drop("status", "error"), matrix, {"m": 20.0}, 1.0, n_subsets=3, subset_size=4, top_k=2,
        params={"base": {"top_p": 0.9}}, num_returns=2, multiplier=1,
    )
    before = calls.value
    out.explain()
    plan = capsys.readouterr().out
    assert "__n_change" not in plan and "__table" not in plan and plan.count("MapInPandas") == 0
    kinds = {r["row_kind"] for r in out.collect()}
    assert {"info", "query", "concat", "paired", "chain_query"} == kinds and calls.value == before > 0


def test_filed_rows_travel_once(msa, monkeypatch, capsys):
    """Rows are dealt to their buckets once and without the other buckets' keys; buckets too large for a task are joined."""
    rng = np.random.default_rng(12)
    rows = ["".join(rng.choice(list("ACDE"), n)).ljust(30, "-") for n in rng.integers(2, 31, 150)]
    rows += [r[:k] + "W" + r[k + 1 :] for r, k in zip(rows, rng.integers(0, 30, 150))]
    rows = list(dict.fromkeys(rows))
    df = msa(rows + rows[:9], rows[:40])
    want = {(i, j, n) for j in range(len(rows)) for i in range(j) if (n := sum(map(str.__eq__, rows[i], rows[j]))) / 30 > 0.85}
    for held, joins in ((1 << 16, 0), (40, 1), (0, 1)):
        monkeypatch.setattr(bands, "HELD_ROWS", held)
        monkeypatch.setattr(bands, "COUNT_CELLS", 64)
        out = dedup.near_duplicate_pairs(df, 0.85)
        out.explain()
        plan = capsys.readouterr().out
        lines = [line for line in plan.splitlines() if "Exchange" in line and "bucket" in line]
        assert plan.count("SortMergeJoin") == joins and (joins or (len(lines) == 1 and "keys#" not in plan))
        got = [tuple(r) for r in out.where("msa_id = 'm0'").select("i", "j", "matches").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r["copies_i"] for r in out.where("msa_id = 'm0' AND i < 9").collect()} == {2}


def test_many_small_files_have_many_writers(spark, tmp_path):
    """Rows of a few bytes are not merged into one task that writes all their files."""
    seen = []
    for name in ("write_records", "write_named"):
        df = spark.range(40).select(F.col("id").alias("msa_id"), F.lit(0).alias("seq_idx"), F.lit("r").alias("label"), F.lit("AC").alias("seq"), F.lit("x").alias("value"))
        spark.sparkContext.setJobGroup(name, name)
        if name == "write_records":
            sinks.write_records(df, f"{tmp_path}/{name}")
        else:
            sinks.write_named(df, f"{tmp_path}/{name}", "msa_id", ".txt", "seq_idx")
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
        seen.append(max(stages, key=lambda s: s.stageId).numTasks)
    assert min(seen) >= 4
    assert len(list(tmp_path.glob("write_records/msa_id=*/part-*"))) == len(list(tmp_path.glob("write_named/*.txt"))) == 40
