"""Exact values and brute-force comparisons on small alignments."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalar as fn
from seqloom.functions import text
from seqloom.operators import augment, columns, dedup, filters, groups, neff, pairing, results, select, structure, tiles
from seqloom.plans import generate, requests, tokens, vectors


def random_rows(n, width, letters="ACDE", seed=1, near=0.5):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        if rows and rng.random() < near:
            row = list(rng.choice(rows))
            for _ in range(rng.randrange(3)):
                row[rng.randrange(width)] = rng.choice(letters)
        else:
            row = [rng.choice(letters) for _ in range(width)]
        rows.append("".join(row))
    return rows


def same(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def brute_neff(rows, t=0.5):
    return sum(1 / sum(same(a, b) >= t for b in rows) for a in rows) / math.sqrt(len(rows[0]))


def brute_dedup(rows, t):
    kept = []
    for i, s in enumerate(rows):
        def close(k):
            o = rows[k]
            return (same(s, o) if len(s) == len(o) else SequenceMatcher(None, s, o).ratio()) > t

        if not any(close(k) for k in kept):
            kept.append(i)
    return kept


def picks(df, group="m0"):
    rows = df.where(F.col("msa_id") == group).collect()
    key = "rank" if "rank" in df.columns else "seq_idx"
    return [r["seq_idx"] for r in sorted(rows, key=lambda r: r[key])]


def test_neff_closed_forms(msa):
    different = ["".join(chr(65 + 4 * j + i) if 4 * j + i < 26 else "-" for j in range(6)) for i in range(2)]
    df = msa(["ACDEFGHIKL"] * 10, ["AAAAAAAAAA", "CCCCCCCCCC", "DDDDDDDDDD", "EEEEEEEEEE"], ["ACDEF"], different)
    got = {r["msa_id"]: (r["n_rows"], r["neff"]) for r in neff.neff(df).collect()}
    assert got["m0"] == (10, pytest.approx(1 / math.sqrt(10)))
    assert got["m1"] == (4, pytest.approx(4 / math.sqrt(10)))
    assert got["m2"] == (1, pytest.approx(1 / math.sqrt(5)))


def test_neff_blocks_equal_brute_force(msa):
    rows = random_rows(70, 12) + random_rows(5, 12)[:1] * 4
    df = msa(rows)
    for block in (2048, 9):
        value = neff.neff(df, 0.6, block_rows=block).collect()[0]["neff"]
        assert value == pytest.approx(brute_neff(rows, 0.6))
    near = {r["seq_idx"]: r["n_neighbours"] for r in neff.neighbour_counts(df, 0.6, block_rows=9).collect()}
    assert near == {i: sum(same(a, b) >= 0.6 for b in rows) - 1 for i, a in enumerate(rows)}


def test_neff_rejects(msa):
    df = msa(["AC", "ACD"], ["", ""], ["AC", "AC"])
    assert [r["msa_id"] for r in neff.neff(df).collect()] == ["m2"]
    assert {r["msa_id"] for r in neff.rejects(df).collect()} == {"m0", "m1"}
    with pytest.raises(Exception):
        neff.neff(df, strict=True).collect()
    with pytest.raises(ValueError):
        neff.neff(df, 1.5)


@pytest.mark.parametrize("t", [0.9, 0.75, 0.5])
def test_near_dedup_equals_scan(msa, t):
    rows = random_rows(60, 20, near=0.7) + ["A" * 20, "A" * 20]
    expected = brute_dedup(rows, t)
    for limit, heads in ((4096, 64), (5, 2)):
        got = dedup.near_dedup(msa(rows), t, max_group_rows=limit, heads=heads)
        assert picks(got.drop("rank")) == expected


def test_near_dedup_ragged(msa):
    rows = [r[: 10 + i % 4] for i, r in enumerate(random_rows(25, 14, near=0.8))]
    for limit in (4096, 4):
        assert picks(dedup.near_dedup(msa(rows), 0.8, max_group_rows=limit, heads=3)) == brute_dedup(rows, 0.8)


@pytest.mark.parametrize("t", [0.95, 0.7, 0.4])
def test_ragged_rows_meet_by_their_rarest_stretches(spark, msa, t):
    rng = random.Random(int(100 * t))
    rows = []
    for _ in range(100):
        row = list(rng.choice(rows)) if rows and rng.random() < 0.6 else rng.choices("ACDEFGHIKL", k=rng.randrange(1, 45))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(row) + 1)
            row[at : at + rng.randrange(2)] = rng.choices("ACDEFGHIKL", k=rng.randrange(2))
        rows.append("".join(row) or "A")
    expected = brute_dedup(rows, t)
    assert picks(dedup.near_dedup(msa(rows), t, max_group_rows=12, heads=16)) == expected
    buckets = {r["seq_idx"]: set(r["buckets"]) for r in dedup.gram_buckets(msa(list(dict.fromkeys(rows))), t, ["msa_id"]).collect()}
    distinct = list(dict.fromkeys(rows))
    met = 0
    for i, a in enumerate(distinct):
        for j in range(i):
            o = distinct[j]
            shared = bool(buckets[i] & buckets[j])
            met += shared
            if (same(a, o) if len(a) == len(o) else SequenceMatcher(None, o, a).ratio()) > t:
                assert shared
    assert t < 0.9 or met < 0.2 * len(distinct) * (len(distinct) - 1) / 2


@pytest.mark.parametrize("t", [0.95, 0.8, 0.6])
def test_least_matches_is_the_least(t):
    for a in range(1, 40):
        for b_ in range(1, 40):
            m = dedup.least_matches(a, b_, t)
            assert 2.0 * m / (a + b_) > t >= 2.0 * (m - 1) / (a + b_)


def test_near_pairs_equal_brute_force(msa):
    rows = list(dict.fromkeys(random_rows(50, 20, near=0.8)))
    got = {(r["i"], r["j"]) for r in dedup.near_duplicate_pairs(msa(rows), 0.85).collect()}
    assert got == {(i, j) for j in range(len(rows)) for i in range(j) if same(rows[i], rows[j]) > 0.85}


def test_clean_repeats(spark):
    given = ["AAAAAACDEFG", "AAAACDEFG", "GSGSGSXYZ", "AAAAA", "", "ACACACACDD-KKKKK"]
    df = spark.createDataFrame([(s,) for s in given], "seq string").select("seq", fn.clean_repeats(F.col("seq")).alias("c"))
    got = {r["seq"]: r["c"] for r in df.collect()}
    assert got == {
        "AAAAAACDEFG": "XXXXXXCDEFG", "AAAACDEFG": "AAAACDEFG", "GSGSGSXYZ": "XXXXXXXYZ", "AAAAA": "XXXXX", "": "",
        "ACACACACDD-KKKKK": "XXXXXXXXDD-XXXXX",
    }


def test_entropy(spark):
    df = spark.createDataFrame([("",), ("AAAAAA",), ("AC",), ("A-",)], "seq string")
    got = {r[0]: r[1] for r in df.select("seq", fn.sequence_entropy(F.col("seq"))).collect()}
    assert got == {"": 0.0, "AAAAAA": 0.0, "AC": 1.0, "A-": 0.5}


def test_hamming_needs_equal_lengths(spark):
    df = spark.createDataFrame([("AC", "ACD")], "a string, b string")
    with pytest.raises(Exception):
        df.select(fn.hamming_distance(F.col("a"), F.col("b"))).collect()


def test_filter_job(msa):
    base = "ACDEFGHIKLMNPQRSTVWY"
    rows = [base] * 10 + [base[:-1] + "A", "AAAA", "A" * 20]
    kept = filters.filter_rows(msa(rows), 20)
    assert picks(kept) == [0, 10]
    report = {r["step"]: (r["removed"], r["remaining"]) for r in filters.filter_report(msa(rows), 20).collect()}
    assert report == {"Clean Repeats": (0, 13), "Length Match": (1, 12), "Entropy Filter": (1, 11), "Deduplicate": (9, 2)}


def test_exact_length_counts(msa):
    df = msa(["AAAA", "AA", "BBBB", "AAAA", "CCCC"])
    c = filters.exact_length_counts(df, 4).collect()[0]
    assert (c["raw_count"], c["valid_count"], c["distinct_count"]) == (5, 4, 3)
    rows = filters.exact_length_rows(df, 4).orderBy("seq_idx").collect()
    assert [r["seq"] for r in rows] == ["AAAA", "BBBB", "CCCC"]


def test_row_numbers_over_small_buckets(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 7)], "msa_id string, seq_idx long")
    got = groups.row_numbers(df, ["msa_id"], F.floor(F.col("seq_idx") / 10), [F.col("seq_idx")], "at")
    assert sorted((r["seq_idx"], r["at"]) for r in got.where("msa_id = 'a'").collect()) == [(i * 3, i) for i in range(50)]


def brute_select(rows, n, strategy):
    chosen = [0]
    while len(chosen) < min(n, len(rows)):
        best, best_gain = None, -math.inf
        for i in range(len(rows)):
            if i in chosen:
                continue
            if strategy == "farthest_first":
                gain = min(1 - same(rows[i], rows[c]) for c in chosen)
            elif strategy == "max_coverage":
                gain = sum(x != "-" and all(rows[c][p] == "-" for c in chosen) for p, x in enumerate(rows[i]))
            else:
                gain = brute_neff([rows[c] for c in chosen] + [rows[i]])
            if round(gain, 10) > round(best_gain, 10):
                best, best_gain = i, gain
        chosen.append(best)
    return chosen


@pytest.mark.parametrize("strategy", ["farthest_first", "max_coverage", "neff_contribution"])
def test_selection_equals_brute_force(msa, strategy):
    rows = random_rows(25, 12, "ACD-", seed=3)
    expected = brute_select(rows, 6, strategy)
    for limit in (4096, 3):
        assert picks(select.select_subset(msa(rows), 6, strategy, max_group_rows=limit)) == expected


@pytest.mark.parametrize("strategy", ["farthest_first", "max_coverage", "neff_contribution"])
@pytest.mark.parametrize("pool", [3, 20])
def test_greedy_by_bounds(msa, monkeypatch, strategy, pool):
    """Small pools, many ties, alignments of unequal size: the picks of the packed form."""
    monkeypatch.setattr(select, "POOL", pool)
    df = msa(random_rows(60, 10, "AC-", seed=5), random_rows(9, 6, "ACD-", seed=6), random_rows(40, 14, "ACDEFGH-", seed=7, near=0.9))
    want = select.select_subset(df, 12, strategy)
    got = select.select_subset(df, 12, strategy, max_group_rows=2)
    for g in ("m0", "m1", "m2"):
        assert picks(got, g) == picks(want, g)


def test_safe_picks_take_several_at_a_time():
    rows = select.to_matrix(random_rows(3000, 30, "ACDEFGHIKLMNPQRSTVWY", seed=8, near=0.1))
    for rule in (select.Farthest, select.Depth):
        want = select.greedy_order(rule(), rows, 40)
        pool = rows[:1500]
        mine = rule()
        mine.start(rows, 1)
        mine.absorb(0)
        worst = mine.value(np.arange(1500, 3000)).max()
        found = select.safe_picks(rule(), pool, 1, 40, (float(worst), 1499))
        assert found == want[1 : 1 + len(found)] and len(found) > 3


@pytest.mark.parametrize("window", [None, 4])
def test_lowest_by_a_callers_measure(msa, spark, window):
    def measure(texts):
        return sum(a != b_ for a in texts for b_ in texts for a, b_ in zip(a, b_)) / 7

    groups = [random_rows(20, 8, "ACD", seed=2), random_rows(3, 5, "ACD", seed=3)]
    q = spark.createDataFrame([("m0", groups[0][4]), ("m1", groups[1][0])], "msa_id string, query string")
    want = select.lowest_neff(msa(*groups), q, 5, window=window, measure=measure)
    got = select.lowest_neff(msa(*groups), q, 5, window=window, measure=measure, max_group_rows=1)
    for g in ("m0", "m1"):
        assert picks(got, g) == picks(want, g)
    depth = {r["msa_id"]: r["neff"] for r in want.collect()}
    assert {r["msa_id"]: r["neff"] for r in got.collect()} == pytest.approx(depth)


@pytest.mark.parametrize("strategy", ["farthest_first", "random"])
def test_one_comparison_serves_all_levels(msa, monkeypatch, strategy):
    monkeypatch.setattr(select, "STEP", 5)
    ladder = [(2, 1), (4, 4), (30, 30), (4, 4)]
    df = msa(random_rows(25, 10, "ACD", seed=3) + ["A" * 10] * 3, random_rows(4, 6, "ACD", seed=4))
    got = {(r["msa_id"], r["max_seq"]): (r["n_rows"], r["neff"]) for r in select.neff_by_depth(df, ladder, strategy).collect()}
    ranked = select.select_subset(df, 60, strategy)
    for a, b_ in ladder:
        for r in neff.neff(ranked.where(F.col("rank") < a + b_)).collect():
            assert got[r["msa_id"], a] == (r["n_rows"], pytest.approx(r["neff"]))


@pytest.mark.parametrize("width, letters, kind", [(60, 22, np.uint8), (130, 3, np.uint8), (65, 40, np.uint32), (1, 1, np.uint8)])
def test_pair_matches_by_bit_planes(width, letters, kind):
    rng = np.random.default_rng(width)
    a, b_ = (rng.integers(60, 60 + letters, (n, width)).astype(kind) for n in (17, 9))
    assert (text.pair_matches(a, b_) == (a[:, None, :] == b_[None, :, :]).sum(axis=2)).all()


def test_selection_rules(msa, spark):
    rows = random_rows(10, 25, "ACDEFGHIKL", seed=4)
    df = msa(rows)
    for s in select.STRATEGIES:
        got = picks(select.select_subset(df, 5, s))
        assert got[0] == 0 and len(set(got)) == 5
        assert len(picks(select.select_subset(df, 50, s))) == 10
        assert picks(select.select_subset(df, 1, s)) == [0]
    outside = spark.createDataFrame([("m0", "W" * 25)], "msa_id string, query string")
    got = select.select_subset(df, 50, "farthest_first", outside)
    assert got.count() == 10 and picks(got)[0] == -1
    with pytest.raises(ValueError):
        select.select_subset(df, 5, "nope")


def test_column_entropy_selection(msa):
    rows = random_rows(12, 10, seed=5)
    n = len(rows)
    scores = [0.0] * n
    for c in range(10):
        col = [r[c] for r in rows]
        p = {x: col.count(x) / n for x in set(col)}
        h = -sum(v * math.log2(v + 1e-12) for v in p.values())
        for i in range(n):
            scores[i] += h / col.count(col[i]) if col.count(col[i]) < n else 0.0
    got = {r["seq_idx"]: r["score"] for r in columns.rarity_scores(msa(rows)).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(scores)


def test_lowest_neff(msa, spark):
    df = msa(["TTTT", "AAAT", "AAAC"])
    q = spark.createDataFrame([("m0", "AAAA")], "msa_id string, query string")
    for limit in (4096, 1):
        got = select.lowest_neff(df, q, 2, measure=lambda s: float(len(set(s))), max_group_rows=limit).orderBy("rank").collect()
        assert [r["seq"] for r in got] == ["AAAC", "AAAT"] and got[0]["neff"] == 3.0
    rows = random_rows(20, 10, seed=6)
    q = spark.createDataFrame([("m0", rows[0])], "msa_id string, query string")
    one = picks(select.lowest_neff(msa(rows), q, 5, window=4))
    assert one == picks(select.lowest_neff(msa(rows), q, 5, window=4, max_group_rows=2))


def test_coevolution_paths_agree(msa):
    rows = random_rows(30, 6, "ACDEFGHIKLMNPQRSTVWY-", seed=7, near=0.3)

    def direct():
        alpha = "ACDEFGHIKLMNPQRSTVWY-X"
        y = np.zeros((30, 6, 22))
        for i, r in enumerate(rows):
            for p, a in enumerate(r):
                y[i, p, alpha.index(a)] = 1
        c = np.cov(y.reshape(30, -1), rowvar=False)
        inv = np.linalg.inv(c + 4.5 / np.sqrt(30) * np.eye(len(c)))
        d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
        raw = np.sqrt(((inv / d).reshape(6, 22, 6, 22)[:, :20, :, :20] ** 2).sum(axis=(1, 3)))
        np.fill_diagonal(raw, 0)
        out = raw - np.outer(raw.mean(1), raw.mean(0)) / raw.mean()
        np.fill_diagonal(out, 0)
        return out

    expected = direct()
    for limit in (4096, 5):
        got = np.zeros((6, 6))
        for r in columns.coevolution(msa(rows), max_group_rows=limit).collect():
            got[r["i"], r["j"]] = r["score"]
        assert got == pytest.approx(expected, abs=1e-8)


@pytest.mark.parametrize("tile, n_rows, width", [(7, 40, 24), (3, 90, 10)])
def test_coevolution_of_many_tiles(msa, monkeypatch, tile, n_rows, width):
    """Strips that do not divide the width, several row blocks and rounds of adding, two alignments of unequal width."""
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 8)
    monkeypatch.setattr(tiles, "FAN_IN", 3)
    groups = [random_rows(n_rows, width, "ACDEFGHIKL-", seed=1), random_rows(12, 5, "ACD", seed=2)]
    got = columns.coevolution(msa(*groups), max_group_rows=1, task_columns=1).collect()
    for g, rows in enumerate(groups):
        want = columns._coevolution_from_rows(rows)
        found = np.full(want.shape, np.nan)
        for r in got:
            if r["msa_id"] == f"m{g}":
                found[r["i"], r["j"]] = r["score"]
        assert found == pytest.approx(want, abs=1e-10)


def test_tiled_inverse_holds(msa, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 4)
    shape = columns.alignment_shape(df := msa(random_rows(30, 11, "ACDEFGHIKL", seed=4)), ["msa_id"])
    sizes = shape.select("msa_id", "n_rows", F.col("max_len").cast("long").alias("width"))
    matrix = tiles.covariance_tiles(tiles.count_tiles(df, sizes, ["msa_id"]), ["msa_id"])
    inverse, _ = tiles.negative_inverse(matrix, ["msa_id"])
    assert tiles.probe_residuals(matrix, inverse, ["msa_id"]).first()["residual"] < 1e-10
    assert tiles.probe_residuals(matrix, matrix, ["msa_id"]).first()["residual"] > 1e-3


def test_wide_coevolution(msa):
    rows = random_rows(4, 600, "ACDEFGHIKL", seed=8)
    out = columns.coevolution(msa(rows))
    assert out.count() == 360_000
    assert out.where("i = j and score <> 0").count() == 0


def test_evolution_draws_from_all_matrices(spark, msa):
    names = [f"m{k:04d}" for k in range(1100)]
    table = spark.createDataFrame([(m, a, b, 1.0) for m in names for a in "AC" for b in "AC"], "matrix string, from_aa string, to_aa string, score double")
    df = spark.range(8000).select(F.lit("m").alias("msa_id"), F.col("id").alias("seq_idx"), F.lit("r").alias("label"), F.lit("ACAC").alias("seq"))
    used = {r["label"] for r in augment.evolve(df, table, {}, 1.0).select("label").distinct().collect()}
    assert len(used) > 1050 and used <= {f"r_evolved_{m}" for m in names}


def test_generation_settings_overwrite_the_cache_mode(spark):
    row = spark.sql("SELECT map('cache_implementation', 'old', 'top_k', '5') AS c, 'static' AS m")
    got = row.select(fn.generation_kwargs(F.col("c"), F.col("m")).alias("k")).collect()[0]["k"]
    assert got == {"cache_implementation": "static", "top_k": "5"}


def test_ragged_scan_equals_pairwise_ratios(msa):

    rows = [r[: 8 + i % 5] for i, r in enumerate(random_rows(60, 14, "ACD", seed=9, near=0.2))] + ["", "", "ACD"]
    kept = []
    for i, r in enumerate(rows):
        def close(k, r=r):
            if len(r) == len(rows[k]):
                return bool(r) and same(r, rows[k]) > 0.7
            return SequenceMatcher(None, r, rows[k]).ratio() > 0.7
        if not any(close(k) for k in kept):
            kept.append(i)
    assert picks(dedup.near_dedup(msa(rows), 0.7)) == kept


def test_mask(msa):
    rows = ["A" * 1000, "a-" + "A" * 998]
    df = msa(rows)
    assert augment.mask_rows(df, 0.0) is df
    full = {r["seq_idx"]: r["seq"] for r in augment.mask_rows(df, 1.0).collect()}
    assert full == {0: rows[0], 1: "a-" + "X" * 998}
    half = {r["seq_idx"]: r["seq"] for r in augment.mask_rows(df, 0.5).collect()}
    assert 400 < half[1].count("X") < 600 and half[0] == rows[0]
    with pytest.raises(ValueError):
        augment.mask_rows(df, 1.1)


def test_mutation_counts_and_probabilities(spark, msa):
    m = augment.grouped_matrix(spark, "g", ["AC", "D", "EFGHIKLMNPQRSTVWY"], 0.0, 0.0, 0.0)
    p = augment.substitution_probs(m)
    sums = p.groupBy("from_aa").agg(F.sum("prob").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["n"] == 20 and r["s"] == pytest.approx(1.0) for r in sums)
    away = augment.grouped_matrix(spark, "g", ["A", "C"], -50.0, 0.0, 0.0)
    df = msa(["AAAAAAAAAA-XAAAAAAAA"] * 3).withColumn("matrix", F.lit("g"))
    out = augment.mutate_rows(df, away, augment.percent_changes(F.lit(25.0)), ["msa_id", "seq_idx"]).collect()
    assert all(r["seq"].count("C") == 5 and r["seq"][10:12] == "-X" for r in out)


def test_evolve(spark, msa):
    m = augment.grouped_matrix(spark, "my mat", ["ACDEFGHIKLMNPQRSTVWY"])
    df = msa(random_rows(9, 30)).withColumn("label", F.concat(F.lit("r"), F.col("seq_idx")))
    out = augment.evolve(df, m, {"my mat": 40.0}, 0.5).collect()
    assert len(out) == 9 and sum(r["label"].endswith("_evolved_my_mat") for r in out) == 4


def test_sample_product(spark):
    rows = [("c", 0, i, "A" * (i + 1)) for i in range(3)] + [("c", 1, i, "X" * (i + 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "complex_id string, chain_idx long, row_idx long, seq string")
    whole = pairing.sample_product(df, 12).orderBy("draw").collect()
    assert [r["seq"] for r in whole] == ["A" * a + "X" * x for a in (1, 2, 3) for x in (1, 2, 3, 4)]
    for k in (2, 5):
        got = [r["seq"] for r in pairing.sample_product(df, k, 3).collect()]
        assert len(got) == 3 * k and all(s in {r["seq"] for r in whole} for s in got)
    one = df.where("chain_idx = 0")
    assert sorted(r["seq"] for r in pairing.paired_block(one).collect()) == ["A", "AA", "AAA"]
    want = spark.createDataFrame([("c", 3)], "complex_id string, n int")
    assert pairing.paired_block(df, n_chains=want).count() == 0


def test_paired_layout(spark):
    q = spark.createDataFrame([("h", "AAAA:BBBB"), ("o", "AAAA:AAAA")], "complex_id string, query string")
    c = spark.createDataFrame([("h", 0, "AAAABBBB"), ("o", 0, "AAAAAAAA")], "complex_id string, seq_idx long, seq string")
    out = pairing.paired_layout(q, c, c).orderBy("complex_id", "ord", "seq_idx").collect()
    h = [(r["label"], r["seq"]) for r in out if r["complex_id"] == "h"]
    o = [(r["label"], r["seq"]) for r in out if r["complex_id"] == "o"]
    assert h == [
        ("#4,4\t1,1", None), ("1\t2", "AAAABBBB"), ("concat_0\tconcat_0", "AAAABBBB"), ("paired_0\tpaired_0", "AAAABBBB"),
        ("chain0_query", "AAAA----"), ("chain1_query", "----BBBB"),
    ]
    assert o == [("#4\t2", None), ("query", "AAAA"), ("concat_0", "AAAAAAAA"), ("paired_0", "AAAAAAAA")]


def test_structure_metrics(spark):
    rng = np.random.default_rng(0)
    ref = rng.normal(size=(30, 3)) * 10
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    noisy = (ref + rng.normal(size=ref.shape)) @ turn.T + 5
    shapes = {"ref": ref, "same": ref, "moved": ref @ turn.T + 7, "noisy": noisy, "mirror": ref * [1, 1, -1], "short": ref[:20]}
    atoms = spark.createDataFrame(
        [(k, i, *map(float, p)) for k, v in shapes.items() for i, p in enumerate(v)], "structure_id string, pos int, x double, y double, z double"
    )
    pairs = spark.createDataFrame([(k, k, "ref") for k in shapes if k != "ref"], "pair_id string, pred_id string, ref_id string")
    got = {r["pair_id"]: (r["rmsd"], r["tm_score"]) for r in structure.structure_metrics(pairs, atoms).collect()}
    assert got["same"] == pytest.approx((0, 1), abs=1e-6) and got["moved"] == pytest.approx((0, 1), abs=1e-6)
    assert got["short"] == pytest.approx((0, 20 / 30), abs=1e-6)

    def direct(m):
        a, b = m - m.mean(0), ref - ref.mean(0)
        u, _, vt = np.linalg.svd(a.T @ b)
        r = vt.T @ np.diag([1, 1, np.linalg.det(vt.T @ u.T)]) @ u.T
        d2 = ((b - a @ r.T) ** 2).sum(1)
        d0 = 1.24 * 15 ** (1 / 3) - 1.8
        return np.sqrt(d2.mean()), (1 / (1 + d2 / max(d0, 0.5) ** 2)).sum() / 30

    for k in ("noisy", "mirror"):
        assert got[k] == pytest.approx(direct(shapes[k]), abs=1e-8)


def test_best_rows(spark):
    rows = [
        ("p", "slow", 8, 8, 2.0, 12.0, 80.0, 0.7), ("p", "best", 8, 8, 1.0, 9.0, 80.0, 0.7), ("p", "light", 8, 8, 3.0, 4.0, None, None),
        ("p", "short", 8, 7, 0.1, 1.0, 90.0, 0.9), ("p", "none", 8, 8, None, 1.0, 90.0, 0.9),
    ]
    df = spark.createDataFrame(
        rows, "protein_id string, strategy string, target_n int, selected_sequences int, neff double, peak_vram_gb double, mean_plddt double, tm_score double"
    )
    got = {r["objective"]: r["strategy"] for r in results.best_rows(df, 8.0, 75.0, 0.65).collect()}
    assert got == {"fixed_count_best": "best", "fold_aware_best": "best", "vram_aware_best": "light"}
    got = {r["objective"]: r["strategy"] for r in results.best_rows(df, 0.5, 99.0).collect()}
    assert got == {"fixed_count_best": "best"}


def test_vector_strategies_share_one_request_table(spark):
    """Noise, layered noise and walks in one table; foreign strategies, missing states and odd lengths give no rows."""
    states = spark.createDataFrame([(1, [float(i * 5 % 24) for i in range(24)]), (2, [0.5] * 5)], "query_id long, vector array<double>")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    wanted = {"encoder_perturb": {"noise_scales": [1e-9, 5.0], "num_return_sequences": 2}, "embedding_walk_full": {"noise_scales": [3.0], "num_return_sequences": 3}}
    wanted["embedding_walk_encoder"] = {"n_pca_components": 2, "step_sizes": [0.0, 40.0], "num_return_sequences": 2}
    asked = requests.strategy_requests(ids, "baseline", {"num_return_sequences": 4})
    for s, conf in wanted.items():
        asked = asked.unionByName(requests.strategy_requests(ids, s, conf))
    decode = vectors.window_decoder("acdefg")
    got = vectors.vector_candidates(asked, states, decode, F.lit(24), samples=6).collect()
    plain = states.where("query_id = 1").select(decode(F.col("vector")).alias("s")).first()["s"]
    by = {}
    for r in got:
        assert r["query_id"] == 1 and len(r["seq"]) == 24
        by.setdefault(r["strategy"], {})[r["request_no"]] = r["seq"]
    assert {s: len(x) for s, x in by.items()} == {"encoder_perturb": 4, "embedding_walk_full": 3, "embedding_walk_encoder": 8}
    assert by["encoder_perturb"][0] == by["encoder_perturb"][1] == plain and len(set(by["encoder_perturb"].values())) == 3
    assert len(set(by["embedding_walk_full"].values())) == 3
    walks = by["embedding_walk_encoder"]
    assert walks[0] == walks[1] == walks[4] == plain and walks[2] == walks[3] != plain and walks[6] != walks[2]


def test_token_strategies_change_a_template_once(spark):
    """Returns of a setting share a template; rates, seeds and variants give others; missing seeds and foreign strategies no rows."""
    ids = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id long, name string")
    conf = {
        "3di_perturb": {"n_3di_seeds": 2, "mutation_rates": [0.0, 0.5], "num_return_sequences": 3},
        "encoder_only_3di_sub": {"mutation_rates": [0.2], "variants_per_rate": 2, "num_return_sequences": 2},
        "temperature_sweep": {"temperatures": [0.5, 2.0], "num_return_sequences": 2},
        "cnn_aa_predict": {"n_3di_seeds": 2},
        "baseline": {"num_return_sequences": 2},
    }
    asked = requests.registered_requests(ids, list(conf), conf)
    seeds = spark.createDataFrame([(1, 0, "acde" * 10), (1, 1, "wyxx" * 10), (2, 0, ""), (3, 0, None)], "query_id long, seed_no int, tokens string")
    matrix = augment.grouped_matrix(spark, "m", ["acde", "wy"], 1.0, 1.0, -1.0)
    out = tokens.template_chunks(asked, seeds, matrix, conf)
    assert out.columns == ["query_id", "name", "strategy", "request_no", "params", "return_no", "chunk"]
    got = {}
    for r in out.collect():
        assert (r["name"] == "x") == (r["query_id"] == 1) and r["params"].get("return_no", 0.0) == r["return_no"]
        got.setdefault((r["query_id"], r["strategy"]), {})[r["request_no"]] = r["chunk"]
    plan = {(r["query_id"], r["strategy"], r["request_no"]): r["params"] for r in asked.collect()}
    for r in out.collect():
        assert plan[r["query_id"], r["strategy"], r["request_no"]] == r["params"]
    assert {k: len(v) for k, v in got.items() if k[0] == 1} == {(1, "3di_perturb"): 12, (1, "encoder_only_3di_sub"): 4, (1, "temperature_sweep"): 4, (1, "cnn_aa_predict"): 2}
    assert {s for q, s in got if q == 2} == set(conf) - {"baseline"} and all(c == "" for (q, _), v in got.items() if q == 2 for c in v.values())
    assert not any(q == 3 for q, _ in got)
    first, second = "acde" * 10, "wyxx" * 10
    perturbed = got[1, "3di_perturb"]
    assert [perturbed[i] for i in (0, 1, 2, 6, 7, 8)] == [first] * 3 + [second] * 3
    for at, plain, most in ((3, first, 20), (9, second, 10)):
        assert perturbed[at] == perturbed[at + 1] == perturbed[at + 2] != plain
        assert 0 < sum(a != b for a, b in zip(perturbed[at], plain)) <= most
    # Tokens that the matrix does not know, and those outside the alphabet, stay.
    assert all(c == "x" for i, c in enumerate(perturbed[9]) if i % 4 > 1)
    sub = got[1, "encoder_only_3di_sub"]
    assert sub[0] == sub[1] != sub[2] == sub[3]
    assert set(got[1, "temperature_sweep"].values()) == {first} and got[1, "cnn_aa_predict"] == {0: first, 1: second}
    with pytest.raises(ValueError):
        tokens.template_chunks(asked, seeds, matrix.unionByName(matrix.withColumn("matrix", F.lit("n"))), conf)


def test_each_strategy_meets_its_kernel(spark):
    """A failure stays with its request and its strategy; a strategy without a kernel, or null, is skipped; no rows give no rows."""
    rows = [(i, s, c) for i, (s, c) in enumerate([("up", "ab"), ("up", "bad"), ("back", "ab"), ("back", "bad"), ("none", "x"), (None, "y"), ("big", "z"), ("up", "c")])]
    df = spark.createDataFrame(rows, "id int, strategy string, chunk string")

    def up(pdf):
        if (pdf["chunk"] == "bad").any():
            raise ValueError("cannot")
        return pdf.assign(seq=pdf["chunk"].str.upper())

    def big(pdf):
        raise MemoryError("out of memory")

    kernels = {"up": up, "back": lambda pdf: pdf.assign(seq=pdf["chunk"].str[::-1]), "big": big}
    got = {r["id"]: (r["seq"], r["status"], r["error"]) for r in generate.run_strategies(df, kernels).collect()}
    assert got == {
        0: ("AB", "ok", ""), 1: (None, "skipped", "cannot"), 2: ("ba", "ok", ""), 3: ("dab", "ok", ""), 4: (None, "skipped", "no kernel for strategy 'none'"),
        5: (None, "skipped", "no kernel for strategy None"), 6: (None, "oom", "out of memory"), 7: ("C", "ok", ""),
    }
    assert generate.run_strategies(df.where("id < 0"), kernels).count() == 0


def test_sampled_products_of_many_chains(spark):
    """The product of the sizes passes 64 bits; the exploded draws are never broadcast."""
    rows = spark.range(40 * 64).select(
        F.lit(1).alias("complex_id"), (F.col("id") % 40).cast("int").alias("chain_idx"), F.floor(F.col("id") / 40).alias("row_idx"),
        F.format_string("%02d", F.floor(F.col("id") / 40)).alias("seq"),
    )
    out = pairing.sample_product(rows, 30, 3)
    got = out.collect()
    assert len(got) == 90 and {len(r.seq) for r in got} == {80}
    assert len({(r.subset_id, r.seq) for r in got}) == 90
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_subsets_of_packed_and_joined_complexes(spark):
    """Complexes that a task holds and larger ones give the same draws, depths and paired rows."""
    rows = spark.createDataFrame(
        [(x, c, i, s) for x in range(3) for c in range(3) for i, s in enumerate(random_rows(4 + x, 10, seed=7 * x + c))],
        "complex_id long, chain_idx int, row_idx long, seq string",
    )
    few = {tuple(r) for r in pairing.sample_product(rows, 6, 4).collect()}
    assert few == {tuple(r) for r in pairing.sample_product(rows, 6, 4, max_group_rows=1).collect()}
    assert len(few) == 72
    only = spark.createDataFrame([(1, 2)], "complex_id long, subset_id int")
    for limit in (1, 4096):
        got = {tuple(r) for r in pairing.sample_product(rows, 6, 4, only=only, max_group_rows=limit).collect()}
        assert got == {t for t in few if t[:2] == (1, 2)}
    depths = [
        sorted((r.complex_id, r.subset_id, r.n_rows, round(r.neff, 9)) for r in pairing.subset_depths(rows, 4, 6, 0.5, max_group_rows=limit).collect())
        for limit in (1, 4096)
    ]
    assert depths[0] == depths[1] and len(depths[0]) == 12


def test_frames_of_a_failing_batch_are_put_together_once(monkeypatch):
    """Order, rows and messages as with halves put together one by one, in few frames however many requests fail."""
    import pandas as pd

    def model(part):
        if (part["chunk"] % 5 == 0).any():
            raise ValueError("no fives")
        if (part["chunk"] % 7 == 0).any():
            raise MemoryError("out of memory")
        return part.assign(seq=part["chunk"].astype(str))

    part = pd.DataFrame({"chunk": range(1, 201)})
    joined, concat = [], pd.concat
    monkeypatch.setattr(generate.pd, "concat", lambda frames, *a, **k: joined.append(1) or concat(frames, *a, **k))
    got = generate._safely(model, part, ["chunk", "seq", "status", "error"])
    assert len(joined) <= 2
    assert got["chunk"].tolist() == list(range(1, 201))
    want = ["skipped" if i % 5 == 0 else "oom" if i % 7 == 0 else "ok" for i in range(1, 201)]
    assert got["status"].tolist() == want
    assert [e == "" for e in got["error"]] == [w == "ok" for w in want]
    lost = generate._safely(lambda x: x, part, ["chunk", "seq", "status", "error"])
    assert set(lost["status"]) == {"skipped"} and len(lost) == 200
