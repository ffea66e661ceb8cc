"""Readers, writers, jobs and streams on small files."""

import os

import pytest
from pyspark.sql import functions as F

from seqloom.operators.augment import grouped_matrix
from seqloom.plans import generate, jobs, requests
from seqloom.sources import fasta, sinks, structures
from seqloom.streaming import streams


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_fasta_reading(spark, tmp_path):
    put(tmp_path / "a.fasta", ">s1 first one\nACD\nEF\n>s2\nGH\n")
    put(tmp_path / "b.fa", ">s3\nKL")
    put(tmp_path / "sub" / "c.fasta", "# note\n>s4\r\nMN\r\n")
    put(tmp_path / "d.txt", ">no\nA\n")
    flat = fasta.read_fasta(spark, str(tmp_path)).orderBy("path", "file_pos").collect()
    assert [(r["query_id"], r["seq"], r["file_pos"]) for r in flat] == [("s1", "ACDEF", 0), ("s2", "GH", 1), ("s3", "KL", 0)]
    deep = {r["query_id"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path), True).collect()}
    assert deep == {"s1": "ACDEF", "s2": "GH", "s3": "KL", "s4": "MN"}
    large = fasta.read_large_fasta(spark, str(tmp_path), True)
    assert {(r["query_id"], r["seq"], r["file_pos"]) for r in large.collect()} == {
        ("s1", "ACDEF", 0), ("s2", "GH", 1), ("s3", "KL", 0), ("s4", "MN", 0)
    }
    assert [os.path.basename(r["path"]) for r in fasta.fasta_paths(spark, str(tmp_path)).collect()] == ["a.fasta", "b.fa"]
    with pytest.raises(FileNotFoundError):
        fasta.fasta_paths(spark, str(put(tmp_path / "none" / "x.txt", "").parent))


def test_a3m_and_project(spark, tmp_path):
    put(tmp_path / "msa" / "p1" / "p1.a3m", ">q\nACde-FG\n>r\nAC-\nFG\n")
    put(tmp_path / "msa" / "p2" / "p2.a3m", "#4,4\t1,1\n>1\t2\nACDEACDE\n")
    rows = fasta.read_project(spark, str(tmp_path)).orderBy("msa_id", "seq_idx").collect()
    assert [(r["msa_id"], r["seq"]) for r in rows] == [("p1", "AC-FG"), ("p1", "AC-FG"), ("p2", "ACDEACDE")]
    info = {r["is_paired"]: r["info"] for r in fasta.paired_files(spark, f"{tmp_path}/msa/*/*.a3m", None).collect()}
    assert info == {False: None, True: "#4,4\t1,1"}
    out = str(tmp_path / "report")
    assert jobs.neff_job(spark, str(tmp_path), out).count() == 0
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert "pdb,NAD" in text and "p1,0.45" in text and "p2,0.35" in text


def test_scores_structures_and_artefacts(spark, tmp_path):
    d = tmp_path / "preds" / "p__s"
    put(d / "p_scores_rank_001_b.json", '{"ptm": 0.1}')
    put(d / "p_scores_rank_001_a.json", '{"ptm": 0.87,\n "plddt": [85.0, 90.0, 78.0, 92.0], "max_pae": 5.2}')
    put(d / "p_unrelaxed_rank_001_a.pdb", "x")
    put(d / "p_relaxed_rank_001_z.pdb", "x")
    put(d / "p_unrelaxed_rank_002.r3.pdb", "x")
    put(d / "p.done.txt", "x")
    r = structures.read_best_scores(spark, str(tmp_path / "preds")).collect()[0]
    assert (r["prediction"], r["ptm"], r["mean_plddt"], r["max_pae"]) == ("p__s", 0.87, 86.25, 5.2)
    assert r["best_pdb"].endswith("p_relaxed_rank_001_z.pdb")
    kinds = {x["name"]: x["kind"] for x in structures.artefact_catalogue(spark, str(tmp_path / "preds")).collect()}
    assert kinds["p_unrelaxed_rank_002.r3.pdb"] == "recycles" and kinds["p.done.txt"] == "drop"
    assert kinds["p_relaxed_rank_001_z.pdb"] == "best" and kinds["p_scores_rank_001_b.json"] == "scores"


def test_pdb(spark, tmp_path):
    def atom(name, res, num, x, alt=" "):
        return f"ATOM  {num:5d} {name:^4}{alt}{res} A{num:4d}    {x:8.3f}{0.0:8.3f}{-1.5:8.3f}  1.00  0.00"

    lines = [atom("N", "ALA", 1, 9), atom("CA", "ALA", 1, 1), atom("CA", "GLY", 2, 2, "A"), atom("CA", "GLY", 2, 3, "B"), atom("CA", "HOH", 3, 4)]
    put(tmp_path / "x.pdb", "\n".join(["HEADER", *lines, "ENDMDL", atom("CA", "ALA", 4, 5)]) + "\n")
    rows = structures.read_pdb(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["structure_id"], r["pos"], r["x"], r["z"]) for r in rows] == [("x", 0, 1.0, -1.5), ("x", 1, 2.0, -1.5)]


def test_matrix_reader(spark, tmp_path):
    put(tmp_path / "tiny.txt", "# comment\n   A  C\nA  4 -1\nC -1  9\n")
    rows = structures.read_matrix(spark, str(tmp_path / "tiny.txt")).collect()
    assert {(r["matrix"], r["from_aa"], r["to_aa"], r["score"]) for r in rows} == {
        ("tiny", "A", "A", 4.0), ("tiny", "A", "C", -1.0), ("tiny", "C", "A", -1.0), ("tiny", "C", "C", 9.0)
    }


def test_subsample_and_mask_jobs(spark, tmp_path):
    put(tmp_path / "in" / "p" / "p.a3m", "".join(f">s{i}\n{s}\n" for i, s in enumerate(["ACDEF", "ACDEG", "KLMNP", "KLMNQ"])))
    pattern = f"{tmp_path}/in/p"
    report = jobs.subsample_job(spark, pattern, str(tmp_path / "out"), 2).collect()[0]
    assert (report["n_before"], report["n_after"]) == (4, 2)
    folder = tmp_path / "out" / "msa_id=p"
    text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    assert text == ">query\nACDEF\n>seq_1\nKLMNP\n"
    jobs.mask_job(spark, pattern, str(tmp_path / "masked"), 1.0)
    folder = tmp_path / "masked" / "msa_id=p"
    text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part"))
    assert text == ">s0\nACDEF\n>s1\nXXXXX\n>s2\nXXXXX\n>s3\nXXXXX\n"


def _mutator(spark):
    matrix = grouped_matrix(spark, "g", ["ACDEFGHIKLMNPQRSTVWY"], 1.0, 0.5)

    def run(r):
        marked = r.withColumn("matrix", F.lit("g"))
        return generate.mutation_candidates(marked, matrix, F.lit(40.0), ["query_id", "run_idx", "seq_idx"])

    return matrix, run


def test_build_alignments(spark):
    matrix, run = _mutator(spark)
    q = spark.createDataFrame([("q1", "ACDEFGHIKLMNPQRSTVWY" * 2)], "query_id string, seq string")
    raw = jobs.candidate_alignments(q, run, n_runs=2)
    assert raw.count() == 2 * 151
    rows = jobs.build_alignments(q, run, matrix, {"g": 10.0}, 0.5).collect()
    by_kind = [sum(r["kind"] == k for r in rows) for k in (0, 1)]
    assert by_kind[0] == by_kind[1] > 10
    assert sorted(r["seq_idx"] for r in rows) == list(range(len(rows)))


def test_build_complexes(spark):
    matrix, run = _mutator(spark)
    q = spark.createDataFrame([("c", "ACDEFGHIKLMNPQRSTVWY:YWVTSRQPNMLKIHGFEDCA")], "complex_id string, query string")
    rows = jobs.build_complexes(q, run, n_subsets=2, subset_size=10, top_k=1, params={"base": {"top_p": 0.9}}).collect()
    kinds = {r["row_kind"] for r in rows}
    assert kinds == {"info", "query", "concat", "paired", "chain_query"}
    assert {len(r["seq"]) for r in rows if r["seq"]} == {40}
    concat = jobs.build_complexes(q, run, mode="concat", params={"base": {"top_p": 0.9}}).collect()
    assert "paired" not in {r["row_kind"] for r in concat}


def test_grids(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert requests.with_decoding_grid(df, {}).count() == 0
    assert requests.with_decoding_grid(df, {"base": {"a": 1.0}}).count() == 1
    assert requests.temperature_variants(df, F.array(F.lit(None).cast("string"), F.lit("static"))).count() == 104


def test_streams(spark, tmp_path):
    put(tmp_path / "in" / "p1" / "a.a3m", ">q\nACDEF\n>r\nACDEF\n")
    for step in (1, 2):
        streams.stream_neff(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(rows) == step and all(r["neff"] == pytest.approx(5**-0.5) for r in rows)
        put(tmp_path / "in" / "p2" / "b.a3m", ">q\nACDEF\n")
    lines = spark.createDataFrame([("x job_a_seed_001 took 12.5s",), ("noise",), ("job_a_seed_2 took 7.5s",)], "value string")
    r = streams.progress(lines, 4).collect()[0]
    assert (r["job"], r["n_done"], r["mean_seconds"], r["share"]) == ("job_a", 2, 10.0, 0.5)


def test_stored_depths(spark):
    """Stored alignments against the depths recorded beside them, where a folder of such is named."""
    base = os.environ.get("STORED_ALIGNMENTS", "")
    if not os.path.isdir(base):
        pytest.skip("no stored alignments")
    from seqloom.operators.neff import neff

    rows = fasta.read_a3m(spark, f"{base}/*/*/msa/*/*.a3m", None, raw=True)
    keyed = rows.withColumn("job", F.regexp_extract("path", "([^/]*/[^/]*)/msa/", 1))
    got = {r["job"]: (r["n_rows"] - 1, r["neff"]) for r in neff(keyed, key=["job"]).collect()}
    table = spark.read.option("header", "true").csv(f"{base}/results.csv").collect()
    assert len(table) == 24
    for r in table:
        n, value = got[f"{r['protein_id']}/{r['strategy']}"]
        assert n == int(r["n_sequences"])
        assert (round(value, 4) if n else 0.0) == pytest.approx(float(r["neff"]), abs=1e-9)


def test_entry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    from seqloom.catalog import registry

    assert set(registry.QUERIES) <= set(entry.queries())


def test_benchmark_folder_and_strategy_job(spark, tmp_path):
    put(tmp_path / "fasta" / "p1.fasta", ">x\nACDEFGHIKL\n>y\nAC\n")
    put(tmp_path / "fasta" / "p2.fasta", ">z\nMNPQRSTVWY\n")
    put(tmp_path / "pdb" / "p1.pdb", "END\n")
    found = fasta.benchmark_queries(spark, str(tmp_path))
    refs = {r["protein_id"]: (r["seq"], r["ref_pdb"]) for r in fasta.with_reference_pdb(found, str(tmp_path)).collect()}
    assert refs["p1"][0] == "ACDEFGHIKL" and refs["p1"][1].endswith("/pdb/p1.pdb") and refs["p2"] == ("MNPQRSTVWY", None)
    proteins = found.withColumnRenamed("seq", "query")
    scores = spark.createDataFrame([("p1", "round_trip", 0.5)], "protein_id string, strategy string, ptm double")

    def generate_rows(wanted):
        return wanted.withColumn("seq", F.when(F.col("request_no") % 2 == 0, F.col("query")).otherwise(F.lit("AC")))

    table, summary = jobs.strategy_job(proteins, generate_rows, ["round_trip", "single_sequence", "nope"], 10, scores, out_path=str(tmp_path / "out"))
    assert {r["variant_param"] for r in table.collect()} == {"rounds=9,seeds=16", ""}
    assert os.path.isdir(tmp_path / "out" / "msa") and os.path.isdir(tmp_path / "out" / "results")
    got = {(r["protein_id"], r["strategy"]): (r["n_sequences"], r["neff"], r["ptm"]) for r in table.collect()}
    one = round(10**-0.5, 4)
    assert got == {
        ("p1", "round_trip"): (10, one, 0.5), ("p2", "round_trip"): (10, one, None),
        ("p1", "single_sequence"): (0, 0.0, None), ("p2", "single_sequence"): (0, 0.0, None),
    }
    shown = {r["strategy"]: (r["neff"], r["ptm"]) for r in summary.collect()}
    assert shown == {"round_trip": ("0.316", "0.500"), "single_sequence": ("0.000", "—")}


def test_ids_with_one_safe_name_keep_apart(spark, tmp_path):
    rows = [(i, k, "x", f"{'AC' if i == 'a/b' else 'DE'}") for i in ("a/b", "a_b", "c") for k in range(2)]
    sinks.write_records(spark.createDataFrame(rows, "msa_id string, seq_idx long, label string, seq string"), str(tmp_path / "out"))
    folders = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("msa_id="))
    assert len(folders) == 3 and folders[0] == "msa_id=a_b" and folders[2] == "msa_id=c"
    texts = {f: "".join((tmp_path / "out" / f / x).read_text() for x in os.listdir(tmp_path / "out" / f) if x.startswith("part")) for f in folders}
    assert texts["msa_id=a_b"] == ">x\nAC\n" * 2 and texts[folders[1]] == ">x\nDE\n" * 2


def test_named_files(spark, tmp_path):
    """A file per key under the key's name, lines in order; two keys of one name are refused, and so is a name that exists."""
    df = spark.createDataFrame([("p1", 1, "B"), ("p1", 0, "A"), ("q/2", 0, "C")], "id string, at int, value string")
    sinks.write_named(df, str(tmp_path / "out"), "id", ".fasta", "at")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"p1.fasta": "A\nB\n", "q_2.fasta": "C\n"}
    with pytest.raises(ValueError):
        sinks.write_named(df.unionByName(df.withColumn("id", F.replace("id", F.lit("/"), F.lit("_")))), str(tmp_path / "two"), "id", ".fasta", "at")
    with pytest.raises(FileExistsError):
        sinks.write_named(df, str(tmp_path / "out"), "id", ".fasta", "at")


def test_sink_labels(spark, tmp_path):
    df = spark.createDataFrame([("m", 0, None, "AC"), ("m", 1, "own", "AD")], "msa_id string, seq_idx long, label string, seq string")
    sinks.append_records(df, str(tmp_path / "out"))
    sinks.append_records(df.where("seq_idx = 1"), str(tmp_path / "out"))
    folder = tmp_path / "out" / "msa_id=m"
    text = sorted((folder / f).read_text() for f in os.listdir(folder) if f.startswith("part"))
    assert text == [">appended_seq_0\nAC\n>own\nAD\n", ">own\nAD\n"]
    assert [r["label"] for r in sinks.folder_headers(df).orderBy("seq_idx").collect()] == ["m", "own"]
    sinks.write_csv(df, str(tmp_path / "csv"), ["seq", "missing"])
    lines = [x for f in os.listdir(tmp_path / "csv") if f.endswith(".csv") for x in (tmp_path / "csv" / f).read_text().splitlines()]
    assert sorted(set(lines)) == ["AC,", "AD,", "seq,missing"]


def test_equal_folder_names_stay_apart(spark, tmp_path):
    for top, ptm in (("runA", 0.25), ("runB", 0.75)):
        put(tmp_path / top / "x" / "a_scores_rank_001.json", '{"ptm": %s, "plddt": [50.0]}' % ptm)
        put(tmp_path / top / "x" / "a_relaxed_rank_001.pdb", "END\n")
    got = structures.read_best_scores(spark, str(tmp_path)).collect()
    assert sorted((r["prediction"], r["ptm"]) for r in got) == [("x", 0.25), ("x", 0.75)]
    assert all(f"/{'runA' if r['ptm'] < 0.5 else 'runB'}/x/" in r["best_pdb"] for r in got)


def test_files_of_one_folder_are_alignments_of_their_own(spark, tmp_path):
    for name in ("a", "b"):
        put(tmp_path / "msa" / "p1" / f"{name}.a3m", ">q\nACDE\n>r\nACDE\n")
    jobs.neff_job(spark, str(tmp_path), str(tmp_path / "report"))
    report = spark.read.option("header", "true").csv(str(tmp_path / "report")).collect()
    assert [(r["pdb"], r["NAD"]) for r in report] == [("p1", "0.50"), ("p1", "0.50")]
    jobs.mask_job(spark, f"{tmp_path}/msa/*", str(tmp_path / "masked"), 0.0)
    assert len([f for f in os.listdir(tmp_path / "masked") if f.startswith("msa_id=")]) == 2


def test_sweep_keeps_status_and_all_candidates(spark, tmp_path):
    ids = "protein_id string, strategy string, variant_param string, cache_implementation string"
    work = spark.createDataFrame([("p", "s", "v", None, "ACDE"), ("p", "s", "w", "static", "ACDE")], f"{ids}, query string")
    rows = [("p", "s", "v", None, i, "ACD" + "EFGH"[i % 4], "ok", "") for i in range(9)]
    rows += [("p", "s", "v", None, 9, None, "skipped", "bad input"), ("p", "s", "w", "static", 0, None, "oom", "out of memory"), ("p", "s", "w", "static", 1, None, "skipped", "z")]
    made = spark.createDataFrame(rows, f"{ids}, seq_idx long, seq string, status string, error string")
    table, best = jobs.sweep_files_job(made, work, str(tmp_path / "out"), 2, 4)
    got = {r["variant_param"]: (r["raw_candidates"], r["selected_sequences"], r["status"], r["error"]) for r in table.collect()}
    assert got == {"v": (9, 2, "skipped", "bad input"), "w": (0, 0, "oom", "out of memory")}
    assert best.collect() == [] and len([f for f in os.listdir(tmp_path / "out" / "msa") if f.startswith("msa_id=")]) == 1
