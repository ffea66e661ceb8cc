"""Near-duplicates, neighbours, languages, pages and the pipeline on small inputs."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import language, minhash, neighbours, pages
from seqloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, batch int"


def words(seed, n):
    return [f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n)]


def near_rows():
    rows, base = [], words(1, 200)
    rows.append((5, " ".join(base)))
    # Copies that differ from the base in one word each: like the base, less like each other.
    for k in range(60):
        other = list(base)
        other[3 * k + 10] = f"x{k}"
        if k % 2:
            other[(3 * k + 110) % 200] = f"y{k}"
        rows.append((100 + k, " ".join(other)))
    rows += [(400 + k, " ".join(words(1, 200 - 12 * k))) for k in range(6)]
    rows += [(500, "Alpha beta"), (501, "alpha BETA"), (502, ""), (503, None), (504, " \n"), (505, "gamma"), (None, "gamma"), (None, "only here"), (505, "gamma")]
    rows += [(600 + k, " ".join(words(50 + k, 80))) for k in range(20)]
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    table = spark.createDataFrame([(i, t, None, None, None, "z", 1) for i, t in rows], SCHEMA)
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for a in range(len(rows)):
        if rows[a][0] is not None:
            members[find(a)].append(rows[a][0])
    want = collections.Counter()
    for a, (i, _) in enumerate(rows):
        least = min(members[find(a)], default=None)
        want[i, len(sets[a]), least, i == least if least is not None else True] += 1
    got = collections.Counter(map(tuple, minhash.near_duplicates(table).collect()))
    assert got == want


def test_head_is_sent_once_per_batch(spark):
    base = words(1, 200)
    rows = [(0, " ".join(base))] + [(k, " ".join(base[: 200 - k])) for k in range(1, 100)]
    texts = spark.createDataFrame([(i, t) for i, t in rows], "node long, text string").select(minhash._home("node", 3).alias("batch"), "node", "text")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 100)] + [(5, k) for k in range(6, 60)], "a long, b long")
    # However many partners a node has, its batch is asked once for each batch that holds some.
    assert minhash._sendings(pairs, 3).groupBy("a").count().agg({"count": "max"}).first()[0] == 3
    got = {tuple(r) for r in minhash._confirmed(pairs, texts, 3, 85).collect()}
    assert got == {(a, b) for a, b in map(tuple, pairs.collect()) if 100 * (196 - b) >= 85 * (196 - a)}


def test_bucket_blocks_lose_no_member(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    same, far = [0] * 5, [2**62 - 1] * 5
    rows = [(1, 50, i, i % 3, same if i % 5 else far, [1] * 24) for i in range(50)] + [(2, 3, 100 + i, i, [i * 7919**4] * 5, [2] * 24) for i in range(3)]
    rows += [(3, 4, 200 + i, i, same, [9 + (i < 2), 3] + [i] * 22) for i in range(4)]
    members = spark.createDataFrame(rows, "key long, n long, node long, component long, bits array<long>, bands array<long>")
    got = {r["node"] for r in minhash._open_members(members, 140).collect()}
    # Of bucket 3 the pairs that share an earlier bucket are left to that one.
    assert got == {*range(50), *range(200, 204)}


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 50, 4000, 6000, 6000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.shared_counts(sets)
    assert all(got[i][j] == want[i][j] for i in range(6) for j in range(i + 1, 6))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 7000), (7000, 101), (300, 301)]
    found = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 7000: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert language.identify_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pages.extract_articles(spark.createDataFrame([], "page_id long, url string, html string"), ["page_id"]).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, none.vec_id % 50 == 0).collect() == []


def brute(rows, k):
    good = [(i, np.array(x, np.float64)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    out = {}
    for i, q in {i: x for i, x in good if i % 50 == 0}.items():
        near = sorted((-float((q * x).sum() / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum()))), j) for j, x in good if j != i)
        out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_neighbours_small_and_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(120)]
    rows[3] = (3, None)
    rows[4] = (4, [0.0] * 8)
    rows[5] = (5, [1.0, None] + [0.0] * 6)
    rows[6] = (6, [float("inf")] + [1.0] * 7)
    rows += [(200 + i, rows[10][1]) for i in range(9)] + [(None, rows[10][1]), (100, rows[100][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, table.vec_id % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(rows, 5)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_neighbour_recall(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(10, 32))
    x = (0.4 * centre[rng.integers(0, 10, 6000)] + rng.normal(size=(6000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table, table.vec_id % 50 == 0, sample=2048).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute(rows, 5)
    assert np.mean([len(got[q] & {j for j, _ in v}) / 5 for q, v in want.items()]) >= 0.9


def test_short_queries_are_asked_everywhere(spark):
    """One probed part holds fewer than k vectors: the others are searched too."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)).astype(np.float32))]
    table = spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], "vec_id long, embedding array<float>, part int, rank int, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table, table.vec_id % 50 == 0, k=300, recall=0.01).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {q: [j for j, _ in near] for q, near in brute(rows, 300).items()}


def test_routing_prunes_where_there_is_structure():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 24))
    x = neighbours.unit(centre[rng.integers(0, 60, 12_000)] + 0.3 * rng.normal(size=(12_000, 24)))
    router = neighbours.fit_router(x[:4096], 64, 0.95)
    p = router.probabilities(x)
    part, queries = p.argmax(1), np.arange(4096, 12_000, 40)
    probes = np.argsort(-p[queries], axis=1)[:, : router.probes]
    scored = np.bincount(part, minlength=64)[probes].sum(1).mean() / len(x)
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -1
    true = np.argsort(-near, axis=1)[:, :5]
    recall = (part[true][:, :, None] == probes[:, None, :]).any(2).mean()
    print(f"recall {recall:.3f}, rows scored {scored:.3f}")
    assert recall >= 0.9 and scored < 0.1


def test_filters_hold_all_their_grams():
    rng = np.random.default_rng(1)
    grams = {name: rng.integers(0, 2**63, 5000).astype(np.uint64) for name in "abc"}
    filters = language.build_filters(grams)
    for i, name in enumerate("abc"):
        assert ((filters.masks(grams[name])[:, 0] >> np.uint64(i)) & np.uint64(1)).all()
    other = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    hit = filters.shares(other, np.array([0, len(other)]))
    assert (hit < 0.001).all()


def test_languages(spark):
    syllables = {"xa": ["thor", "ing", "and", "er"], "xb": ["sch", "ung", "ein", "keit"], "xc": ["ción", "que", "ado", "los"]}
    rng, rows = np.random.default_rng(2), []
    for i in range(300):
        lang = ["xa", "xb", "xc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(30)), lang, None, None, "q", 1))
    rows += [(900, None, "xa", None, None, "q", 1), (901, "123 .!", "xa", None, None, "q", 1), (902, "schung", None, None, None, "q", 1), (None, "thoring", "xa", None, None, "q", 1)]
    got = {r["doc_id"]: r for r in language.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == ["xa", "xb", "xc"][i % 3] for i in range(300))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert got[902]["lang_pred"] == "xb" and got[None]["lang_pred"] == "xa" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_sample(spark):
    from pyspark.sql import functions as F

    # Many copies of some keys, so that several rows share a last hash.
    rows = [(i if i % 7 else i // 70, "abc"[i * i % 4 % 3], "x" * (i % 50)) for i in range(3000)] + [(i, "few", f"y{i}") for i in range(9)]
    table = spark.createDataFrame(rows, "key long, lang string, text string").select("lang", "text", F.xxhash64("key").alias("h"))
    for n in (1, 10, 333, 2000):
        want = collections.Counter()
        for lang in ("a", "b", "c", "few"):
            mine = sorted((r["h"], len(r["text"]), r["text"]) for r in table.collect() if r["lang"] == lang)
            want.update((lang, t) for _, _, t in mine[:n])
        assert collections.Counter(map(tuple, language.least_hashed(table, n).collect())) == want


def test_languages_read_two_thousand_texts(spark):
    letters = "abcdefghijklmnopqrst"
    # Each text has n-grams of its own.
    texts = ["".join(letters[k // 20**j % 20] for j in (2, 1, 0)) + "zz" for k in range(1900)]
    filters = language.learn_filters(spark.createDataFrame([(k, t, "xa") for k, t in enumerate(texts)], "key long, text string, lang string"))
    grams, first = language.text_grams(texts)
    assert (filters.shares(grams, first)[:, 0] > 0.99).all()


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Top &amp; title</h1><p>First <b>bo</b>ld\n text.<p>Second.<br>line</article><footer>f</footer>", "Top & title First bold text. Second. line"),
    (
        '<div id="header">Site</div><div class="content"><h2>Title</h2><p>' + "Long text of some words. " * 8 + '</p><p>Short end.</p></div><div class="comments"><p>'
        + "I like this very much. " * 9 + '</p></div><aside>More</aside><form><input><p>Write to us</p></form><div class="cookie-notice">We use them</div>',
        "Title " + "Long text of some words. " * 8 + "Short end.",
    ),
    (
        '<div class="wrap has-sidebar"><div class="page-header">Site</div><div class="post"><div class="post-header"><h1>Own title</h1></div><p>' + "Some text of the post. " * 6
        + '</p></div><div class="sidebar"><p>' + "Other things to read here. " * 9 + "</p></div></div>",
        "Own title " + "Some text of the post. " * 6,
    ),
    ("", ""),
    (None, ""),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style>", ""),
    ("<p>a &lt; b<!-- no --> 3 < 4", "a < b 3 < 4"),
    ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>" + "Here is the text itself, without links. " * 5, "Here is the text itself, without links. " * 5),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_pages(source, text):
    assert pages.main_text(source).split() == text.split()


TEXT = "Here is the text itself, without links. " * 5
WRAPPED = [
    # A form around the page: only its controls go.
    (f'<form id="aspnetForm"><nav><a href=1>One</a></nav><div><h1>Title</h1><p>{TEXT}</p></div><input><button>Send</button><select><option>x</select></form>', f"Title {TEXT}"),
    (f'<p>Site</p><form id="aspnetForm"><div class="sidebar">Other things</div><main><p>{TEXT}</p></main><label>Search</label></form>', TEXT),
    # Wrappers whose names only speak of a box.
    *((f'<div class="{name}"><article><p>{TEXT}</p></article><div class="sidebar">Other things</div></div>', TEXT) for name in ("content-sidebar-wrap", "layout-with-sidebar", "main-content sidebar-right")),
    *((f'<div class="site-header">Site</div><div class="{name}"><div><p>{TEXT}</p></div><div class="sidebar">Other things</div></div>', TEXT) for name in ("content-sidebar-wrap", "layout-with-sidebar")),
    ("".join(f'<div class="elementor-widget elementor-widget-{k}"><div class="elementor-widget-container">{x}</div></div>' for k, x in (("nav-menu", "Menu"), ("heading", "<h1>Title</h1>"), ("text-editor", f"<p>{TEXT}</p>"), ("text-editor", f"<p>{TEXT}</p>"))), f"Title {TEXT} {TEXT}"),
    # What is no wrapper stays dropped, longer or not.
    (f'<div><p>{TEXT}</p></div><div class="comments-area"><article class="comment-body"><p>{"I like this. " * 200}</p></article></div><form><p>Write to us</p></form>', TEXT),
    (f'<article><p>{TEXT}</p></article><div class="footer-widgets"><p>{"We sell many things. " * 50}</p></div>', TEXT),
    (f'<main><p>{TEXT}</p><div class="related"><article>{"Another one. " * 50}</article></div></main>', TEXT),
    # A head without end tag.
    (f"<html><head><title>T</title><meta charset=utf-8><body><p>{TEXT}", TEXT),
]


@pytest.mark.parametrize(("source", "text"), WRAPPED)
def test_wrapped_pages(source, text):
    assert pages.main_text(source).split() == text.split()


LINKS = "".join(f"<li><a href={k}>Author and title number {k} of the list</a></li>" for k in range(4))
LISTED = " ".join(f"Author and title number {k} of the list" for k in range(4))
LINKED = [
    # Link-heavy parts within the article are its text; menus at its edges are not.
    (f"<div><p>{TEXT}</p><p>See <a href=1>the first source here</a> and <a href=2>the second source</a></p><ul>{LINKS}</ul><p>{TEXT}</p></div>", f"{TEXT} See the first source here and the second source {LISTED} {TEXT}"),
    (f"<div><h1>Title</h1><ul>{LINKS}</ul><p>{TEXT}</p><p>{TEXT}</p><ul>{LINKS}</ul></div>", f"Title {TEXT} {TEXT}"),
    (f"<div><p>{TEXT}</p><p>{TEXT}</p><h2>References</h2><ol>{LINKS}</ol><ul>{LINKS}</ul></div>", f"{TEXT} {TEXT} References {LISTED}"),
    # Many links elsewhere do not take the article along.
    (f"<div><ul>{LINKS * 20}</ul><div><p>{TEXT}</p><p>{TEXT}</p></div></div>", f"{TEXT} {TEXT}"),
]


@pytest.mark.parametrize(("source", "text"), LINKED)
def test_linked_text(source, text):
    assert pages.main_text(source).split() == text.split()


def test_marked_at_every_depth():
    assert pages.main_text("".join(f'<div class="x{"abcdefghij"[k % 10] * (k // 10 + 1)}-sidebar">' for k in range(2000)) + "deep text") == "deep text"


def test_very_deep_page():
    assert pages.main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"


def test_pipeline_stages(spark, tmp_path):
    body = [" ".join(words(9 + i, 60)) for i in range(30)]
    rows = [(i, body[i], "en", f"s{i % 3}", len(body[i]), "z", 1) for i in range(30)]
    rows += [(50, body[4] + " more", "en", "s0", 0, "z", 1), (51, "too short", "en", "s1", 0, "z", 1), (52, " ".join(words(99, 50) + words(13, 60)[20:50]), None, None, 0, "z", 1), (53, None, None, None, None, "z", 1)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, SCHEMA).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(seen[0]) == {*range(30), 50, 52}
    assert set(seen[1]) == {*range(30), 52}
    assert seen[2][52]["text"] == " ".join(words(99, 50)) and all(seen[2][i]["text"] == body[i] for i in range(30))
    taken = collections.Counter(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/3").collect())
    assert set(taken.values()) <= {1, 2, 3}
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == taken
    once = spark.read.parquet(f"{tmp_path}/4").drop("sequence_id", "offset")
    again = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


CLASHES = "score double, n_words int, kept string, size int, taken int, __row int, __row_ string, node long, copy int, none int, row string, stratum int, cutoff int, h int, rk int, body string"


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Extra columns named like the stages' own pass through; rows without doc_id are told apart by their text."""
    good = [" ".join(f"{w}{k}{i}" for i in range(60)) for k, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    extra = (0.5, 1, "x", 2, 3, 4, "y", 5, 6, 7, "z", 8, 9, 10, 11, "b")
    texts = [(1, good[0]), (2, good[1]), (None, good[0]), (None, good[2]), (None, good[3] + " end"), (5, None), (None, None)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    docs = spark.createDataFrame([(i, t, "en", None, 7, *extra) for i, t in texts], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = [(1, good[0]), (2, good[1]), (None, good[2]), (None, good[3] + " end")]
    wanted = [[*left, (None, good[0])], left, left]
    for (_, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        rows = docs.collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == sorted((i or 0, t) for i, t in want)
        assert all(tuple(r)[5:] == extra for r in rows)
        folder = str(tmp_path / f"s{len(want)}{_[:3]}")
        docs.write.parquet(folder)
        docs = spark.read.parquet(folder)
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert {r["text"] for r in mixed} == {t for _, t in left} and all(tuple(r)[5:] == extra for r in mixed)


def test_run_removes_the_tables_between(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(corpus_pipeline, "new_folder", lambda _: made.append(tmp_path / f"stage{len(made)}") or str(made[-1]))
    spark.createDataFrame([(i, f"word{i} " * 30 + "end", "en", "a", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(made) == 4 and [p.exists() for p in made] == [False] * 3 + [True]
