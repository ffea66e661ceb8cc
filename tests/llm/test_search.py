"""Phrase mining, exact dedup and ranked search against plain Python."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from seqloom.llm import exact, golomb, phrases, ranked

CLASHING = "key long, uid string, batch int, n int, score double, terms string, body string, kept boolean, print string, rank int"


@pytest.fixture
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, *[None] * 10) for i, t, lang in rows], f"doc_id long, text string, lang string, {CLASHING}")

    return make


def odd_rows():
    long = " ".join(f"w{(i * i * 31 + i) % 97}" for i in range(30_000))
    return [
        (1, "The cat, the CAT sat. The cat sat on\tthe mat", "en"),
        (2, "the cat sat; the cat sat on the mat the cat sat on", "en"),
        (2, "the cat sat; the cat sat on the mat the cat sat on", "en"),
        (3, "the cat sat on the mat", "de"),
        (3, "the cat sat on the mat", "de"),
        (4, None, "en"),
        (5, "", None),
        (None, "", "en"),
        (6, "the cat sat on the mat\nthe cat\x0bsat on\rthe mat", None),
        (7, "the cat sat on the mat", "und"),
        (8, long, "fr"),
        (9, long + "!", "fr"),
        (10, "ÉTÉ été Été été: 日本 語 日本 語, 日本 語", "fr"),
        (None, "the cat sat on", "en"),
        (None, "the cat sat on", "en"),
        (11, " \t.,;:!? ", "en"),
        (12, "ha " * 50, "es"),
        (13, "\x1f\x00 a\x1fb a\x1fb a\x1fb", "es"),
    ]


@pytest.mark.parametrize("n, width", [(0, 20), (1, 20), (3, 3), (500, 12), (5000, 64), (5000, 45)])
def test_golomb_round_trip(n, width):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, (1 << width) - 1, n, np.uint64, endpoint=True))
    body = golomb.encode(keys, width)
    assert (golomb.decode(body) == keys).all() and len(golomb.decode(body)) == len(keys)
    if n == 5000:
        assert 8 * len(body) < len(keys) * (width - math.log2(n) + 2.5)


def test_golomb_messages_cover_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 3000, np.uint64))
    table = golomb.messages(7, keys, 30, 6, np.arange(len(keys)))
    back = [golomb.decode(k) | (np.uint64(b) << np.uint64(24)) for b, k in zip(table["bucket"].to_pylist(), table["keys"].to_pylist(), strict=True)]
    assert (np.concatenate(back) == keys).all()
    counts = [golomb.counts_of(e, len(k)) for e, k in zip(table["extra"].to_pylist(), back, strict=True)]
    assert (np.concatenate(counts) == np.arange(len(keys))).all()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_phrases(rows, least, top):
    total, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longest = collections.Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = lang, w[i : i + size]
                longest[part] = max(longest[part], a)
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * longest[lang, w] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, len(w))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize("batch", [1 << 10, 8 << 20])
def test_phrases(docs, monkeypatch, batch):
    monkeypatch.setattr(phrases, "BATCH_BYTES", batch)
    rows = odd_rows() + [(100 + i, f"a rare phrase {i % 3} of few words, in piece {i % 2}", "en") for i in range(40)]
    got = [tuple(r) for r in phrases.mine_phrases(docs(rows), least=3, top=40).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_phrases(rows, 3, 40)


def test_phrases_are_dropped_at_the_bound(docs):
    # "a b" occurs 5 times, "a b c" 4 times: 100 * 4 >= 80 * 5 drops it.
    rows = [(i, "a b c", "en") for i in range(4)] + [(9, "a b", "en")]
    got = {r["phrase"] for r in phrases.mine_phrases(docs(rows), least=3).collect()}
    assert got == {"a b c"}


def test_phrases_leave_no_folder(spark, docs, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(phrases, "new_folder", lambda _: made.append(str(tmp_path / str(len(made)))) or made[-1])
    phrases.mine_phrases(docs(odd_rows()), least=3).collect()
    assert made and not list(tmp_path.iterdir())


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, text, _ in rows:
        groups[text or ""].append(i)
    out = collections.Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, keep, len(ids), False, sha) for i in ids)
        out[keep, keep, len(ids), False, sha] -= 1
        out[keep, keep, len(ids), True, sha] += 1
    return +out


@pytest.mark.parametrize("spare", [12, -4])
def test_exact(docs, monkeypatch, spare):
    """With few bits most fingerprints collide, and the bytes decide."""
    monkeypatch.setattr(exact, "SPARE_BITS", spare)
    rows = odd_rows() + [(1000 + i, f"text {i % 150}", "en") for i in range(400)] + [(2000 + i, "one text", None) for i in range(300)]
    got = collections.Counter(map(tuple, exact.exact_duplicates(docs(rows)).collect()))
    assert got == plain_groups(rows)


def test_exact_with_a_full_bitmap(docs, monkeypatch):
    monkeypatch.setattr(exact, "MOST_BITS", 16)
    monkeypatch.setattr(exact, "SEGMENT_WORDS", 8)
    rows = [(i, f"text {i // 2}", None) for i in range(3000)]
    got = collections.Counter(map(tuple, exact.exact_duplicates(docs(rows)).collect()))
    assert got == plain_groups(rows)


def plain_ranks(rows, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))

    vectors = [(i, collections.Counter(terms(t))) for i, t, *_ in rows]
    vectors = [(i, v) for i, v in vectors if v]
    n, length = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = collections.Counter(t for _, v in vectors for t in v)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = collections.Counter()
    for item, mine in asked.items():
        found = []
        for i, v in vectors:
            m = 50 + (50 * sum(v.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * v[t] // (1000 * v[t] + 20 * m)) for t in mine if v[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out.update((item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1))
    return out


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 0, 0, 0.0) for i, t in items], "item_id long, text string, print long, rank int, score double")


@pytest.mark.parametrize("terms, leaf, k", [(1 << 18, 32, 50), (9, 2, 3)])
def test_ranked(spark, docs, monkeypatch, terms, leaf, k):
    """The second case searches in several blocks, with deep tries and many ties at the end."""
    monkeypatch.setattr(ranked, "MOST_TERMS", terms)
    monkeypatch.setattr(ranked, "LEAF", leaf)
    monkeypatch.setattr(ranked, "LEAST_TRIES", 2)
    rows = odd_rows() + [(100 + i, " ".join(f"t{j}" for j in range(i % 7, 9) for _ in range(1 + i % 3)), None) for i in range(120)]
    items = [(1, "The CAT sat"), (2, "t1 t3, t5 and t8"), (3, None), (4, ""), (5, "nowhere"), (6, "日本 été w5 w6"), (2, "cat t0"), (7, "t8"), (8, "a1 b_c")]
    got = ranked.ranked_search(docs(rows), items_of(spark, items), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_ranks(rows, items, k)


def test_search_prunes():
    """Leaves whose bound lies below the scores already found are not read."""
    rng = np.random.default_rng(3)
    size = 40
    terms = np.sort(np.concatenate([np.sort(rng.choice(500, size, replace=False))[None] for _ in range(4000)]), axis=1)
    trie = ranked.Trie(np.arange(4001) * size, terms.ravel(), np.ones(terms.size, np.int32), np.full(4000, 100))
    weight = np.zeros(500, np.int64)
    weight[[0, 1, 2, 3]] = 9000
    weight[[400, 410]] = 10
    seen = []
    trie_range, trie.range = trie.range, collections.UserList(trie.range)
    trie.range.__class__ = type("Counted", (collections.UserList,), {"__getitem__": lambda self, i: seen.append(i) or trie_range[i]})
    docs, scores = trie.best(weight, np.arange(4000), 10)
    sums = weight[terms[trie.order]].sum(1) * int(ranked.share(np.array([1]), np.array([100]))[0])
    assert sorted(scores.tolist()) == sorted(sums.tolist())[-10:] and len(seen) < len(trie_range) / 4


def test_empty_tables(spark, docs):
    none = docs([])
    no_items = items_of(spark, [])
    assert phrases.mine_phrases(none).collect() == []
    assert exact.exact_duplicates(none).collect() == []
    assert ranked.ranked_search(none, items_of(spark, [(1, "a b")])).collect() == []
    assert ranked.ranked_search(docs([(1, "a b", None)]), no_items).collect() == []
    assert ranked.ranked_search(docs([(1, None, None)]), items_of(spark, [(1, "a b")])).collect() == []
