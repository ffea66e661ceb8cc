"""Ranked lexical search over tries of restricted term vectors.

Of each document only the terms that some item holds are kept, in order of their frequency. The documents are
dealt to tasks of a bounded number of entries; a task sorts its vectors, so that common beginnings share a path,
and builds a trie with paths of one child drawn together. Every node knows the greatest tf of each term and the least
length norm m below it, which bounds the score of any document under it. Per item the trie is searched depth first,
best bound first, and a subtree goes once its bound lies below the worst score that still counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm import kernels as K
from seqloom.session import written

#: Distinct terms of the items that a task holds at a time (8 bytes each, and their weights): larger item tables are searched in blocks.
MOST_TERMS = 1 << 18
#: Vector entries per trie, least number of tries, and documents of a leaf.
TRIE_ENTRIES, LEAST_TRIES, LEAF = 1 << 22, 16, 32

VECTOR = "uid long, doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, uid long, score long"


def _terms_only() -> np.ndarray:
    """Lower case; every ASCII byte that is no letter or digit becomes a blank."""
    table = np.full(256, 32, np.uint8)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = np.arange(a, b)
    return K.lower_ascii(table)


def term_prints(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all terms in text order, first term of each text)."""
    data = _terms_only()[texts.data]
    start, end, first = K.words_of(data, texts.offsets)
    return K.word_prints(data, start, end), first


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, print): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            prints, first = term_prints(K.Texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(K.owner(first))), pa.array(prints.view(np.int64))], ["item_id", "print"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(K.tidy(run), f"item_id {kind}, print long").distinct()


def term_vectors(docs: DataFrame, prints: np.ndarray) -> DataFrame:
    """Per document its number of terms, and the numbers and frequencies of those that are among the sorted ``prints``."""
    shared = docs.sparkSession.sparkContext.broadcast(prints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        quick = np.zeros(1 << 20, bool)
        quick[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in K.chunks(batches, "text"):
            found, first = term_prints(K.Texts(batch.column("text")))
            at = np.flatnonzero(quick[(found >> np.uint64(44)).astype(np.int64)])
            term = np.searchsorted(known, found[at])
            ok = known[np.minimum(term, max(len(known) - 1, 0))] == found[at] if len(known) else np.zeros(len(at), bool)
            text = np.searchsorted(first, at[ok], side="right") - 1
            pair, tf = np.unique(text * max(len(known), 1) + term[ok], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(batch.num_rows + 1) * max(len(known), 1)).astype(np.int32)
            terms = (pair % max(len(known), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (terms, tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array(np.diff(first)), *lists], ["uid", "doc_id", "n", "terms", "tfs"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(K.tidy(run), VECTOR)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a unit of weight gets; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Trie:
    """The vectors of a task. ``order`` sorts its documents so that each node is a range of them."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray):
        n = len(first) - 1
        big = terms.astype(">u4").tobytes()
        bodies = [big[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(n), key=bodies.__getitem__), np.int64)
        size = np.diff(first)[self.order]
        take = K.ragged(first[:-1][self.order], size)
        self.first, self.terms, self.tfs, self.m = np.concatenate(([0], np.cumsum(size))), terms[take], tfs[take], m[self.order]
        self.common = self._common()
        self.children: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.range: list[tuple[int, int]] = []
        self._build(n)

    def _common(self) -> np.ndarray:
        """Length of the path that each document shares with the one before it."""
        size = np.diff(self.first)
        shared = np.zeros(len(size), np.int64)
        at = np.arange(1, len(size))
        depth = 0
        while len(at):
            at = at[(size[at] > depth) & (size[at - 1] > depth)]
            at = at[self.terms[self.first[at] + depth] == self.terms[self.first[at - 1] + depth]]
            shared[at] += 1
            depth += 1
        return shared

    def _build(self, n: int) -> None:
        """Nodes are split where their documents part; small neighbours under one node share a leaf, and so do equal vectors."""
        inner: list[tuple[int, list[int]]] = []
        self.range.append((0, n))
        waiting = [0] if n > LEAF else []
        while waiting:
            node = waiting.pop()
            a, b = self.range[node]
            path = self.common[a + 1 : b].min()
            edges = np.concatenate(([a], np.flatnonzero(self.common[a + 1 : b] == path) + a + 1, [b])).tolist()
            below, low = [], a
            for i in range(1, len(edges)):
                last = i == len(edges) - 1
                if last or edges[i + 1] - low > LEAF:
                    below.append(len(self.range))
                    self.range.append((low, edges[i]))
                    low = edges[i]
            inner.append((node, below))
            waiting += [x for x in below if self.range[x][1] - self.range[x][0] > LEAF]
        summary: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

        def of(node: int) -> tuple[np.ndarray, np.ndarray, int]:
            if node in summary:
                return summary.pop(node)
            a, b = self.range[node]
            part = slice(self.first[a], self.first[b])
            return (*greatest(self.terms[part], self.tfs[part]), int(self.m[a:b].min()))

        for node, below in reversed(inner):
            parts = [of(x) for x in below]
            terms, tfs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            child = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            m = np.array([p[2] for p in parts], np.int64)
            self.children[node] = (np.array(below), child, terms, tfs, m)
            summary[node] = (*greatest(terms, tfs), int(m.min()))

    def best(self, weight: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k highest scores above 0; equal ones by place in ``ids``. ``weight`` holds the item's terms."""
        docs, scores, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        stack = [(np.iinfo(np.int64).max, 0)]
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            if node not in self.children:
                a, b = self.range[node]
                part = slice(self.first[a], self.first[b])
                doc = np.repeat(np.arange(a, b), np.diff(self.first[a : b + 1]))
                sums = gains(weight, self.terms[part], self.tfs[part], doc - a, self.m[a:b])
                hit = np.flatnonzero(sums >= floor)
                if len(hit):
                    docs, scores = np.append(docs, hit + a), np.append(scores, sums[hit])
                    if len(docs) >= k:
                        keep = np.lexsort((ids[docs], -scores))[:k]
                        docs, scores = docs[keep], scores[keep]
                        floor = int(scores[-1])
                continue
            below, child, terms, tfs, m = self.children[node]
            bounds = gains(weight, terms, tfs, child, m)
            go = np.flatnonzero(bounds >= floor)
            stack += [(int(bounds[i]), int(below[i])) for i in go[np.argsort(bounds[go], kind="stable")]]
        keep = np.lexsort((ids[docs], -scores))[:k]
        return docs[keep], scores[keep]


def greatest(terms: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms with the greatest tf of each."""
    order = np.argsort(terms, kind="stable")
    terms, tfs = terms[order], tfs[order]
    begin = np.flatnonzero(np.diff(terms, prepend=-1))
    return terms[begin], np.maximum.reduceat(tfs, begin) if len(begin) else tfs


def gains(weight: np.ndarray, terms: np.ndarray, tfs: np.ndarray, row: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum of weight x share per row, in 64-bit integers."""
    w = weight[terms]
    at = np.flatnonzero(w)
    out = np.zeros(len(m), np.int64)
    np.add.at(out, row[at], w[at] * share(tfs[at].astype(np.int64), m[row[at]]))
    return out


def _search(vectors: DataFrame, items: list[np.ndarray], prints: np.ndarray, totals: tuple[int, int], k: int) -> DataFrame:
    """The k best documents of each trie for each item (arrays of numbers of terms)."""
    spark = vectors.sparkSession
    n_docs, length = totals
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(prints), np.int64)
    for row in counted:
        df[row["term"]] = row["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    # The most frequent terms come first on the paths, so that paths are shared.
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    by_rank = np.empty(len(df), np.int64)
    by_rank[rank] = weight
    shared = spark.sparkContext.broadcast((rank, by_rank, [rank[x] for x in items]))
    filled = vectors.where(F.size("terms") > 0)
    entries = filled.agg(F.sum(F.size("terms"))).first()[0] or 0
    tries = max(LEAST_TRIES, -(-entries // TRIE_ENTRIES))

    def search(table: pa.Table) -> pa.Table:
        rank, weights, wanted = shared.value
        table = table.combine_chunks()
        column = table.column("terms").combine_chunks()
        first = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(column)))))
        terms, tfs = rank[np.asarray(column.flatten())], np.asarray(table.column("tfs").combine_chunks().flatten())
        row = K.owner(first)
        order = np.lexsort((terms, row))
        n = table.column("n").to_numpy()
        m = np.array([50 + (50 * int(x) * n_docs) // length for x in n], np.int64)
        trie = Trie(first, terms[order], tfs[order], m)
        doc_id = table.column("doc_id").combine_chunks()
        uid = table.column("uid").to_numpy()
        place = np.empty(len(n), np.int64)
        place[np.lexsort((uid, doc_id.fill_null(0).to_numpy(), np.asarray(doc_id.is_null())))] = np.arange(len(n))
        ids = place[trie.order]
        out = [np.zeros(0, np.int64)] * 3
        for number, mine in enumerate(wanted):
            if not len(mine):
                continue
            weight = np.zeros(len(rank), np.int64)
            weight[mine] = weights[mine]
            docs, scores = trie.best(weight, ids, k)
            out = [np.append(x, y) for x, y in zip(out, (np.full(len(docs), number), trie.order[docs], scores), strict=True)]
        return pa.table({"item": pa.array(out[0], pa.int32()), "doc_id": doc_id.take(pa.array(out[1])), "uid": uid[out[1]], "score": out[2]})

    return filled.withColumn("trie", F.pmod(F.xxhash64("uid"), F.lit(tries))).groupBy("trie").applyInArrow(K.tidy_groups(search), FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents (doc_id, text) of each item (item_id, text).

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased; a null text has none. Only
    scores above 0 count; equal ones are ranked by doc_id, rows without one last, and repeated rows stand beside each other.
    Rows that share an item_id are one item with all their terms. An item without terms, or whose terms no document
    holds, has no rows, and so has every item if a table is empty. Texts of any length are read whole. Further columns of any name
    play no part. Terms are told apart by 64-bit fingerprints. Items are collected block by block, at most about
    ``MOST_TERMS`` of their terms at a time; documents never are.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items))
    blocks = max(1, -(-asked.count() // MOST_TERMS))
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        if mine.empty:
            continue
        prints, term = np.unique(mine["print"].to_numpy().view(np.uint64), return_inverse=True)
        names, item = np.unique(mine["item_id"].to_numpy(), return_inverse=True)
        vectors = written(term_vectors(docs, prints))
        n_docs, length = vectors.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            continue
        found = _search(vectors, [term[item == i] for i in range(len(names))], prints, (n_docs, length), k)
        kind = items.schema["item_id"].dataType.simpleString()
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names.tolist())], f"item int, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
