"""Near-duplicates by b-bit MinHash.

Of each text's shingle set the minima under many hash functions are taken. Bands of full minima give the
candidates; of each minimum only ``BITS`` low bits are kept and packed, and pairs whose bit
agreement, corrected for chance agreement, lies far below the wanted similarity are dropped. The others
are confirmed on the full sets. Buckets are searched from their first member; only members that end up in
another component than a bucket-mate are then compared with the rest of the bucket, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import kernels as K
from seqloom.llm.components import components
from seqloom.llm.exchange import BATCH_BYTES
from seqloom.session import cut_lineage

SHINGLE = 5
#: A pair of similarity 0.85 shares none of 24 bands of 6 minima once in 85,000 cases.
BANDS, ROWS, BITS = 24, 6, 2
#: Standard deviations that the estimate of a linked pair may fall short.
SLACK = 5.0
#: Node numbers from here on stand for texts none of whose rows has a doc_id.
NAMELESS = 1 << 62
BLOCK = 256


def shingle_prints(texts: K.Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, first, key1, key2): sorted distinct shingle prints of each text, and two prints of its word sequence."""
    data = K.lower_ascii(texts.data)
    start, end, first = K.words_of(data, texts.offsets)
    prints = K.word_prints(data, start, end)
    sums = K.prefix_sums(prints)
    n = np.diff(first)
    # A text of fewer words is one shingle; its length keeps it apart from shingles of full width.
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = K.ragged(first[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    shingles = K.span_prints(sums, at, at + size) ^ K.mix(size.astype(np.uint64))
    text = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((shingles, text))
    shingles = shingles[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    distinct = np.bincount(text[new], minlength=len(n))
    key1 = K.span_prints(sums, first[:-1], first[1:])
    other = K.prefix_sums(K.word_prints(data, start, end, seed=1))
    key2 = K.span_prints(other, first[:-1], first[1:]) ^ K.mix(n.astype(np.uint64))
    return shingles[new], np.concatenate(([0], np.cumsum(distinct))), key1, key2


def signatures(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, bits) of non-empty sets: band keys (sets, BANDS) and packed low bits (sets, words)."""
    sets, functions = len(first) - 1, BANDS * ROWS
    factors = K.mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    minima = np.empty((functions, sets), np.uint64)
    for i in range(functions):
        minima[i] = np.minimum.reduceat(shingles * factors[i], first[:-1])
    minima = K.mix(minima)
    bands = np.empty((sets, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(sets, b + 1, np.uint64)
        for row in minima[b * ROWS : (b + 1) * ROWS]:
            key = K.mix(key ^ row)
        bands[:, b] = key
    per_word = 64 // BITS
    words = -(-functions // per_word)
    bits = np.zeros((sets, words), np.uint64)
    for i in range(functions):
        bits[:, i // per_word] |= (minima[i] & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (i % per_word))
    return bands, bits


def agreement_floor(similarity: float) -> int:
    """Least number of agreeing minima of a pair that may have the similarity."""
    n, chance = BANDS * ROWS, 2.0**-BITS
    p = chance + (1 - chance) * similarity
    return math.floor(n * p - SLACK * math.sqrt(n * p * (1 - p)))


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Similarity from agreeing minima, less the agreement that ``BITS`` bits have by chance."""
    chance = 2.0**-BITS
    return (agreeing / (BANDS * ROWS) - chance) / (1 - chance)


def _agreeing(a: str, b: str) -> Column:
    """Agreeing minima of two packed signatures: positions in which no bit differs."""
    low = F.lit(0x5555555555555555)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(low)).cast("int")

    return BANDS * ROWS - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)


def node_key() -> Column:
    """Number of a row's document: its doc_id, or one of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def sketch(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n_bytes, n_shingles, key1, key2, bands, bits) per row; bands and bits null for empty sets."""
    rows = docs.select(node_key().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            texts = K.Texts(batch.column("text"))
            shingles, first, key1, key2 = shingle_prints(texts)
            n = np.diff(first)
            full = n > 0
            bands, bits = signatures(shingles, np.concatenate(([0], np.cumsum(n[full]))))

            def lists(values: np.ndarray) -> pa.Array:
                out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * values.shape[1]))).astype(np.int32)), pa.array(values.ravel().view(np.int64)))
                return out

            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("doc_id"), pa.array(np.diff(texts.offsets)), pa.array(n), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), lists(bands), lists(bits)],
                ["node", "doc_id", "n_bytes", "n_shingles", "key1", "key2", "bands", "bits"],
            )

    return rows.mapInArrow(K.tidy(run), "node long, doc_id long, n_bytes long, n_shingles long, key1 long, key2 long, bands array<long>, bits array<long>")


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and packed signatures allow the similarity."""
    left = reps.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("xa"))
    right = reps.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("xb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(left, "a").join(right, "b").where(fits & (_agreeing("xa", "xb") >= agreement_floor(percent / 100))).select("a", "b")


def node_sets(rows: pa.Table, nodes: set[int]) -> dict[int, np.ndarray]:
    """Shingle sets of the nodes that are among a batch's texts."""
    kept = rows.filter(pa.array([x in nodes for x in rows.column("node").to_pylist()], pa.bool_()))
    out = {}
    for at in range(0, kept.num_rows, 256):
        part = kept.slice(at, 256)
        shingles, first, _, _ = shingle_prints(K.Texts(part.column("text")))
        for i, node in enumerate(part.column("node").to_pylist()):
            out[node] = shingles[first[i] : first[i + 1]]
    return out


def _home(node: str, batches: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(batches)).cast("int")


def _sendings(pairs: DataFrame, batches: int) -> DataFrame:
    """(batch, a, to): once per node ``a`` and batch ``to`` that holds partners of it, however many they are."""
    return pairs.select(_home("a", batches).alias("batch"), "a", _home("b", batches).alias("to")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, batches: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets meet the bound.

    The set of ``a`` travels once to each batch that holds partners of it. The pairs wait in the batch of ``b``,
    where a text has no more of them than bands, and the partners' sets are made from their texts.
    """

    def send(rows: pa.Table, asked: pa.Table) -> pa.Table:
        a = asked.column("a").to_pylist()
        sets = node_sets(rows, set(a))
        return pa.table({"batch": asked.column("to"), "a": asked.column("a"), "b": pa.nulls(len(a), pa.int64()), "shingles": pa.array([sets[x].tobytes() for x in a], pa.binary())})

    def compare(rows: pa.Table, met: pa.Table) -> pa.Table:
        sent, asked = met.filter(met.column("b").is_null()), met.filter(met.column("b").is_valid())
        heads = {x: np.frombuffer(body, np.uint64) for x, body in zip(sent.column("a").to_pylist(), sent.column("shingles").to_pylist(), strict=True)}
        partners = asked.column("b").to_pylist()
        sets = node_sets(rows, set(partners))
        left, right = [], []
        for x, y in zip(asked.column("a").to_pylist(), partners, strict=True):
            both = np.concatenate((heads[x], sets[y]))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(both) - shared):
                left.append(x)
                right.append(y)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    sent = texts.groupBy("batch").cogroup(_sendings(pairs, batches).groupBy("batch")).applyInArrow(K.tidy_groups(send), "batch int, a long, b long, shingles binary")
    waiting = pairs.select(_home("b", batches).alias("batch"), "a", "b", F.lit(None).cast("binary").alias("shingles"))
    return texts.groupBy("batch").cogroup(sent.unionByName(waiting).groupBy("batch")).applyInArrow(K.tidy_groups(compare), "a long, b long")


def _by_group(batches: Iterator[pa.RecordBatch], run: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Runs whole groups of rows sorted by ``group``; a group may go on over batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        group = table.column("group").to_numpy()
        cut = int(np.searchsorted(group, group[-1], side="left"))
        if cut:
            out = run(table.slice(0, cut).combine_chunks())
            if out is not None:
                yield out
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        out = run(rest.combine_chunks())
        if out is not None:
            yield out


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return np.asarray(column.flatten()).view(np.uint64).reshape(len(column), -1)


def _group_ends(group: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))


def _open_members(members: DataFrame, floor: int) -> DataFrame:
    """(group, side, node, component) of members with a plausible partner in another component.

    ``members`` has (key, n, node, component, bits, bands). A bucket is dealt to blocks by node, and pairs of
    blocks meet in tasks, so that no task holds a large bucket. Of the buckets that two nodes share
    only the first counts.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    side = F.when(F.col("at.i") == F.col("at.j"), F.lit(-1)).otherwise((F.col("mine") == F.col("at.i")).cast("int"))
    dealt = (
        members.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("at", F.explode(meets))
        .select(F.xxhash64("key", "at.i", "at.j").alias("group"), side.alias("side"), "key", "node", "component", "bits", "bands")
    )
    low = np.uint64(0x5555555555555555)

    def flag(table: pa.Table) -> pa.RecordBatch:
        group, side, node, comp = (table.column(c).to_numpy() for c in ("group", "side", "node", "component"))
        key = table.column("key").to_numpy().view(np.uint64)
        bits, bands = _matrix(table, "bits"), _matrix(table, "bands")
        ends = _group_ends(group)
        end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
        hit, at, step = np.zeros(len(group), bool), np.arange(len(group)), 1
        while len(at):
            at = at[at + step < end[at]]
            other = at + step
            ok = (comp[at] != comp[other]) & ((side[at] < 0) | (side[at] != side[other]))
            x, y = at[ok], other[ok]
            d = bits[x] ^ bits[y]
            near = BANDS * ROWS - np.bitwise_count((d | (d >> np.uint64(1))) & low).sum(1) >= floor
            x, y = x[near], y[near]
            same = bands[x] == bands[y]
            mine = bands[x, same.argmax(1)] == key[x]
            hit[x[mine]] = True
            hit[y[mine]] = True
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(v[hit]) for v in (group, side, node, comp)], ["group", "side", "node", "component"])

    spread = dealt.repartition("group").sortWithinPartitions("group")
    return spread.mapInArrow(K.tidy(lambda batches: _by_group(batches, flag)), "group long, side int, node long, component long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block's sets, by products of slices of its incidence matrix."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    keep = several[column]
    row, column = row[keep], (np.cumsum(several) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for at in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _cross_links(members: DataFrame, texts: DataFrame, batches: int, percent: int) -> DataFrame:
    """Links (a, b) that join components within some bucket; the full sets meet in blocks.

    Of the links of a block only those are given that join components not yet joined by others of it,
    so a dense bucket gives about as many rows as it has members.
    """
    members = cut_lineage(_open_members(members, agreement_floor(percent / 100)))
    wanted = members.select("node").distinct().select(F.pmod(F.xxhash64("node"), F.lit(batches)).cast("int").alias("batch"), "node")

    def sets_of_nodes(rows: pa.Table, asked: pa.Table) -> pa.Table:
        sets = node_sets(rows, set(asked.column("node").to_pylist()))
        return pa.table({"node": pa.array(list(sets), pa.int64()), "shingles": pa.array([x.tobytes() for x in sets.values()], pa.binary())})

    sets = texts.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(K.tidy_groups(sets_of_nodes), "node long, shingles binary")

    def link(table: pa.Table) -> pa.RecordBatch | None:
        group, side, node, comp = (table.column(c).to_numpy() for c in ("group", "side", "node", "component"))
        bodies = table.column("shingles").to_pylist()
        left, right, begin = [], [], 0
        for end in _group_ends(group).tolist():
            block = [np.frombuffer(x, np.uint64) for x in bodies[begin:end]]
            shared = shared_counts(block)
            size = np.fromiter(map(len, block), np.int64, len(block))
            c, s, ids = comp[begin:end], side[begin:end], node[begin:end]
            linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
            linked &= (c[:, None] != c[None, :]) & ((s[:, None] < 0) | (s[:, None] != s[None, :]))
            root = {x: x for x in c.tolist()}

            def find(x: int, root: dict = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                p, q = find(int(c[i])), find(int(c[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    left.append(int(ids[i]))
                    right.append(int(ids[j]))
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    met = members.join(sets, "node").repartition("group").sortWithinPartitions("group")
    return met.mapInArrow(K.tidy(lambda batches: _by_group(batches, link)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, with_node: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text), and if asked for its :func:`node_key`.

    Texts are linked whose sets of distinct 5-word shingles (ASCII letters lower-cased; fewer words: the
    sequence as one shingle) have 100 * intersection >= percent * union. Texts of equal word sequence are one
    node, named by its least doc_id. Null texts and texts without words are linked with nothing. Rows that
    share a doc_id are one document and get one component. A row without doc_id takes the component of its
    text; where a component has no doc_id at all, component_id is null and its rows are kept. Repeated
    rows get equal answers; further columns play no part.
    """
    rows = cut_lineage(sketch(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    filled = rows.where("n_shingles > 0")
    classes = filled.groupBy("key1", "key2").agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("copies"))
    # Aggregates are cut off before they are joined: on two plain exchanges Spark can split a hot key.
    copied = cut_lineage(classes.where("copies > 1").drop("copies"))
    named = rows.select("node", "doc_id", "n_shingles", "key1", "key2").join(copied, ["key1", "key2"], "left")
    named = cut_lineage(named.select("node", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("class", "node")).alias("class")))
    reps = filled.join(classes.select(F.col("class").alias("node")), "node", "left_semi").select("node", "n_shingles", "bands", "bits").dropDuplicates(["node"])
    reps = cut_lineage(reps)
    banded = reps.select("node", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(banded.join(cut_lineage(heads), "key"))
    texts = (
        docs.select(node_key().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
        .select(F.pmod(F.xxhash64("node"), F.lit(batches)).cast("int").alias("batch"), "node", "text")
        .repartition(batches, "batch")
    )
    tested = cut_lineage(_plausible(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct(), reps, percent))
    links = cut_lineage(_confirmed(tested, texts, batches, percent))
    found = cut_lineage(components(links, "a", "b"))
    # Buckets whose members are not all of one component yet.
    placed = shared.select("key", "n", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    members = placed.join(cut_lineage(split), "key", "left_semi").join(reps.select("node", "bits", "bands"), "node")
    links = links.unionByName(cut_lineage(_cross_links(members, texts, batches, percent)))
    found = components(links, "a", "b").withColumnRenamed("node", "class")
    joined = named.join(found, "class", "left")
    least = F.coalesce("component", "class", "node")
    component = F.when(least < NAMELESS, least)
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *["node"] * with_node)
