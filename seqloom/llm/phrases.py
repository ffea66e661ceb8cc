"""Phrase collocations mined level by level over persisted occurrence relations.

The relation of length k has the occurrences of frequent phrases of k words, in order of piece and position. It is
kept as runs of words: in a run a frequent phrase begins at every position but the last k - 1, so joining the relation
with itself on piece and adjacent position is stepping along the runs. The joined occurrences are counted per batch, the
counts are added up by the owners of hash ranges, and the relation of length k + 1 is what the semi-join
with the frequent groups leaves. Each relation is written once and read for the next length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import golomb
from seqloom.llm import kernels as K
from seqloom.operators.groups import first_n
from seqloom.session import new_folder, remove_folder, written

#: Text bytes of a batch, and distinct phrases per owner.
BATCH_BYTES, OWNER_KEYS = 8 << 20, 1 << 20
BITS = 64
UNKNOWN = "und"

#: ``runs``: word numbers of the batch in order of piece and position, -1 between runs. Word i of the batch has the
#: i-th of ``keys``; ``langs`` (numbers in ``names``) and ``words`` are kept as long as words are not named.
RELATION = "batch long, names array<string>, counts array<long>, keys binary, langs binary, words binary, runs binary, distinct long"
#: A frequent phrase, given by the batch its owner chose: its key, the keys of its words, its count.
PHRASE = "lang string, word string, parts array<long>, key long, a long"
ANSWER = "batch long, bucket int, frequent binary, named binary, totals binary"


def _pack(values: np.ndarray) -> bytes:
    """int32 values, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def _delimited() -> np.ndarray:
    """Lower case; every byte that ends a piece becomes a line feed."""
    table = K.lower_ascii(np.arange(256, dtype=np.uint8))
    table[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10
    return table


def lang_seed(lang: str) -> np.ndarray:
    """A value that keeps the phrases of a language apart from all others."""
    data = np.frombuffer(lang.encode(), np.uint8)
    return K.span_prints(K.prefix_sums(K.byte_values(data, 2)), np.array([0]), np.array([len(data)]))


def occurrences(batch: int, table: pa.Table) -> dict:
    """The relation of single words of some texts (text, lang)."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(langs, pa.ChunkedArray):
        langs = langs.combine_chunks()
    names = langs.dictionary.to_pylist()
    code = np.asarray(langs.indices).astype(np.int64)
    seeds = np.concatenate([np.zeros(0, np.uint64), *[lang_seed(x) for x in names]])
    keys, owners, words, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
    counts, done = np.zeros(len(names), np.int64), 0
    length = np.asarray(pc.binary_length(table.column("text"))).astype(np.int64)
    total, at = np.cumsum(length), 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + K.CHUNK_BYTES, side="right")))
        texts = K.Texts(table.column("text").slice(at, to - at))
        data = _delimited()[texts.data]
        start, end, first = K.words_of(data, texts.offsets)
        text = K.owner(first)
        lang = code[at:to][text]
        counts += np.bincount(lang, minlength=len(names))
        prints = K.word_prints(data, start, end) ^ seeds[lang] if len(start) else np.zeros(0, np.uint64)
        found, at_first, which = np.unique(prints, return_index=True, return_inverse=True)
        piece = np.cumsum(data == 10)[start] if len(start) else np.zeros(0, np.int64)
        breaks = np.flatnonzero((np.diff(piece) != 0) | (np.diff(text) != 0)) + 1
        runs.append(np.insert(which + done, breaks, -1))
        runs.append(np.full(1, -1))
        keys.append(found)
        owners.append(lang[at_first])
        body = data.tobytes()
        words += [body[a:b] for a, b in zip(start[at_first].tolist(), end[at_first].tolist(), strict=True)]
        done += len(found)
        at = to
    every = np.concatenate(keys)
    found, at_first, which = np.unique(every, return_index=True, return_inverse=True)
    run = np.concatenate(runs)
    run = np.where(run < 0, -1, which[run]) if len(which) else run
    return {
        "batch": batch, "names": names, "counts": counts.tolist(), "keys": found.tobytes(), "langs": _pack(np.concatenate(owners)[at_first]),
        "words": pa.compress(joined := b"\n".join(words[i] for i in at_first.tolist()), "zstd", asbytes=True) + len(joined).to_bytes(8, "little"),
        "runs": _pack(run), "distinct": len(found),
    }


def first_relation(docs: DataFrame) -> DataFrame:
    """One row per batch of texts (text, lang); batches are numbered when they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("keys", pa.binary()), ("langs", pa.binary()), ("words", pa.binary()), ("runs", pa.binary()), ("distinct", pa.int64())])
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([occurrences(number, pa.Table.from_batches(waiting))], schema)

        for batch in batches:
            for part in K.chunks([batch], "text", BATCH_BYTES):
                waiting.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= BATCH_BYTES:
                    yield flush()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield flush()

    return docs.mapInArrow(K.tidy(run), RELATION)


class Relation:
    """A batch's occurrences of frequent phrases of k - 1 words, and the joined ones of k words."""

    def __init__(self, row: dict, k: int):
        self.batch, self.k = row["batch"], k
        self.keys = np.frombuffer(row["keys"], np.uint64)
        self.runs = _unpack(row["runs"])
        if k == 1:
            self.at = np.flatnonzero(self.runs >= 0)
            self.phrase = self.keys[self.runs[self.at]]
        else:
            inside = np.cumsum(self.runs < 0)
            self.at = np.arange(max(len(self.runs) - k + 1, 0))
            ok = (self.runs[self.at] >= 0) & (inside[self.at] == inside[self.at + k - 1])
            self.at = self.at[ok]
            self.phrase = self.spans(self.at, k)
        self.found, self.which = np.unique(self.phrase, return_inverse=True)

    def spans(self, at: np.ndarray, k: int) -> np.ndarray:
        """Keys of the phrases of k words at these places."""
        words = self.keys[self.runs[at[:, None] + np.arange(k)]] if len(at) else np.zeros((0, k), np.uint64)
        return phrase_keys(words)

    def counts(self) -> np.ndarray:
        return np.bincount(self.which, minlength=len(self.found))


def phrase_keys(words: np.ndarray) -> np.ndarray:
    """Keys of phrases given by the keys of their words, a row each."""
    if words.shape[1] == 1:
        return words[:, 0]
    key = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        key = K.mix(key + column)
    return key


def _ask(relation: DataFrame, k: int, bits: int) -> DataFrame:
    """Counts of the joined occurrences, per batch and owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = Relation(row, k)
                if len(mine.found):
                    yield from golomb.messages(mine.batch, mine.found, BITS, bits, mine.counts()).to_batches()

    return relation.select("batch", "keys", "runs").mapInArrow(K.tidy(run), golomb.MESSAGE)


def _answers(messages: DataFrame, least: int) -> DataFrame:
    """Which of the phrases are frequent; the totals go to one batch that has the phrase."""

    def reply(table: pa.Table) -> pa.Table:
        parts = [golomb.decode(k) for k in table.column("keys").to_pylist()]
        size = [len(p) for p in parts]
        keys = np.concatenate(parts)
        counts = np.concatenate([golomb.counts_of(e, n) for e, n in zip(table.column("extra").to_pylist(), size, strict=True)])
        order = np.argsort(keys, kind="stable")
        run = keys[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(run), 1), bool), run[1:] != run[:-1])))
        total = np.add.reduceat(counts[order], begin) if len(begin) else counts
        enough = total >= least
        frequent, named, sums = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        frequent[order] = np.repeat(enough, np.diff(np.append(begin, len(run))))
        named[order[begin[enough]]] = True
        sums[order[begin]] = total
        cuts = np.concatenate(([0], np.cumsum(size)))
        pieces = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table(
            {
                "batch": table.column("batch"),
                "bucket": table.column("bucket"),
                "frequent": pa.array([np.packbits(frequent[p]).tobytes() for p in pieces], pa.binary()),
                "named": pa.array([np.packbits(named[p]).tobytes() for p in pieces], pa.binary()),
                "totals": pa.array([sums[p][named[p]].astype("<i8").tobytes() for p in pieces], pa.binary()),
            }
        )

    return messages.groupBy("bucket").applyInArrow(K.tidy_groups(reply), ANSWER)


def _next(relation: DataFrame, answers: DataFrame, k: int, bits: int) -> DataFrame:
    """Relation rows of length k, and a phrase row for each frequent phrase that a batch is to name."""
    schema = f"{RELATION}, {PHRASE}"
    kinds = {name: kind for name, kind in [("batch", pa.int64()), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("keys", pa.binary()), ("langs", pa.binary()), ("words", pa.binary()), ("runs", pa.binary()), ("distinct", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("parts", pa.list_(pa.int64())), ("key", pa.int64()), ("a", pa.int64())]}

    def table(columns: dict, n: int) -> pa.Table:
        return pa.table({c: pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()})

    def step(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return table({}, 0)
        row = rows.to_pylist()[0]
        mine = Relation(row, k)
        n = len(mine.found)
        frequent, named, totals = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        at = {b: i for i, b in enumerate(answers.column("bucket").to_pylist())}
        bodies = [answers.column(c).to_pylist() for c in ("frequent", "named", "totals")]
        for owner, a, b in golomb.owners(mine.found, BITS, bits):
            i = at[owner]
            frequent[a:b] = np.unpackbits(np.frombuffer(bodies[0][i], np.uint8), count=b - a)
            named[a:b] = np.unpackbits(np.frombuffer(bodies[1][i], np.uint8), count=b - a)
            totals[a:b][named[a:b]] = np.frombuffer(bodies[2][i], "<i8")
        # Starts of frequent phrases; runs of successive ones keep their words.
        keep = frequent[mine.which]
        start = mine.at[keep]
        cut = np.flatnonzero(np.diff(start) != 1) + 1 if len(start) else np.zeros(0, np.int64)
        low, high = np.append(0, cut), np.append(cut, len(start))
        length = (high - low + k) * (len(start) > 0)
        place = K.ragged(start[low] if len(start) else low, length - (len(start) > 0))
        ends = np.cumsum(length - 1)[:-1]
        runs = np.insert(mine.runs[place], ends, -1) if len(place) else place
        used = np.unique(runs[runs >= 0])
        shorter = np.full(len(mine.keys) + 1, -1)
        shorter[used] = np.arange(len(used))
        out = {"batch": [mine.batch], "keys": [mine.keys[used].tobytes()], "runs": [_pack(shorter[runs])], "distinct": [len(used)]}
        some = np.zeros(n, np.int64)
        some[mine.which] = mine.at
        give = np.flatnonzero(named)
        words = mine.runs[some[give][:, None] + np.arange(k)] if n else np.zeros((0, k), np.int64)
        phrases = {"parts": list(mine.keys[words].view(np.int64)) if len(give) else [], "key": mine.found[give].view(np.int64), "a": totals[give]}
        if k == 1:
            body, size = row["words"][:-8], int.from_bytes(row["words"][-8:], "little")
            text = pa.decompress(body, size, "zstd", asbytes=True).split(b"\n")
            lang = _unpack(row["langs"])
            phrases["word"] = [text[i].decode("utf-8") for i in words[:, 0].tolist()]
            phrases["lang"] = [row["names"][lang[i]] for i in words[:, 0].tolist()]
        return pa.concat_tables([table(out, 1), table(phrases, len(give))])

    return relation.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(K.tidy_groups(step), schema)


def mine_levels(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """(counts per lang, phrase rows of each length, folders written)."""
    spark = docs.sparkSession
    folders = [new_folder(spark)]
    relation = written(first_relation(docs), folders[0])
    total = relation.select(F.explode(F.arrays_zip("names", "counts")).alias("x")).groupBy(F.col("x.names").alias("lang")).agg(F.sum("x.counts").alias("n"))
    levels = []
    for k in range(1, most_words + 1):
        bits = golomb.owner_bits(relation.agg(F.sum("distinct")).first()[0] or 0, OWNER_KEYS)
        answers = _answers(_ask(relation, k, bits), least)
        folders.append(new_folder(spark))
        both = written(_next(relation, answers, k, bits), folders[-1])
        levels.append(both.where("key is not null").select(*PHRASE.replace(" string", "").replace(" array<long>", "").replace(" long", "").split(", ")))
        relation = both.where("key is null").select(*[c.split()[0] for c in RELATION.split(", ")])
    return total, levels, folders


def _with_parts(phrases: DataFrame, k: int) -> DataFrame:
    """Adds ``cuts``, (first part, rest) keys of each cut, and ``inner``, keys of the shorter phrases of 2 words and more in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.asarray(batch.column("parts").flatten()).view(np.uint64).reshape(-1, k)
            left = np.column_stack([phrase_keys(words[:, :j]) for j in range(1, k)])
            right = np.column_stack([phrase_keys(words[:, j:]) for j in range(1, k)])
            inner = [phrase_keys(words[:, i : i + size]) for size in range(2, k) for i in range(k - size + 1)]
            inner = np.column_stack(inner) if inner else np.zeros((len(words), 0), np.uint64)

            def lists(values: np.ndarray) -> pa.Array:
                offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().view(np.int64)))

            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("parts"), batch.column("a"), lists(left), lists(right), lists(inner)], ["key", "parts", "a", "left", "right", "inner"])

    return phrases.select("key", "parts", "a").mapInArrow(K.tidy(run), "key long, parts array<long>, a long, left array<long>, right array<long>, inner array<long>")


def mine_phrases(docs: DataFrame, most_words: int = 4, least: int = 30, top: int = 2000, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` collocations of each language.

    Texts (``text``, ``lang``) are lower-cased in A-Z and cut into pieces at . , ; : ! ? and line ends, pieces into words
    at blanks and tabs. ``n`` counts a language's words; phrases of 2 to ``most_words`` words of one piece that occur
    ``least`` times or more (``a``, overlaps included) are candidates. Of all cuts into a first part and a rest, which occur l and r
    times, the one of least score floor(2000000 a / (l + r)) counts, of equal ones the shortest first part. A candidate
    goes if a longer one holds it and has 100 * its count >= ``percent`` * a. Equal scores are ranked by a, then by phrase in byte order.

    A null text has no words; a null lang is ``und``. Repeated rows count each time. Texts of any length are read whole, some 60
    bytes of memory a byte for 2 MB of text at a time (or the one longer text). An empty table gives no rows; further columns of
    any name play no part. Phrases are told apart by 64-bit keys. The tables written on the way are removed at the end.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    total, levels, folders = mine_levels(given, most_words, least)
    words, longer = levels[0], levels[1:]
    folders.append(new_folder(spark))
    phrases = None
    for k, level in enumerate(longer, 2):
        part = _with_parts(level, k)
        phrases = part if phrases is None else phrases.unionByName(part)
    phrases = written(phrases, folders[-1])
    known = words.select("key", "a").unionByName(phrases.select("key", "a"))
    covered = phrases.select("a", F.explode("inner").alias("key")).groupBy("key").agg(F.max("a").alias("longest"))
    # Cut off from its aggregate, the join stands on plain exchanges.
    folders.append(new_folder(spark))
    covered = written(covered, folders[-1])
    left = phrases.join(covered, "key", "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * percent))
    cuts = left.select("key", "a", F.posexplode(F.arrays_zip("left", "right")).alias("cut", "of")).select("key", "a", "cut", "of.*")
    sides = cuts.join(known.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))")
    scored = sides.select("key", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("cut")).groupBy("key", "a").agg(F.min("cut").alias("cut"))
    named = (
        left.select("key", F.posexplode("parts").alias("at", "word_key")).join(words.select(F.col("key").alias("word_key"), "word", "lang"), "word_key")
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"), F.first("lang").alias("lang"))
        .select("key", "lang", F.array_join(F.transform("spelt", lambda x: x.word), " ").alias("phrase"))
    )
    rows = named.join(scored, "key").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = first_n(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, "place")
    out = best.join(total, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = written(out)
    for folder in folders:
        remove_folder(spark, folder)
    return out
