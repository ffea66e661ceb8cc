"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import seqloom
from seqloom.llm import catalog, minhash, mixing, packing, rules, substrings
from seqloom.session import new_folder, remove_folder

# Kernels travel to the Python workers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(seqloom)


def _held(docs: DataFrame, *apart: str) -> tuple[str, Column]:
    """A free name, and all columns but ``apart`` as one of that name: the stages' own columns clash with none of them."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return name, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in apart]).alias(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rules. Repeated rows are judged alike; an empty table stays one. Columns of any name are kept.
    """
    name, row = _held(docs)
    labels = catalog.table(spark, sf_dir, "labels")
    return rules.quality_rules(docs.select("doc_id", "text", "lang", row), labels, [name]).where("kept").select(f"{name}.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Rows that share a doc_id are one document. A row without doc_id is found again by its text; it stays if nothing
    with a doc_id is near it. Texts without words stay. Columns of any name are kept.
    """
    name, row = _held(docs)
    plain = docs.select("doc_id", "text")
    kept = minhash.near_duplicates(plain, with_node=True).where("kept").select("node").distinct()
    return docs.select(minhash.node_key().alias("node"), row).join(kept, "node", "left_semi").select(f"{name}.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; texts of which nothing is left go.

    Texts of which nothing is cut, null ones too, stay as they are. Rows without doc_id count as last; rows that share one
    take nothing from each other. ``n_chars``, if there, follows the text. Other columns of any name are kept.
    """
    name, row = _held(docs, "text")
    cut = substrings.remove_passages(docs.select("doc_id", "text", row, F.col("text").isNull().alias("none")), [name, "none"], with_text=True, untouched=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(~F.col("none"), F.col("kept_text"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[made[c].alias(c) if c in made else F.col(f"{name}.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Texts without words have no size and are not taken. A null source is one of its own. Columns of any name are kept.
    """
    name, row = _held(docs)
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source", row), carry=(name,))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(f"{name}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    A null text is an empty one, of the end token alone. Repeated rows are packed each time; other columns play no part.
    """
    return packing.pack_documents(docs, catalog.tokenizer_path())


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_near_copies),
    ("repeated passages", cut_repeated_passages),
    ("source mix", mix),
    ("packing", pack),
]

#: No SQL states a tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. A stage's table is removed when the next one is written; the last stays for the result."""
    docs, before = catalog.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
