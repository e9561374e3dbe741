"""The stages that turn raw documents into a sharded training mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import decontaminate, language, mixing, queries, sharding, simhash
from patronage.session import scratch_path


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter, or torn between languages, go.

    A null or empty text has no letter. The text alone decides, so repeated rows stay or go together, and null ids do
    not matter; long texts are read whole. Nothing is left of an empty table, or where no language can be learned.
    """
    found = language.identify(docs, language.learn(docs))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null and empty texts are near copies of each other, and one of them stays. A null id comes after all others; of rows equal in id
    and text one stays. An empty table stays empty. Length makes no difference. Which edits still make a near copy follows from the
    shingles and the radius, which are those of the query.
    """
    return simhash.keep_one(docs, shingle_words=3, radius=2)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; contaminated ones go as a whole.

    An item of fewer than five words counts only where a line or a sentence is that item. Null and empty texts hold
    none and stay, as does everything beside an empty benchmark; equal rows stay or go together; long texts are searched whole.
    """
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"), short_items=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document a whole number of times, as often as brings its source near its target.

    A document without words (a null or empty text) is never taken. Null sources are one source, the last. Rows equal in id, source and
    text are taken together. An empty table stays empty.
    """
    return mixing.blend(docs)


def on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard each belongs to: every row has one, null ids and texts too, and equal rows the same."""
    return sharding.place(docs, queries.SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", in_a_language),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
    ("sharding", on_shards),
]

#: The language classifier is trained, which SQL cannot express. Tests hold what run() makes of the documents of the language
#: stage against plain Python, on a whole table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next.

    Nulls, empty and very long texts, repeated rows and empty tables go through as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
