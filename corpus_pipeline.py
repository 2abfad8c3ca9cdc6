"""A training corpus from raw documents: quality, near-duplicates, repeated passages, mix, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import minhash, mixing, packing, quality, substring
from weftgraph.llm.scratch import materialize, shuffled_join


#: Word shingles of five words and this similarity, in percent, make documents near-duplicates here.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality policy, as they are.

    Null, empty and wordless texts have fewer words than the policy asks for and go. Each row is judged by its own text, so
    repeated rows stay or go together, and rows without a doc_id are judged like others.
    """
    judged = quality.with_ledger(docs, name="__weft_ledger")
    return judged.filter(quality.passes(bits="__weft_ledger.fail_bits")).drop("__weft_ledger")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, at NEAR_PERCENT: that with the least doc_id, rows without one last.

    Each row is a document of its own, also where rows share a doc_id or have none; of rows that stand twice one stays.
    Null, empty and wordless texts are no duplicates of anything and stay.
    """
    key = "__weft_key"
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if odd:  # rows are told apart by a number of their own
        keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    else:
        keyed = docs.withColumn(key, F.col("doc_id").cast("bigint"))
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent=NEAR_PERCENT)
    if odd:
        found = materialize(found.filter("n_shingles > 0").select(F.col("doc_id").alias(key), F.col("component_id").alias("__weft_group")), "groups")
        ids = shuffled_join(keyed.select(key, F.col("doc_id").alias("__weft_id")), found, [key])
        first = F.min(F.struct(F.col("__weft_id").isNull().alias("none"), "__weft_id", key)).alias("first")
        stays = ids.groupBy("__weft_group").agg(first).select(F.col(f"first.{key}").alias(key))
        gone = shuffled_join(found.select(key), stays, [key], "left_anti")
    else:
        gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return shuffled_join(keyed, gone, [key], "left_anti").drop(key)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated passages; a null text becomes empty, and n_chars follows the text.

    Every row stays, with no words if all of them repeat. Passages of repeated rows repeat, so they go from each of them.
    """
    found = substring.remove_repeats(docs)
    columns = [F.col("kept") if c == "text" else F.length("kept").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*(column.alias(c) for column, c in zip(columns, docs.columns, strict=True)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, up to three times.

    Null sources are one source, the last. Texts without a word are taken no time. Repeated rows have one hash and are taken
    alike; a row without a doc_id is hashed by its text.
    """
    return mixing.Mix(docs).documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with the crc32 of their ids.

    Null and empty texts are one token, the end of a document. Repeated rows are packed each for itself; null ids stay null.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express hashing with densification, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
