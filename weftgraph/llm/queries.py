"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id, parts: int, part: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.Mix(_table(spark, sf_dir, "documents")).table().select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    rules = quality.Rules()
    judged = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents"), rules), "v1", rules)
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask(quality.BASE))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    held = lambda doc_id: F.coalesce(_held_out(doc_id, 3, 1), F.lit(False))
    field = toxicity.teach(docs, _table(spark, sf_dir, "labels"), lambda doc_id: ~held(doc_id))
    scored = toxicity.score(docs, field)
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    found = substring.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)
    return found.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    held = lambda doc_id: F.coalesce(_held_out(doc_id, 5, 0), F.lit(False))
    model = langid.teach(docs.filter(~held(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quotes

    return quotes.link(_table(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    found = topk.top_k(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = """
WITH whole AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _sql() -> dict[str, str]:
    from . import sql
    from .mixing import MIX_SQL

    return {"op1_mixing": MIX_SQL, "op2_quality": sql.QUALITY, "op4_urlfilter": sql.urls(), "op5_substring": sql.SUBSTRING, "op7_quotes": sql.QUOTES, "op9_minhash": sql.NEAR, "op10_topk": TOPK_SQL}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_urlfilter": op4_urlfilter,
    "op5_substring": op5_substring,
    "op6_langid": op6_langid,
    "op7_quotes": op7_quotes,
    "op8_packing": op8_packing,
    "op9_minhash": op9_minhash,
    "op10_topk": op10_topk,
}

SQL: dict[str, str] = _sql()
