"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors,
each rotated by its place. A text is the sum (bundle) of its n-grams' vectors, a language the bundle of its documents.
A text gets the language whose prototype has the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
ORDER = 3
SYMBOLS = 2048  # code points share letter vectors modulo this; 0 is the border of a word
#: Documents of a language that teach its prototype, in expectation; chosen by hash of the doc_id, so the sample is bounded.
TEACH = 1500
LANGUAGES = 4096  # languages taught at most: those with the most documents
BLOCK = 4096  # n-grams bound at once
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Symbol of each code point: 0 for what is not a letter."""
    points = np.arange(0x110000)
    letter = np.array([chr(i).isalpha() for i in points])
    return np.where(letter, 1 + points % (SYMBOLS - 1), 0).astype(np.int64)


@cache
def _vectors(dimensions: int) -> tuple[np.ndarray, ...]:
    base = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
    return tuple(np.roll(base, place, axis=1).astype(np.int8) for place in range(ORDER))


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed, and their counts; none if it has no letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = np.zeros(len(points) + 2, np.int64)
    symbols[1:-1] = _letters()[points]
    symbols = symbols[np.append(True, (symbols[1:] != 0) | (symbols[:-1] != 0))]  # one border between words
    if not symbols.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = symbols[: len(symbols) - ORDER + 1].copy()
    for place in range(1, ORDER):
        packed = packed * SYMBOLS + symbols[place : len(symbols) - ORDER + 1 + place]
    return np.unique(packed, return_counts=True)


def bundle(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    grams, counts = ngrams(text)
    out = np.zeros(dimensions, np.float32)
    vectors = _vectors(dimensions)
    for lo in range(0, len(grams), BLOCK):
        left, bound = grams[lo : lo + BLOCK], None
        for place in reversed(range(ORDER)):
            one = vectors[place][left % SYMBOLS]
            left = left // SYMBOLS
            bound = one if bound is None else bound * one
        out += counts[lo : lo + BLOCK].astype(np.float32) @ bound.astype(np.float32)
    return out


def teach(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TEACH, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (rows of length 1), from about per_language documents of each, chosen by hash of the doc_id.

    Of more than LANGUAGES languages those with the most documents are taught. Rows without a doc_id or language don't teach; those without a text are chosen like others and add nothing.
    """
    rows = labelled.select("doc_id", F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND lang IS NOT NULL")
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    limit = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * 2.0**32
    chosen = rows.join(F.broadcast(most), "lang")  # LANGUAGES rows at most
    sample = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < limit).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = bundle(body, dimensions)
                size = np.linalg.norm(one)
                if size:
                    sums[name] = sums.get(name, 0) + one / size
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype(np.float64) for x in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    parts = sample.mapInArrow(vectors, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    names = sorted(sums["lang"].unique())
    out = np.zeros((len(names), dimensions), np.float64)
    out[pd.Categorical(sums["lang"], names).codes, sums["at"]] = sums["x"].round(6)
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """One row a document: doc_id, lang_pred, score.

    score is the cosine with the chosen prototype, from 0 to 1 (negative ones count as 0). Null and empty texts, texts
    without a letter, and every text if no language was taught, get ``und`` and 0. Ties go to the first language by name. Repeated
    rows are judged alike, and only doc_id and text are looked at.
    """
    names, prototypes = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for one in batch.column(1):
                vector = bundle(one.as_py(), prototypes.shape[1])
                size = np.linalg.norm(vector)
                cosines = prototypes @ vector / size if size and names else np.zeros(0)
                best = int(cosines.argmax()) if len(cosines) else -1
                langs.append(names[best] if best >= 0 else UNKNOWN)
                scores.append(float(min(max(cosines[best], 0.0), 1.0)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
