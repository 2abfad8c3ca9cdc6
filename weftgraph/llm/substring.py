"""Removal of repeated word passages by seed and extend.

Seeds: every window of LENGTH words has one anchor, the least-hashed k-gram in it (winnowing), so equal windows have
equal anchors at the same place. Extension: an anchor's stretch is all the words, left and right, of the windows that
it stands for. Occurrences with equal anchor and equal stretch are repeated as a whole and are settled by counting.
Of each other stretch under a shared anchor, only one occurrence is extended window by window, to find how far left
and right it matches the rest; so a passage that a million documents share costs one extension a distinct context, and
counts are pre-aggregated before they meet. Windows marked as repeated overlap to the maximal repeats, and their words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .scratch import materialize, shuffled_join

LENGTH = 35
SEED = 5
_LOW = tk.U((1 << 31) - 1)


class Anchors:
    """The anchors of some texts: k-gram hash, stretch hash, and the first and last window that each stands for."""

    def __init__(self, words: tk.Words, length: int, seed: int):
        self.rolling = tk.Rolling(words.hashes())
        grams = self.rolling.runs(seed)
        counts = words.counts
        self.windows = np.maximum(counts - length + 1, 0)
        text = np.repeat(np.arange(len(counts)), self.windows)
        hop = np.cumsum(self.windows) - self.windows
        starts = np.arange(len(text)) - hop[text] + words.first[text]
        if len(starts):
            key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # ties go to the leftmost
            width, span = length - seed + 1, 1
            while 2 * span <= width:
                key = np.minimum(key[:-span], key[span:])
                span *= 2
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
            place = (key[starts] & _LOW).astype(np.int64)
            head = np.ones(len(starts), bool)
            head[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(starts)) - 1
            self.text, self.lo, self.hi = text[heads], starts[heads], starts[tails]
            at = place[heads]
            self.gram = grams[at]
            self.stretch = tk.mix(self.rolling.spans(self.lo, self.hi + length) + (at - self.lo).astype(np.uint64) * tk.U(0xC2B2AE3D27D4EB4F))
        else:
            self.text = self.lo = self.hi = np.zeros(0, np.int64)
            self.gram = self.stretch = np.zeros(0, np.uint64)
        self.length = length

    def of(self, i: int) -> slice:
        return slice(*np.searchsorted(self.text, [i, i + 1]))


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in tk.text_chunks(batch.column(2)):
                found = Anchors(tk.words_of(data, offs), length, seed)
                own = np.arange(len(found.text)) - np.searchsorted(found.text, found.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo + found.text], pa.int64()), pa.array(k2[lo + found.text], pa.int64()), pa.array(own.astype(np.int32)), pa.array(found.gram.view(np.int64)), pa.array(found.stretch.view(np.int64))],
                    ["k1", "k2", "i", "gram", "stretch"],
                )

    return run


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in [start, end) of any span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, ends, 1)
    return np.cumsum(step[:-1]) > 0


def _kept(text: bytes, gone: np.ndarray | None, digest: bool) -> bytes:
    """The text without the words that are gone; for a digest, its words joined by one space."""
    if digest:
        words = text.split()
        return b" ".join(words if gone is None or not gone.any() else compress(words, ~gone))
    if gone is None or not gone.any():
        return text
    words = tk.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    stay = np.concatenate([[False], ~gone, [False]])
    first, last = np.flatnonzero(stay[1:-1] & ~stay[:-2]), np.flatnonzero(stay[1:-1] & ~stay[2:])
    return b" ".join(text[a:b] for a, b in zip(words.starts[first], words.ends[last], strict=True))


#: What a document is told of one of its anchors: its windows are all repeated; extend it and ask for each; all are
#: repeated, and extend it for others.
SETTLED, ASK, HELP = 0, 1, 2


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            texts = pa.array([pack(t) for t in some.column(3).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], texts], ["k1", "k2", "row", "text"])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def _by_size(texts: list[bytes], limit: int = tk.CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _extend(length: int, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        own_id = TaskContext.get().partitionId() << 40  # numbers the rows of the table that is written
        for batch in batches:
            for some in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                packed = some.column(3).to_pylist()
                texts, told_all = [unpack(t) for t in packed], some.column(4).to_pylist()
                for lo, hi in _by_size(texts):
                    words = tk.words_of(*_joined(texts[lo:hi]))
                    found = Anchors(words, length, seed)
                    out: dict[str, list] = {x: [] for x in ("n", "gone", "kept", "text", "spans", "gram", "window", "start", "weight")}
                    for i in range(hi - lo):
                        text, told = texts[lo + i], told_all[lo + i]
                        first, n = words.first[i], int(words.counts[i])
                        spans, gram, window, start, weight = np.zeros(0, np.int64), [], [], [], []
                        gone, asks = None, False
                        if told:
                            said, own = np.array(told, np.int64), found.of(i)
                            a, b, g = found.lo[own], found.hi[own], found.gram[own]
                            done = said[said % 3 != ASK] // 3
                            spans = np.column_stack([a[done] - first, b[done] - first + length]).ravel()
                            gone = _covered(n, spans[::2], spans[1::2])
                            for j in said[said % 3 != SETTLED]:
                                at = np.arange(a[j // 3], b[j // 3] + 1)
                                gram.append(np.full(len(at), g[j // 3]))
                                window.append(found.rolling.spans(at, at + length))
                                start.append(at - first)
                                weight.append(np.full(len(at), j % 3))
                                asks |= bool(j % 3 == ASK)
                        out["n"].append(n)
                        out["gone"].append(int(gone.sum()) if gone is not None else 0)
                        body = None if asks else _kept(text, gone, digest)
                        out["kept"].append(None if asks else hashlib.sha256(body).hexdigest().encode() if digest else pack(body))
                        out["text"].append(packed[lo + i] if asks else None)
                        out["spans"].append(spans if asks else spans[:0])
                        for name, got, kind in (("gram", gram, np.uint64), ("window", window, np.uint64), ("start", start, np.int64), ("weight", weight, np.int64)):
                            out[name].append(np.concatenate(got).astype(kind).view(np.int64) if got else np.zeros(0, np.int64))
                    nested = lambda name, kind: tk.lists(np.concatenate(out[name]), np.array([len(x) for x in out[name]]), kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(own_id, own_id + hi - lo)), some.column(2).slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["kept"], pa.binary()), pa.array(out["text"], pa.binary()), nested("spans", pa.int32()), nested("gram", pa.int64()), nested("window", pa.int64()), nested("start", pa.int32()), nested("weight", pa.int32())],
                        ["own", "row", "n_words", "n_removed", "kept", "text", "spans", "gram", "window", "start", "weight"],
                    )
                    own_id += hi - lo

    return run


def _finish(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for some in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                n_words, n_gone = some.column(1).to_pylist(), some.column(2).to_pylist()
                kept, texts, spans, starts = (some.column(c) for c in (3, 4, 5, 6))
                gone_out, kept_out = [], []
                for i in range(some.num_rows):
                    if kept[i].is_valid:
                        gone = n_gone[i]
                        body = kept[i].as_py().decode() if digest else unpack(kept[i].as_py()).decode()
                    else:
                        span = np.array(spans[i].as_py() or [], np.int64)
                        more = np.array(starts[i].as_py() or [], np.int64)
                        mask = _covered(n_words[i], np.append(span[::2], more), np.append(span[1::2], more + length))
                        raw, gone = _kept(unpack(texts[i].as_py()), mask, digest), int(mask.sum())
                        body = hashlib.sha256(raw).hexdigest() if digest else raw.decode()
                    gone_out.append(gone)
                    kept_out.append(body)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(gone_out, pa.int64()), pa.array(kept_out, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, digest: bool = False) -> DataFrame:
    """One row a document: row (a struct of all columns but text), n_words, n_removed, kept (the text left).

    Between words that stay together the text keeps its own spacing; elsewhere one space stands. With digest, kept
    is the SHA-256 of the words left, joined by one space, and row has doc_id alone.

    A word goes if a window of length consecutive words that covers it also starts elsewhere, in this document or
    another. Null and empty texts have no words and keep the empty text. Repeated rows count as copies of each other;
    null ids stay null.
    """
    doc_id = F.col("doc_id").cast("bigint")
    # Rows are told apart by id and text: rows equal in both are copies and fare alike.
    row = F.struct(doc_id.alias("doc_id")) if digest else F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    texts = docs.select(F.coalesce(doc_id, F.lit(-1)).alias("k1"), F.xxhash64(doc_id, "text").alias("k2"), row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    anchors = texts.select("k1", "k2", "text").mapInArrow(_anchors(length, seed), "k1 bigint, k2 bigint, i int, gram bigint, stretch bigint")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most")).filter("n > 1")
    shared = shuffled_join(anchors, grams.select("gram", (F.col("least") != F.col("most")).alias("mixed")), ["gram"])
    # Where all stretches under an anchor agree, that is all there is to know.
    shared = materialize(shared.select("k1", "k2", "i", *(F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("gram", "stretch"))), "shared")
    settled = shared.filter("gram IS NULL").select("k1", "k2", (F.col("i") * 3 + SETTLED).alias("said"))
    mixed = shared.filter("gram IS NOT NULL").withColumn("one", F.xxhash64("k1", "k2", "i"))
    stretches = mixed.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min("one").alias("first"))
    several, chosen = F.col("n") > 1, F.col("one") == F.col("first")
    code = F.when(several & chosen, HELP).when(several, SETTLED).otherwise(ASK)
    extended = shuffled_join(mixed, stretches, ["gram", "stretch"]).select("k1", "k2", (F.col("i") * 3 + code).alias("said"))
    told = settled.unionByName(extended).groupBy("k1", "k2").agg(F.collect_set("said").alias("told"))

    packed = texts.select("k1", "k2", "row", "text")
    carried = T.StructField("row", texts.schema["row"].dataType)  # as an object: its names may need quotes in text

    def schema_of(before: str, after: str) -> T.StructType:
        parsed = [list(T.StructType.fromDDL(x)) if x else [] for x in (before, after)]
        return T.StructType([*parsed[0], carried, *parsed[1]])

    packed = packed.mapInArrow(_squeeze, schema_of("k1 bigint, k2 bigint", "text binary"))
    asked = shuffled_join(packed, told, ["k1", "k2"], "left").select("k1", "k2", "row", "text", "told")
    schema = schema_of("own bigint", "n_words bigint, n_removed bigint, kept binary, text binary, spans array<int>, gram array<bigint>, window array<bigint>, start array<int>, weight array<int>")
    state = materialize(asked.mapInArrow(_extend(length, seed, digest), schema), "state")

    windows = state.filter(F.size("gram") > 0).select("own", F.explode(F.arrays_zip("gram", "window", "start", "weight")).alias("w")).select("own", "w.*")
    found = windows.groupBy("gram", "window").agg(F.sum("weight").alias("n"), F.min("weight").alias("least"))
    found = found.filter((F.col("n") > 1) & (F.col("least") == ASK)).select("gram", "window")
    asking = windows.filter(F.col("weight") == ASK).select("own", "gram", "window", "start")
    replies = shuffled_join(asking, found, ["gram", "window"]).groupBy("own").agg(F.collect_list("start").alias("starts"))

    done = ["row", "n_words", "n_removed", "kept", "text", "spans"]
    settled_rows = state.filter(F.col("kept").isNotNull()).select(*done, F.lit(None).cast("array<int>").alias("starts"))
    open_rows = shuffled_join(state.filter(F.col("kept").isNull()).select("own", *done), replies, ["own"], "left").select(*done, "starts")
    return settled_rows.unionByName(open_rows).mapInArrow(_finish(length, digest), schema_of("", "n_words bigint, n_removed bigint, kept string"))
