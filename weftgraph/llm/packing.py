"""Concatenate and cut: documents end to end, cut into windows of a fixed number of tokens.

Pass one tokenises each text once, in its own partition, and keeps ids and the running token count within that
partition. The totals of the partitions (one number each) are summed in order to give every partition its global
offset. Pass two cuts at the multiples of the window with column expressions alone: each piece is a boundary record
that says which tokens of which document lie where in which sequence. No text or id is ever shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import broadcast_if_small, materialize

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, by word.

    No pre-token or special token spans ASCII white space, and none joins a letter or digit with marks after it, but for
    contractions; so a text's ids are those of its words, with marks at a word's end as words of their own. The tokenizer
    ignores case but in special tokens. Words met before are looked up by hash; beyond MOST of them memory starts afresh.
    """

    MOST = 2_500_000
    BATCH = 512
    BREAK = "\x01"  # stands alone between words that are encoded together; words that hold it are encoded by themselves

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.between = self._encode([self.BREAK])[0]
        self.forget()

    def forget(self) -> None:
        """Two sorted tables of (key, place, size): a large one, and a small one for what is new, merged into it now and then."""
        empty = np.zeros(0, np.int64)
        self.old = self.new = (np.zeros(0, np.uint64), empty, empty)
        self.store, self.stored = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _find(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], keys)
        inside = at < len(table[0])
        inside[inside] = table[0][at[inside]] == keys[inside]
        return at, inside

    @staticmethod
    def _put(table: tuple, rows: tuple) -> tuple:
        place = np.searchsorted(table[0], rows[0])
        return tuple(np.insert(t, place, r) for t, r in zip(table, rows, strict=True))

    def _remember(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.stored + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.stored], ids, np.zeros(self.stored + len(ids), np.uint32)])
        self.store[self.stored : self.stored + len(ids)] = ids
        self.new = self._put(self.new, (keys, self.stored + np.cumsum(sizes) - sizes, sizes))
        self.stored += len(ids)
        if len(self.new[0]) > 50_000 + len(self.old[0]) // 8:
            self.old = self._put(self.old, self.new)
            self.new = tuple(x[:0] for x in self.new)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words end to end, and how many each has."""
        flat, sizes = [], []
        for lo in range(0, len(words), self.BATCH):
            some = words[lo : lo + self.BATCH]
            joined = f" {self.BREAK} ".join(some)
            if len(self.between) != 1 or joined.count(self.BREAK) != len(some) - 1:
                got = self._encode(some)
                flat += got
                sizes.append([len(x) for x in got])
                continue
            ids = self._encode([joined])[0]
            cut = ids == self.between[0]
            flat.append(ids[~cut])
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1)
        return np.concatenate(flat), np.concatenate(sizes).astype(np.int64)

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (their bytes, and where each starts), and how many each has."""
        words = tk.words_of(data, offs)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        starts, ends, first = _split_marks(words)
        words = tk.Words(data, starts, ends, first)
        keys = words.hashes(lower=True)
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if len(special):
            special = np.unique(np.searchsorted(starts, special, "right") - 1)
            keys[special] = tk.mix(words.hashes()[special] + tk.U(1))
        keys, one, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) + len(keys) > self.MOST:
            self.forget()
        place, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for table in (self.old, self.new):
            at, hit = self._find(table, keys[left])
            place[left[hit]], size[left[hit]] = table[1][at[hit]], table[2][at[hit]]
            left = left[~hit]
        if len(left):
            raw, some = data.tobytes(), one[left]
            got, sizes = self.words([raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            place[left], size[left] = self.stored + np.cumsum(sizes) - sizes, sizes
            self._remember(keys[left], got, sizes)
        at, size = place[back], size[back]
        hop = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=hop[1:])
        ids = self.store[np.arange(hop[-1]) + np.repeat(at - hop[:-1], size)]
        return ids, hop[first[1:]] - hop[first[:-1]]


#: ASCII marks that neither start a contraction nor stand in a special token.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True
MARKS = 3  # the longest run of marks that is split off


def _split_marks(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, with a run of marks at the end split off where it follows an ASCII letter or digit, or a letter from U+C0 to U+FF."""
    data, starts, ends = words.data, words.starts, words.ends
    run = np.zeros(len(starts), np.int64)
    for k in range(1, MARKS + 2):
        here = np.maximum(ends - k, 0)
        run += (run == k - 1) & (ends - starts > k) & _MARK[data[here]]
    last = ends - run - 1
    latin = (last > starts) & (data[last] >= 0x80) & (data[last - 1] == 0xC3) & (data[last] != 0x97) & (data[last] != 0xB7)
    run[(run > MARKS) | ~(_PLAIN[data[last]] | latin)] = 0
    cut = run > 0
    shift = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(cut, out=shift[1:])
    place = np.arange(len(starts)) + shift[:-1]
    n = len(starts) + int(shift[-1])
    s, e = np.empty(n, np.int64), np.empty(n, np.int64)
    s[place], e[place] = starts, ends - run
    s[place[cut] + 1], e[place[cut] + 1] = (ends - run)[cut], ends[cut]
    return s, e, words.first + shift[words.first]


#: One a Python worker: what it has met stays for its next tasks.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(name)
        part, at, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for lo, hi, data, offs in tk.text_chunks(batch.column(1)):
                ids, sizes = _ENCODERS[name].ids(data, offs)
                n = hi - lo
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                whole = np.full(int(ends[-1]), end_id, "<u4")
                inner = np.ones(len(whole), bool)
                inner[ends - 1] = False
                whole[inner] = ids
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column(0).slice(lo, n), pa.array(at + ends - sizes), pa.array(sizes), binary],
                    ["part", "row", "doc_id", "local_start", "doc_tokens", "ids"],
                )
                at += int(ends[-1])
                row += n

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are followed by end_id, so null and empty texts give one piece of one token. Repeated rows are
    packed each for itself, null ids stay null. No documents, no pieces. Only the last sequence can be short.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = materialize(rows.mapInArrow(_encoder(tokenizer, end_id), "part int, row bigint, doc_id bigint, local_start bigint, doc_tokens bigint, ids binary"), "encoded")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a partition
    placed = encoded.join(broadcast_if_small(offsets), "part").withColumn("at", F.col("base") + F.col("local_start"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("doc_tokens") - 1) / length)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("at"), F.col("sequence_id") * length)
    hi = F.least(F.col("at") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * length)
    cut = cut.select("doc_id", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"), "doc_tokens", "sequence_id", (lo - F.col("sequence_id") * length).alias("offset"), "ids")
    piece = F.expr("substring(ids, CAST(4 * start + 1 AS INT), CAST(4 * length AS INT))")
    return cut.select("doc_id", "start", "length", piece.alias("ids"), "doc_tokens", "sequence_id", "offset")
