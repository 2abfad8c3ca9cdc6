"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and one failure bit a rule.
Policies are versioned masks over these bits, so a change of policy and an ablation (what would be kept
without one rule) are bitwise operations over the ledger and never read the texts again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_next_same")
WINDOW = 5  # words in a window of n_repeat_words
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True

#: (name, SQL condition over the measurements that makes a document fail). A rule's bit is its place here.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 10"),
    ("repeats_itself", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "10 * n_upper > 4 * word_chars"),
    ("stutters", "100 * n_next_same > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines * 5 > n_words"),
)
BASE = ("too_short", "repeats_itself")
#: Versioned policies: the rules each one applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "stutters"),
    "v2": (*BASE, "symbols", "shouting", "stutters", "word_length", "repeated_lines"),
}


@dataclass(frozen=True)
class Rules:
    rules: tuple[tuple[str, str], ...] = RULES

    def bit(self, name: str) -> int:
        return 1 << [n for n, _ in self.rules].index(name)

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(self.bit(n) for n in names)


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for lo, hi, data, offs in tk.text_chunks(column):
        n = hi - lo
        words = tk.words_of(data, offs)

        def total(flags: np.ndarray, offs=offs) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[offs[1:]] - sums[offs[:-1]]

        hashes = words.hashes()
        text_of = words.text_of()
        covered = np.zeros(len(hashes) + 1, np.int64)
        runs = tk.Rolling(hashes).runs(WINDOW)
        if len(runs):
            inside = np.flatnonzero(text_of[: len(runs)] == text_of[WINDOW - 1 :])
            keys = tk.mix(runs[inside] + text_of[inside].astype(np.uint64) * tk.U(0xA24BAED4963EE407))
            _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
            starts = inside[times[back] > 1]
            covered[starts] += 1
            np.subtract.at(covered, starts + WINDOW, 1)
        same = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        first = words.first
        out["n_words"].append(words.counts)
        out["word_chars"].append(total(~tk.IS_SPACE[data] & ((data & 0xC0) != 0x80)))
        out["n_symbols"].append(total(SYMBOL[data]))
        out["n_upper"].append(total(UPPER[data]))
        out["n_repeat_words"].append(total(np.cumsum(covered[:-1]) > 0, first))
        out["n_next_same"].append(total(same, first))
        raw, dup = data.tobytes(), np.zeros(n, np.int64)
        for i in range(n):
            lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
        out["n_dup_lines"].append(dup)
    return {m: np.concatenate(v) if v else np.zeros(0, np.int64) for m, v in out.items()}


def _measured(texts: pa.Array) -> pa.Array:
    got = _measure(texts)
    return pa.StructArray.from_arrays([pa.array(got[m], pa.int64()) for m in MEASURES], list(MEASURES))


def with_ledger(docs: DataFrame, rules: Rules | None = None, name: str = "ledger") -> DataFrame:
    """docs with one more column, a struct of the measurements and fail_bits, with bit k set if rule k fails.

    Null and empty texts have no words and so fail too_short. Every row is measured for itself and no row moves. A column
    of docs that has that name already is replaced.
    """
    rules = rules or Rules()
    measure = F.arrow_udf(_measured, "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    bits = F.lit(0).cast("bigint")
    rows = docs.withColumn(name, measure(F.col("text").cast("string")))
    for k, (_, cond) in enumerate(rules.rules):
        names = re.sub(r"\b([a-z]+(?:_[a-z]+)+)\b", lambda m: f"`{name}`.{m[1]}", cond)
        bits = bits + F.when(F.expr(names), F.lit(1 << k)).otherwise(0)
    return rows.withColumn(name, F.col(name).withField("fail_bits", bits))


def ledger(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row a document: doc_id, the measurements, and fail_bits. Null ids stay null, repeated rows give repeated rows."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_ledger(rows, rules, "ledger").select("doc_id", "ledger.*")


def passes(policy: str = "v1", rules: Rules | None = None, bits: str = "fail_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit((rules or Rules()).mask(POLICIES[policy]))) == 0


def apply_policy(book: DataFrame, policy: str = "v1", rules: Rules | None = None) -> DataFrame:
    """The ledger with kept: no rule of the policy failed."""
    return book.withColumn("kept", passes(policy, rules))


def ablations(book: DataFrame, policy: str = "v1", rules: Rules | None = None) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it."""
    rules = rules or Rules()
    whole = rules.mask(POLICIES[policy])
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole))
    counts = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    out = None
    for name in POLICIES[policy]:
        bit = rules.bit(name)
        row = counts.agg(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias("fails"),
            F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("fails_alone"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(whole & ~bit)) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
        out = row if out is None else out.unionByName(row)
    return out
