"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents; tokens get theirs from them: a token of a toxic document is toxic if its word, or the start
of its word, stands almost only in toxic documents of a bounded sample. The field has two states, transitions, and weights for
a token's word, the word's starts of several lengths, and the words before and after it, for all words and starts
that stand in some documents of the sample; it is fitted by gradient ascent on the likelihood. Forward-backward gives each token
of a text its marginal probability of being toxic. Marginals give the offending spans, and through a logistic layer fitted on
the documents' labels the document's score. The executors cut the sample's texts into numbers of features; only these are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import materialize, small_batches

STARTS = (4, 5, 6)  # bytes of a word's start that are features
KINDS = 1 + len(STARTS)
#: The sample that fits the model: about so many labelled documents of either class, and so many characters of them, chosen
#: by hash of the doc_id; documents of more than LONGEST characters don't teach.
TEACH, TEACH_CHARS, LONGEST = 2500, 6_000_000, 200_000
LEAST_DOCS = 4  # documents of the sample that a feature must stand in
MOST_FEATURES = 1 << 17  # features with weights, those in most documents
LEAST_LIFT = 20.0  # times more frequent in toxic documents than in others, for a feature that labels tokens
LANE = 64  # tokens a lane of the blocked scan
EPOCHS, STEPS, BATCH_TOKENS = 12, 60, 1 << 17  # times that each batch is looked at; steps at least
DECAY = 0.05  # of weights; WORD_DECAY of whole words, so that starts, which unseen words share, carry more
WORD_DECAY = 0.5
SLOTS = 1 << 22  # of the table in which features are looked up; of features that share one the most frequent stays

#: White space, ASCII marks and control characters part words.
PARTS = np.zeros(256, bool)
PARTS[[c for c in range(128) if not chr(c).isalnum()]] = True


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    """The words of some texts, and which are single characters of a script without spaces (U+3000 to U+9FFF)."""
    n = len(data)
    part, wide = PARTS[data], (data >= 0xE3) & (data <= 0xE9)
    mark = (data == 0xE2) & np.isin(np.append(data[1:], 0)[:n], (0x80, 0x81))  # U+2000 to U+207F: quotes and dashes
    for shift in range(3):
        part[shift:] |= mark[: n - shift]
    start = ~part
    start[1:] &= part[:-1]
    inner = offs[:-1][offs[:-1] < n]
    start[inner] = ~part[inner]
    start |= wide
    start[3:] |= wide[: n - 3] & ~part[3:]
    starts = np.flatnonzero(start)
    borders = np.append(np.flatnonzero(start | part), n)
    ends = borders[np.searchsorted(borders, starts) + 1] if n else starts
    return tk.Words(data, starts, ends, np.searchsorted(starts, offs)), wide[starts]


def token_features(data: np.ndarray, offs: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    """(words, features): hashes of each word in lower case (A-Z), and of its starts; 0 for a start longer than the word.

    Of a character without spaces around it, the start of six bytes goes on into the next one.
    """
    words, wide = tokens_of(data, offs)
    starts, size = words.starts, words.ends - words.starts
    n = len(starts)
    out = np.zeros((n, KINDS), np.uint64)
    if not n:
        return words, out
    folded = tk._BYTE[tk.LOWER[data]]
    hop = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(size.sum()) - np.repeat(hop, size)
    whole = folded[np.repeat(starts, size) + within] * tk._char_powers(int(size.max()))[within]
    out[:, 0] = tk.mix(np.add.reduceat(whole, hop) + size.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15))
    reach = size.copy()
    follows = wide[:-1] & wide[1:] & (starts[1:] == words.ends[:-1])
    reach[:-1][follows] = 6
    acc, power, columns = np.zeros(n, np.uint64), tk._char_powers(64), {s: 1 + j for j, s in enumerate(STARTS)}
    live = np.arange(n)
    for j in range(max(STARTS)):
        live = live[reach[live] > j]
        acc[live] += folded[starts[live] + j] * power[j]
        if j + 1 in columns:
            out[live, columns[j + 1]] = tk.mix(acc[live] + tk.U(j + 1))
    out[np.ix_(wide, [columns[s] for s in STARTS if s != 6])] = 0
    last = words.first[1:][np.diff(words.first) > 0] - 1  # a text's last character goes no further
    out[last[wide[last]], columns[6]] = 0
    return words, out


class Lexicon:
    """Numbers of features, by an exact look into a table of slots; -1 for those without a weight."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.full(SLOTS, -1, np.int32)
        self.table[(keys & tk.U(SLOTS - 1)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def numbers(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(features.shape, -1, np.int32)
        at = self.table[(features & tk.U(SLOTS - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.keys[at] == features), at, np.int32(-1))


@dataclass
class Field:
    keys: np.ndarray  # feature hashes with weights, one a slot
    weights: np.ndarray  # 3 rows: of a token's own features, of the word before it, of the word after it; a last column of 0
    bias: float
    stay: np.ndarray  # 2x2 transition factors
    start: np.ndarray  # 2 factors
    layer: np.ndarray  # logistic weights over document features

    def potentials(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """From numbers of features (-1 finds the weight 0), a row a token."""
        if not len(at):
            return np.zeros(0)
        before, after = neighbours(at[:, 0], first)
        return self.bias + self.weights[0][at].sum(1) + self.weights[1][before] + self.weights[2][after]

    def marginals(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(self.potentials(at, first), first, self.stay, self.start)[0]

    def score(self, marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(marginal, first) @ self.layer, -30, 30)))


def neighbours(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each; -1 at the borders of texts."""
    before, after = np.append(-1, word[:-1]), np.append(word[1:], -1)
    some = np.diff(first) > 0
    before[first[:-1][some]], after[first[1:][some] - 1] = -1, -1
    return before, after


def forward_backward(potential: np.ndarray, first: np.ndarray, stay: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token and expected transitions (2x2); exact, for all texts at once.

    Texts lie end to end: where one starts, the transition forgets the state before. The chain is cut into lanes that are
    walked side by side; first each lane's 2x2 product, then the states between lanes, then each token.
    """
    n = len(potential)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    lanes = -(-n // LANE)
    fresh = np.ones(lanes * LANE, bool)
    fresh[:n] = False
    fresh[first[:-1][np.diff(first) > 0]] = True
    top = np.maximum(potential, 0)
    psi = np.ones((2, lanes * LANE))
    psi[0, :n], psi[1, :n] = np.exp(-top), np.exp(potential - top)
    # moves[s][t]: factor from state s to state t into each token, by place in the lane and lane.
    moves = [[np.ascontiguousarray((np.where(fresh, start[t], stay[s, t]) * psi[t]).reshape(lanes, LANE).T) for t in (0, 1)] for s in (0, 1)]
    (m00, m01), (m10, m11) = moves

    a, b, c, d = m00[0].copy(), m01[0].copy(), m10[0].copy(), m11[0].copy()
    for j in range(1, LANE):
        a, b = a * m00[j] + b * m10[j], a * m01[j] + b * m11[j]
        c, d = c * m00[j] + d * m10[j], c * m01[j] + d * m11[j]
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    product = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
    into, outof, x, y = [], [], 0.5, 0.5
    for a, b, c, d in product:
        into.append((x, y))
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for a, b, c, d in reversed(product):
        outof.append((x, y))
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((2, LANE, lanes)), np.empty((2, LANE, lanes))
    x, y = np.array(into).T
    for j in range(LANE):
        x, y = x * m00[j] + y * m10[j], x * m01[j] + y * m11[j]
        size = x + y
        x, y = x / size, y / size
        alpha[0, j], alpha[1, j] = x, y
    x, y = np.array(outof[::-1]).T
    for j in range(LANE - 1, -1, -1):
        beta[0, j], beta[1, j] = x, y
        x, y = m00[j] * x + m01[j] * y, m10[j] * x + m11[j] * y
        size = x + y
        x, y = x / size, y / size
    flat = lambda z: z.T.reshape(-1)[:n]
    clean, bad = flat(alpha[0] * beta[0]), flat(alpha[1] * beta[1])
    marginal = bad / (clean + bad)
    inner = np.flatnonzero(~fresh[1:n]) + 1
    pair = np.array([[flat(alpha[s])[inner - 1] * flat(moves[s][t])[inner] * flat(beta[t])[inner] for t in (0, 1)] for s in (0, 1)])
    pair /= pair.sum(axis=(0, 1))
    return marginal, pair.sum(axis=2)


def document_features(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, log-odds of its likeliest token, log of the expected number of toxic tokens, and of their share."""
    counts = np.diff(first)
    some = counts > 0
    out = np.zeros((len(counts), 4))
    out[:, 0] = 1
    out[:, 1], out[:, 2], out[:, 3] = -9.0, np.log(1e-3), np.log(1e-3)
    if some.any():
        at = first[:-1][some]
        most, total = np.maximum.reduceat(marginal, at), np.add.reduceat(marginal, at)
        most = np.clip(most, 1e-4, 1 - 1e-4)
        out[some, 1] = np.log(most / (1 - most))
        out[some, 2] = np.log(total + 1e-3)
        out[some, 3] = np.log(total / counts[some] + 1e-3)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * p * (1 - p)
        w += np.linalg.solve((x * s[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def gradient(field: Field, at: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the log-likelihood of the tokens' labels: for weights, bias and the logs of the transition factors."""
    marginal, moved = forward_backward(field.potentials(at, first), first, field.stay, field.start)
    off = label - marginal
    k = field.weights.shape[1]
    before, after = neighbours(at[:, 0], first)
    weights = np.stack([np.bincount((at % k).ravel(), np.repeat(off, at.shape[1]), k), np.bincount(before % k, off, k), np.bincount(after % k, off, k)])
    weights[:, -1] = 0
    seen = np.zeros((2, 2))
    inner = np.ones(len(label), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    inner = np.flatnonzero(inner)
    np.add.at(seen, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
    return weights, float(off.sum()), seen - moved


def fit(keys: np.ndarray, words: np.ndarray, seeds: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> Field:
    """keys, which of them are whole words and which label tokens; docs: numbers of features, a row a token; weight: how many
    documents each stands for (the classes are sampled unevenly)."""
    k = len(keys)
    field = Field(keys, np.zeros((3, k + 1)), -3.0, np.array([[0.95, 0.05], [0.5, 0.5]]), np.array([0.95, 0.05]), np.zeros(4))
    batches, lo, size = [], 0, 0
    for hi, doc in enumerate(docs, 1):
        size += len(doc)
        if size >= BATCH_TOKENS or hi == len(docs):
            at, first = np.concatenate([np.zeros((0, KINDS), np.int32), *docs[lo:hi]]), np.concatenate([[0], np.cumsum([len(d) for d in docs[lo:hi]])])
            bad = np.repeat(toxic[lo:hi] == 1, np.diff(first))
            batches.append((at, first, (np.append(seeds, False)[at].any(1) & bad).astype(float)))
            lo, size = hi, 0
    if k:
        _ascend(field, words, batches)
    rows = [document_features(field.marginals(at, first), first) for at, first, _ in batches]
    field.layer = _logistic(np.concatenate(rows), toxic.astype(float), weight / weight.mean())
    return field


def _ascend(field: Field, words: np.ndarray, batches: list) -> None:
    """Likelihood gradient ascent with Adam, batch by batch, over weights, bias and transitions."""
    shape, n = field.weights.shape, field.weights.size
    decay = np.full(shape, WORD_DECAY)
    decay[0, :-1][~words] = DECAY
    theta = np.concatenate([field.weights.ravel(), [field.bias], np.log(field.stay).ravel()])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    share, steps = 1 / len(batches), max(STEPS, EPOCHS * len(batches))
    for step in range(1, steps + 1):
        at, first, label = batches[(step - 1) % len(batches)]
        weights, bias, moves = gradient(field, at, first, label)
        grad = np.concatenate([(weights - share * decay * field.weights).ravel(), [bias], (moves - share * DECAY * np.log(field.stay)).ravel()])
        mean, var = 0.9 * mean + 0.1 * grad, 0.98 * var + 0.02 * grad**2
        rate = 0.25 * STEPS / steps * (1 if step < 0.8 * steps else 0.3)
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.98**step)) + 1e-8)
        field.weights, field.bias, field.stay = theta[:n].reshape(shape), float(theta[n]), np.exp(theta[n + 1 :]).reshape(2, 2)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to (feature, word, toxic, clean): how many documents of either class have a feature, batch by batch."""
    for batch in batches:
        for lo, hi, data, offs in tk.text_chunks(batch.column(1)):
            bad = batch.column(0).slice(lo, hi - lo).to_numpy() == 1
            words, features = token_features(data, offs)
            text, flat, kind = np.repeat(words.text_of(), KINDS), features.ravel(), np.tile(np.arange(KINDS) == 0, len(features))
            order = np.lexsort((flat, text))
            text, flat, kind = text[order], flat[order], kind[order]
            once = flat != 0
            once[1:] &= (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
            values, where, back = np.unique(flat[once], return_index=True, return_inverse=True)
            counts = [np.bincount(back, some[text[once]], len(values)).astype(np.int64) for some in (bad, ~bad)]
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(kind[once][where]), *map(pa.array, counts)], ["feature", "word", "toxic", "clean"])


def encode(keys: np.ndarray):
    """Rows (doc_id, toxic, text) to (doc_id, toxic, numbers): KINDS numbers of features a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(keys)
        for batch in batches:
            for lo, hi, data, offs in tk.text_chunks(batch.column(2)):
                words, features = token_features(data, offs)
                numbers = tk.lists(lexicon.numbers(features).ravel(), words.counts * KINDS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), numbers], ["doc_id", "toxic", "numbers"])

    return run


def teach(docs: DataFrame, labels: DataFrame, training: Callable[[Column], Column] | None = None, per_class: int = TEACH) -> Field | None:
    """The field from documents and their labels (doc_id, toxic); None unless both classes have some.

    training, of a doc_id, says which rows may teach. About per_class labels of either class are chosen by hash of the
    doc_id (fewer, if their texts have more than TEACH_CHARS), so the sample has one size however many there are, and what
    is gathered is the numbers of its tokens' features. Labels other than 0 and 1, rows without a doc_id and documents of more than
    LONGEST characters don't teach; of several labels for one document the highest counts, of several rows one.
    """
    if training is not None:
        docs, labels = docs.filter(training(F.col("doc_id"))), labels.filter(training(F.col("doc_id")))
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = {k: min(1.0, per_class / counts[k]) for k in (0, 1)}
    limit = lambda: F.when(F.col("toxic") == 1, int(2**32 * share[1])).otherwise(int(2**32 * share[0]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**32))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter(F.length("text") <= LONGEST).join(F.broadcast(known.filter(place < limit())), "doc_id")  # 2 * per_class rows, about
    sample = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    chars = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    if len(chars) < 2:
        return None
    for k in (0, 1):
        share[k] *= min(1.0, TEACH_CHARS / max(1, chars[k]))
    sample = sample.filter(place < limit())

    with small_batches(docs.sparkSession):
        seen = sample.select("toxic", "text").mapInArrow(count_features, "feature bigint, word boolean, toxic bigint, clean bigint").groupBy("feature").agg(F.first("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        often = F.col("toxic") + F.col("clean")
        slot = F.col("feature").bitwiseAND(F.lit(SLOTS - 1))
        best = seen.filter(often >= LEAST_DOCS).groupBy(slot.alias("slot")).agg(F.max_by(F.struct("feature", "word", "toxic", "clean"), F.struct(often.alias("n"), F.col("feature"))).alias("f")).select("f.*")
        chosen = best.orderBy(often.desc(), "feature").limit(MOST_FEATURES).toArrow()
        keys = chosen.column("feature").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        words, bad, clean = (chosen.column(c).to_numpy()[order] for c in ("word", "toxic", "clean"))
        gathered = sample.select("doc_id", "toxic", "text").mapInArrow(encode(keys[order]), "doc_id bigint, toxic int, numbers array<int>").toArrow().sort_by("doc_id")
    toxic = gathered.column("toxic").to_numpy()
    if len(np.unique(toxic)) < 2:
        return None
    lift = (bad / toxic.sum()) / ((clean + 0.3) / (toxic == 0).sum())
    seeds = (bad >= LEAST_DOCS) & (lift >= LEAST_LIFT)
    numbers = gathered.column("numbers").combine_chunks()
    flat, offs = numbers.flatten().to_numpy().reshape(-1, KINDS), (numbers.offsets.to_numpy() - numbers.offsets[0].as_py()) // KINDS
    spread = np.argsort(tk.mix(gathered.column("doc_id").to_numpy().view(np.uint64)))  # so that batches are alike
    tokens = [flat[offs[i] : offs[i + 1]] for i in spread]
    return fit(keys[order], words.astype(bool), seeds, tokens, toxic[spread], np.where(toxic[spread] == 1, 1 / share[1], 1 / share[0]))


def score(docs: DataFrame, field: Field | None, least: float = 0.5) -> DataFrame:
    """One row a document: doc_id, score, spans (start and end, in characters, of runs of tokens with a marginal of least or more).

    Null, empty and wordless texts get the score of a text without any sign of toxicity, and no spans. Without a
    field (no labels of both classes) every score is 0. Repeated rows are scored alike. Only doc_id and text are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(field.keys) if field is not None else None
        for batch in batches:
            for lo, hi, data, offs in tk.text_chunks(batch.column(1)):
                n = hi - lo
                scores, spans = np.zeros(n), [[] for _ in range(n)]
                if field is not None:
                    words, features = token_features(data, offs)
                    marginal = field.marginals(lexicon.numbers(features), words.first)
                    scores = field.score(marginal, words.first)
                    text_of, chars = words.text_of(), np.cumsum((data & 0xC0) != 0x80)
                    for t in np.flatnonzero(marginal >= least):
                        own = text_of[t]
                        zero = chars[offs[own]] - 1
                        a, b = int(chars[words.starts[t]] - 1 - zero), int(chars[words.ends[t] - 1] - zero)
                        if spans[own] and t and text_of[t - 1] == own and marginal[t - 1] >= least:
                            spans[own][-1]["end"] = b
                        else:
                            spans[own].append({"start": a, "end": b})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start:int,end:int>>")
