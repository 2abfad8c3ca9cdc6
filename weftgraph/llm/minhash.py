"""Near-duplicates by one-permutation hashing with optimal densification.

A text's set of word shingles is hashed once; the hash range is cut into equal bins and the least hash of each bin
is the sketch, an empty bin borrowing from a randomly chosen bin that is not empty. Bands of the sketch are bucket
keys. Texts with equal sets are one class from the start, so copies never meet in a bucket. First every class of a
bucket is joined with one centre: the class that shares its buckets with the most others, which in a group of
variants is the one nearest to all of them. Links are confirmed on the full sets. Where the other classes of a bucket
then still are in more than one component, all of them are compared with each other: the bucket is dealt into groups,
each two groups meet in one cell, and a cell counts what its sets share by products of 0/1 matrices. So every two
classes of a bucket are compared or in one component, while the rows follow the classes, not their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import join, materialize, shuffled_join

SHINGLE = 5
BANDS, ROWS = 32, 6
PERCENT = 85
#: A group of a bucket has about so many classes and shingles at most; a cell has two groups.
GROUP, GROUP_SHINGLES = 512, 1_000_000
#: Up to so many links are made components in one task, 16 bytes each.
ONE_TASK = 1 << 20
#: Rows without an id get one above all others, made from the text.
NO_ID = 1 << 62


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of its whole word sequence, if that is shorter."""
    for lo, hi, data, offs in tk.text_chunks(column):
        words = tk.words_of(data, offs)
        rolling = tk.Rolling(words.hashes(lower=True))
        runs, first = rolling.runs(shingle), words.first
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= shingle:
                got = np.sort(runs[a : b - shingle + 1])
                keep = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                yield got[keep]
            else:
                yield rolling.spans(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


class Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.bounds = np.array([(j * 2**64 + self.k - 1) // self.k for j in range(self.k)], np.uint64)

    def bins(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least hash of each bin, and which bins have one."""
        at = np.searchsorted(hashes, self.bounds)
        full = np.append(at[1:], len(hashes)) > at
        return np.where(full, hashes[np.minimum(at, len(hashes) - 1)], 0).astype(np.uint64), full

    def densify(self, values: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Each empty bin takes the value of the first full bin in its own fixed random sequence of bins."""
        text, column = np.nonzero(~full)
        attempt = 0
        while len(text):
            attempt += 1
            source = (tk.mix(column.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15) + tk.U(attempt * 0x632BE59BD9B4E019 % 2**64)) % tk.U(self.k)).astype(np.int64)
            hit = full[text, source]
            values[text[hit], column[hit]] = values[text[hit], source[hit]]
            text, column = text[~hit], column[~hit]
        return values

    def keys(self, values: np.ndarray) -> np.ndarray:
        grouped = values.reshape(len(values), self.bands, self.rows)
        out = np.tile(tk.mix(np.arange(1, self.bands + 1, dtype=np.uint64)), (len(values), 1))
        for r in range(self.rows):
            out = tk.mix(out * tk.U(0xD6E8FEB86659FD93) + grouped[:, :, r])
        return out


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, rows)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = list(shingle_sets(part.column(1), shingle))
                n = len(sets)
                values, full = np.zeros((n, sketcher.k), np.uint64), np.zeros((n, sketcher.k), bool)
                some = np.array([len(s) > 0 for s in sets], bool)
                h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        values[i], full[i] = sketcher.bins(s)
                        h1[i], h2[i] = tk.mix(s ^ tk.U(0x5851F42D4C957F2D)).sum(), tk.mix(s + tk.U(0x14057B7EF767814F)).sum()
                keys = np.zeros((n, bands), np.uint64)
                if some.any():
                    keys[some] = sketcher.keys(sketcher.densify(values[some], full[some]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), tk.lists(keys[some].ravel().view(np.int64), np.where(some, bands, 0), pa.int64())],
                    ["node", "told", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            linked = np.zeros(len(u), bool)
            last, centre = None, None
            for lo in range(0, len(u), 512):
                others = shingle_sets(batch.column(3).slice(lo, 512), shingle)
                for i, other in enumerate(others, lo):
                    if last != u[i]:
                        last, centre = u[i], next(shingle_sets(batch.column(2).slice(i, 1), shingle))
                    small, large = (centre, other) if len(centre) < len(other) else (other, centre)
                    if 100 * len(small) < percent * len(large) or not len(small):
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    linked[i] = 100 * both >= percent * (len(small) + len(large) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[linked]), pa.array(v[linked])], ["u", "v"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two different sets share, exactly: sums stay far below 2**24."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    joined = np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    fresh = np.append(True, joined[1:] != joined[:-1])
    column = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1
    owner, column = owner[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        some = np.zeros((len(sets), 2048), np.float32)
        some[owner[a:b], column[a:b] - lo] = 1
        both += some @ some.T
    return both.astype(np.int64)


def _bridges(nodes: np.ndarray, components: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of nodes that join all components which links of these sets join."""
    both, size = _common(sets), np.array([len(s) for s in sets])
    linked = np.triu(100 * both >= percent * (size[:, None] + size[None] - both), 1) & (components[:, None] != components[None])
    parent: dict[int, int] = {}
    out = []
    for i, j in np.argwhere(linked):
        x, y = int(components[i]), int(components[j])
        while parent.get(x, x) != x:
            x = parent[x]
        while parent.get(y, y) != y:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _compare(shingle: int, percent: int):
    """Rows (cell, rep, component, text) come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            found = _bridges(np.array(nodes), np.array(comps), sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        cell, nodes, comps, sets = None, [], [], []
        for batch in batches:
            cells, reps, component = (batch.column(k).to_pylist() for k in range(3))
            for i, s in enumerate(shingle_sets(batch.column(3), shingle)):
                if cells[i] != cell:
                    yield links()
                    cell, nodes, comps, sets = cells[i], [], [], []
                if len(s):
                    nodes.append(reps[i])
                    comps.append(component[i])
                    sets.append(s)
        yield links()

    return run


def _cells(members: DataFrame) -> DataFrame:
    """(rep, component, cell): each two classes of a bucket meet in a cell, if the bucket has more than one component.

    members (key, rep, n_shingles, component) has a bucket's classes. Of buckets with the same classes one is taken.
    """
    totals = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    groups = F.ceil(F.greatest(F.col("n") / GROUP, F.col("shingles") / GROUP_SHINGLES)).cast("int")
    open_ = totals.filter("low < high").groupBy("n", "shingles", "sum").agg(F.min("key").alias("key")).select("key", groups.alias("g"))
    mine = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("g")).cast("int")
    dealt = join(members, materialize(open_, "open"), ["key"]).withColumn("mine", mine)
    others = F.expr("IF(g = 1, array(0), filter(sequence(0, g - 1), x -> x <> mine))")
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("rep", "component", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"))


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in edges (u, v) and the least id connected with each: least labels of neighbours, and of these labels' labels."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(ids))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_labels(*map(np.concatenate, zip(*ends, strict=True)))], ["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (u, v): the least id connected.

    Up to ONE_TASK edges, counted before, are followed in one task; more by alternating large-star and small-star.
    """

    def spread(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = shuffled_join(e, least, ["u"])
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = least.filter("m < u").select("u", F.col("m").alias("v"))
        return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()

    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_in_one_task, "id bigint, component bigint")
    edges = materialize(edges.distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = materialize(spread(spread(edges, True), False), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept.

    Two documents are linked if the Jaccard similarity of their shingle sets is percent or more. Null, empty and
    wordless texts have no shingles and link with nothing. Rows that share a doc_id are linked by their texts, like others; a
    row without a doc_id gets the component_id of what it links with, null if nothing there has an id, and is kept only then.
    """
    node = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)))
    texts = docs.select(node.alias("node"), F.col("text").cast("string").alias("text")).withColumn("told", F.xxhash64("text"))
    schema = "node bigint, told bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"
    sketches = materialize(texts.select("node", "text", "told").mapInArrow(_sketches(shingle, bands, rows), schema), "sketches")

    # A class is all rows with the same set; its text is that of its least row, found by node and hash.
    same = ["h1", "h2", "n_shingles"]
    classes = sketches.filter("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("node", "told")).alias("least"), F.first("bands").alias("bands"))
    classes = materialize(classes.select(*same, "least.*", "bands").withColumn("rep", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(shuffled_join(keyed, shared, ["key"]), "members")
    weight = materialize(members.groupBy("rep").agg(F.sum("n").alias("weight")), "weight")
    members = materialize(join(members, weight, ["rep"]).select("key", "rep", "n_shingles", "weight"), "weighted")
    if sketches.groupBy("node", "told").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():  # rows that stand twice
        texts = texts.groupBy("node", "told").agg(F.first("text").alias("text"))
    wanted = materialize(join(classes.select("rep", "node", "told"), weight.select("rep"), ["rep"]), "wanted")
    candidate_texts = materialize(join(texts, wanted, ["node", "told"]).select("rep", "text"), "texts")

    # A bucket's centre is its heaviest class.
    centres = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("c")).select("key", (-F.col("c.r")).alias("u"))
    stars = shuffled_join(members, centres, ["key"]).filter("rep <> u")
    pairs = materialize(stars.select("u", F.col("rep").alias("v")).distinct(), "pairs")
    first = candidate_texts.select(F.col("rep").alias("v"), F.col("text").alias("text_v"))
    second = candidate_texts.select(F.col("rep").alias("u"), F.col("text").alias("text_u"))
    both = pairs.join(first.hint("merge"), "v").join(second.hint("merge"), "u").select("u", "v", "text_u", "text_v")
    links = materialize(both.mapInArrow(_confirm(shingle, percent), "u bigint, v bigint"), "links")
    comps = materialize(components(links), "components")

    # The rest of a bucket, where it is not one component, is compared all with all.
    rest = join(stars.select("key", "rep", "n_shingles"), comps.withColumnRenamed("id", "rep"), ["rep"], "left")
    rest = materialize(rest.select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), "rest")
    cells = materialize(_cells(rest), "cells")
    meeting = shuffled_join(cells, candidate_texts, ["rep"]).select("cell", "rep", "component", "text")
    more = meeting.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(shingle, percent), "u bigint, v bigint")
    more = materialize(more, "links")
    if more.limit(1).count():
        comps = materialize(components(comps.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")

    # From classes back to rows: the least node of a component, of all its classes.
    nodes = materialize(join(classes.select(F.col("rep").alias("id"), "node"), comps, ["id"]), "nodes")
    least = materialize(nodes.groupBy("component").agg(F.min("node").alias("least")), "least")
    least = materialize(join(nodes.select("id", "component"), least, ["component"]).select(F.col("id").alias("rep"), "least"), "least")
    labels = join(classes.select("rep", *same, "node"), least, ["rep"], "left").select(*same, F.coalesce("least", "node").alias("component"))
    joined = shuffled_join(sketches.select("node", *same), materialize(labels, "labels"), same, "left")
    component = F.coalesce("component", "node")
    own = F.when(F.col("node") < NO_ID, F.col("node"))
    group = F.when(component < NO_ID, component)
    return joined.select(own.alias("doc_id"), "n_shingles", group.alias("component_id"), own.eqNullSafe(group).alias("kept"))
