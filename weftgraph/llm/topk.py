"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt into buckets of like length. A first bound on each query's k-th best score comes from the longest
candidates, and queries are dealt into blocks of like need: the least length with which a candidate can reach the bound.
A bucket goes only to the blocks that its longest vector can serve. There each query needs a cosine of at least
bound / (its length x the bucket's longest): above 1 it skips the bucket; if it is low, only the bucket's prefix of
vectors long enough is looked at; if it is high, a vector must also lie in the range that the cosine allows in the query's
largest coordinates. What is left is verified by exact integer products, which raise the bounds for the next bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialize

SCALE = 256
BUCKET = 2048  # candidates in a bucket
BLOCK = 16384  # queries in a block
VALUES = 1 << 21  # components in a bucket or block: wide vectors make smaller ones
CELL = 256  # buckets that meet a block in one place, about
LONGEST = 4096  # candidates that give the first bounds
COSINE = 0.5  # from here on, coordinates are tried
FOCUS = 3  # coordinates tried
CHUNK = 256  # queries multiplied at once
SLACK = 1e-9  # of lengths, for rounding

#: Of a bucket of candidates or a block of queries.
KINDS = {"bucket": pa.int64(), "longest": pa.float64(), "least": pa.float64(), "own": pa.binary(), "ids": pa.binary(), "wide": pa.int32(), "bits": pa.int32(), "matrix": pa.binary(), "bounds": pa.binary()}
PACKED = "bucket bigint, longest double, least double, own binary, ids binary, wide int, bits int, matrix binary, bounds binary"
FOUND = "q_row bigint, query_id bigint, vec_id bigint, score bigint"


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest of 16, 32 and 64 bits."""
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    return matrix.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _sizes(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(1))


def _dense(column: pa.Array) -> np.ndarray:
    """A column of lists as a matrix, shorter lists filled up with zeros."""
    flat, offs = column.flatten().to_numpy(), column.offsets.to_numpy()
    size = np.diff(offs)
    matrix = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    matrix[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = flat
    return matrix


def _pack(size: int):
    """Rows (row, id, v[, bound, need]), as they come, to one row for every size of them: its vectors as a matrix, its length and least need."""

    def flush(parts: list, at: int) -> tuple[pa.RecordBatch, list]:
        wide = max(p[2].shape[1] for p in parts)
        own, ids, bounds, needs = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3, 4))
        matrix = np.concatenate([np.pad(p[2], ((0, 0), (0, wide - p[2].shape[1]))) for p in parts])
        some = _narrow(matrix[:size])
        row = [at, float(_sizes(some).max(initial=0)), float(needs[:size].min()), own[:size].tobytes(), ids[:size].tobytes(), wide, some.itemsize * 8, some.tobytes(), bounds[:size].tobytes()]
        batch = pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, KINDS.values(), strict=True)], list(KINDS))
        return batch, [(own[size:], ids[size:], matrix[size:], bounds[size:], needs[size:])] if len(own) > size else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: list = []
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            own, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            more = [batch.column(k).to_numpy() if batch.num_columns > k else np.zeros(len(own)) for k in (3, 4)]
            if len(own):
                parts.append((own, ids, _dense(batch.column(2)), *more))
            while sum(len(p[0]) for p in parts) >= size:
                made, parts = flush(parts, at)
                at += 1
                yield made
        if parts:
            yield flush(parts, at)[0]

    return run


def _matrix(raw: bytes, bits: int, wide: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{bits // 8}").reshape(-1, wide) if wide else np.zeros((0, 0), np.int16)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as floating-point numbers where these are exact. The wider side is cut where the other ends: what is missing is zero."""
    wide = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :wide], vectors[:, :wide]
    tops = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (queries, vectors)]
    most = tops[0] * tops[1] * max(1, wide)
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return queries.astype(kind) @ vectors.astype(kind).T
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def survivors(query: np.ndarray, size: float, sizes: np.ndarray, units: np.ndarray, bound: float) -> np.ndarray:
    """Which vectors of a bucket (longest first, of more than no length) can reach a positive bound with this query."""
    need = bound / (size * sizes[0])
    prefix = int(np.searchsorted(-sizes, -bound / size * (1 - SLACK), "right"))
    unit = query / size
    ok = np.ones(prefix, bool)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        if f >= units.shape[1]:
            continue
        middle, room = unit[f] * need, np.sqrt(max(0.0, 1 - need * need) * max(0.0, 1 - unit[f] ** 2)) + SLACK
        lo = middle - room if unit[f] > -need else -1.0
        hi = middle + room if unit[f] < need else 1.0
        ok &= (units[:prefix, f] >= lo) & (units[:prefix, f] <= hi)
    return np.flatnonzero(ok)


class Block:
    """The queries of a block with their k best so far."""

    def __init__(self, k: int, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray, bounds: np.ndarray):
        self.k, self.own, self.ids, self.matrix, self.sizes = k, own, ids, matrix, _sizes(matrix)
        self.bound = bounds.copy()  # a score below it is of no use
        self.least = np.full(len(own), np.iinfo(np.int64).max)  # nor is one at it with an id above this
        self.best = [np.zeros(0, np.int64) for _ in range(3)]  # query, vec_id, score
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.fresh.append((query, ids, score))
        self.waiting += len(query)
        if self.waiting > 1 << 18:
            self.settle()

    def settle(self) -> None:
        if not self.fresh:
            return
        query, ids, score = (np.concatenate([b, *(f[i] for f in self.fresh)]) for i, b in enumerate(self.best))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept, last = place < self.k, place == self.k - 1
        at, better = query[last], score[last] >= self.bound[query[last]]
        self.bound[at[better]], self.least[at[better]] = score[last][better], ids[last][better]
        self.best, self.fresh, self.waiting = [query[kept], ids[kept], score[kept]], [], 0

    def meet(self, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        sizes = _sizes(vectors)
        order = np.argsort(-sizes, kind="stable")
        own, ids, vectors, sizes = own[order], ids[order], vectors[order], sizes[order]
        units = vectors / np.maximum(sizes, 1e-300)[:, None]
        for lo in range(0, len(self.own), CHUNK):
            some = np.arange(lo, min(lo + CHUNK, len(self.own)))
            told = (self.bound[some] > 0) & np.isfinite(self.bound[some])
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(told, self.bound[some] / self.sizes[some], 0.0)  # a query of no length needs endless ones
                need = np.where(told, shortest / max(sizes[0], 1e-300), 0.0)
            some, need, shortest = some[need <= 1 + SLACK], need[need <= 1 + SLACK], shortest[need <= 1 + SLACK]
            near = need >= COSINE
            for q in some[near]:
                at = survivors(self.matrix[q], self.sizes[q], sizes, units, self.bound[q])
                if len(at):
                    self._take(np.array([q]), at, own, ids, products(self.matrix[q : q + 1], vectors[at]))
            some, shortest = some[~near], shortest[~near]
            if len(some):
                prefix = int(np.searchsorted(-sizes, -shortest.min() * (1 - SLACK), "right"))
                self._take(some, np.arange(prefix), own, ids, products(self.matrix[some], vectors[:prefix]))
        self.settle()

    def _take(self, queries: np.ndarray, at: np.ndarray, own: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        bound = self.bound[queries]
        if score.dtype == np.int64:  # bounds this large are rounded
            bound = bound - np.abs(bound) * 2.0**-50
        q, c = np.nonzero(score >= bound.astype(np.float64 if score.dtype == np.int64 else score.dtype)[:, None])
        score, query, c = score[q, c].astype(np.int64), queries[q], at[c]
        good = (own[c] != self.own[query]) & ((score != self.bound[query]) | (ids[c] <= self.least[query]))
        if good.any():
            self.add(query[good], ids[c[good]], score[good])

    def result(self) -> pa.RecordBatch:
        query, ids, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.own[query], self.ids[query], ids, score)], ["q_row", "query_id", "vec_id", "score"])


def _search(k: int):
    """Rows (block, cell, bucket, own, ids, wide, bits, matrix, bounds) come sorted by block and cell, the queries of each first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = (np.frombuffer(row[c], np.int64) for c in ("own", "ids"))
                matrix = _matrix(row["matrix"], row["bits"], row["wide"]) if row["wide"] else np.zeros((len(own), 1), np.int16)
                if row["bucket"] is None:
                    if block is not None:
                        yield block.result()
                    now, block = (row["block"], row["cell"]), Block(k, own, ids, matrix, np.frombuffer(row["bounds"], np.float64))
                elif now == (row["block"], row["cell"]):
                    block.meet(own, ids, matrix)
        if block is not None:
            yield block.result()

    return run


def _bounded(seeds: pa.Table, k: int):
    """Adds to (row, id, v, square) the bound that the seeds give, and the length that a candidate needs to reach it."""
    seed_rows, seed_vectors = seeds.column("row").to_numpy(), _dense(seeds.column("v").combine_chunks()) if seeds.num_rows else np.zeros((0, 0), np.int64)
    seed_vectors = _narrow(seed_vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = batch.column(0).to_numpy(), batch.num_rows
            bounds = np.full(n, -np.inf)
            if n and len(seed_rows) >= k:
                queries = _narrow(_dense(batch.column(2)))
                for lo in range(0, n, CHUNK):
                    scores = products(queries[lo : lo + CHUNK], seed_vectors).astype(np.float64)
                    scores[own[lo : lo + CHUNK, None] == seed_rows[None]] = -np.inf
                    bounds[lo : lo + CHUNK] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            size = np.sqrt(batch.column(3).to_numpy())
            told = np.isfinite(bounds) & (bounds > 0) & (size > 0)
            need = np.where(told, bounds / np.maximum(size, 1e-300), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bounds), pa.array(need)], ["row", "id", "v", "bound", "need"])

    return run


def served(buckets: DataFrame, blocks: DataFrame) -> DataFrame:
    """buckets with each block that their longest vector can serve: the queries' blocks, two numbers each, against all buckets."""
    needs = broadcast_if_small(blocks.select(F.col("bucket").alias("block"), F.col("least").alias("_least")))
    return buckets.drop("least").join(needs, F.col("longest") * (1 + SLACK) >= F.col("_least")).drop("_least")


def top_k(vectors: DataFrame, is_query, k: int = 5, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row a query and rank: query_id, rank (from 1), vec_id, score; the k highest inner products, ties to smaller vec_id.

    is_query: a Column over vec_id. Components become floor(256 x). Rows with a null vec_id or vector, or a null or
    non-finite component, take no part. A shorter vector counts as filled up with zeros. A row is never its own
    candidate, though another row with the same vec_id is; each row of a repeated query gets an answer of its own.
    With fewer than k candidates all are returned.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    fine = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("v")).withColumn("square", square)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    wide = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    bucket, block = (max(1, min(n, VALUES // wide)) for n in (bucket, block))

    # The first bounds: LONGEST candidates, a fixed number, against every query.
    by_length = [F.col("square").desc(), F.col("row")]  # the row breaks ties, so that like lengths spread evenly
    seeds = rows.select("row", "v", "square").orderBy(*by_length).limit(max(k, min(LONGEST, VALUES // wide))).select("row", "v").toArrow()
    asked = rows.filter(is_query(F.col("id"))).select("row", "id", "v", "square")
    asked = materialize(asked.mapInArrow(_bounded(seeds, k), "row bigint, id bigint, v array<bigint>, bound double, need double"), "asked")

    buckets = rows.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    buckets = materialize(buckets.select("row", "id", "v").mapInArrow(_pack(bucket), PACKED), "buckets")
    # Blocks are made of queries with like needs. A partition's last block may be short, so the table written says which there are.
    by_need = [F.col("need"), F.col("row")]
    blocks = asked.repartitionByRange(max(1, asked.count() // block), *by_need).sortWithinPartitions(*by_need)
    blocks = materialize(blocks.select("row", "id", "v", "bound", "need").mapInArrow(_pack(block), PACKED), "blocks")

    # A bucket has a copy for each block that it can serve, a block a copy for each cell; in a cell the block is read first.
    n_buckets, n_blocks = buckets.count(), blocks.count()
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, n_blocks)
    cells = max(1, min(n_buckets, max(spread, -(-n_buckets // CELL))))
    dealt = served(buckets, blocks).withColumn("cell", F.pmod(F.xxhash64("bucket"), F.lit(cells)).cast("int"))
    asking = blocks.withColumnRenamed("bucket", "block").withColumns({"bucket": F.lit(None).cast("bigint"), "cell": F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))})
    columns = ["block", "cell", "bucket", "longest", "own", "ids", "wide", "bits", "matrix", "bounds"]
    met = dealt.select(columns).unionByName(asking.select(columns)).repartition("block", "cell")
    met = met.sortWithinPartitions("block", "cell", F.col("bucket").isNotNull(), F.col("longest").desc())
    found = materialize(met.mapInArrow(_search(k), FOUND), "found", 64)
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
