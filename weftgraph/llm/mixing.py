"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations alone.

A source's target is a number of whole copies of each of its documents and a rest. The rest is filled by the
documents whose hash lies under a threshold. The threshold is found without a sort: sum the sizes by source and
leading hash bits, find the bucket in which the rest runs out, and look only into that bucket with the next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, materialize, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3  # no source, and no document, is taken more than so many times
BITS, LEVELS = 12, 3  # bits of the hash a level
MOST_SOURCES = 200_000  # up to so many sources are shared out in one task


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row a source.

    Shares go by weight; a source stops at cap times its size and its excess is shared by weight among the rest, until
    none is above. Up to MOST_SOURCES one task sorts them by cap over weight: the capped ones come first, and the first source
    that its share fits sets the share a unit of weight of all after it. More are ranked by range and shared out by
    repeated aggregation, which ends at the same share.
    """
    sizes = materialize(sizes, "sizes")
    if small(sizes, MOST_SOURCES):
        return _shared_in_one(sizes, weights, cap)
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ranged.withColumn("row", F.monotonically_increasing_id()), "ranked")
    counts = placed.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    bases = broadcast_if_small(counts.select("part", before.alias("base")))
    rank = F.col("base") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    tops = placed.withColumn("part", F.shiftright("row", 33)).join(bases, "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).cast("double").alias("top"))
    total = float(tops.agg(F.sum("source_size")).first()[0])
    unit, capped = None, -1
    while True:
        over = F.lit(False) if unit is None else F.col("top") < F.col("weight") * unit
        got = tops.agg(F.sum(over.cast("long")).alias("n"), F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)).alias("top"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if got["n"] == capped or not got["weight"]:
            break
        unit, capped = (total - got["top"]) / got["weight"], got["n"]
    return tops.select("source", "source_size", F.least("top", F.col("weight") * unit).alias("target"))


def _shared_in_one(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("top", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("top") / F.col("weight"), "rank")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    unit = left / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    shared = weighted.withColumn("place", F.row_number().over(order)).withColumn("unit", unit)
    fits = F.when(F.col("unit") * F.col("weight") <= F.col("top"), F.struct("place", "unit"))
    shared = shared.withColumn("from", F.min(fits).over(every))
    target = F.when(F.col("place") < F.col("from.place"), F.col("top")).otherwise(F.least("top", F.col("from.unit") * F.col("weight")))
    return shared.select("source", "source_size", target.alias("target"))


def _hash(bits: int) -> Column:
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("bigint")


#: A null source becomes an empty one with a flag, to join by plain equality.
def _key() -> list[Column]:
    return [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none")]


class Mix:
    """The plan of a mix: how often each source is taken whole, and below which hash once more.

    The hash comes from the doc_id (from the text where that is null), so reruns agree and repeated rows are taken
    alike. Null texts have size 0; null sources form one source, the last. Texts of size 0 are taken no time.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, bits: int = BITS, levels: int = LEVELS):
        self.cap, self.total = cap, bits * levels
        source = F.col("source").cast("string").alias("source")
        self.sized = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source, n_words(F.col("text")).alias("size"), _hash(self.total).alias("hash")), "sized")
        per_source = materialize(source_targets(self.sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
        whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("int")
        plan = per_source.select(*_key(), "source_size", "target", whole.alias("whole"))
        plan = plan.withColumn("rest", F.when(F.col("whole") < cap, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))
        rows = self.sized.select("size", "hash", *_key())
        bounds = plan.select("_s", "_none", "rest", F.lit(0).cast("bigint").alias("prefix"))
        for level in range(1, levels + 1):
            shift = bits * (levels - level)
            inside = rows.join(broadcast_if_small(bounds), ["_s", "_none"]).filter(F.shiftright("hash", shift + bits) == F.col("prefix"))
            histogram = inside.groupBy("_s", "_none", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
            upto = F.sum("n").over(Window.partitionBy("_s", "_none").orderBy("bucket"))  # 2^bits rows a source at most
            over = histogram.withColumn("upto", upto).filter("upto > rest")
            first = over.groupBy("_s", "_none").agg(F.min(F.struct("bucket", "n", "upto", "rest")).alias("b"))
            if level < levels:
                bounds = first.select("_s", "_none", (F.col("b.rest") - F.col("b.upto") + F.col("b.n")).alias("rest"), F.col("b.bucket").alias("prefix"))
            else:  # the last bucket goes in if that comes nearer to the target
                nearer = F.col("b.upto") - F.col("b.rest") < F.col("b.rest") - (F.col("b.upto") - F.col("b.n"))
                bounds = first.select("_s", "_none", (F.col("b.bucket") + F.when(nearer, 1).otherwise(0)).alias("below"))
            bounds = materialize(bounds, "bounds")
        thresholds = plan.join(bounds, ["_s", "_none"], "left").select("_s", "_none", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
        self.thresholds = materialize(thresholds, "thresholds")

    def _copies(self, rows: DataFrame) -> DataFrame:
        """rows with _size and _hash, joined with the thresholds, and _copies."""
        once_more = (F.col("_hash") < F.col("below")) & (F.col("whole") < self.cap)
        copies = F.when(F.col("_size") > 0, F.col("whole") + F.when(once_more, 1).otherwise(0)).otherwise(0)
        return rows.join(broadcast_if_small(self.thresholds), ["_s", "_none"]).withColumn("_copies", copies)

    def table(self) -> DataFrame:
        """One row a document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
        rows = self._copies(self.sized.withColumnsRenamed({"size": "_size", "hash": "_hash"}).select("*", *_key()))
        return rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).cast("bigint").alias("taken"))

    def documents(self, docs: DataFrame) -> DataFrame:
        """The documents of the mix with all their columns, each as often as it is taken."""
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
        rows = self._copies(docs.select(whole, n_words(F.col("text")).alias("_size"), _hash(self.total).alias("_hash"), *_key()))
        return rows.filter("_copies > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_row.*")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 9) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
tops AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS top FROM weighed),
units AS (
  SELECT *, row_number() OVER w AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(top) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM tops WINDOW w AS (ORDER BY top / weight, rank)),
start AS (SELECT place AS p, unit AS u FROM units WHERE unit * weight <= top ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN place < p THEN top ELSE least(top, u * weight) END AS target FROM units, start),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS INTEGER), 3) ELSE 0 END AS whole FROM targets),
summed AS (
  SELECT s.*, p.source_size, p.target, p.whole, CASE WHEN p.whole < 3 THEN p.target - p.whole * p.source_size ELSE 0 END AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto, sum(s.size) OVER (PARTITION BY s.source, s.h) AS n
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 3 AND (upto <= rest OR (upto - n <= rest AND upto - rest < rest - (upto - n))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
