"""Changes of node and edge tables: dense ids for bulk loads, updates by id sets, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_once


def with_dense_ids(rows: DataFrame, start: int, name: str = "id") -> tuple[DataFrame, int]:
    """rows with consecutive ids from start, and how many there are.

    rows are run once: they are written with the number of their partition and their place in it, and ids come from what was
    written, whatever partitions it is read in later. Only a count a partition is gathered.
    """
    placed = write_once(rows.withColumn("_row", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_row", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    bases, total = [], start
    for r in counts:
        bases.append((r["part"], total))
        total += r["n"]
    base = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part bigint, _base bigint"))  # one row a partition
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", F.shiftright("_row", 33)).join(base, "_part")
    return numbered.withColumn(name, F.col("_base") + within).drop("_part", "_row", "_base"), total - start


def changed_rows(frame: DataFrame, ids: DataFrame | Column, changes: dict[str, Column]) -> DataFrame:
    """The rows of frame that ids picks, after the changes."""
    picked = frame.filter(ids) if isinstance(ids, Column) else frame.join(ids, "id", "left_semi")
    return picked.select(*(changes.get(c, F.col(c)).alias(c) for c in frame.columns))


def update_rows(frame: DataFrame, ids: DataFrame | Column, changes: dict[str, Column]) -> DataFrame:
    """frame with the changes made to the rows that ids picks; one pass over frame, one join with ids."""
    if isinstance(ids, Column):
        hit, rows = ids, frame
    else:
        rows = frame.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
        hit = F.coalesce(F.col("_hit"), F.lit(False))
    return rows.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in frame.columns))


def shards(frame: DataFrame, bounds: list[int]) -> DataFrame:
    """(shard, count, min_id, max_id); shard k holds the ids from bounds[k] up to the next bound."""
    shard = F.size(F.filter(F.array(*(F.lit(b).cast("bigint") for b in bounds)), lambda b: b <= F.col("id"))) - 1
    return frame.groupBy(shard.alias("shard")).agg(F.count("*").alias("count"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def compact_bounds(frame: DataFrame, capacity: int) -> list[int]:
    """First ids of shards filled to capacity in order of id. Ranks are made within runs of capacity ids, so no task sorts all."""
    runs = frame.select("id", F.floor(F.col("id") / capacity).alias("run"))
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a run
    ranked = runs.join(counts.withColumn("before", before), "run")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("run").orderBy("id")) - 1
    first = ranked.withColumn("rank", rank).filter(F.col("rank") % capacity == 0)
    return sorted(r["id"] for r in first.select("id").collect())  # one row a shard
