"""Version tables and reads as of a time.

A version row is id, version_id, valid_from, valid_to, tx_from, tx_to (nanoseconds, half-open) and all fields as they
were, so an explicit null differs from a field that did not change. Changes only append to a log: a logged version ends the
validity of all earlier ones of its node from its own time on, so nothing that is there is written again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import write_once

FOREVER = 2**63 - 1
VERSION_COLUMNS = ("version_id", "valid_from", "valid_to", "tx_from", "tx_to")
Clock = Callable[[], int]


def system_clock() -> int:
    return time.time_ns()


class ManualClock:
    """A clock for tests and replays."""

    def __init__(self, now: int = 0):
        self.now = now

    def __call__(self) -> int:
        return self.now


def as_of(versions: DataFrame, fields: list[str], valid_time: int | None, tx_time: int | None, log: DataFrame | None = None) -> DataFrame:
    """One row a node that is visible at the times given: its newest version there. A time left out sets no condition.

    A logged version that is valid by the valid time hides all earlier ones, also where it is not known at the tx time.
    """
    valid_time, tx_time = (None if t == FOREVER else t for t in (valid_time, tx_time))
    for at, start, end in ((valid_time, "valid_from", "valid_to"), (tx_time, "tx_from", "tx_to")):
        if at is not None:
            versions = versions.filter((F.col(start) <= F.lit(at)) & (F.lit(at) < F.col(end)))
    if log is not None:
        if valid_time is not None:
            log = log.filter(F.col("valid_from") <= F.lit(valid_time))
        elif tx_time is not None:
            log = log.filter(F.col("tx_from") <= F.lit(tx_time))
        versions = versions.unionByName(log)
    newest = versions.groupBy("id").agg(F.max_by(F.struct("tx_from", *fields), "version_id").alias("_row"))
    if log is not None and tx_time is not None:
        newest = newest.filter(F.col("_row.tx_from") <= F.lit(tx_time))
    return newest.select("id", *(F.col(f"_row.{f}").alias(f) for f in fields))


#: Logged versions are numbered from here on, in order of the changes; other numbers lie below.
LOGGED = 1 << 40


def stamped(nodes: DataFrame, fields: list[str], now: int, number: int, tx_from: int) -> DataFrame:
    """Versions of nodes (id and fields) that are valid from now on."""
    stamps = {"version_id": number, "valid_from": now, "valid_to": FOREVER, "tx_from": tx_from, "tx_to": FOREVER}
    return nodes.select("id", *(F.lit(v).cast("bigint").alias(k) for k, v in stamps.items()), *fields)


def first_versions(nodes: DataFrame, fields: list[str], now: int) -> DataFrame:
    return stamped(nodes, fields, now, 0, 0)


@dataclass
class Versions:
    """The versions of a schema's nodes: those they began with, and the log of changes."""

    frame: DataFrame
    log: DataFrame | None = None
    changes: int = 0
    waiting: list[tuple] = field(default_factory=list)  # first versions of nodes added one by one, that wait for the next read

    def flushed(self) -> DataFrame:
        if self.waiting:
            rows = self.frame.sparkSession.createDataFrame(self.waiting, self.frame.schema)
            self.waiting = []
            self.frame = self.frame.unionByName(rows)
        return self.frame

    def whole(self) -> DataFrame:
        return self.flushed() if self.log is None else self.flushed().unionByName(self.log)

    def add(self, rows: DataFrame) -> None:
        self.frame = self.flushed().unionByName(rows)

    def change(self, changed: DataFrame, fields: list[str], now: int, every: int) -> None:
        """Append a version of each row changed (id and fields). Of the log, every so many changes are written as one table."""
        self.changes += 1
        new = write_once(stamped(changed, fields, now, LOGGED + self.changes, now))
        self.log = new if self.log is None else self.log.unionByName(new)
        if self.changes % every == 0:
            self.log = write_once(self.log)

    def as_of(self, fields: list[str], valid_time: int | None, tx_time: int | None) -> DataFrame:
        return as_of(self.flushed(), fields, valid_time, tx_time, self.log)

    def keep(self, ids: Callable[[DataFrame], DataFrame]) -> None:
        """Remove the versions that ids, a function of a table, leaves out."""
        self.frame = ids(self.flushed())
        self.log = None if self.log is None else ids(self.log)


def history(events: DataFrame, id_column: str, time_ns, fields: list[str]) -> DataFrame:
    """A version table from a table of events, each of which states all fields of a node from its time on."""
    from pyspark.sql import Window

    order = Window.partitionBy(id_column).orderBy("_at")
    rows = events.withColumn("_at", time_ns)
    until = F.coalesce(F.lead("_at").over(order), F.lit(FOREVER))
    return rows.select(F.col(id_column).cast("bigint").alias("id"), (F.row_number().over(order) - 1).cast("bigint").alias("version_id"), F.col("_at").alias("valid_from"), until.alias("valid_to"), F.col("_at").alias("tx_from"), F.lit(FOREVER).alias("tx_to"), *fields)
