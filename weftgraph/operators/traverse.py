"""One hop of a pattern: rows so far joined with an edge type and the nodes at its other end.

A hop is given the prefix (one row a tuple of node ids so far), the edges as (_near, _far, edge columns) with _near the end
that the prefix has, and the nodes at the far end, their columns already named alias.field. Parallel edges are made one only
after the join with the prefix, so that a selective prefix leaves few rows, and a join by shuffle leaves them where they are needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR, FAR, ORDER = "_near", "_far", "_order"


def _at(name: str):
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Edges:
    """The edges of a hop. columns: properties that are looked at, named alias.field; unique: there are no parallel ones."""

    frame: DataFrame  # NEAR, FAR, columns, and ORDER unless unique
    columns: tuple[str, ...] = ()
    unique: bool = False

    def apart(self, rows: DataFrame, ids: list[str]) -> DataFrame:
        """rows joined with the edges, once a tuple of ids: of parallel edges the one highest in ORDER gives the properties."""
        if self.unique:
            return rows
        if not self.columns:
            return rows.drop(ORDER).dropDuplicates(ids)
        others = [c for c in rows.columns if c not in (*ids, *self.columns, ORDER)]
        best = F.max_by(F.struct(*(_at(c) for c in self.columns)), ORDER).alias("_best")
        one = rows.groupBy(*(_at(c) for c in ids)).agg(best, *(F.first(_at(c)).alias(c) for c in others))
        return one.select(*(F.col(f"_best.`{c}`").alias(c) if c in self.columns else _at(c) for c in rows.columns if c != ORDER))


def ids_of(rows: DataFrame, *more: str) -> list[str]:
    """The node ids of a prefix: they tell its rows apart."""
    return [*(c for c in rows.columns if c.endswith(".id") and c.count(".") == 1), *more]


def inner(prefix: DataFrame, edges: Edges, nodes: DataFrame, near: str, far: str) -> DataFrame:
    met = edges.apart(prefix.join(edges.frame, _at(near) == F.col(NEAR)).drop(NEAR), ids_of(prefix, FAR))
    return met.join(nodes, F.col(FAR) == _at(far)).drop(FAR)


def keep_prefix(prefix: DataFrame, edges: Edges, nodes: DataFrame, near: str, far: str) -> DataFrame:
    """Every prefix row stays, with nulls where nothing matches."""
    pairs = edges.frame.join(nodes, F.col(FAR) == _at(far)).drop(FAR)
    return edges.apart(prefix.join(pairs, _at(near) == F.col(NEAR), "left").drop(NEAR), ids_of(prefix, far))


def keep_nodes(prefix: DataFrame, edges: Edges, nodes: DataFrame, near: str, far: str) -> DataFrame:
    """Every far node stays, with nulls where nothing matches."""
    met = edges.apart(prefix.join(edges.frame, _at(near) == F.col(NEAR)).drop(NEAR), ids_of(prefix, FAR))
    return met.join(nodes, F.col(FAR) == _at(far), "right").drop(FAR)


def keep_both(prefix: DataFrame, edges: Edges, nodes: DataFrame, near: str, far: str) -> DataFrame:
    existing = edges.frame.join(nodes.select(_at(far).alias("_exists")), F.col(FAR) == F.col("_exists"), "left_semi")
    met = edges.apart(prefix.join(existing, _at(near) == F.col(NEAR), "left").drop(NEAR), ids_of(prefix, FAR))
    return met.join(nodes, F.col(FAR) == _at(far), "full").drop(FAR)


def close(prefix: DataFrame, edges: Edges, near: str, far: str, how: str) -> DataFrame:
    """Both ends are in the prefix: the edge must run between them (left: the row stays all the same)."""
    met = prefix.join(edges.frame, (_at(near) == F.col(NEAR)) & (_at(far) == F.col(FAR)), how)
    return edges.apart(met.drop(NEAR, FAR), ids_of(prefix))


def within_schema(prefix: DataFrame, edges: Edges, nodes: DataFrame, near: str, far: str, keep_prefix_rows: bool, keep_far_rows: bool, near_is_source: bool) -> DataFrame:
    """RIGHT and FULL where both ends have one schema.

    A node that is the source of a match is no target: pairs with such a target go, and it never stands alone on the
    target's side. Otherwise both sides keep what matched nothing.
    """
    # On a later hop the prefix's rows take the place of the sources: a row stays alone unless its node is the source of a match.
    source, target = (near, far) if near_is_source else (far, near)
    pairs = inner(prefix, edges, nodes, near, far)
    end = lambda c, is_source: F.struct(_at(c).alias("_id"), F.lit(is_source).alias("_from"))
    ends = pairs.select(F.explode(F.array(end(source, True), end(target, False))).alias("_end")).select("_end.*")
    roles = ends.groupBy("_id").agg(F.max("_from").alias("_from"))  # of all nodes in pairs
    sources, all_ends = roles.filter("_from").select("_id"), roles.select("_id")
    out = pairs.join(sources, _at(target) == F.col("_id"), "left_anti")
    for rows, key, wanted in ((prefix, near, keep_prefix_rows), (nodes, far, keep_far_rows)):
        if wanted:  # a target of a pair is a source, or stands in a pair that is kept
            alone = rows.join(all_ends if key == target else sources, _at(key) == F.col("_id"), "left_anti")
            out = out.unionByName(alone, allowMissingColumns=True)
    return out
