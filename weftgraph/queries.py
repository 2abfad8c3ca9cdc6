"""The registered graph queries over the test tables, and their DuckDB SQL.

Result columns are named alias_field: a dot in a name needs quoting everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Config, Graph
from .lang.runner import execute
from .operators import temporal
from .plans.expressions import Comparison, Path
from .plans.query import Item, Query, Update
from .views import document_graph, event_graph, star_graph, table, talk_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


_OPEN: dict[tuple, Graph] = {}


def opened(view: Callable[[SparkSession, str], Graph], spark: SparkSession, sf_dir: str) -> Graph:
    """A view of the test tables that stays open for queries that change nothing, as a database does; the tables are read-only."""
    key = (view, spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = view(spark, sf_dir)
    return _OPEN[key]


def _pattern(name: str, view: Callable[[SparkSession, str], Graph], query: Query, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(opened(view, spark, sf_dir).query(query).df)
    SQL[name] = sql


def _steps(name: str, sql: str):
    """Registers a function of (spark, sf_dir) that changes a graph before it reads it."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(run(spark, sf_dir))
        SQL[name] = sql
        return run

    return register


_CUSTOMER = 'c_custkey AS c_id, c_name, c_acctbal, c_mktsegment AS c_segment'
_ORDER = 'o_orderkey AS o_id, o_orderstatus AS o_status, o_totalprice, o_orderpriority AS o_priority'

# Scans, filters, projection

_pattern("node_scan", star_graph, Query.match("c:Customer"), f"SELECT {_CUSTOMER} FROM customer")
_pattern("node_scan_select_alias", star_graph, Query.match("c:Customer").traverse("c", "IN_NATION", "n:Nation").select("n", "c.name"), "SELECT c_name, n_nationkey::BIGINT AS n_id, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_pattern("select_as", star_graph, Query.match("c:Customer").select(Item("c.name", "who"), Item("c.acctbal", "money")), "SELECT c_name AS who, c_acctbal AS money FROM customer")
_pattern("filter_eq", star_graph, Query.match("c:Customer").where("c.segment", "=", "BUILDING").select("c.id", "c.name"), "SELECT c_custkey AS c_id, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
_pattern("filter_neq", star_graph, Query.match("c:Customer").where("c.segment", "!=", "BUILDING").select("c.id"), "SELECT c_custkey AS c_id FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
_pattern("filter_range", star_graph, Query.match("o:Orders").where("o.totalprice", ">=", 100000.0).and_where("o.totalprice", "<", 200000).select("o.id", "o.totalprice"), "SELECT o_orderkey AS o_id, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
_pattern("filter_and_or", star_graph, Query.match("p:Part").where("p.size", ">", 40).or_where("p.size", "<", 5).and_where("p.retailprice", ">", 950).select("p.id", "p.size"), "SELECT p_partkey AS p_id, p_size FROM part WHERE (p_size > 40 OR p_size < 5) AND p_retailprice > 950")
_pattern("filter_precedence", star_graph, Query.match("p:Part").where(Comparison("p.size", ">", 40) | (Comparison("p.size", "<", 5) & Comparison("p.retailprice", ">", 950))).select("p.id", "p.size"), "SELECT p_partkey AS p_id, p_size FROM part WHERE p_size > 40 OR p_size < 5 AND p_retailprice > 950")
_pattern("filter_string_ops", star_graph, Query.match("p:Part").where("p.name", "CONTAINS", "ll").and_where("p.brand", "STARTS_WITH", "Brand#1").and_where("p.name", "ENDS_WITH", "g").select("p.id", "p.name"), "SELECT p_partkey AS p_id, p_name FROM part WHERE contains(p_name, 'll') AND starts_with(p_brand, 'Brand#1') AND ends_with(p_name, 'g')")
_pattern("filter_null", star_graph, Query.match("c:Customer").where("c.name", "=", None).or_where("c.acctbal", "!=", None).select("c.id"), "SELECT c_custkey AS c_id FROM customer WHERE c_name IS NULL OR c_acctbal IS NOT NULL")

# Inner hops

_pattern("inner_hop", star_graph, Query.match("c:Customer").where("c.segment", "=", "BUILDING").traverse("c", "PLACED", "o:Orders").where("o.totalprice", ">", 150000.0), f"SELECT {_CUSTOMER}, {_ORDER} FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 150000")
_pattern("two_hop", star_graph, Query.match("c:Customer").traverse("c", "IN_NATION", "n:Nation").traverse("n", "IN_REGION", "r:Region").select("c.id", "n.name", "r.name"), "SELECT c_custkey AS c_id, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_pattern("three_hop", star_graph, Query.match("o:Orders").where("o.totalprice", ">", 250000.0).traverse("o", "SUPPLIED_BY", "s:Supplier").traverse("s", "BASED_IN", "n:Nation").traverse("n", "IN_REGION", "r:Region").select("o.id", "s.id", "n.name", "r.name"), "SELECT DISTINCT o_orderkey AS o_id, s_suppkey AS s_id, n_name, r_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 250000")
_pattern("incoming_hop", star_graph, Query.match("n:Nation").where("n.name", "!=", "x").traverse("c:Customer", "IN_NATION", "n").select("n.id", "c.id"), "SELECT n_nationkey::BIGINT AS n_id, c_custkey AS c_id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name <> 'x'")
_pattern("branching", star_graph, Query.match("o:Orders").where("o.totalprice", ">", 280000.0).traverse("o", "CONTAINS", "p:Part").traverse("o", "SUPPLIED_BY", "s:Supplier").select("o.id", "p.id", "s.id"), "SELECT DISTINCT o_orderkey AS o_id, a.l_partkey AS p_id, b.l_suppkey AS s_id FROM orders JOIN lineitem a ON o_orderkey = a.l_orderkey JOIN lineitem b ON o_orderkey = b.l_orderkey WHERE o_totalprice > 280000")
_pattern("triangle", star_graph, Query.match("c:Customer").traverse("c", "IN_NATION", "n:Nation").traverse("c", "PLACED", "o:Orders").traverse("o", "SUPPLIED_BY", "s:Supplier").traverse("s", "BASED_IN", "n").select("c.id", "o.id", "s.id", "n.id"), "SELECT DISTINCT c_custkey AS c_id, o_orderkey AS o_id, s_suppkey AS s_id, c_nationkey::BIGINT AS n_id FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
_pattern("parallel_edges_distinct", star_graph, Query.match("o:Orders").traverse("o", "CONTAINS", "p:Part").select("o.id", "p.id"), "SELECT DISTINCT l_orderkey AS o_id, l_partkey AS p_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
_LAST = "row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) * 16 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) DESC) = 1"
_pattern("edge_alias_filter", star_graph, Query.match("o:Orders").traverse("o", "CONTAINS", "p:Part", alias="e").where("e.quantity", ">=", 45.0).and_where("e.returnflag", "=", "R").select("o.id", "p.id", "e.quantity"), f"SELECT o_orderkey AS o_id, p_partkey AS p_id, l_quantity AS e_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 AND l_returnflag = 'R' QUALIFY {_LAST}")
_pattern("edge_alias_select", star_graph, Query.match("o:Orders").traverse("o", "CONTAINS", "p:Part", alias="e").select("o.id", "p.id", "e"), f"SELECT o_orderkey AS o_id, p_partkey AS p_id, l_quantity AS e_quantity, l_extendedprice AS e_extendedprice, l_discount AS e_discount, l_returnflag AS e_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey QUALIFY {_LAST}")
_pattern("cross_alias_where", star_graph, Query.match("c:Customer").traverse("c", "PLACED", "o:Orders").where("c.acctbal", "<", 0.0).or_where("o.totalprice", ">", 290000.0).select("c.id", "o.id"), "SELECT c_custkey AS c_id, o_orderkey AS o_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal < 0 OR o_totalprice > 290000")
_pattern("friend_join", star_graph, Query.match("c:Customer").where("c.acctbal", ">", 3000.0).and_where("c.segment", "=", "MACHINERY").traverse("c", "PLACED", "o:Orders").where("o.totalprice", ">", 25000.0).inline_where().select("c.id", "o.id"), "SELECT c_custkey AS c_id, o_orderkey AS o_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 3000 AND c_mktsegment = 'MACHINERY' AND o_totalprice > 25000")

_pattern("field_compare", star_graph, Query.match("c:Customer").traverse("c", "PLACED", "o:Orders").where("o.totalprice", ">", Path("c.acctbal")).select("c.id", "o.id"), "SELECT c_custkey AS c_id, o_orderkey AS o_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > c_acctbal")
_pattern("field_compare_one_alias", star_graph, Query.match("p:Part").where("p.retailprice", "<", Path("p.size")).or_where("p.name", "CONTAINS", Path("p.brand")).or_where("p.size", "<", 10).select("p.id"), "SELECT p_partkey AS p_id FROM part WHERE p_retailprice < p_size OR contains(p_name, p_brand) OR p_size < 10")

# Outer hops

_DL = "FROM documents d {join} JOIN labels l ON d.doc_id = l.doc_id"
_pattern("left_hop", document_graph, Query.match("d:Document").traverse("d", "LABELLED", "l:Label", "LEFT").select("d.id", "l.id", "l.toxic"), f"SELECT d.doc_id AS d_id, l.doc_id AS l_id, toxic AS l_toxic {_DL.format(join='LEFT')}")
_pattern("left_hop_inline_where", document_graph, Query.match("d:Document").traverse("d", "LABELLED", "l:Label", "LEFT").where("l.toxic", "=", 1).inline_where().select("d.id", "l.id"), f"SELECT d.doc_id AS d_id, l.doc_id AS l_id {_DL.format(join='LEFT')} AND toxic = 1")
_pattern("left_hop_post_where", document_graph, Query.match("d:Document").traverse("d", "LABELLED", "l:Label", "LEFT").where("l.toxic", "=", 1).select("d.id", "l.id"), f"SELECT d.doc_id AS d_id, l.doc_id AS l_id {_DL.format(join='LEFT')} WHERE coalesce(toxic = 1, false) OR l.doc_id IS NULL")
_pattern("left_hop_ansi", document_graph, Query.match("d:Document").traverse("d", "LABELLED", "l:Label", "LEFT").where("l.toxic", "=", 1).mode("ansi").select("d.id", "l.id"), f"SELECT d.doc_id AS d_id, l.doc_id AS l_id {_DL.format(join='LEFT')} WHERE toxic = 1")
_pattern("right_cross", document_graph, Query.match("d:Document").where("d.lang", "=", "en").traverse("d", "LABELLED", "l:Label", "RIGHT").select("d.id", "l.id"), "SELECT d.doc_id AS d_id, l.doc_id AS l_id FROM (SELECT * FROM documents WHERE lang = 'en') d RIGHT JOIN labels l ON d.doc_id = l.doc_id")
_pattern("full_cross", document_graph, Query.match("d:Document").where("d.lang", "=", "en").traverse("d", "LABELLED", "l:Label", "FULL").select("d.id", "l.id"), "SELECT d.doc_id AS d_id, l.doc_id AS l_id FROM (SELECT * FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id")
_pattern("right_second_hop", star_graph, Query.match("n:Nation").where("n.id", "<", 5).traverse("c:Customer", "IN_NATION", "n").traverse("c", "PLACED", "o:Orders", "RIGHT").where("o.totalprice", ">", 200000.0).inline_where().select("n.id", "c.id", "o.id"), "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT n_nationkey::BIGINT AS n_id, c_custkey AS c_id, o_orderkey AS o_id FROM (SELECT * FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 5) FULL JOIN big ON c_custkey = o_custkey")
_SELF = """WITH node AS (SELECT conv_id * 1000 + turn AS id, role, turn FROM conversations),
e AS (SELECT id AS s, id - 1 AS t FROM node WHERE turn > 0{only}),
kept AS (SELECT * FROM e WHERE t NOT IN (SELECT s FROM e)),
right_only AS (SELECT NULL::BIGINT AS s, id AS t FROM node WHERE id NOT IN (SELECT s FROM e) AND id NOT IN (SELECT t FROM kept)),
left_only AS (SELECT id AS s, NULL::BIGINT AS t FROM node WHERE id NOT IN (SELECT s FROM e))
SELECT s AS a_id, t AS b_id FROM kept UNION ALL SELECT * FROM right_only"""
_pattern("right_self", talk_graph, Query.match("a:Message").traverse("a", "ANSWERS", "b:Message", "RIGHT").select("a.id", "b.id"), _SELF.format(only=" AND role = 'assistant'"))
_pattern("full_self", talk_graph, Query.match("a:Message").traverse("a", "REPLIES", "b:Message", "FULL").select("a.id", "b.id"), _SELF.format(only="") + " UNION ALL SELECT * FROM left_only")
_LATER = """WITH node AS (SELECT conv_id * 1000 + turn AS id, role, turn FROM conversations),
one AS (SELECT id AS a, id - 1 AS b FROM node WHERE turn > 0 AND role = 'assistant'),
m AS (SELECT a, b, n.id - 1 AS c FROM one JOIN node n ON one.b = n.id AND n.turn > 0),
kept AS (SELECT * FROM m WHERE c NOT IN (SELECT b FROM m))
SELECT a AS a_id, b AS b_id, c AS c_id FROM kept UNION ALL SELECT a, b, NULL FROM one WHERE b NOT IN (SELECT b FROM m)
UNION ALL SELECT NULL, NULL, id FROM node WHERE id NOT IN (SELECT b FROM m) AND id NOT IN (SELECT c FROM kept)"""
for _how in ("RIGHT", "FULL"):
    _pattern(f"{_how.lower()}_self_later_hop", talk_graph, Query.match("a:Message").traverse("a", "ANSWERS", "b:Message").traverse("b", "REPLIES", "c:Message", _how).select("a.id", "b.id", "c.id"), _LATER)
_pattern("left_self", talk_graph, Query.match("a:Message").traverse("a", "REPLIES", "b:Message", "LEFT").select("a.id", "b.id"), "SELECT conv_id * 1000 + turn AS a_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS b_id FROM conversations")
_pattern("left_then_left", document_graph, Query.match("d:Document").traverse("d", "LABELLED", "l:Label", "LEFT").traverse("d2:Document", "LABELLED", "l", "RIGHT").select("d.id", "l.id", "d2.id"), "SELECT d.doc_id AS d_id, l.doc_id AS l_id, l.doc_id AS d2_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

# Time

_VERSIONS = "WITH v AS (SELECT user_id AS u_id, event_type AS u_event_type, value AS u_value, epoch_us(ts) AS begun, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events), mid AS (SELECT 1704067200000000 + 15 * 86400000000::BIGINT AS t)"
_MID = (1_704_067_200_000_000 + 15 * 86_400_000_000) * 1000
_pattern("as_of_valid", event_graph, Query.match("u:User").as_of_valid_time(_MID), f"{_VERSIONS} SELECT u_id, u_event_type, u_value FROM v, mid WHERE begun <= t AND t < coalesce(until, 9223372036854775807)")
_pattern("as_of_tx", event_graph, Query.match("u:User").as_of_tx_time(_MID), f"{_VERSIONS} SELECT u_id, u_event_type, u_value FROM v, mid WHERE begun <= t QUALIFY row_number() OVER (PARTITION BY u_id ORDER BY begun DESC) = 1")
_pattern("as_of_bitemporal", event_graph, Query.match("u:User").as_of(_MID - 86_400_000_000_000, _MID), f"{_VERSIONS} SELECT u_id, u_event_type, u_value FROM v, mid WHERE begun <= t - 86400000000 AND t - 86400000000 < coalesce(until, 9223372036854775807) AND begun <= t")
_pattern("as_of_current", event_graph, Query.match("u:User"), f"{_VERSIONS} SELECT u_id, u_event_type, u_value FROM v WHERE until IS NULL")

# Maps

_pattern("map_key_filter", event_graph, Query.match("e:Event").where("e.props.k", ">", 50).select("e.id", "e.event_type"), "SELECT event_id AS e_id, event_type AS e_event_type FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
_pattern("map_key_project", event_graph, Query.match("e:Event").select("e.id", "e.props.k"), "SELECT event_id AS e_id, CAST(json_extract(props, '$.k') AS BIGINT) AS e_props_k FROM events")
_pattern("map_key_project_typed", event_graph, Query.match("e:Event").select("e.id", Item("e.props.k", "k", "string")), "SELECT event_id AS e_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k FROM events")


@_steps("map_key_set", "SELECT event_id AS e_id, CASE WHEN value > 50 THEN 7 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS e_props_k, CASE WHEN value > 50 THEN 'hot' END AS e_props_heat FROM events")
def _map_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    graph.update(Update.match(Query.match("e:Event").where("e.value", ">", 50.0)).set("e.props.k", 7).set("e.props.heat", "hot"))
    return graph.query(Query.match("e:Event").select("e.id", Item("e.props.k", kind="int64"), Item("e.props.heat", kind="string"))).df


# Changes


@_steps("update_by_id", "SELECT c_custkey AS c_id, CASE WHEN c_custkey = 7 THEN 'Seven' ELSE c_name END AS c_name FROM customer")
def _update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.update(Update.on("Customer", 7).set("name", "Seven"))
    return graph.query(Query.match("c:Customer").select("c.id", "c.name")).df


@_steps("update_match", "SELECT c_custkey AS c_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 280000) THEN 'VIP' ELSE c_mktsegment END AS c_segment FROM customer")
def _update_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.update(Update.match(Query.match("c:Customer").traverse("c", "PLACED", "o:Orders").where("o.totalprice", ">", 280000.0)).set("c.segment", "VIP"))
    return graph.query(Query.match("c:Customer").select("c.id", "c.segment")).df


_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
_ITEMS = f"(SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_PLACE)}) AS item FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders and parts with items as edges that have ids: the order's number and the item's place in it."""
    graph = star_graph(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_PLACE))
    edges = items.select((F.col("l_orderkey") * 1000 + place).alias("id"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"))
    graph.use_edges("ITEM", edges, "Orders", "Part")
    return graph


@_steps("update_edge", "SELECT l_orderkey AS o_id, l_partkey AS p_id, CASE WHEN l_quantity >= 45 THEN 0.0 ELSE l_discount END AS e_discount FROM " + _ITEMS + " JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY item DESC) = 1")
def _update_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _items(spark, sf_dir)
    graph.update(Update.match(Query.match("o:Orders").traverse("o", "ITEM", "p:Part", alias="e").where("e.quantity", ">=", 45.0)).set("e.discount", 0.0))
    return graph.query(Query.match("o:Orders").traverse("o", "ITEM", "p:Part", alias="e").select("o.id", "p.id", "e.discount")).df


@_steps("update_edge_without_ids", "SELECT o_custkey AS c_id, o_orderkey AS o_id, CASE WHEN o_totalprice > 200000 THEN 'late' ELSE o_orderpriority END AS e_priority FROM customer JOIN orders ON c_custkey = o_custkey")
def _update_edge_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that were registered without ids get them when they are changed."""
    graph = _placed(spark, sf_dir)
    graph.update(Update.match(Query.match("c:Customer").traverse("c", "ORDERED", "o:Orders", alias="e").where("o.totalprice", ">", 200000.0)).set("e.priority", "late"))
    return graph.query(Query.match("c:Customer").traverse("c", "ORDERED", "o:Orders", alias="e").select("c.id", "o.id", "e.priority")).df


@_steps("update_node_fields", "SELECT c_custkey AS c_id, CASE WHEN c_custkey = 5 THEN 'Five' ELSE c_name END AS c_name, CASE WHEN c_custkey = 5 THEN 1.5 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey = 6 THEN 'SIX' ELSE c_mktsegment END AS c_segment FROM customer")
def _update_node_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.update_node_fields("Customer", 5, {"name": "Five", "acctbal": 1.5})
    graph.update_node("Customer", 6, "segment", "SIX")
    return graph.query(Query.match("c:Customer")).df


@_steps("map_replace", "SELECT event_id AS e_id, CASE WHEN value <= 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS e_props_k, CASE WHEN value > 50 THEN 1.5 END AS e_props_only FROM events")
def _map_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    graph.update(Update.match(Query.match("e:Event").where("e.value", ">", 50.0)).set("e.props", {"only": 1.5}))
    return graph.query(Query.match("e:Event").select("e.id", Item("e.props.k", kind="int64"), Item("e.props.only", kind="double"))).df


@_steps("map_key_remove", "SELECT event_id AS e_id, CASE WHEN value <= 50 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS e_props_k FROM events")
def _map_key_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = event_graph(spark, sf_dir)
    graph.update(Update.match(Query.match("e:Event").where("e.value", ">", 50.0)).remove("e.props.k"))
    return graph.query(Query.match("e:Event").select("e.id", Item("e.props.k", kind="int64"))).df


@_steps("array_set", "SELECT c_custkey AS c_id, CASE WHEN c_acctbal < 0 THEN ['debt', 'watch'] ELSE [c_mktsegment] END AS c_tags FROM customer")
def _array_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark)
    customer = table(spark, sf_dir, "customer")
    graph.use_nodes("Customer", customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.array("c_mktsegment").alias("tags")))
    graph.update(Update.match(Query.match("c:Customer").where("c.acctbal", "<", 0.0)).set("c.tags", ["debt", "watch"]))
    return graph.query(Query.match("c:Customer").select("c.id", "c.tags")).df


@_steps("array_append", "SELECT c_custkey AS c_id, CASE WHEN c_acctbal < 0 THEN [c_mktsegment, 'debt', 'watch'] ELSE [c_mktsegment] END AS c_tags FROM customer")
def _array_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark)
    customer = table(spark, sf_dir, "customer")
    graph.use_nodes("Customer", customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.array("c_mktsegment").alias("tags")))
    graph.update(Update.match(Query.match("c:Customer").where("c.acctbal", "<", 0.0)).append("c.tags", ["debt", "watch"]))
    return graph.query(Query.match("c:Customer").select("c.id", "c.tags")).df


def _placed(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and orders with edges that have a property and no id."""
    graph = star_graph(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    graph.use_edges("ORDERED", orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("priority")), "Customer", "Orders")
    return graph


@_steps("edge_alias_without_ids", "SELECT c_custkey AS c_id, o_orderkey AS o_id, o_orderpriority AS e_priority FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority <> '1-URGENT'")
def _edge_alias_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).query(Query.match("c:Customer").traverse("c", "ORDERED", "o:Orders", alias="e").where("e.priority", "!=", "1-URGENT").select("c.id", "o.id", "e.priority")).df


@_steps("edge_json_roundtrip", "SELECT l_orderkey AS source_id, l_partkey AS target_id, l_quantity AS quantity, l_discount AS discount, l_returnflag AS returnflag FROM lineitem")
def _edge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to JSON objects, and those to edges again."""
    graph = _items(spark, sf_dir)
    graph.create_edge_schema("COPY", {"quantity": "double", "discount": "double", "returnflag": "string"}, "Orders", "Part")
    graph.connect_json("COPY", graph.edges_as_json("ITEM"))
    return graph.edge_frame("COPY").drop("id", "created_ts")


@_steps("edge_scan", f"SELECT item AS id, l_orderkey AS source_id, l_partkey AS target_id, l_quantity AS quantity FROM {_ITEMS}")
def _edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).scan_edges("ITEM").select("id", "source_id", "target_id", "quantity")


@_steps("show_edges", f"SELECT item AS id, l_orderkey AS source_id, l_partkey AS target_id, CAST(NULL AS BIGINT) AS created_ts FROM {_ITEMS}")
def _show_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(_items(spark, sf_dir), "SHOW EDGES ITEM;")


@_steps("outgoing_edges", "SELECT o_custkey AS source_id, o_orderkey AS target_id FROM orders WHERE o_custkey = 7")
def _outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).outgoing(7, "PLACED").select("source_id", "target_id")


@_steps("incoming_edges", "SELECT c_custkey AS source_id, c_nationkey::BIGINT AS target_id FROM customer WHERE c_nationkey = 3")
def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).incoming(3, "IN_NATION").select("source_id", "target_id")


@_steps("node_and_edge_lookup", f"SELECT c_name AS what, c_acctbal AS value FROM customer WHERE c_custkey = 7 UNION ALL SELECT l_returnflag, l_quantity FROM {_ITEMS} WHERE item = 1000 * (SELECT min(l_orderkey) FROM lineitem) + 1")
def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _items(spark, sf_dir)
    first = graph.edge_frame("ITEM").agg(F.min("source_id")).first()[0]
    node, edge = graph.get_node("Customer", 7), graph.get_edge("ITEM", first * 1000 + 1)
    return spark.createDataFrame([(node.name, node.acctbal), (edge.returnflag, edge.quantity)], "what string, value double")


@_steps("edge_bulk_lookup", f"SELECT l_orderkey AS source_id, l_partkey AS target_id, l_quantity AS quantity FROM {_ITEMS} WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND item % 1000 <= 2")
def _edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _items(spark, sf_dir)
    done = graph.node_frame("Orders").filter("status = 'F'")
    wanted = done.select(F.explode(F.array(F.col("id") * 1000 + 1, F.col("id") * 1000 + 2)).alias("id"))
    return graph.edges_of("ITEM", wanted).select("source_id", "target_id", "quantity")


@_steps("column_values", "SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_acctbal IS NOT NULL")
def _column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).column("Customer", "acctbal")


@_steps("empty_table", "SELECT 0::BIGINT AS u_id, '' AS u_name, 0::INTEGER AS u_age WHERE false")
def _empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark)
    graph.create_schema("User", {"name": "string", "age": "int32"})
    return graph.query(Query.match("u:User")).df


@_steps("csv_graph", "SELECT n_nationkey::BIGINT AS n_id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _csv_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges loaded from CSV files."""
    import uuid

    from .sources.files import edges_from_csv, nodes_from_csv
    from .storage import shared_root

    graph, base = Graph(spark), f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    for name in ("nation", "region"):
        table(spark, sf_dir, name).write.csv(f"{base}/{name}", header=True)
    columns = table(spark, sf_dir, "nation").columns
    nations = ", ".join({"n_nationkey": "n_nationkey long", "n_regionkey": "n_regionkey long"}.get(c, f"{c} string") for c in columns)
    regions = ", ".join({"r_regionkey": "r_regionkey long"}.get(c, f"{c} string") for c in table(spark, sf_dir, "region").columns)
    nodes_from_csv(graph, "Nation", f"{base}/nation", nations, "n_nationkey")
    nodes_from_csv(graph, "Region", f"{base}/region", regions, "r_regionkey")
    edges_from_csv(graph, "IN_REGION", f"{base}/nation", nations, "Nation", "Region", "n_nationkey", "n_regionkey")
    return graph.query(Query.match("n:Nation").traverse("n", "IN_REGION", "r:Region").select("n.id", Item("n.n_name", "n_name"), Item("r.r_name", "r_name"))).df


@_steps("filter_bool", "SELECT c_custkey AS c_id, c_acctbal > 5000 AS c_rich FROM customer WHERE NOT c_acctbal > 5000")
def _filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph(spark)
    graph.use_nodes("Customer", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 5000).alias("rich")))
    return graph.query(Query.match("c:Customer").where("c.rich", "=", False)).df


@_steps("versioned_updates", "SELECT c_custkey AS c_id, moment, CASE WHEN moment > 1 AND c_acctbal > 9000 THEN 'TOP' WHEN moment > 0 AND c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS c_segment FROM customer, (VALUES (0), (1), (2)) t(moment)")
def _versioned_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk nodes, changed twice: as of each time they read as they were then."""
    graph, clock = _versioned(spark, sf_dir)
    parts = [graph.query(Query.match("c:Customer").as_of_valid_time(10 * at).select("c.id", "c.segment")).df.withColumn("moment", F.lit(at)) for at in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _versioned(spark: SparkSession, sf_dir: str):
    clock = temporal.ManualClock(0)
    graph = star_graph(spark, sf_dir, Config(versioning=True, clock=clock))
    graph.node_frame("Customer")  # registered at 0
    for now, least, segment in ((10, 5000.0, "RICH"), (20, 9000.0, "TOP")):
        clock.now = now
        graph.update(Update.match(Query.match("c:Customer").where("c.acctbal", ">", least)).set("c.segment", segment))
    return graph, clock


@_steps("version_counts", "SELECT c_custkey AS id, 1 + (c_acctbal > 5000)::BIGINT + (c_acctbal > 9000)::BIGINT AS versions FROM customer")
def _version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir)[0].version_counts("Customer")


@_steps("versions_after_restore", "SELECT c_custkey AS c_id, c_mktsegment AS c_segment, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS now FROM customer")
def _versions_after_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's nodes begin their versions when they are restored."""
    clock = temporal.ManualClock(5)
    config = _snapshot_config(spark, versioning=True, clock=clock)
    graph = Graph(spark, config)
    graph.use_nodes("Customer", star_graph(spark, sf_dir).node_frame("Customer"))
    graph.commit()
    again = Graph.open(spark, config)
    clock.now = 6
    again.update(Update.match(Query.match("c:Customer").where("c.acctbal", "<", 0.0)).set("c.segment", "DEBT"))
    now = again.query(Query.match("c:Customer").select("c.id", Item("c.segment", "now"))).df
    return again.query(Query.match("c:Customer").as_of_valid_time(5).select("c.id", "c.segment")).df.join(now, "c.id")


@_steps("as_of_without_versions", "SELECT c_custkey AS c_id, CASE WHEN c_custkey = 7 THEN 'Seven' ELSE c_name END AS c_name FROM customer")
def _as_of_without_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.update(Update.on("Customer", 7).set("name", "Seven"))
    return graph.query(Query.match("c:Customer").as_of_valid_time(_MID).select("c.id", "c.name")).df


@_steps("delete_by_id", "SELECT c_custkey AS c_id FROM customer WHERE c_custkey <> 7")
def _delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    execute(graph, "DELETE Customer(7);")
    return graph.query(Query.match("c:Customer").select("c.id")).df


@_steps("delete_path", "WITH hit AS (SELECT * FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 280000) SELECT 'c' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM hit) UNION ALL SELECT 'o', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM hit)")
def _delete_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a pattern go."""
    graph = star_graph(spark, sf_dir)
    execute(graph, "DELETE (c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice > 280000.0;")
    left = [graph.node_frame(schema).select(F.lit(kind).alias("kind"), "id") for kind, schema in (("c", "Customer"), ("o", "Orders"))]
    return left[0].unionByName(left[1])


@_steps("delete_nodes", "SELECT c_custkey AS c_id FROM customer WHERE NOT c_acctbal < 0")
def _delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    graph.delete_matched(Query.match("c:Customer").where("c.acctbal", "<", 0.0))
    return graph.query(Query.match("c:Customer").select("c.id")).df


@_steps("delete_edges_from_to", "SELECT c_custkey AS c_id, n_nationkey::BIGINT AS n_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (c_mktsegment = 'BUILDING' AND n_nationkey < 10)")
def _delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    single = graph.edge_frame("IN_NATION")
    graph.edges["IN_NATION"].frame = single.withColumn("id", F.col("source_id"))
    graph.delete_edges("IN_NATION", ("Customer", F.col("segment") == "BUILDING"), ("Nation", F.col("id") < 10))
    return graph.query(Query.match("c:Customer").traverse("c", "IN_NATION", "n:Nation").select("c.id", "n.id")).df


@_steps("create_bulk", "SELECT n_name AS s_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _create_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges loaded in bulk, with ids that the graph gives."""
    graph = Graph(spark)
    graph.create_schema("Place", {"name": "string"})
    graph.create_schema("Firm", {"name": "string", "nation": "string"})
    supplier, nation = (table(spark, sf_dir, t) for t in ("supplier", "nation"))
    graph.create_nodes("Place", nation.select(F.col("n_name").alias("name")))
    graph.create_nodes("Firm", supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("nation")))
    firms, places = graph.node_frame("Firm"), graph.node_frame("Place")
    graph.create_edge_schema("AT", None, "Firm", "Place")
    graph.connect_many("AT", firms.join(places.select(F.col("id").alias("target_id"), F.col("name").alias("nation")), "nation").select(F.col("id").alias("source_id"), "target_id"))
    return graph.query(Query.match("f:Firm").traverse("f", "AT", "s:Place").select("s.name")).df.groupBy("`s.name`").agg(F.count("*").alias("n"))


@_steps("create_bulk_aggregated", "SELECT n_part, l_partkey AS p_key, s_lines AS p_lines, s_flags AS p_flags FROM (SELECT l_partkey, count(*) AS s_lines, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS s_flags, sum(count(*)) OVER () AS total, count(*) OVER () AS n_part FROM lineitem GROUP BY l_partkey)")
def _create_bulk_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges made of aggregated tables: each row becomes one node and one edge, whatever partitions they are read in."""
    graph = Graph(spark)
    graph.create_schema("Sold", {"key": "int64", "lines": "int64", "flags": "string"})
    items = table(spark, sf_dir, "lineitem")
    sold = items.groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("lines"), F.concat_ws("", F.array_sort(F.collect_set("l_returnflag"))).alias("flags"))
    n = graph.create_nodes("Sold", sold)
    nodes = graph.node_frame("Sold")
    graph.create_edge_schema("SAME", {"flags": "string"}, "Sold", "Sold")
    assert graph.connect_many("SAME", nodes.groupBy(F.col("id").alias("source_id")).agg(F.max("id").alias("target_id"), F.max("flags").alias("flags"))) == n
    found = graph.query(Query.match("p:Sold").traverse("p", "SAME", "q:Sold", alias="e").select("p.key", "p.lines", "e.flags")).df
    return found.withColumnRenamed("e.flags", "p.flags").withColumn("n_part", F.lit(n).cast("bigint"))


@_steps("show_edge_types", "SELECT * FROM (SELECT 'BASED_IN' AS type, count(*) AS count FROM supplier UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem UNION ALL SELECT 'IN_NATION', count(*) FROM customer UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'PLACED', count(*) FROM orders)")
def _show_edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(star_graph(spark, sf_dir), "SHOW EDGE TYPES;")


def _snapshot_config(spark: SparkSession, **more) -> Config:
    import uuid

    from .storage import shared_root

    config = Config(path=f"{shared_root(spark)}/snapshot-{uuid.uuid4().hex}", **more)
    path = spark._jvm.org.apache.hadoop.fs.Path(config.path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return config


@_steps("snapshot_roundtrip", f"SELECT {_CUSTOMER}, {_ORDER} FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 280000")
def _snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _snapshot_config(spark)
    graph, whole = Graph(spark, config), star_graph(spark, sf_dir)
    graph.use_nodes("Customer", whole.node_frame("Customer"))
    graph.use_nodes("Orders", whole.node_frame("Orders"))
    graph.use_edges("PLACED", whole.edge_frame("PLACED").select("source_id", "target_id"), "Customer", "Orders", unique=True)
    graph.commit()
    return Graph.open(spark, config).query(Query.match("c:Customer").traverse("c", "PLACED", "o:Orders").where("o.totalprice", ">", 280000.0)).df


@_steps("snapshot_of_before", "SELECT c_custkey AS c_id, c_mktsegment AS before, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS after, 2 AS n_snapshots FROM customer")
def _snapshot_of_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits; the first is restored beside the second."""
    from .sources.snapshot import restore, snapshots

    config = _snapshot_config(spark)
    graph = Graph(spark, config)
    graph.use_nodes("Customer", star_graph(spark, sf_dir).node_frame("Customer"))
    first = graph.commit()
    graph.update(Update.match(Query.match("c:Customer").where("c.acctbal", "<", 0.0)).set("c.segment", "DEBT"))
    graph.commit()
    read = lambda g, name: g.query(Query.match("c:Customer").select("c.id", Item("c.segment", name))).df
    both = read(restore(spark, config, first), "before").join(read(Graph.open(spark, config), "after"), "c.id")
    return both.withColumn("n_snapshots", F.lit(len(snapshots(spark, config.path))))


@_steps("shard_info", "SELECT CAST(floor(id / 1000) AS BIGINT) AS shard, count(*) AS count, min(c) AS min_id, max(c) AS max_id FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, c_custkey AS c FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def _shard_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir, Config(shard_capacity=1000))
    graph.delete_matched(Query.match("c:Customer").where("c.acctbal", "<", 0.0))
    graph.compact_all()
    return graph.shards("Customer").withColumn("shard", F.col("shard").cast("bigint"))


# Statements


def _text(name: str, statement: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(execute(opened(star_graph, spark, sf_dir), statement))
    SQL[name] = sql


_text("text_match", 'MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE c.segment = "BUILDING" AND o.totalprice > 150000.0 SELECT c.id, o.totalprice AS price;', "SELECT c_custkey AS c_id, o_totalprice AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 150000")
_text("text_incoming_left", "MATCH (n:Nation)<-[:IN_NATION RIGHT]-(c:Customer), (n)-[:IN_REGION]->(r:Region) WHERE (r.id < 2 OR n.id > 20) SELECT n.id, c.id, r.id;", "SELECT n_nationkey::BIGINT AS n_id, c_custkey AS c_id, r_regionkey::BIGINT AS r_id FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2 OR n_nationkey > 20")
_text("text_edge_alias", "MATCH (o:Orders)-[e:CONTAINS INNER]->(p:Part) WHERE e.quantity >= 48.0 AND o.totalprice > 200000 SELECT o.id, p, e.returnflag;", f"SELECT o_orderkey AS o_id, p_partkey AS p_id, p_name, p_brand, p_size, p_retailprice, l_returnflag AS e_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey QUALIFY {_LAST} AND l_quantity >= 48 AND o_totalprice > 200000")


_text("text_field_compare", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.totalprice <= c.acctbal OR c.acctbal < 0 SELECT c.id, o.id;", "SELECT c_custkey AS c_id, o_orderkey AS o_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice <= c_acctbal OR c_acctbal < 0")


_text("text_layout_and_comments", """MATCH (c:Customer)   // who
-- what they ordered
  -[:PLACED]->(o:Orders)
WHERE (c.segment = "BUILDING" OR c.segment = "MACHINERY") AND (o.totalprice > 200000.0 OR o.totalprice < 20000.0) AND o.status <> "F"
SELECT c.id AS who, o.id AS what;""", "SELECT c_custkey AS who, o_orderkey AS what FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (o_totalprice > 200000 OR o_totalprice < 20000) AND o_orderstatus <> 'F'")


@_steps("text_update_pattern", "SELECT c_custkey AS c_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 280000) THEN 'VIP' ELSE c_mktsegment END AS c_segment FROM customer")
def _text_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    execute(graph, 'UPDATE MATCH (c:Customer)-[:PLACED]->(o:Orders) SET c.segment = "VIP" WHERE o.totalprice > 280000.0;')
    return execute(graph, "MATCH (c:Customer) SELECT c.id, c.segment;")


@_steps("text_delete_edges", "SELECT c_custkey AS c_id, o_orderkey AS o_id FROM customer JOIN orders ON c_custkey = o_custkey WHERE NOT (c_mktsegment = 'BUILDING' AND o_orderstatus = 'F')")
def _text_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    execute(graph, 'DELETE EDGE PLACED FROM (Customer{segment = "BUILDING"}) TO (Orders{status = "F"});')
    return execute(graph, "MATCH (c:Customer)-[:PLACED]->(o:Orders) SELECT c.id, o.id;")


@_steps("text_create_edges", "SELECT n_name, r_name FROM (SELECT 'Xland' AS n_name) x, region WHERE r_name LIKE 'A%' UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _text_create_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new node, and edges from it to each node that a selection picks."""
    graph = star_graph(spark, sf_dir)
    id = execute(graph, 'CREATE NODE Nation (name = "Xland") RETURN id;')
    for name in (r["name"] for r in graph.node_frame("Region").filter("name LIKE 'A%'").collect()):
        execute(graph, f'CREATE EDGE IN_REGION FROM Nation({id}) TO (Region{{name = "{name}"}});')
    return execute(graph, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) SELECT n.name, r.name;")


@_steps("text_script", "SELECT 'Ann' AS u_name, 31::BIGINT AS u_age, 'Acme' AS c_name, 2020::BIGINT AS e_since UNION ALL SELECT 'Bob', 25, NULL, NULL")
def _text_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas, nodes, edges and an update by statements."""
    graph = Graph(spark)
    for statement in (
        "CREATE SCHEMA User (name: STRING, age: INT64);", "CREATE SCHEMA Company (name: STRING);", "CREATE EDGE SCHEMA WORKS_AT (since: INT64);",
        'CREATE NODE User (name = "Ann", age = 30);', 'CREATE NODE User (name = "Bob", age = 25);', 'CREATE NODE Company (name: "Acme") RETURN id;',
        'CREATE UNIQUE EDGE WORKS_AT FROM (User{name="Ann"}) TO Company(0) WITH (since = 2020);', 'UPDATE (u:User) SET u.age = 31 WHERE u.name = "Ann";',
    ):
        execute(graph, statement)
    return execute(graph, "MATCH (u:User)-[e:WORKS_AT LEFT]->(c:Company) SELECT u.name, u.age, c.name, e.since;")
