"""The star-schema test tables as a property graph.

Nodes: Region, Nation, Customer, Supplier, Orders, Part, Message, Document, Label and User (one version an event).
Edges: IN_REGION, IN_NATION, BASED_IN, PLACED, CONTAINS (with properties), REPLIES, ANSWERS, LABELLED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import maps
from .graph import Config, Graph
from .operators import temporal


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is looked up once: the files are read-only, so footers need not be opened for each query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _nodes(table: DataFrame, key: str, **fields: str) -> DataFrame:
    return table.select(F.col(key).cast("bigint").alias("id"), *(F.col(c).alias(n) for n, c in fields.items()))


def _edges(table: DataFrame, source: str, target: str) -> DataFrame:
    return table.select(F.col(source).cast("bigint").alias("source_id"), F.col(target).cast("bigint").alias("target_id"))


def user_versions(events: DataFrame) -> DataFrame:
    """Each event states its user's whole state from its time on."""
    return temporal.history(events, "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") * 1000, ["event_type", "value"])


def star_graph(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Graph:
    read = lambda name: table(spark, sf_dir, name)
    graph = Graph(spark, config)

    def nodes(schema: str, source: str, key: str, **fields: str) -> None:
        graph.on_demand(schema, lambda: graph.use_nodes(schema, _nodes(read(source), key, **fields)))

    def edges(name: str, rows: str, source: str, target: str, ends: tuple[str, str], unique: bool = True) -> None:
        graph.on_demand(name, lambda: graph.use_edges(name, _edges(read(rows), source, target), *ends, unique=unique))

    def contains() -> None:
        # An item has no id of its own; of parallel items the one that is last in this order counts.
        items = read("lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), item_order().alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"))
        graph.use_edges("CONTAINS", items, "Orders", "Part")

    nodes("Region", "region", "r_regionkey", name="r_name")
    nodes("Nation", "nation", "n_nationkey", name="n_name")
    nodes("Customer", "customer", "c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment")
    nodes("Supplier", "supplier", "s_suppkey", name="s_name", acctbal="s_acctbal")
    nodes("Orders", "orders", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority")
    nodes("Part", "part", "p_partkey", name="p_name", brand="p_brand", size="p_size", retailprice="p_retailprice")
    edges("IN_REGION", "nation", "n_nationkey", "n_regionkey", ("Nation", "Region"))
    edges("IN_NATION", "customer", "c_custkey", "c_nationkey", ("Customer", "Nation"))
    edges("BASED_IN", "supplier", "s_suppkey", "s_nationkey", ("Supplier", "Nation"))
    edges("PLACED", "orders", "o_custkey", "o_orderkey", ("Customer", "Orders"))
    edges("SUPPLIED_BY", "lineitem", "l_orderkey", "l_suppkey", ("Orders", "Supplier"), False)
    graph.on_demand("CONTAINS", contains)
    return graph


def item_order() -> Column:
    """Orders items by ship date, then line number, then price in cents: one number for each that differs in these."""
    days = F.datediff(F.col("l_shipdate"), F.lit("1990-01-01")).cast("bigint")
    return (days * 16 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("bigint")


def talk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Messages; REPLIES from each to the one before, ANSWERS from an assistant's to the one before."""
    graph = Graph(spark)
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    graph.use_nodes("Message", rows.select("id", "conv_id", "turn", "role"))
    later = rows.filter("turn > 0").select(F.col("id").alias("source_id"), (F.col("id") - 1).alias("target_id"), "role")
    graph.use_edges("REPLIES", later.drop("role"), "Message", "Message", unique=True)
    graph.use_edges("ANSWERS", later.filter("role = 'assistant'").drop("role"), "Message", "Message", unique=True)
    return graph


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    graph = Graph(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graph.use_nodes("Document", docs.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars"))
    graph.use_nodes("Label", labels.select(F.col("doc_id").alias("id"), "quality", "toxic"))
    graph.use_edges("LABELLED", labels.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("target_id")), "Document", "Label", unique=True)
    return graph


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event nodes with a property map; User nodes with versions."""
    graph = Graph(spark, Config(versioning=True))
    events = table(spark, sf_dir, "events")

    def users() -> None:
        versions = user_versions(events)
        graph.use_nodes("User", temporal.as_of(versions, ["event_type", "value"], None, None), versions)

    graph.on_demand("Event", lambda: graph.use_nodes("Event", events.select(F.col("event_id").alias("id"), "user_id", "event_type", "value", maps.from_json(F.col("props")).alias("props"))))
    graph.on_demand("User", users)
    return graph
