"""The code-graph model over relational tables: nodes, edges and their closure as DataFrames.

nodes: id, kind, name, path, parent, loc, tags, external. edges: src, dst, kind, label, weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.durable import dealt

#: Where each kind of node's ids begin.
REGION, NATION, BRAND, SUPPLIER, CUSTOMER, ORDER = 1, 100, 500, 10_000, 1_000_000, 100_000_000
#: Containment is at most this deep: repository, two levels of packages, file, symbol.
DEPTH = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def closure(self) -> DataFrame:
        """(node, ancestor, dist) with each node its own ancestor at 0: one small join a level."""
        up = self.nodes.filter("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("ancestor"))
        level = self.nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"))
        out = level.withColumn("dist", F.lit(0).cast("long"))
        for d in range(1, DEPTH + 1):
            level = level.join(up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("node", F.col("next").alias("ancestor"))
            out = out.unionByName(level.withColumn("dist", F.lit(d).cast("long")))
        return out


def graph(spark: SparkSession, sf_dir: str, home: bool = False) -> Graph:
    """Regions and nations are nested packages, brands external ones, suppliers and customers files,
    orders symbols. home: only calls between an order and a supplier of its customer's nation."""
    region, nation, part, supplier, customer, orders, lines = (read(spark, sf_dir, t) for t in ("region", "nation", "part", "supplier", "customer", "orders", "lineitem"))
    long = lambda c: c.cast("long")
    none = F.array().cast("array<string>")

    def node(df, id_, kind, name, path, parent, loc=F.lit(0), tags=none, external=False):
        return df.select(long(id_).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), long(parent).alias("parent"), long(loc).alias("loc"), tags.alias("tags"), F.lit(external).alias("external"))

    c = F.col
    brands = part.select("p_brand").distinct()
    brand = c("p_brand")
    brand_id = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") + BRAND
    state = F.when(c("o_orderstatus") == "F", "db").when(c("o_orderstatus") == "O", "queue").otherwise("process")
    segment = F.concat(F.lit("route:/"), F.lower("c_mktsegment"))
    nodes = [
        node(spark.range(1), F.lit(0), "repo", F.lit("repo"), F.lit(""), F.lit(None)),
        node(region, c("r_regionkey") + REGION, "package", c("r_name"), c("r_name"), F.lit(0)),
        node(nation.join(region, c("n_regionkey") == c("r_regionkey")), c("n_nationkey") + NATION, "package", c("n_name"), F.concat_ws("/", "r_name", "n_name"), c("n_regionkey") + REGION),
        node(brands, brand_id, "package", brand, F.concat(F.lit("external:"), brand), F.lit(0), external=True),
        node(supplier, c("s_suppkey") + SUPPLIER, "file", c("s_name"), c("s_name"), c("s_nationkey") + NATION, c("s_suppkey") % 100 + 1, F.array(F.lit("http-server"))),
        node(customer, c("c_custkey") + CUSTOMER, "file", c("c_name"), c("c_name"), c("c_nationkey") + NATION, c("c_custkey") % 50 + 1, F.array(segment, F.lit("http-client"))),
        node(orders.join(customer, c("o_custkey") == c("c_custkey")), c("o_orderkey") + ORDER, "symbol", F.concat(F.lit("o"), "o_orderkey"), F.concat_ws("#", "c_name", "o_orderkey"), c("o_custkey") + CUSTOMER, F.lit(0), F.array(state)),
    ]
    all_nodes = nodes[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)

    def edge(df, src, dst, kind, label):
        return df.select(long(src).alias("src"), long(dst).alias("dst"), F.lit(kind).alias("kind"), label.cast("string").alias("label"), "weight")

    n_lines = lines.count()
    lines = dealt(lines, n_lines, "l_orderkey")
    at_order = lines.join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    if home:
        at_order = at_order.join(customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey")))
    calls = at_order.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("weight"))
    bought = lines.join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(part.select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).select("o_custkey", "p_brand")
    imports = dealt(bought, n_lines, "o_custkey").groupBy("o_custkey", "p_brand").agg(F.count("*").alias("weight"))
    lowest = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("lowest"))
    flows = supplier.join(lowest, c("s_nationkey") == c("c_nationkey")).join(nation, c("s_nationkey") == c("n_nationkey")).withColumn("weight", F.lit(1).cast("long"))
    contains = all_nodes.filter("parent is not null").withColumn("weight", F.lit(1).cast("long"))
    edges = edge(calls, c("l_orderkey") + ORDER, c("l_suppkey") + SUPPLIER, "calls", c("l_returnflag"))
    edges = edges.unionByName(edge(flows, c("s_suppkey") + SUPPLIER, c("lowest") + CUSTOMER, "flow", F.concat(F.lit("http /"), "n_name")))
    if not home:
        edges = edges.unionByName(edge(imports, c("o_custkey") + CUSTOMER, brand_id, "imports", F.lit(None)))
        edges = edges.unionByName(edge(contains, c("parent"), c("id"), "contains", F.lit(None)))
    # kept for the session, in memory or on disk: most queries read both several times, and a lost part is made anew
    return Graph(all_nodes.persist(), edges.persist())


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, event_id, event_type, next_type): each user's events in the order of time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "event_id", "event_type", F.lead("event_type").over(w).alias("next_type"))
