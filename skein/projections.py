"""Graphs read out of the star-schema and event tables; the SQL is the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph, GraphOptions, both_ways, endpoints, grouped
from skein.plans.deal import deal
from skein.plans.ranking import with_position

# Parts that follow each other in an order.
LINECHAIN = """
select src, dst, cast(min(q) as int) as weight
from (select l_partkey as src, cast(l_quantity as int) as q,
             lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_suppkey) as dst
      from lineitem) t
where dst is not null and src <> dst group by src, dst"""

# Users that follow each other in time.  DuckDB takes the window as it is; in Spark, where a window without a key
# is one task, places in the global order are joined to the next.
HANDOFF = """
select src, dst, cast(count(*) as int) as weight
from (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events) t
where dst is not null and src <> dst group by src, dst"""

# Parts (even ids) and their suppliers (odd ids).
PARTSUPP = """
select l_partkey * 2 as src, l_suppkey * 2 + 1 as dst, cast(min(l_quantity) as int) as weight
from lineitem group by l_partkey * 2, l_suppkey * 2 + 1"""

_CUSTPART = """
select o_custkey * 2 as src, l_partkey * 2 + 1 as dst, cast(min(l_quantity) as int) as weight
from orders join lineitem on o_orderkey = l_orderkey
where l_quantity >= {q} group by o_custkey * 2, l_partkey * 2 + 1"""

# Customers (even ids) and their parts (odd ids): "custpart" over all order lines is one component, the other two keep
# the lines of at least 45 and of 50 pieces, of which the graph falls into several, as some queries need.
SQL = {"linechain": LINECHAIN, "handoff": HANDOFF, "partsupp": PARTSUPP, "custpart": _CUSTPART.format(q=0), "custpart45": _CUSTPART.format(q=45), "custpart50": _CUSTPART.format(q=50)}

# What the four kinds of SQL above group, a row for each pair of lines: Spark deals it by the size of the input, and
# undirected graphs group it once, with its reverse.
_CUSTPART_ROWS = """
select o_custkey * 2 as src, l_partkey * 2 + 1 as dst, l_quantity as weight
from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey where l_quantity >= {q}"""
ROWS = {
    "linechain": """
select src, dst, q as weight
from (select l_partkey as src, cast(l_quantity as int) as q,
             lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_suppkey) as dst
      from {lineitem}) t
where dst is not null and src <> dst""",
    "partsupp": "select l_partkey * 2 as src, l_suppkey * 2 + 1 as dst, l_quantity as weight from {lineitem}",
    "custpart": _CUSTPART_ROWS.format(q=0), "custpart45": _CUSTPART_ROWS.format(q=45), "custpart50": _CUSTPART_ROWS.format(q=50),
}


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection's edges before they are grouped, without touching the session's named views."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders") if f"{{{t}}}" in ROWS[name]}
    if name == "linechain":
        frames["lineitem"] = deal(frames["lineitem"], "l_orderkey")
    return spark.sql(ROWS[name], **frames)


def edges_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection's edges."""
    if name == "handoff":
        placed = with_position(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id"), ["ts", "event_id"]).select("position", F.col("user_id").alias("src"))
        after = placed.select((F.col("position") - 1).alias("position"), F.col("src").alias("dst"))
        return placed.join(after, "position").where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("int").alias("weight"))
    return grouped(rows_of(spark, sf_dir, name)).withColumn("weight", F.col("weight").cast("int"))


def load(spark: SparkSession, sf_dir: str, name: str, directed: bool = True) -> Graph:
    """The projection as a graph; repeated pairs of an undirected one keep the smaller weight."""
    options = GraphOptions(name=name, directed=directed)
    if directed:  # grouped by (src, dst) already
        edges = edges_of(spark, sf_dir, name)
        return Graph(endpoints(edges), edges, options)
    if name not in ROWS:
        return Graph.from_edges(edges_of(spark, sf_dir, name), options=options)
    # The smallest weight of an edge and its reverse is the smallest of all their rows.
    edges = both_ways(rows_of(spark, sf_dir, name).where("src is not null and dst is not null")).withColumn("weight", F.coalesce(F.col("weight").cast("int"), F.lit(0)))
    return Graph(edges.select(F.col("src").alias("id")).distinct(), edges, options)


def graph_sql(name: str, directed: bool = True) -> str:
    """Common table expressions ``edges`` and ``nodes`` for the SQL twins."""
    if directed:
        return f"edges as ({SQL[name]}), nodes as (select src as id from edges union select dst from edges)"
    return f"""one_way as ({SQL[name]}),
edges as (select src, dst, min(weight) as weight from (select src, dst, weight from one_way union all select dst, src, weight from one_way) b group by src, dst),
nodes as (select distinct src as id from edges)"""
