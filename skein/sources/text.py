"""Text formats: edge lists, node lists, adjacency lists, dumps, scores and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph

_NUMBER = r"^\d+$"
# A number may end in one of the line ends that are no white space, as $ allows in _NUMBER.
_TWO_NUMBERS = r"^\s*\d+[\u0085\u2028\u2029]?\s+\d+[\u0085\u2028\u2029]?(\s|$)"


def _rows(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments (# and %)."""
    line = F.trim(F.regexp_replace(F.col(lines.columns[0]), r"\s+", " "))
    return lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike("^[#%]"))


def parse_edges(lines: DataFrame) -> DataFrame:
    """``src<ws>dst[<ws>weight]`` lines as edges; lines that don't begin with two numbers are left out."""
    # One look at the raw line: conditions on its parts would have the planner take it apart for each of them.
    line = F.trim(F.regexp_replace(F.col(lines.columns[0]), r"\s+", " "))
    parts = lines.where(F.col(lines.columns[0]).rlike(_TWO_NUMBERS)).select(F.split(line, " ").alias("p"))
    weight = F.when((F.size("p") >= 3) & F.get("p", F.lit(2)).rlike(r"^-?\d+$"), F.get("p", F.lit(2)).try_cast("int")).otherwise(0)
    return parts.select(F.col("p")[0].try_cast("long").alias("src"), F.col("p")[1].try_cast("long").alias("dst"), weight.alias("weight"))


def parse_nodes(lines: DataFrame) -> DataFrame:
    """One id a line."""
    return _rows(lines).where(F.col("line").rlike(_NUMBER)).select(F.col("line").try_cast("long").alias("id"))


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """``id degree n1,n2,...`` lines (commas or spaces) as ``(node_id, degree, edgelist)``; the degree is the list's length."""
    parts = _rows(lines).select(F.split("line", " ", 3).alias("p")).where((F.size("p") >= 2) & F.col("p")[0].rlike(_NUMBER))
    members = F.filter(F.split(F.coalesce(F.get("p", F.lit(2)), F.lit("")), "[, ]+"), lambda x: x != "")
    lists = parts.select(F.col("p")[0].try_cast("long").alias("node_id"), F.transform(members, lambda x: x.try_cast("long")).alias("edgelist"))
    return lists.select("node_id", F.size("edgelist").alias("degree"), "edgelist")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return parse_nodes(spark.read.text(path))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(spark.read.text(path))


def adjacency_lines(lists: DataFrame) -> DataFrame:
    """``value``: ``id degree n1,n2,...``."""
    members = F.array_join(F.transform("edgelist", lambda x: x.cast("string")), ",")
    return lists.select(F.concat_ws(" ", F.col("node_id").cast("string"), F.col("degree").cast("string"), members).alias("value"))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Records as text: every column with its name."""
    return nodes.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in nodes.columns]).alias("value"))


def dump(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` records in key order, as text."""
    return node_lines(df.orderBy(*keys).limit(n))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_scores(scores: DataFrame, path: str, score: str = "rank") -> None:
    """``id<TAB>score`` lines."""
    scores.select("id", score).write.csv(path, sep="\t")


def write_labels(components: DataFrame, path: str) -> None:
    """One component label a line."""
    components.select(F.col("component").cast("string").alias("value")).write.text(path)


def append_run_log(spark: SparkSession, path: str, **fields) -> None:
    """Append one row to a CSV run log; each file of it has the header."""
    spark.createDataFrame([tuple(fields.values())], list(fields)).coalesce(1).write.mode("append").csv(path, header=True)


def run_log_means(log: DataFrame, by: list[str]) -> DataFrame:
    """Mean of every numeric column of a run log."""
    numeric = [f.name for f in log.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float") and f.name not in by]
    return log.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])


def from_adjacency(lists: DataFrame) -> DataFrame:
    """Edges of adjacency lists, all of weight 0."""
    return lists.select(F.col("node_id").alias("src"), F.explode("edgelist").alias("dst"), F.lit(0).alias("weight"))


def edge_lines(g: Graph) -> DataFrame:
    """``value``: ``src<TAB>dst<TAB>weight``."""
    return g.edges.select(F.concat_ws("\t", "src", "dst", "weight").alias("value"))
