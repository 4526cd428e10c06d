"""A registry of datasets: a JSON list of names, paths, counts and directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from skein.model import GraphError, GraphOptions


@dataclass(frozen=True)
class Dataset:
    """One graph's text file; counts are what its owner says of it."""

    dataset_name: str
    graph_path: str
    num_nodes: int
    num_edges: int
    directed: bool = True

    def __post_init__(self) -> None:
        if self.num_nodes <= 0 or self.num_edges <= 0:
            raise GraphError(f"{self.dataset_name}: counts must be positive")
        if not self.graph_path:
            raise GraphError(f"{self.dataset_name}: no path")

    def options(self, **more) -> GraphOptions:
        return GraphOptions(name=self.dataset_name, directed=self.directed, **more)


def read_registry(spark: SparkSession, path: str, check_files: bool = False) -> dict[str, Dataset]:
    """Datasets by name; a name that occurs twice is an error, and so, with ``check_files``, is a file that isn't there."""
    fs = lambda p: (q := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q)
    rows = spark.read.option("multiLine", True).schema("dataset_name string, graph_path string, num_nodes long, num_edges long, directed boolean").json(path).collect()
    out = {r["dataset_name"]: Dataset(r["dataset_name"], r["graph_path"] or "", r["num_nodes"] or 0, r["num_edges"] or 0, r["directed"] is not False) for r in rows}
    if len(out) != len(rows):
        raise GraphError("a dataset is listed twice")
    missing = [d.graph_path for d in out.values() if not fs(d.graph_path)] if check_files else []
    if missing:
        raise GraphError(f"no file {missing[0]}")
    return out
