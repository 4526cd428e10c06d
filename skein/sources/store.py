"""A graph store: immutable versions in Parquet, committed by one small metadata write.

    <root>/<graph>/v=<n>/nodes|edges|edges_by_dst|adj_out|adj_in
    <root>/<graph>/v=<n>/metadata          written last: a version without it doesn't exist
    <root>/<graph>/snapshots/<name>        points to a version

Tables are dealt by ranges of their key and sorted within, so min/max statistics
of row groups and files turn range reads into short scans.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.model import Graph, GraphError, GraphOptions, Layout
from skein.operators.reads import adjacency, degrees


class GraphStore:
    """Versions of one graph under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str, options: GraphOptions) -> None:
        self.spark, self.options = spark, options
        self.path = f"{root.rstrip('/')}/{options.directory()}"

    # Files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # Versions

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        found = [int(n[2:]) for n in self._names(self.path) if n.startswith("v=")]
        return sorted(v for v in found if self._exists(f"{self.path}/v={v}/metadata/_SUCCESS"))

    def create(self, g: Graph, overwrite: bool = False) -> int:
        """Write the first version; an existing graph is an error unless it may be replaced."""
        if self._exists(self.path):
            if not overwrite:
                raise GraphError(f"{self.path} exists")
            self._delete(self.path)
        return self.commit(g, expected=None)

    def commit(self, g: Graph, expected: int | None = None) -> int:
        """Write a new version.

        ``expected`` is the version that the change was made from: if another has
        been committed since, GraphError is raised and nothing changes.
        """
        last = self.versions()
        if expected is not None and (not last or last[-1] != expected):
            raise GraphError(f"version {expected} is no longer the last")
        version = (last[-1] if last else 0) + 1
        base = f"{self.path}/v={version}"
        if self._exists(base):  # what a failed or concurrent commit has left
            raise GraphError(f"{base} is being written; clean() removes it if its writer is gone")
        g = replace(g, options=self.options)
        parts = [self.options.partitions] if self.options.partitions else []
        sort = lambda df, *keys: df.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
        nodes = degrees(g) if self.options.read_optimize else g.nodes
        sort(nodes, "id").write.parquet(f"{base}/nodes")
        sort(g.edges, "src", "dst").write.parquet(f"{base}/edges")
        layout = self.options.layout
        if layout is Layout.ADJACENCY:
            sort(adjacency(g, "out"), "node_id").write.parquet(f"{base}/adj_out")
            if g.directed:  # an undirected graph's in-lists are its out-lists
                sort(adjacency(g, "in"), "node_id").write.parquet(f"{base}/adj_in")
        if layout in (Layout.SPLIT_EDGE_KEY, Layout.EDGE_KEY) and g.directed:
            self._write_index(version)
        self._read(version).metadata().withColumns({"layout": F.lit(layout.value), "version": F.lit(version).cast("long")}).coalesce(1).write.parquet(f"{base}/metadata")
        return version

    def clean(self) -> None:
        """Remove what commits without metadata have left; call it when no writer is at work."""
        whole = {f"v={v}" for v in self.versions()}
        for name in self._names(self.path):
            if name.startswith("v=") and name not in whole:
                self._delete(f"{self.path}/{name}")

    def _version(self, version: int | None) -> int:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise GraphError(f"no version {version} in {self.path}" if version else f"nothing in {self.path}")
        return known[-1] if version is None else version

    def _read(self, version: int) -> Graph:
        base = f"{self.path}/v={version}"
        return Graph(self.spark.read.parquet(f"{base}/nodes").select("id"), self.spark.read.parquet(f"{base}/edges"), self.options)

    def graph(self, version: int | None = None) -> Graph:
        """A version, by default the last; later commits don't change what it reads."""
        return self._read(self._version(version))

    def metadata(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self._version(version)}/metadata")

    def restore_options(self, version: int | None = None) -> GraphOptions:
        """The options as the metadata has them."""
        m = self.metadata(version).first()
        return replace(self.options, name=m["db_name"], directed=m["is_directed"], weighted=m["is_weighted"], read_optimize=m["read_optimize"], layout=Layout(m["layout"]))

    def lists(self, direction: str = "out", version: int | None = None) -> DataFrame:
        """Adjacency lists, stored or computed."""
        v = self._version(version)
        path = f"{self.path}/v={v}/adj_{direction if self.options.directed else 'out'}"
        return self.spark.read.parquet(path) if self._exists(path) else adjacency(self._read(v), direction)

    def node_records(self, version: int | None = None) -> DataFrame:
        """``(id, in_degree, out_degree)``, stored if read-optimised, else computed."""
        v = self._version(version)
        stored = self.spark.read.parquet(f"{self.path}/v={v}/nodes")
        return stored if "in_degree" in stored.columns else degrees(self._read(v))

    # Index by destination

    def _write_index(self, version: int) -> None:
        edges = self.spark.read.parquet(f"{self.path}/v={version}/edges")
        edges.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").write.parquet(f"{self.path}/v={version}/edges_by_dst")

    def create_indices(self, version: int | None = None) -> None:
        """Write the copy sorted by (dst, src), if it isn't there."""
        v = self._version(version)
        if not self._exists(f"{self.path}/v={v}/edges_by_dst"):
            self._write_index(v)

    def drop_indices(self, version: int | None = None) -> None:
        self._delete(f"{self.path}/v={self._version(version)}/edges_by_dst")

    def edges_by_dst(self, version: int | None = None) -> DataFrame:
        """Edges for reads by destination, from the index if there is one."""
        v = self._version(version)
        path = f"{self.path}/v={v}/edges_by_dst"
        return self.spark.read.parquet(path if self._exists(path) else f"{self.path}/v={v}/edges")

    # Snapshots

    def checkpoint(self, name: str | None = None) -> str:
        """Name the last version; by default by the time, like 2024_01_31_12_00_00."""
        name = name or datetime.now(timezone.utc).strftime("%Y_%m_%d_%H_%M_%S")
        if self._exists(f"{self.path}/snapshots/{name}"):
            raise GraphError(f"snapshot {name} exists")
        self.spark.createDataFrame([(self._version(None),)], "version long").coalesce(1).write.parquet(f"{self.path}/snapshots/{name}")
        return name

    def snapshots(self) -> list[str]:
        return self._names(f"{self.path}/snapshots")

    def snapshot(self, name: str | None = None) -> Graph:
        """The graph as it was when the snapshot (by default the last by name) was taken."""
        names = self.snapshots()
        if not names or (name is not None and name not in names):
            raise GraphError(f"no snapshot {name}")
        return self._read(self.spark.read.parquet(f"{self.path}/snapshots/{name or names[-1]}").first()["version"])
