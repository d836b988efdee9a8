"""The store contract and two adapters: tables of runs in memory, and Parquet by run and version."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Store(Protocol):
    def publish(self, run_id: str, tables: dict[str, DataFrame]) -> None: ...

    def add(self, table: str, run_id: str, rows: DataFrame) -> None: ...

    def get(self, table: str, run_id: str | None = None) -> DataFrame | None: ...


class MemoryStore:
    """Keeps plans, for tests and inspection without a run."""

    def __init__(self) -> None:
        self.tables: dict[tuple[str, str], DataFrame] = {}

    def publish(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        self.tables.update({(table, run_id): rows for table, rows in tables.items()})

    def add(self, table: str, run_id: str, rows: DataFrame) -> None:
        old = self.tables.get((table, run_id))
        self.tables[table, run_id] = rows if old is None else old.unionByName(rows)

    def get(self, table: str, run_id: str | None = None) -> DataFrame | None:
        out = None
        for (name, run), rows in self.tables.items():
            if name == table and run_id in (None, run):
                rows = rows.withColumn("run_id", F.lit(run))
                out = rows if out is None else out.unionByName(rows)
        return out


class ParquetStore:
    """A folder of tables by run and version; logs are added to by run alone.

    publish() writes each table as a new version, which nobody reads yet, and then adds one row that says which version of each table counts.
    Readers follow the run's last such row, so whoever stops in between leaves the former state whole. Versions that no row names any
    more stay until vacuum().
    """

    #: Tables whose versions are partitioned once more, so that readers of all runs open only what they ask for.
    BY = {"reuse": ["boundary"]}
    LOG = "publications"
    ROW = "n long, tables map<string,string>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/{path.split('/')[0]}").parquet(f"{self.root}/{path}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _last(self, run_id: str):
        rows = self._read(f"{self.LOG}/run_id={run_id}")
        return rows.orderBy(F.desc("n")).select("n", "tables").first() if rows is not None else None

    def publish(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        version, last = f"v{uuid.uuid4().hex}", self._last(run_id)
        for table, rows in tables.items():
            rows.drop("run_id", "version").write.partitionBy(*self.BY.get(table, [])).parquet(f"{self.root}/{table}/run_id={run_id}/version={version}")
        n, known = (last["n"] + 1, last["tables"]) if last else (0, {})
        row = self.spark.createDataFrame([(n, {**known, **dict.fromkeys(tables, version)})], self.ROW)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/{self.LOG}/run_id={run_id}")  # one file, there whole or not at all

    def add(self, table: str, run_id: str, rows: DataFrame) -> None:
        rows.drop("run_id").write.mode("append").parquet(f"{self.root}/{table}/run_id={run_id}")

    def get(self, table: str, run_id: str | None = None) -> DataFrame | None:
        if run_id is not None:
            last = self._last(run_id)
            version = last["tables"].get(table) if last else None
            rows = self._read(f"{table}/run_id={run_id}" + (f"/version={version}" if version else ""))
            return None if rows is None or (version is None and "version" in rows.columns) else rows.withColumn("run_id", F.lit(run_id)).drop("version")
        rows, log = self._read(table), self._read(self.LOG)
        if rows is None or "version" not in rows.columns:
            return rows
        if log is None:
            return None
        last = log.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max_by("tables", "n").alias("tables")).select("run_id", F.col("tables")[table].alias("version"))
        return rows.drop("run_id").join(last, "version").drop("version")

    def vacuum(self, run_id: str) -> list[str]:
        """Deletes the run's versions that its last publication doesn't name, once no reader of former ones is left; their folders."""
        jvm, last = self.spark._jvm, self._last(run_id)
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(path(f"{self.root}/*/run_id={run_id}/version=*")) or []
        folders = [f.getPath() for f in found]
        gone = [p for p in folders if last and last["tables"].get(p.getParent().getParent().getName()) != p.getName().partition("=")[2]]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.toString() for p in gone)
