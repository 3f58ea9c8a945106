"""Tables that streams change: a full copy, later changes by key, and one commit per batch.

A batch writes what it changed under its own version and then the commit that
names those tables, so readers see all of a batch or none of it. A batch reads
versions below its own only: when it is replayed after a crash it sees what it saw
before and writes the same again. Changes are folded into a new full copy after
every ``fold_after`` batches, which bounds what a reader has to merge; what is
older than the full copy before that one is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "table string, full boolean"


class VersionedTables:
    """``keys``: columns that name a row, per table. ``root``: a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], fold_after: int = 20):
        self.spark, self.root, self.keys, self.fold_after = spark, root.rstrip("/"), keys, fold_after

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Version 0: full copies. Does nothing where they are committed already, so a restarted stream goes on."""
        if not self._there(f"{self.root}/commits"):
            self._commit(0, tables, True)

    def versions(self, below: int | None = None) -> list[tuple[int, str, bool]]:
        """(version, table, full copy?) of what is committed, in order."""
        marks = self.spark.read.schema(f"{_COMMIT}, version long").option("recursiveFileLookup", "true")
        rows = marks.parquet(f"{self.root}/commits").collect()
        seen = sorted((r["version"], r["table"], r["full"]) for r in rows)
        return [v for v in seen if below is None or v[0] < below]

    def current(self, table: str, below: int | None = None) -> DataFrame:
        """The rows of a table as of the last commit, or of the last one below a version."""
        return self._merged(table, [(v, full) for v, name, full in self.versions(below) if name == table])

    def _merged(self, table: str, mine: list[tuple[int, bool]]) -> DataFrame:
        start = max(v for v, full in mine if full)
        base = self.spark.read.parquet(self._path(table, start, True))
        later = [self._path(table, v, False) for v, full in mine if not full and v > start]
        if not later:
            return base
        keys = self.keys[table]
        schema = T.StructType([*base.schema.fields, T.StructField("version", T.LongType())])
        parts = self.spark.read.option("basePath", f"{self.root}/{table}/changes").schema(schema).parquet(*later)
        newest = Window.partitionBy(*keys).orderBy(F.col("version").desc())
        changed = parts.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(*base.columns)
        named = changed.select(*[F.col(k).alias(f"_{k}") for k in keys])
        kept = base.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
        return kept.unionByName(changed)

    def commit(self, version: int, changes: dict[str, DataFrame]) -> None:
        """Write the changed rows of a batch, whole rows each, and commit them together."""
        self._commit(version, changes, False)
        if version % self.fold_after == 0:
            self.fold(version)
            self.expire()

    def fold(self, version: int) -> None:
        """Full copies as of ``version``, made of earlier copies and changes, so that a replay makes the same ones."""
        known = [v for v in self.versions(version + 1) if v[:1] + v[2:] != (version, True)]
        names = sorted({name for _, name, _ in known})
        for table in names:
            merged = self._merged(table, [(v, full) for v, name, full in known if name == table])
            merged.write.mode("overwrite").parquet(self._path(table, version, True))
        self._mark(version, [(n, True) for n in names], "-full")

    def expire(self) -> None:
        """Remove what only versions below the last full copy but one need; the last batch may still be replayed."""
        full = sorted({v for v, _, whole in self.versions() if whole})
        for version, table, whole in self.versions(full[-2] if len(full) > 1 else 0):
            self._remove(self._path(table, version, whole))
            self._remove(f"{self.root}/commits/at{version}{'-full' if whole else '-changes'}")
    def _commit(self, version: int, tables: dict[str, DataFrame], full: bool) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._path(name, version, full))
        self._mark(version, [(n, full) for n in tables], "-full" if full else "-changes")

    def _mark(self, version: int, rows: list[tuple[str, bool]], kind: str) -> None:
        marks = self.spark.createDataFrame(rows, _COMMIT).coalesce(1)
        marks.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.root}/commits/at{version}{kind}")

    def _path(self, table: str, version: int, full: bool) -> str:
        return f"{self.root}/{table}/{'full' if full else 'changes'}/version={version}"

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _there(self, path: str) -> bool:
        files, place = self._files(path)
        return files.exists(place)

    def _remove(self, path: str) -> None:
        files, place = self._files(path)
        files.delete(place, True)
