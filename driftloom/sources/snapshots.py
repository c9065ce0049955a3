"""Page snapshots in partitions by time: retention drops folders and leaves recent ones alone.

An append writes its rows by month (or day) of ``checked_at`` and, beside them, a narrow table of heads: the newest
sequence number of each page in it. The manifest names all folders with their row counts and is renamed into place.
Retention reads the heads, the partitions that are too old, the one that the limit falls into, and the rows
carried before; the last two are written anew. Partitions behind the limit are neither read nor written. Rows without a
time stay. There is one writer at a time; what a killed write leaves goes with the next one.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.keyed import Manifests, _ddl, _wider
from driftloom.sources.tables import _fs

#: Names of partitions: pattern for Spark, pattern for the driver.
UNITS = {"month": ("yyyy-MM", "%Y-%m"), "day": ("yyyy-MM-dd", "%Y-%m-%d")}
UNDATED = "undated"
_WRITE, _PART = "_write", "_part"


class SnapshotStore(Manifests):
    """Snapshots with ``keys``, ``seq`` (grows with time within a page) and ``checked_at``; versions as in KeyedState."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("entity_id", "page_type"),
                 unit: str = "month", keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.unit, self.keep = spark, path, list(keys), unit, keep

    def _start(self, version: int | None) -> tuple[int, dict | None, str]:
        if version is None:
            version = max(self.versions(), default=-1) + 1
        return version, self._before(version), f"{version:012d}-{uuid.uuid4().hex[:8]}"

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def append(self, rows: DataFrame, version: int | None = None) -> int:
        """Adds rows as a new version; the same version again replaces itself. Existing folders are not touched."""
        version, old, write = self._start(version)
        old = old or {"schema": _ddl(rows), "parts": {}, "heads": [], "carried": []}
        folder, heads = f"data/{_WRITE}={write}", f"heads/{write}"
        part = F.coalesce(F.date_format("checked_at", UNITS[self.unit][0]), F.lit(UNDATED))
        rows.withColumn(_PART, part).write.mode("overwrite").partitionBy(_PART).parquet(f"{self.path}/{folder}")
        there = self._load([folder], f"{_ddl(rows)}, {_PART} string")
        found = there.groupBy(*self.keys, _PART).agg(
            F.max_by("checked_at", "seq").alias("checked_at"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n")
        )
        found.write.mode("overwrite").parquet(f"{self.path}/{heads}")
        counts = self.spark.read.parquet(f"{self.path}/{heads}").groupBy(_PART).agg(F.sum("n").alias("n")).collect()
        parts = {k: list(v) for k, v in old["parts"].items()}
        for name, n in counts:
            parts.setdefault(name, []).append([f"{folder}/{_PART}={name}", n])
        self._publish(old | {"version": version, "schema": _wider(old["schema"], rows), "parts": parts, "heads": [*old["heads"], heads]})
        self._clear()
        return version

    def read(self) -> DataFrame | None:
        """All rows of the newest version; None if there is none."""
        manifest = self._before(None)
        if manifest is None:
            return None
        folders = [path for part in manifest["parts"].values() for path, _ in part]
        return self._load(folders + [path for path, _ in manifest["carried"]], manifest["schema"])

    def count(self) -> int:
        """Rows of the newest version, from its manifest alone."""
        manifest = self._before(None)
        groups = [] if manifest is None else [*manifest["parts"].values(), manifest["carried"]]
        return sum(n for group in groups for _, n in group)

    def prune(self, as_of: datetime, days: int, version: int | None = None) -> int:
        """Removes rows older than ``days`` but each page's newest one, as a new version; returns how many went."""
        version, old, write = self._start(version)
        if old is None:
            return 0
        limit = as_of - timedelta(days=days)
        edge, cut = limit.strftime(UNITS[self.unit][1]), F.lit(limit.isoformat(sep=" ")).cast("timestamp_ntz")
        gone = [f for part, folders in old["parts"].items() if part != UNDATED and part < edge for f in folders]
        split, carried = old["parts"].get(edge, []), old["carried"]
        if not gone and not split:
            return 0

        heads, kept, aside = f"heads/{write}", f"data/{_WRITE}={write}/{_PART}={edge}", f"carried/{write}"
        latest = self.spark.read.parquet(*[f"{self.path}/{h}" for h in old["heads"]]).groupBy(*self.keys).agg(
            F.max_by("checked_at", "seq").alias("checked_at"), F.max("seq").alias("seq")
        )
        latest.write.mode("overwrite").parquet(f"{self.path}/{heads}")
        stale = self.spark.read.parquet(f"{self.path}/{heads}").filter(F.col("checked_at") < cut).select(*self.keys, "seq")
        aged = self._load([p for p, _ in [*gone, *split, *carried]], old["schema"]).filter(F.col("checked_at") < cut)
        aged.join(stale, [*self.keys, "seq"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/{aside}")
        recent = self._load([p for p, _ in split], old["schema"]).filter(F.col("checked_at") >= cut)
        if split:
            recent.write.mode("overwrite").parquet(f"{self.path}/{kept}")
        n_aside = self._load([aside], old["schema"]).count()
        n_kept = self._load([kept], old["schema"]).count() if split else 0

        parts = {part: f for part, f in old["parts"].items() if part == UNDATED or part > edge}
        parts |= {edge: [[kept, n_kept]]} if n_kept else {}
        self._publish(old | {"version": version, "parts": parts, "heads": [heads], "carried": [[aside, n_aside]]})
        self._clear()
        return sum(n for _, n in [*gone, *split, *carried]) - n_aside - n_kept

    def _clear(self) -> None:
        """Drops old versions, and the folders that no version names."""
        done = self.versions()
        for version in done[: -self.keep]:
            fs, file = _fs(self.spark, f"{self.path}/manifests/{version:012d}.json")
            fs.delete(file, False)
        named: set[str] = set()
        for manifest in map(self._manifest, done[-self.keep :]):
            named |= {path for part in manifest["parts"].values() for path, _ in part}
            named |= {*manifest["heads"], *[path for path, _ in manifest["carried"]]}
        for kind in ("heads", "carried"):
            for path in self._folders(kind):
                self._drop(path, path in named)
        for write in self._folders("data"):
            parts = self._folders(write)
            for path in parts:
                self._drop(path, path in named)
            self._drop(write, any(path in named for path in parts))

    def _folders(self, inside: str) -> list[str]:
        fs, root = _fs(self.spark, f"{self.path}/{inside}")
        return [f"{inside}/{s.getPath().getName()}" for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []

    def _drop(self, path: str, keep: bool) -> None:
        if not keep:
            fs, folder = _fs(self.spark, f"{self.path}/{path}")
            fs.delete(folder, True)
