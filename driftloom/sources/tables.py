"""Table sinks: append, versioned state, evolved reads and digest files.

Every write goes to a folder of its own; a state version counts only once Spark has put its success
marker there, so a lost executor or a repeated batch never leaves half a version in view.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import scratch_path


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def append(df: DataFrame, path: str, batch: int | None = None, partition_by: list[str] | None = None) -> None:
    """Add rows. With a batch number the write is repeatable: the same batch replaces itself."""
    if batch is None:
        df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


_OWNED: list[list[str]] = []


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Drops, at its end, the scratch tables that operators have written inside it.

    Operators write such tables while a plan is being built, and results read them; so store the results
    before the end. Outside of it, scratch tables stay until the shared folder is cleared.
    """
    paths: list[str] = []
    _OWNED.append(paths)
    try:
        yield paths
    finally:
        _OWNED.remove(paths)
        for path in paths:
            fs, folder = _fs(spark, path)
            fs.delete(folder, True)


def owned_path(spark: SparkSession, label: str) -> str:
    """A fresh scratch path, which belongs to the innermost :func:`owned_tables` if there is one."""
    path = scratch_path(spark, label)
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, lineage cut.

    With ``keep`` the table outlives the :func:`owned_tables` around it.
    """
    path = (scratch_path if keep else owned_path)(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a state table, oldest first."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(
            spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        ):
            found.append(int(name.split("=", 1)[1]))
    return sorted(found)


def commit_state(df: DataFrame, path: str, version: int | None = None, keep: int = 2) -> int:
    """Write a new version of a state table and drop all but the last ``keep`` versions.

    Readers see the version only when it is complete; committing the same version again replaces it.
    """
    spark = df.sparkSession
    if version is None:
        version = max(versions(spark, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    for old in [v for v in versions(spark, path) if v < version][: -keep or None]:
        fs, folder = _fs(spark, f"{path}/version={old}")
        fs.delete(folder, True)
    return version


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest committed version (older than ``before``), or None when there is none."""
    done = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={done[-1]}") if done else None


def read_evolved(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """A table whose older files lack newer columns; missing values take their defaults."""
    wanted = spark.createDataFrame([], schema).schema
    df = spark.read.schema(wanted).parquet(path)
    return df.select(
        *[
            F.coalesce(F.col(f.name), F.lit((defaults or {})[f.name]).cast(f.dataType)).alias(f.name)
            if f.name in (defaults or {})
            else F.col(f.name)
            for f in wanted
        ]
    )


def write_digest(messages: DataFrame, path: str) -> None:
    """One JSON row per message: ``{"blocks": [...]}`` with its run and message number."""
    messages.write.mode("overwrite").json(path)
