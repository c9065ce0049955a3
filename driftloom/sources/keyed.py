"""Keyed state whose commits cost what changed.

The rows stand in buckets by the hash of their key, as plain Parquet folders. A commit writes the changed rows only, as
one more folder beside the buckets; what is read is the buckets' rows whose key no later folder has, and the newest of
the later ones. Buckets with many later rows are rewritten with them, the worst first, and no commit rewrites more
rows than a few times those it brings (what it does not use, a later one may). A commit counts once its manifest is there, which
names the folders and is renamed into place; folders that no kept manifest names are what a killed write has left, and
go with the next commit. Committing a version again starts from the versions before it, so a repeated batch
replaces itself. There is one writer at a time, as with a stream's checkpoint. Keys must not be null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.tables import _fs

#: Rows of a bucket at which a state is made; with four times as many it gets four times the buckets.
BUCKET_ROWS = 1 << 20
LEAST_BUCKETS = 16
#: A bucket is rewritten when its later rows are more than so many times it, within this many rows for each row of the commit.
REWRITE_SHARE, REWRITE_ROWS = 2, 2
#: Later folders of like size that are merged into one.
MERGED_FOLDERS = 4
_BUCKET, _WRITE = "_bucket", "_write"


class Manifests:
    """Numbered versions of a table, each one a small file that is renamed into place."""

    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, folder = _fs(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _manifest(self, version: int) -> dict:
        fs, file = _fs(self.spark, f"{self.path}/manifests/{version:012d}.json")
        return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(file), "UTF-8"))

    def _before(self, version: int | None) -> dict | None:
        done = [v for v in self.versions() if version is None or v < version]
        return self._manifest(done[-1]) if done else None

    def _publish(self, manifest: dict) -> None:
        name = f"{self.path}/manifests/{manifest['version']:012d}.json"
        fs, draft = _fs(self.spark, f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = _fs(self.spark, name)
        fs.delete(final, False)
        if not fs.rename(draft, final):
            raise RuntimeError(f"cannot commit {name}")


class KeyedState(Manifests):
    """One row per key, in versions. ``keys`` are the columns that name a row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_rows: int = BUCKET_ROWS, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.bucket_rows, self.keep = spark, path, keys, bucket_rows, keep

    def _clear(self) -> None:
        """Drops old versions, and the folders that no version names."""
        done = self.versions()
        for old in done[: -self.keep]:
            fs, file = _fs(self.spark, f"{self.path}/manifests/{old:012d}.json")
            fs.delete(file, False)
        named = set()
        for version in done[-self.keep :]:
            manifest = self._manifest(version)
            named |= {write for write, _ in manifest["base"].values()} | set(manifest["later"])
        fs, root = _fs(self.spark, f"{self.path}/data")
        for status in fs.listStatus(root):
            if status.getPath().getName().removeprefix(f"{_WRITE}=") not in named:
                fs.delete(status.getPath(), True)

    # --- Rows -------------------------------------------------------------------------------

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        """Rows of some folders with their bucket and write, columns that a folder lacks being null."""
        wanted = f"{schema}, {_BUCKET} int, {_WRITE} string"
        if not paths:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).option("basePath", f"{self.path}/data").parquet(*paths)

    def _later(self, manifest: dict, writes: list[str], buckets: list[int] | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key that some of the later folders have."""
        later = self._load([f"{self.path}/data/{_WRITE}={write}" for write in writes], manifest["schema"])
        if buckets is not None:
            later = later.filter(F.col(_BUCKET).isin(buckets))
        # What a bucket was rewritten with does not come after it.
        since: dict[str, list[int]] = {}
        for k, (write, _) in manifest["base"].items():
            since.setdefault(write, []).append(int(k))
        for write, rewritten in since.items():
            if write > min(writes, default=write):
                later = later.filter(~(F.col(_BUCKET).isin(rewritten) & (F.col(_WRITE) < write)))
        if only is not None:
            later = later.join(only, self.keys, "left_semi")
        if len(writes) < 2:
            return later
        newest = later.groupBy(*self.keys).agg(F.max(_WRITE).alias(_WRITE))
        return later.join(newest, [*self.keys, _WRITE], "left_semi")

    def _merged(self, manifest: dict, buckets: list[int] | None = None, only: DataFrame | None = None) -> DataFrame:
        """The rows of all buckets or some, and of all keys or those of ``only``."""
        chosen = {int(k): v for k, v in manifest["base"].items() if buckets is None or int(k) in set(buckets)}
        paths = [f"{self.path}/data/{_WRITE}={write}/{_BUCKET}={k}" for k, (write, n) in sorted(chosen.items()) if n]
        base = self._load(paths, manifest["schema"])
        columns = [c for c in base.columns if c not in (_BUCKET, _WRITE)]
        names = None if only is None else only.select(*self.keys).distinct()
        if names is not None:
            base = base.join(names, self.keys, "left_semi")
        base = base.select(*columns)
        if not manifest["later"]:
            return base
        later = self._later(manifest, sorted(manifest["later"]), buckets, names).select(*columns)
        return base.join(later.select(*self.keys), self.keys, "left_anti").unionByName(later)

    def note(self, before: int | None = None) -> dict:
        """What the newest version (before one) was committed with."""
        manifest = self._before(before)
        return manifest["note"] if manifest else {}

    def read(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """The newest version, or the newest before one; None if there is none. ``only`` limits it to the keys of some rows.

        With ``only``, buckets that have none of its keys are not read, if there are many.
        """
        manifest = self._before(before)
        if manifest is None:
            return None
        if only is None or manifest["buckets"] <= LEAST_BUCKETS:
            return self._merged(manifest, only=only)
        touched = only.select(self._bucket(manifest["buckets"]).alias(_BUCKET)).distinct().collect()
        return self._merged(manifest, [row[0] for row in touched], only)

    def _write(self, rows: DataFrame, version: int, step: int, buckets: int, by_bucket: bool) -> tuple[str, dict[str, int]]:
        """A folder of rows, and how many of each bucket it has; every row moves once, to the file it stands in."""
        write = f"{version:012d}-{step}-{uuid.uuid4().hex[:8]}"
        tagged = rows.withColumn(_BUCKET, self._bucket(buckets)).repartition(_BUCKET).sortWithinPartitions(_BUCKET, *self.keys)
        out = tagged.write.mode("overwrite")
        (out.partitionBy(_BUCKET) if by_bucket else out).parquet(f"{self.path}/data/{_WRITE}={write}")
        there = self._load([f"{self.path}/data/{_WRITE}={write}"], _ddl(rows))
        return write, {str(r[0]): r[1] for r in there.groupBy(_BUCKET).count().collect()}

    def commit(self, rows: DataFrame, version: int | None = None, note: dict | None = None, live: Column | None = None) -> int:
        """Puts rows (one per key, new or changed) into a new version. The same version again replaces itself.

        A small note may go with it. Buckets that are rewritten lose rows that are not ``live``; readers filter the others.
        """
        if version is None:
            version = max(self.versions(), default=-1) + 1
        old = self._before(version)
        if old is None:
            write, counts = self._write(rows, version, 0, LEAST_BUCKETS, True)
            base = {k: [write, n] for k, n in counts.items()}
            manifest = {"version": version, "buckets": LEAST_BUCKETS, "schema": _ddl(rows), "base": base, "later": {}, "credit": 0}
        else:
            manifest = self._changed(old, rows, version, live)
        self._publish(self._enough_buckets(manifest, live) | {"note": note or {}})
        self._clear()
        return version

    def _changed(self, old: dict, rows: DataFrame, version: int, live: Column | None) -> dict:
        write, counts = self._write(rows, version, 0, old["buckets"], False)
        manifest = old | {"version": version, "schema": _wider(old["schema"], rows), "base": dict(old["base"]), "later": old["later"] | {write: counts}}
        manifest["credit"] = old["credit"] + REWRITE_ROWS * sum(counts.values())

        def size_and_later(bucket: str) -> tuple[int, int]:
            since, n = manifest["base"].get(bucket, ["", 0])
            return n, sum(c.get(bucket, 0) for w, c in manifest["later"].items() if w > since)

        sizes = {str(b): size_and_later(str(b)) for b in range(old["buckets"])}
        chosen = []
        for bucket, (n, later) in sorted(sizes.items(), key=lambda s: -s[1][1] / max(s[1][0], 1)):
            if later <= REWRITE_SHARE * n or n + later > manifest["credit"]:
                break
            chosen.append(int(bucket))
            manifest["credit"] -= n + later
        if chosen:
            write, counts = self._write(_only(self._merged(manifest, chosen), live), version, 1, old["buckets"], True)
            manifest["base"] |= {str(k): [write, counts.get(str(k), 0)] for k in chosen}
        manifest = self._few_folders(manifest)
        needed = min((manifest["base"].get(str(b), ["", 0])[0] for b in range(old["buckets"]) if sizes[str(b)][1]), default="")
        manifest["later"] = {w: c for w, c in manifest["later"].items() if w > needed}
        return manifest

    def _few_folders(self, manifest: dict) -> dict:
        """The newest later folders merged into one, where several are of like size; so there are as many as the logarithm of all."""
        newest, rows = [], 0
        for write in sorted(manifest["later"], reverse=True):
            n = sum(manifest["later"][write].values())
            if newest and n > 2 * rows:
                break
            newest.append(write)
            rows += n
        if len(newest) < MERGED_FOLDERS:
            return manifest
        merged = self._later(manifest, newest).drop(_BUCKET, _WRITE)
        write, counts = self._write(merged, manifest["version"], 0, manifest["buckets"], False)
        return manifest | {"later": {w: c for w, c in manifest["later"].items() if w not in newest} | {write: counts}}

    def _enough_buckets(self, manifest: dict, live: Column | None) -> dict:
        """The same version dealt anew, where its buckets have grown too large."""
        total = sum(n for _, n in manifest["base"].values()) + sum(sum(c.values()) for c in manifest["later"].values())
        if total <= 4 * manifest["buckets"] * self.bucket_rows:
            return manifest
        buckets = max(4 * manifest["buckets"], -(-total // self.bucket_rows))
        write, counts = self._write(_only(self._merged(manifest), live), manifest["version"], 2, buckets, True)
        return manifest | {"buckets": buckets, "base": {k: [write, n] for k, n in counts.items()}, "later": {}, "credit": 0}


def _only(rows: DataFrame, live: Column | None) -> DataFrame:
    return rows if live is None else rows.filter(live)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (_BUCKET, _WRITE))


def _wider(schema: str, rows: DataFrame) -> str:
    """The schema with the columns that only the new rows have behind it."""
    known = rows.sparkSession.createDataFrame([], schema).columns
    more = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in known])
    return f"{schema}, {_ddl(more)}" if more.columns else schema
