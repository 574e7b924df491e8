"""Sharding by size-tiered compaction, with versioned manifests.

Arrivals are written once, as runs of small immutable Parquet shards. Runs of similar size (one tier: sizes within a
factor of `fanout`) are merged as soon as a tier holds `fanout` of them, into shards of about the target size; a merged
run then belongs to a higher tier, so a byte is rewritten about log(total / arrival) times. Every change becomes visible
by one atomic rename of a new manifest, which fails if that version already exists; readers see one whole version, and
keep its files until a `vacuum` whose age they have passed.
Merging only concatenates, so it needs no shuffle: each output shard is one task over whole input files.

DataFrame operations only; the driver handles paths, sizes and manifests.

Defined cases: rows are kept as they are (nulls, empty texts, repeated rows, any extra columns); an empty arrival adds
no run; reading a store without rows gives the schema and no rows; a lost race for a version raises `Conflict`.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import delete, table_bytes


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root.rstrip("/"), target_bytes, fanout, smallest
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(self.root)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if not version:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> int:
        """Publishes a manifest under its version, all of it or nothing."""
        folder = f"{self.root}/manifests"
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, self._path(f"{folder}/{manifest['version']:012d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is taken") from e
        return manifest["version"]

    # changes

    def _run(self, path: str, rows: int, origin: list[str]) -> dict:
        return {"path": path, "bytes": table_bytes(self.spark, f"{self.root}/{path}"), "rows": rows, "from": origin}

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Adds rows as one run, or as one run for each value of the column `by` (which isn't stored), in one commit."""
        schema = (arrivals.drop(by) if by else arrivals).schema
        now = self.manifest()
        path = f"runs/{uuid.uuid4().hex}"
        writer = arrivals.write.partitionBy(by) if by else arrivals.write
        writer.parquet(f"{self.root}/{path}")
        if by:
            # the schema is given, as a write of no rows leaves no file to infer it from
            counts = {(str(v) if v is not None else None): n for v, n in self.spark.read.schema(arrivals.schema).parquet(f"{self.root}/{path}").groupBy(F.col(f"`{by}`").cast("string")).count().collect()}  # one row per arrival
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}")) if s.isDirectory()]
            value = lambda n: None if n.endswith("__HIVE_DEFAULT_PARTITION__") else n.split("=", 1)[1]
            new = [self._run(f"{path}/{n}", counts[value(n)], [n]) for n in sorted(found)]
        else:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").count()
            new = [self._run(path, rows, [path])] if rows else []
        return self._committed({"version": now["version"] + 1, "schema": schema.json(), "runs": now["runs"] + new}, path)

    def _committed(self, manifest: dict, path: str) -> int:
        """Commits; a lost race leaves nothing of the run behind."""
        try:
            return self.commit(manifest)
        except Conflict:
            delete(self.spark, f"{self.root}/{path}")
            raise

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)))

    def due(self, runs: list[dict]) -> list[dict]:
        """The runs to merge next: those of the lowest tier that holds `fanout` of them."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            tiers.setdefault(self.tier(r["bytes"]), []).append(r)
        full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
        return sorted(tiers[full[0]], key=lambda r: (r["bytes"], r["path"])) if full else []

    def compact(self, retain_seconds: float | None = None) -> int:
        """Merges until no tier is full; each merge is one commit. Files of older versions stay for their readers, unless
        `retain_seconds` says how long: then `vacuum` runs after each merge."""
        while runs := self.due((now := self.manifest())["runs"]):
            size = sum(r["bytes"] for r in runs)
            path = f"runs/{uuid.uuid4().hex}"
            self._read(now, runs).coalesce(max(1, round(size / self.target))).write.parquet(f"{self.root}/{path}")
            merged = self._run(path, sum(r["rows"] for r in runs), [x for r in runs for x in r["from"]])
            gone = {r["path"] for r in runs}
            self._committed({"version": now["version"] + 1, "schema": now["schema"], "runs": [r for r in now["runs"] if r["path"] not in gone] + [merged]}, path)
            if retain_seconds is not None:
                self.vacuum(retain_seconds=retain_seconds)
        return self.manifest()["version"]

    def vacuum(self, keep_versions: int = 1, retain_seconds: float = 3600) -> None:
        """Deletes versions older than `retain_seconds` but the last `keep_versions`, and runs of that age that no version left names: also those of writers that died before their commit. A reader or an uncommitted writer has that long."""
        before = time.time() - retain_seconds
        found = self.versions()
        # a version is in use until the next one is made, so its age counts from there
        old = [v for v, after in zip(found, found[1:], strict=False) if self._made(f"manifests/{after:012d}.json") <= before][: max(0, len(found) - keep_versions)]
        for v in old:
            delete(self.spark, f"{self.root}/manifests/{v:012d}.json")
        named = {r["path"] for v in self.versions() for r in self.manifest(v)["runs"]}
        folders = {p.split("/")[1] for p in named}
        runs = self._path(f"{self.root}/runs")
        for s in self._fs.listStatus(runs) if self._fs.exists(runs) else []:
            name = s.getPath().getName()
            if name not in folders and s.getModificationTime() / 1000 <= before:
                delete(self.spark, f"{self.root}/runs/{name}")
            elif any(p.startswith(f"runs/{name}/") for p in named):  # a folder of several runs
                for part in self._fs.listStatus(s.getPath()):
                    if part.isDirectory() and f"runs/{name}/{part.getPath().getName()}" not in named and part.getModificationTime() / 1000 <= before:
                        delete(self.spark, f"{self.root}/runs/{name}/{part.getPath().getName()}")

    def _made(self, path: str) -> float:
        return self._fs.getFileStatus(self._path(f"{self.root}/{path}")).getModificationTime() / 1000

    # reading

    def _files(self, manifest: dict, runs: list[dict]) -> DataFrame:
        """The runs' files, or an empty folder's if there are none."""
        paths = [f"{self.root}/{r['path']}" for r in runs]
        if not paths:
            paths = [f"{self.root}/empty"]
            self._fs.mkdirs(self._path(paths[0]))
        return self.spark.read.schema(self._schema(manifest)).parquet(*paths)

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else StructType([])

    def _read(self, manifest: dict, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self._files(manifest, runs).select(*[F.col(f"`{c}`") for c in self._schema(manifest).names])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m, m["runs"])

    def placed(self, *columns: str) -> DataFrame:
        """The named columns with each row's shard, the shard's bytes and the version read."""
        m = self.manifest()
        rows = self._files(m, m["runs"])
        file = rows.metadataColumn("_metadata")  # the files' own, also where a column has that name
        return rows.select(*columns, F.element_at(F.split(file["file_path"], "/runs/"), -1).alias("shard"), file["file_size"].alias("shard_bytes"), F.lit(m["version"]).cast("long").alias("version"))
