"""Tables whose new versions become visible together.

A commit writes the changed rows of every table it names aside, and then makes them all visible by renaming one manifest to
the next number.  Readers resolve tables through the newest manifest, so they see all of a commit or none of it: what a failed or lost
writer leaves behind no manifest names.  Two commits from the same version can't both rename; the second is told and starts anew.

Only changed rows are written.  A reader takes the first part of a table without the keys that later parts have, and of those the rows of
the newest version (merge on read); ``compact`` writes that as a new first part.  Parts of a few bytes a row may hold very many rows,
so they are joined by shuffles and never gathered in the driver.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"


class Conflict(RuntimeError):
    """Another writer has committed since the version that this commit started from."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="labelscan-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def manifest(self) -> dict:
        """The newest manifest: ``version``, and of each table its keys and parts."""
        fs, folder = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        newest = max((n for n in names if n.endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "tables": {}}
        stream = fs.open(self._path("manifests", newest))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, temporary = self._fs(), self._path("manifests", f"{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        gateway, files = self.spark.sparkContext._gateway, self.jvm.org.apache.hadoop.fs
        plain = gateway.new_array(getattr(files, "Options$Rename"), 0)  # refuses to replace a file
        try:
            files.FileContext.getFileContext(temporary.toUri(), self.conf).rename(temporary, self._path("manifests", f"{manifest['version']:012d}.json"), plain)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise

    def _write(self, rows: DataFrame, name: str, version: int) -> str:
        part = f"data/{name}/{version:012d}-{uuid.uuid4().hex}"
        rows.withColumn(VERSION, F.lit(version)).write.parquet(f"{self.root}/{part}")
        return part

    def aside(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that a commit needs several times, computed once; no manifest names them, so ``vacuum`` deletes them."""
        path = f"{self.root}/data/{name}/aside-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def create(self, keys: dict[str, list[str]], **tables: DataFrame) -> int:
        """The first version of all tables; ``keys`` of a table that is only appended to are empty."""
        return self._commit({"version": 0, "tables": {n: {"keys": keys[n], "parts": []} for n in tables}}, tables)

    def commit(self, manifest: dict, **changes: DataFrame) -> int:
        """New rows, and new values of stored ones, of several tables at once; ``manifest`` is what the changes were made from."""
        return self._commit(manifest, changes)

    def _commit(self, manifest: dict, changes: dict[str, DataFrame], replace: bool = False) -> int:
        version, tables = manifest["version"] + 1, dict(manifest["tables"])
        for name, rows in changes.items():
            part = self._write(rows, name, version)
            tables[name] = tables[name] | {"parts": [part] if replace else [*tables[name]["parts"], part]}
        self._publish({"version": version, "tables": tables})
        return version

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as of a manifest, by default the newest."""
        table = (manifest or self.manifest())["tables"][name]
        first, *later = [f"{self.root}/{p}" for p in table["parts"]]
        if not later:
            return self.spark.read.parquet(first).drop(VERSION)
        if not table["keys"]:
            return self.spark.read.parquet(first, *later).drop(VERSION)
        changed = self.spark.read.parquet(*later)
        columns = [c for c in changed.columns if c != VERSION]
        newest = changed.groupBy(*table["keys"]).agg(F.max_by(F.struct(*columns), VERSION).alias("row")).select("row.*")
        return self.spark.read.parquet(first).drop(VERSION).join(changed.select(*table["keys"]).hint("merge"), table["keys"], "left_anti").select(*columns).unionByName(newest)

    def compact(self, *names: str) -> int:
        """One part for each of the tables."""
        manifest = self.manifest()
        return self._commit(manifest, {n: self.read(n, manifest) for n in names}, replace=True)

    def vacuum(self) -> int:
        """Deletes the parts that the newest manifest doesn't name, and older manifests; no reader or writer may be at work."""
        fs, manifest, gone = self._fs(), self.manifest(), 0
        named = {p for t in manifest["tables"].values() for p in t["parts"]}
        for table in fs.listStatus(self._path("data")):
            for part in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{part.getPath().getName()}" not in named:
                    gone += fs.delete(part.getPath(), True)
        for old in fs.listStatus(self._path("manifests")):
            if old.getPath().getName() != f"{manifest['version']:012d}.json":
                fs.delete(old.getPath(), False)
        return gone
