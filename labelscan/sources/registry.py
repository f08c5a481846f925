"""A log whose schema evolves: versions of its schema beside it, one scan over files of all versions.

A column has an identity; files name columns by it, so a renamed column keeps its values and a name that is dropped and comes again
is another column.  Rows older than a column get its default, however old; null in newer rows stays null.  A new version becomes
visible by the rename of a manifest, as data does (``versions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reports import aligned
from .versions import Versions

WRITTEN = "_schema"


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Versions(spark, root)

    def current(self) -> dict:
        """``version``, ``next`` identity and ``columns`` (id, name, type, default as SQL, since)."""
        return self.store.manifest()

    def _put(self, was: dict, columns: list[dict], following: int) -> int:
        names = [c["name"] for c in columns]
        if len(set(names)) < len(names) or WRITTEN in names:
            raise ValueError("column names must differ")
        self.store._publish({"version": was["version"] + 1, "next": following, "columns": columns})
        return was["version"] + 1

    def create(self, schema: str) -> int:
        fields = T._parse_datatype_string(schema).fields
        return self._put({"version": 0}, [{"id": k, "name": f.name, "type": f.dataType.simpleString(), "default": "null", "since": 1} for k, f in enumerate(fields)], len(fields))

    def add(self, name: str, kind: str, default: str = "null") -> int:
        """A new last column; ``default`` is an SQL constant for the rows there are."""
        was = self.current()
        return self._put(was, [*was["columns"], {"id": was["next"], "name": name, "type": kind, "default": default, "since": was["version"] + 1}], was["next"] + 1)

    def rename(self, name: str, to: str) -> int:
        return self._change(name, lambda c: [c | {"name": to}])

    def drop(self, name: str) -> int:
        return self._change(name, lambda c: [])

    def _change(self, name: str, put) -> int:
        was = self.current()
        if name not in [c["name"] for c in was["columns"]]:
            raise ValueError(f"no column {name}")
        return self._put(was, [x for c in was["columns"] for x in (put(c) if c["name"] == name else [c])], was["next"])

    def append(self, rows: DataFrame) -> None:
        """Appends rows; columns that they lack get their defaults, columns that the schema lacks are refused."""
        now = self.current()
        unknown = set(rows.columns) - {c["name"] for c in now["columns"]}
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        whole = aligned(rows, ", ".join(f"`{c['name']}` {c['type']}" for c in now["columns"]))
        own = [(F.col(f"`{c['name']}`") if c["name"] in rows.columns else F.expr(c["default"]).cast(c["type"])).alias(f"c{c['id']}") for c in now["columns"]]
        whole.select(*own, F.lit(now["version"]).alias(WRITTEN)).write.mode("append").parquet(f"{self.root}/data")

    def read(self) -> DataFrame:
        """All rows in the newest schema, by one scan of its columns."""
        now = self.current()["columns"]
        stored = self.spark.read.schema(", ".join([*[f"c{c['id']} {c['type']}" for c in now], f"{WRITTEN} int"])).parquet(f"{self.root}/data")
        value = lambda c: F.col(f"c{c['id']}") if c["default"] == "null" else F.when(F.col(WRITTEN) < c["since"], F.expr(c["default"]).cast(c["type"])).otherwise(F.col(f"c{c['id']}"))
        return stored.select(*[value(c).alias(c["name"]) for c in now])
