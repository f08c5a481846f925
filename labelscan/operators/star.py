"""The star of inspections with keys that hold: changes are checked against what they touch, deletions go down the references.

Only changed rows are checked: a new row for its own key and for the keys it refers to, a deletion for the rows that refer to
it.  All of it is semi and anti joins on keys, with the changes on the small side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import STAR

#: Primary keys; references (table, column, parent), and whether a deletion of the parent goes on to the row.
KEYS = {"users": ["user_id"], "products": ["product_id"], "inspections": ["inspection_id"], "violations": ["inspection_id", "field_key"]}
REFERENCES = [("inspections", "product_id", "products", True), ("inspections", "user_id", "users", False), ("violations", "inspection_id", "inspections", True)]
REQUIRED = {"users": ["user_id", "name"], "products": ["product_id", "item_id"], "inspections": ["inspection_id", "compliant"], "violations": ["inspection_id", "field_key"]}
FAULT = ["tbl", "fault", "key"]


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in STAR[name].split(", ")]


def keyed(name: str, df: DataFrame, fault: str) -> DataFrame:
    return df.select(F.lit(name).alias("tbl"), F.lit(fault).alias("fault"), F.concat_ws("/", *[F.col(k).cast("string") for k in KEYS[name]]).alias("key"))


def faults(changes: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """``tbl, fault, key`` of new rows that can't be stored: null in a required column, a key given twice or stored already, a parent that is nowhere."""
    out = []
    for name, new in changes.items():
        keys = KEYS[name]
        out.append(keyed(name, new.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED[name]])), "null"))
        out.append(keyed(name, new.groupBy(*keys).count().filter("count > 1"), "given twice"))
        out.append(keyed(name, new.select(*keys).distinct().join(stored[name].select(*keys), keys, "left_semi"), "stored already"))
        for _, column, parent, _ in (r for r in REFERENCES if r[0] == name):
            (own,) = KEYS[parent]
            known = reduce(DataFrame.union, [t[parent].select(F.col(own).alias(column)) for t in (stored, changes) if parent in t])
            out.append(keyed(name, new.filter(F.col(column).isNotNull()).join(known, column, "left_anti"), f"no {parent}"))
    return reduce(DataFrame.unionByName, out)


def deleted(name: str, gone: DataFrame, stored: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(keys to delete by table, faults): a deletion by key and what it takes along; rows that refer without going along are faults."""
    keys = {name: stored[name].join(gone.select(*KEYS[name]).distinct(), KEYS[name], "left_semi")}
    kept, level = [], [name]
    while level:
        parent = level.pop()
        for child, column, of, cascade in REFERENCES:
            if of != parent:
                continue
            (own,) = KEYS[parent]
            hit = stored[child].join(keys[parent].select(F.col(own).alias(column)), column, "left_semi").select(*stored[child].columns)
            if cascade:
                keys[child] = hit if child not in keys else keys[child].unionByName(hit).dropDuplicates(KEYS[child])
                level.append(child)
            else:
                kept.append(keyed(child, hit, f"refers to {parent}"))
    none = keyed(name, stored[name].limit(0), "")
    return {t: df.select(*KEYS[t]) for t, df in keys.items()}, reduce(DataFrame.unionByName, kept, none)


def without(stored: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a deletion."""
    return {n: df.join(gone[n], KEYS[n], "left_anti").select(*df.columns) if n in gone else df for n, df in stored.items()}
