"""Queries of arriving data: intake checks, the star's keys, reports of all ages, the dashboard kept up, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import intake, legacy, star
from ..sources import adapters, dims
from ..sources.readers import table
from ..sources.versions import Versions, shared_folder
from ..streaming import dashboard
from .catalogue import query
from .reports import best

WHOLE_WORD = '[{"text": "a", "conf": 90, "left": 1, "top": 2, "width": 3, "height": 4}]'


def arriving(spark, d):
    """Uploads of the tables: an order is a record, its first three lines are its images."""
    n, p, k = F.col("l_linenumber"), F.col("l_partkey"), F.col("o_orderkey")
    label = F.when(p % 19 == 0, "top").when(n == 1, "front").when(n == 2, F.when(p % 31 == 0, "FRONT ").otherwise(" Back")).otherwise("side")
    image = F.struct(label.alias("label"), F.when(p % 23 == 0, " ").otherwise(F.concat(F.lit("img-"), (p % 60).cast("string"))).alias("source"), F.when(F.col("l_suppkey") % 17 == 0, "text/plain").otherwise("image/png").alias("content_type"))
    images = table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), image.alias("i")))), lambda x: x["i"]).alias("images"))
    words = F.when(k % 11 == 0, '[{"text": "a", "conf": 1}]').when(k % 11 == 1, "[[1, 2]]").when(k % 11 == 2, "not json").otherwise(WHOLE_WORD)
    return table(spark, d, "orders").join(images, "o_orderkey", "left").select(
        k.alias("id"), F.when(k % 7 == 0, None).when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("product_id"), F.when(k % 29 == 0, "").when(k % 2 == 0, "s").alias("session_id"), "images",
        F.when(k % 9 == 0, F.array(F.lit("front"), F.lit("back"))).alias("labels"), words.alias("words"), F.when(k % 22 == 0, '{"words": []}').when(k % 3 == 0, "{}").alias("metadata"),
        F.when(k % 17 == 0, "[1]").when(k % 17 == 1, '{"a": true}').when(k % 17 == 2, "odd").alias("confirmations"),
    )


@query("""WITH images AS (
        SELECT l_orderkey AS id, CASE WHEN l_partkey % 19 = 0 THEN 'top' WHEN l_linenumber = 1 THEN 'front' WHEN l_linenumber = 2 THEN CASE WHEN l_partkey % 31 = 0 THEN 'front' ELSE 'back' END ELSE 'side' END AS side,
               CASE WHEN l_partkey % 23 > 0 THEN l_partkey % 60 END AS source, l_suppkey % 17 = 0 AS other FROM lineitem WHERE l_linenumber <= 3
    ), per AS (
        SELECT id, count(*) AS n, bool_or(other) AS other, bool_or(side = 'top') AS unknown, bool_or(source IS NULL) AS empty, count(DISTINCT side) < count(side) AS same_side, count(DISTINCT source) < count(source) AS same_source FROM images GROUP BY id
    ), records AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS none, o_orderkey % 7 > 0 AND o_orderkey % 13 = 0 AS blank, o_orderkey % 29 = 0 AS blank_session, o_orderkey % 2 = 0 AND o_orderkey % 29 > 0 AS session, per.* EXCLUDE id FROM orders LEFT JOIN per ON per.id = o_orderkey)
    SELECT id, concat_ws(',', CASE WHEN n IS NULL THEN 'no_image' END, CASE WHEN id % 9 = 0 AND coalesce(n, 0) <> 2 THEN 'label_count' END, CASE WHEN other THEN 'content_type' END, CASE WHEN (none OR blank) AND NOT session THEN 'no_identifier' END,
        CASE WHEN blank THEN 'blank_product_id' END, CASE WHEN blank_session THEN 'blank_session_id' END, CASE WHEN unknown THEN 'unknown_label' END, CASE WHEN empty THEN 'empty_source' END, CASE WHEN same_side THEN 'duplicate_label' END,
        CASE WHEN same_source THEN 'duplicate_source' END, CASE WHEN id % 11 = 0 AND id % 22 > 0 THEN 'word_fields' END, CASE WHEN id % 17 IN (0, 2) THEN 'confirmations' END) AS errors FROM records""")
def intake_errors(spark, d):
    return intake.checked(arriving(spark, d)).select("id", F.array_join("errors", ",").alias("errors"))


# -- the star ---------------------------------------------------------------------------------------------------------


def star_of(spark, d) -> dict:
    """Customers as products, clerks of nations as users, orders as inspections, lines as violations."""
    text = lambda c: F.col(c).cast("string")
    rules = F.element_at(F.array(*map(F.lit, dims.FIELDS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return {
        "users": table(spark, d, "nation").select(text("n_nationkey").alias("user_id"), F.col("n_name").alias("name"), F.lit("viewer").alias("role")),
        "products": table(spark, d, "customer").select(text("c_custkey").alias("product_id"), text("c_custkey").alias("item_id"), F.col("c_name").alias("product_name")),
        "inspections": table(spark, d, "orders").select(text("o_orderkey").alias("inspection_id"), text("o_custkey").alias("product_id"), (F.col("o_orderkey") % 30).cast("string").alias("user_id"), F.col("o_orderdate").cast("string").alias("created_at"), (F.col("o_orderstatus") == "F").alias("compliant")),
        "violations": table(spark, d, "lineitem").filter("l_returnflag <> 'A' and l_linenumber <= 6").select(text("l_orderkey").alias("inspection_id"), rules.alias("field_key"), F.lit("R").alias("rule_id")),
    }


@query("""WITH v AS (SELECT l_orderkey AS i, l_linenumber AS f FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber <= 6), gone AS (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3)
    SELECT 'products' AS tbl, (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 3) AS n UNION ALL SELECT 'inspections', (SELECT count(*) FROM orders WHERE o_custkey % 7 <> 3)
    UNION ALL SELECT 'violations', (SELECT count(*) FROM v WHERE i NOT IN (SELECT o_orderkey FROM gone)) UNION ALL SELECT 'users', (SELECT count(*) FROM nation)""")
def star_cascade(spark, d):
    """Rows left after products are deleted with what hangs on them, three levels down."""
    stored = star_of(spark, d)
    gone, _ = star.deleted("products", stored["products"].filter("cast(product_id as long) % 7 = 3"), stored)
    left = star.without(stored, gone)
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n")) for n, df in left.items()])


@query("SELECT 'inspections' AS tbl, 'refers to users' AS fault, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 30 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 0)")
def star_restricted(spark, d):
    """Inspections that keep their inspectors from being deleted."""
    stored = star_of(spark, d)
    return star.deleted("users", stored["users"].filter("cast(user_id as long) % 5 = 0"), stored)[1]


@query("""WITH new_i AS (SELECT o_orderkey * 3 AS i, o_custkey + 20 AS p, o_orderkey % 30 AS u FROM orders WHERE o_orderkey % 10 = 0), new_v AS (SELECT l_orderkey * 2 AS i, l_linenumber % 6 + 1 AS f FROM lineitem WHERE l_orderkey % 10 = 5 AND l_linenumber <= 7),
    names(f, field) AS (VALUES """ + ", ".join(f"({k + 1}, '{f}')" for k, f in enumerate(dims.FIELDS)) + """)
    SELECT 'inspections' AS tbl, 'stored already' AS fault, i::VARCHAR AS key FROM new_i WHERE i IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'inspections', 'no products', i::VARCHAR FROM new_i WHERE p NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'inspections', 'no users', i::VARCHAR FROM new_i WHERE u NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'inspections', 'null', i::VARCHAR FROM new_i WHERE i % 4 = 0
    UNION ALL SELECT 'violations', 'given twice', i || '/' || field FROM new_v JOIN names USING (f) GROUP BY i, field HAVING count(*) > 1
    UNION ALL SELECT 'violations', 'no inspections', i || '/' || field FROM new_v JOIN names USING (f) WHERE i NOT IN (SELECT o_orderkey FROM orders) AND i NOT IN (SELECT i FROM new_i)
    UNION ALL SELECT DISTINCT 'violations', 'stored already', i || '/' || field FROM new_v JOIN names USING (f) WHERE (i, f) IN (SELECT (l_orderkey, l_linenumber % 6 + 1) FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber <= 6)""")
def star_faults(spark, d):
    """What is wrong with a delivery of inspections and violations."""
    k = F.col("o_orderkey")
    rules = F.element_at(F.array(*map(F.lit, dims.FIELDS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    new = {
        "inspections": table(spark, d, "orders").filter("o_orderkey % 10 = 0").select((k * 3).cast("string").alias("inspection_id"), (F.col("o_custkey") + 20).cast("string").alias("product_id"), (k % 30).cast("string").alias("user_id"), F.when(k * 3 % 4 > 0, True).alias("compliant")),
        "violations": table(spark, d, "lineitem").filter("l_orderkey % 10 = 5 and l_linenumber <= 7").select((F.col("l_orderkey") * 2).cast("string").alias("inspection_id"), rules.alias("field_key")),
    }
    return star.faults(new, star_of(spark, d))


# -- reports of all ages ----------------------------------------------------------------------------------------------


def mixed_reports(spark, d):
    """Reports of both shapes, some without any, some that aren't JSON."""
    row, k = best(spark, d), F.col("product_id")
    name = F.element_at(F.array(*map(F.lit, dims.FIELDS)), F.col("field_no") + 1)
    new = F.struct(F.col("status").alias("status"), F.col("label").alias("extracted_value"), F.col("conf").alias("confidence"), F.lit("r").alias("reason"))
    old = F.struct((F.col("status") == "FOUND").alias("present"), F.col("label").alias("matched_text"), F.when(F.col("field_no") % 2 == 0, "d").alias("description"))
    per = row.groupBy(k.alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(name, new))).alias("new"), F.map_from_entries(F.collect_list(F.struct(name, old))).alias("old"))
    made = lambda **m: F.to_json(F.struct(*[v.alias(n) for n, v in m.items()]))
    report = F.when(F.col("id") % 5 == 0, "{broken").when(F.col("id") % 5 == 1, made(fields=F.col("old"))).when(F.col("id") % 5 == 2, made(field_decisions=F.col("new"), fields=F.col("old"))).when(F.col("id") % 5 == 3, F.concat(F.lit('{"field_decisions": {}, "fields": '), F.to_json("old"), F.lit("}"))).otherwise('{"field_decisions": 7}')
    return per.select("id", report.alias("report"))


@query(f"""SELECT product_id AS id, product_id % 5 <> 2 AS legacy, {"['" + "', '".join(dims.FIELDS) + "']"}[field_no + 1] AS field_key, CASE WHEN product_id % 5 <> 2 THEN CASE WHEN field_no % 2 = 0 THEN 'd' ELSE {"['" + "', '".join(dims.FIELDS) + "']"}[field_no + 1] END END AS declaration,
    CASE WHEN product_id % 5 <> 2 THEN '-' END AS rule_id, CASE WHEN product_id % 5 = 2 THEN status WHEN status = 'FOUND' THEN 'PASS' ELSE 'VIOLATION' END AS status, label AS extracted_value, CASE WHEN product_id % 5 = 2 THEN conf::DOUBLE END AS confidence,
    CASE WHEN product_id % 5 = 2 THEN 'r' WHEN status = 'FOUND' THEN 'Present in the legacy report.' ELSE 'Missing in the legacy report.' END AS reason FROM best WHERE product_id % 5 IN (1, 2, 3)""", "candidates", "best")
def legacy_decisions(spark, d):
    return legacy.decisions(mixed_reports(spark, d))


# -- the dashboard ----------------------------------------------------------------------------------------------------

adapters.SQL["current"] = f"""current AS (
        SELECT product_id AS id, field_no, CASE WHEN product_id % 3 = 0 THEN field_no % 2 = 0 OR status = 'FOUND' ELSE status = 'FOUND' END AS present FROM best WHERE product_id % 4 < 3
    ), reports AS (SELECT id, bool_and(present) AS compliant FROM current GROUP BY id)"""


@query(f"""SELECT (SELECT count(*) FROM reports) AS total_scanned, (SELECT count(*) FROM reports WHERE compliant) AS compliant_count, round(100 * (SELECT count(*) FROM reports WHERE compliant) / (SELECT count(*) FROM reports), 1) AS compliance_rate,
    (SELECT string_agg(f || ':' || n, ',' ORDER BY n DESC, f) FROM (SELECT {"['" + "', '".join(dims.FIELDS) + "']"}[field_no + 1] AS f, count(*) AS n FROM current WHERE NOT present GROUP BY f ORDER BY n DESC, f LIMIT 5)) AS most_common_violations""", "candidates", "best", "current")
def dashboard_row(spark, d):
    """Three batches, the last with new versions of a third of the reports; the second comes twice."""
    name = F.element_at(F.array(*map(F.lit, dims.FIELDS)), F.col("field_no") + 1)

    def version(n, present):
        missing = F.array_compact(F.collect_list(F.when(~present, name)))
        return F.struct(F.lit(n).cast("long").alias("version"), F.every(present).alias("compliant"), missing.alias("violations")).alias(f"v{n}")

    found = F.col("status") == "FOUND"
    rows = best(spark, d).filter("product_id % 4 < 3")
    store = Versions(spark, shared_folder(spark, "dashboard"))
    dashboard.open_store(store)
    arrived = store.aside(rows.groupBy(F.col("product_id").cast("string").alias("id")).agg(version(1, found), version(2, found | (F.col("field_no") % 2 == 0))), "arrived")
    first, later = arrived.select("id", "v1.*"), arrived.filter("cast(id as long) % 3 = 0").select("id", "v2.*")
    for number, batch in ((0, first.filter("cast(id as long) % 2 = 0")), (1, first.filter("cast(id as long) % 2 = 1")), (1, first.filter("cast(id as long) % 2 = 1")), (2, later), (3, first)):
        dashboard.fold(store, batch, number)
    listed = F.array_join(F.transform("most_common_violations", lambda v: F.concat_ws(":", v["field"], v["count"])), ",")
    return dashboard.dashboard(store).withColumn("most_common_violations", listed)
