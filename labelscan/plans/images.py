"""Queries over images: captions, positions, pixels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overlays, pixels, positions
from ..sources import adapters
from ..sources.readers import table
from .catalogue import query
from .reports import best

CAPTIONS = """boxed AS (
        SELECT product_id AS image_id, field_no AS pos, 'field ' || field_no || ' - ' || status || ' - ' || label AS text, 160 + (product_id % 4)::INT * 40 AS w, 120 + (product_id % 3)::INT * 30 AS h,
               (part % 170)::INT - 10 AS x, (part * 7 % 130)::INT - 5 AS y, (part % 50)::INT AS bw, 8 + (part % 20)::INT AS bh FROM best
    ), boxes AS (
        SELECT *, greatest(0, x) AS l, greatest(0, y) AS t, least(w - 1, x + bw) AS r, least(h - 1, y + bh) AS b, CASE WHEN length(text) <= (w - 8) // 6 THEN text ELSE substr(text, 1, greatest(0, (w - 8) // 6 - 3)) || '...' END AS caption
        FROM boxed WHERE bw > 0 AND x + bw > 0 AND y + bh > 0 AND x < w AND y < h
    ), sized AS (
        SELECT *, 6 * length(caption) + 6 AS cw, 17 AS ch, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS n FROM boxes
    ), started AS (
        SELECT *, least(greatest(0, l), greatest(0, w - cw)) AS cx, least(greatest(0, CASE WHEN t >= ch + 2 THEN t - ch - 2 ELSE b + 2 END), greatest(0, h - ch)) AS cy FROM sized
    ), laid(image_id, n, taken) AS (
        SELECT image_id, 0::BIGINT, []::STRUCT(l INT, t INT, r INT)[] FROM (SELECT DISTINCT image_id FROM started)
        UNION ALL
        SELECT s.image_id, s.n, list_append(taken, {'l': cx, 't': coalesce(list_filter(
            list_transform(list_concat([cy], flatten(list_transform(range(ch + 2, h, ch + 2), lambda o: [cy + o, cy - o]))), lambda y: least(greatest(0, y), greatest(0, h - ch))),
            lambda y: len(list_filter(taken, lambda o: cx < o.r AND cx + cw > o.l AND y < o.t + 17 AND y + ch > o.t)) = 0)[1], cy)::INT, 'r': cx + cw})
        FROM laid JOIN started AS s ON s.image_id = laid.image_id AND s.n = laid.n + 1
    )"""


def captioned(spark, d):
    part, product = F.col("part"), F.col("product_id")
    return best(spark, d).select(
        product.alias("image_id"), F.col("field_no").alias("pos"), F.concat_ws(" - ", F.concat(F.lit("field "), F.col("field_no").cast("string")), "status", "label").alias("text"),
        (160 + product % 4 * 40).cast("int").alias("image_width"), (120 + product % 3 * 30).cast("int").alias("image_height"),
        (part % 170 - 10).cast("int").alias("left"), (part * 7 % 130 - 5).cast("int").alias("top"), (part % 50).cast("int").alias("width"), (8 + part % 20).cast("int").alias("height"),
    )


#: The fold as a recursive query, a step for each box of an image; all captions are 17 high.
PLACED = f"""WITH RECURSIVE {adapters.SQL['candidates']}, {adapters.SQL['best']}, {CAPTIONS}
    SELECT s.image_id, s.pos, s.caption, concat_ws(',', l, t, r, b) AS box, concat_ws(',', taken[s.n].l, taken[s.n].t, taken[s.n].r, taken[s.n].t + 17) AS caption_box
    FROM started AS s JOIN (SELECT image_id, arg_max(taken, n) AS taken FROM laid GROUP BY image_id) USING (image_id)"""


@query(PLACED)
def placed_captions(spark, d):
    shown = lambda c: F.concat_ws(",", *[F.col(f"{c}.{k}") for k in ("left", "top", "right", "bottom")]).alias(c)
    return overlays.placed(captioned(spark, d)).select("image_id", "pos", "caption", shown("box"), shown("caption_box"))


@query("""SELECT o_orderkey, s_suppkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)
    JOIN (SELECT l_orderkey * 10 + l_linenumber AS s_suppkey, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS position FROM lineitem WHERE l_quantity < 10) USING (position)""")
def zipped_tables(spark, d):
    """Two tables of different lengths beside each other by position."""
    left = positions.with_positions(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    right = table(spark, d, "lineitem").filter("l_quantity < 10").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("s_suppkey"))
    right = positions.with_positions(right, "l_partkey", "l_orderkey", "l_linenumber")
    return left.join(right, "position").select("o_orderkey", "s_suppkey", "position")


@query("""SELECT l_orderkey AS id, l_linenumber - 1 AS pos, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus WHEN l_linenumber = 1 THEN 'front' WHEN l_linenumber = 2 THEN 'back' ELSE 'image-' || l_linenumber END AS label FROM lineitem""")
def default_labels(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (n - 1).alias("pos"), F.when(n % 3 == 0, F.col("l_linestatus")).when(n % 2 == 0, " ").alias("label"))
    return positions.labelled(rows, "id")


def text_images(spark, d):
    """Texts as grey images of 24 to 87 columns; every seventh lacks a byte, every eleventh has two channels."""
    raw, k = F.encode("text", "UTF-8"), F.col("doc_id")
    width = (24 + k % 64).cast("int")
    height = F.floor(F.octet_length(raw) / width).cast("int")
    kept = width * height - F.when(k % 7 == 0, 1).otherwise(0)
    return table(spark, d, "documents").select(k.alias("id"), width.alias("width"), height.alias("height"), F.when(k % 11 == 0, 2).otherwise(1).alias("channels"), F.substring(raw, F.lit(1), kept).alias("pixels"))


@query(r"""WITH raw AS (SELECT doc_id AS id, (24 + doc_id % 64)::INT AS width, hex(encode(coalesce(text, ''))) AS x, text IS NULL AS none FROM documents),
    shaped AS (SELECT *, (length(x) // 2 // width)::INT AS height FROM raw),
    told AS (SELECT *, CASE WHEN none OR width * height - (id % 7 = 0)::INT <= 0 THEN 'image must not be empty' WHEN id % 11 = 0 THEN 'image must be grayscale, BGR, or BGRA' WHEN id % 7 = 0 THEN 'size and pixels differ' END AS why FROM shaped),
    pixels AS (SELECT id, width, height, k // width AS y, k % width AS c, ('0x' || substr(x, 2 * k + 1, 2))::INT AS v FROM (SELECT *, unnest(range(width * height)) AS k FROM told WHERE why IS NULL)),
    near AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS r_, lag(v) OVER u AS a, lead(v) OVER u AS b FROM pixels WINDOW r AS (PARTITION BY id, y ORDER BY c), u AS (PARTITION BY id, c ORDER BY y)),
    edges AS (SELECT *, coalesce(l, r_, v) + coalesce(r_, l, v) + coalesce(a, b, v) + coalesce(b, a, v) - 4 * v AS e FROM near),
    sums AS (SELECT id, count(*) AS n, sum(v) AS s, sum(v * v) AS q, count(*) FILTER (v >= 250) AS g, sum(e) AS es, sum(e * e) AS eq FROM edges GROUP BY id)
    SELECT id, width, CASE WHEN NOT none THEN height END AS height, CASE WHEN n > 0 THEN round(greatest(0, eq / n - (es / n) * (es / n)), 6) END AS blur, round(s / n, 6) AS brightness, round(g / n, 6) AS glare, CASE WHEN n > 0 THEN round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) END AS contrast,
           CASE WHEN why IS NOT NULL THEN 'Image could not be assessed safely (' || why || ').' END AS problem FROM told LEFT JOIN sums USING (id)""")
def pixel_metrics(spark, d):
    """Metrics from tiles of 16 x 16 pixels; texts' bytes are the pixels."""
    out = pixels.metrics(text_images(spark, d), side=16)
    return out.select("id", "width", "height", *[F.round(c, 6).alias(c) for c in ("blur", "brightness", "glare", "contrast")], "problem")


@query()
def image_quality(spark, d):
    """Scores, statuses and recommendations from pixels, with unusable images; tests hold it against a direct version."""
    out = pixels.assessed(pixels.metrics(text_images(spark, d)))
    return out.select("id", "status", "quality_score", "recommendation", "allows_ocr", "explanation", *[f"{c}_score" for c in ("resolution", "blur", "brightness", "glare", "readability")])
