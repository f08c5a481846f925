"""Fill-in-the-middle transformation over relational units.

A text is cut into units, runs of letters and single other characters.  Its units become rows (``posexplode`` of their lengths); a
running sum of lengths per document says where each unit ends.  Cut requests, two a document, drawn from its identifier, are
rows of a table of their own and meet the units by ordinal.  What they find is aggregated to two offsets a document, at which the text is
cut and put together again with marks.

One exchange of the texts by document serves all readers: units, requests and the texts that are cut.  Units, their
running sums, requests and offsets stay where the texts lie.  A document's units are sorted in one task, as its text is one row.

Edge cases: a null text counts as empty; empty texts, and texts that contain a mark, stay plain; a null identifier is drawn for as if it were
written as nothing; rows that repeat identifier and text are cut alike (their units are stacked in one running sum, which is divided by
their number); rows that repeat only the identifier are drawn alike and cut each by its own units; equal draws leave an empty middle;
texts of any length are cut whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the transformation: what a unit is, the marks of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
KEYS = ["id", "digest"]


def draws(ident: Column, seed: str) -> Column:
    """Four unsigned 32-bit numbers of an identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def form_of(text: Column, h: Column, percent: int, spm_percent: int) -> Column:
    marked = reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    return F.when((text == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")


def cuts(n: Column, h: Column) -> list[Column]:
    """Ordinals of the last units of prefix and middle."""
    drawn = [h[k] % (n + 1) for k in (0, 1)]
    return [F.least(*drawn), F.greatest(*drawn)]


def output_of(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "spm", spm).otherwise(psm)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no text with a mark in it is ever cut, so each mark stands there once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    whole = F.when(form == "spm", F.concat(second, F.get(parts, F.lit(3)), first)).otherwise(F.concat(first, F.get(parts, F.lit(3)), second))
    return F.when(form == "plain", output).otherwise(whole)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; ``percent`` of the documents are cut, of these ``spm_percent`` suffix first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    form, n = form_of(F.col("text"), draws(F.col("doc_id"), seed), percent, spm_percent), F.regexp_count("text", F.lit(UNIT)).cast("long")
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("digest"), "doc_id", "text", form.alias("form"), n.alias("n")).repartition(*KEYS)
    cut = cuts(F.col("n"), draws(F.col("doc_id"), seed))

    asked = rows.select(*KEYS, F.when(F.col("form") != "plain", F.array(*cut)).alias("asked"))
    asked = asked.groupBy(*KEYS).agg(F.max(F.get("asked", F.lit(0))).alias("first"), F.max(F.get("asked", F.lit(1))).alias("second"), F.count(F.lit(1)).alias("copies"))
    asked = asked.select(*KEYS, F.array("first", "second").alias("asked"), "copies")

    # the start of a text is a unit without length; what lies behind the second cut nobody asks for
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), 0), F.length)
    lengths = F.concat(F.array(F.lit(0)), F.slice(lengths, F.lit(1), cut[1].cast("int")))
    units = rows.select(*KEYS, F.posexplode_outer(F.when(F.col("form") != "plain", lengths)).alias("ordinal", "length"))
    ends = units.select(*KEYS, "ordinal", F.sum("length").over(Window.partitionBy(*KEYS).orderBy("ordinal")).alias("end"))

    # equality of keys alone deals out the rows, as the texts are dealt already; the ordinal is compared where they meet
    keyed = [ends[k] == asked[k] for k in KEYS]
    found = ends.join(asked.hint("shuffle_hash"), reduce(Column.__and__, keyed, F.array_contains("asked", F.col("ordinal").cast("long"))))
    at = lambda k: F.max(F.when(F.col("ordinal") == F.get("asked", F.lit(k)), F.expr("end div copies")))
    offsets = found.groupBy(*[ends[k] for k in KEYS]).agg(at(0).alias("prefix_chars"), at(1).alias("upto"))

    out = rows.join(offsets.hint("shuffle_hash"), KEYS, "left")
    start, end = F.col("prefix_chars").cast("int"), F.col("upto").cast("int")
    pieces = F.substring("text", F.lit(1), start), F.substring("text", start + 1, end - start), F.substring("text", end + 1, F.length("text"))
    return out.select("doc_id", "n", "form", "prefix_chars", (F.col("upto") - F.col("prefix_chars")).alias("middle_chars"), output_of(F.col("form"), F.col("text"), *pieces).alias("output"))
