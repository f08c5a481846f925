"""Fill in the middle against a direct version, on all odd kinds of texts."""

import hashlib
import re
from collections import Counter

from corpus import clashing, frame, rows
from pyspark.sql import functions as F

from labelscan.llm import infill

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def direct(ident, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (ident, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (ident, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (ident, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def found(df):
    out = infill.transform(df)
    both = out.select("*", infill.restored(F.col("output"), F.col("form")).alias("restored")).collect()
    return Counter(tuple(r)[:-1] for r in both), [(r["doc_id"], r["restored"]) for r in both]


def test_every_kind_of_text(spark):
    got, texts = found(clashing(spark))
    assert got == Counter(direct(i, t) for i, t, _ in rows())
    assert sorted(texts) == sorted((i, t or "") for i, t, _ in rows())
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_marks_ties_and_repeated_rows(spark):
    odd = ["<P>", "a <S> b", "x<M>", "a<b<", "<P", "S>M><", "<é\U0001d4b3 日本>\n\n", "A", "  ", "\r\n\0", None, ""]
    data = [(k, t, None) for k, t in enumerate(odd * 5)] + [(None, "one two three", None), (0, "one two three", None), (-1, None, None)]
    data += [(7, "same row of seven words in it", "a")] * 5 + [(7, "another text of the same identifier", "b"), (None, None, None), (None, "one two three", None)]
    got, texts = found(frame(spark, data))
    assert got == Counter(direct(i, t) for i, t, _ in data)
    assert Counter(texts) == Counter((i, t or "") for i, t, _ in data)


def test_very_long_text_and_empty_table(spark):
    data = [(k, "word, é " * 60_000 + "#" * k, "a") for k in range(4)]
    assert found(frame(spark, data))[0] == Counter(direct(i, t) for i, t, _ in data)
    assert infill.transform(frame(spark, [])).collect() == []


def test_texts_are_shuffled_once(spark):
    """Units, running sums, requests and cuts use the exchange of the texts; nothing else moves but identifiers and numbers."""
    spark.createDataFrame(rows(), "doc_id long, text string, source string").createOrReplaceTempView("fim_rows")
    df = infill.transform(spark.table("fim_rows"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id#") == plan.count("REPARTITION_BY_COL") == 3  # two of them alike: reused
    assert "BroadcastExchange" not in plan
