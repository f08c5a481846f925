"""Information-theoretic sanitisation of personal data.

Base entities (e-mail, ip, card, phone) are found by fixed patterns.  Then corpus counts estimate how strongly terms reveal
them.  Contexts are the different texts that hold an entity, and the documents that hold none.  With N contexts, n(c) that
hold c, n(t) that hold term t outside base spans and n(c, t) that hold both, a term discloses

    PMI(c; t) / IC(c) = ln(p N / n(c)) / ln(N / n(c))

of c, where p is the lower end (``DEVIATIONS``) of the confidence interval of n(c, t) / n(t).  A term is revealing where its
disclosure reaches ``THRESHOLD`` and p reaches ``LEAST``, so that no common thing is disclosed by next to nothing.  The same measure
and limits hold on both routes:

* *entity*: c is one entity, which at least ``SUPPORT`` contexts share with the term; here n(t) counts documents, so that copies,
  which corroborate nothing, weigh against the term;
* *class*: most entities stand in one text only, so they back off to their kind and to all entities together.  The contexts
  must name at least ``CLASS_SUPPORT`` different entities (each counts by its least one): near copies repeat theirs and are no evidence.

Terms back off too: a value that is written once, as in ``key = value`` or ``key: "value"``, counts as the term ``key =``, so what
the key's company discloses marks the value.

Each occurrence of a revealing term outside base spans, in whichever document, is an added span: it is generalised to its
kind, or removed from ``REMOVE`` on.  Counts cover all documents.  Terms are runs of word characters of any length, in lower
case; Han characters and kana, which stand without spaces, give each two neighbours as a term (spans may then overlap, as may a
value and the words in it).

One pass over the texts gives the terms of documents without an entity, summed per task before the shuffle, and rows for the
terms of the others.  On the first route, terms and entities of a document are paired only where ``LEAST`` can be reached
at all: as n(c, t) <= n(c), only where n(t) <= n(c) / LEAST; the commonest terms leave before the join.  A second pass gives
base spans and the occurrences of terms that a bitmap of fixed size doesn't rule out; a salted join with the revealing terms
decides.  Only such narrow rows are joined, so texts are never shuffled.

Edge cases: a null text is an empty one; an entity or a class in every context carries no information and adds nothing; copies of
a text with an entity are one context, copies of one without are several (which only makes their terms less revealing); rows that
repeat an identifier are separate documents; equal disclosures count alike; texts of any length are read whole; columns besides
identifier and text are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone", "term")
#: Fixed patterns. Looking behind at a digit only spares attempts inside a run of digits that has failed from its start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[^0-9]+")
#: Scripts without spaces between words.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
TERM, DENSE = re.compile(f"[{UNSPACED}]+|[^\\W{UNSPACED}]+"), re.compile(f"[{UNSPACED}]{{3,}}")
#: What is assigned, and what it is assigned to, which may stand in quotes.
ASSIGN, KEY, VALUE = re.compile(r"[=:]"), re.compile(r"([^\W\d]\w{0,63})[\"']?[\x20\t]{0,8}$"), re.compile(r"[\x20\t]{0,8}[\"']?([^\s\"',;]+)")
#: Contexts that a term and an entity share, different entities behind a class, disclosure from which a term is revealing or removed.
SUPPORT, CLASS_SUPPORT, THRESHOLD, REMOVE = 2, 8, 0.6, 0.98
#: How many standard deviations below its estimate a probability is taken, and what it must be at least.
DEVIATIONS, LEAST = 2.0, 0.3
#: Values of a salt, which spreads the occurrences of one term over tasks.
SALTS = 32
#: Vocabulary entries a task holds before it passes them on.
HELD = 300_000
#: Bits of the bitmap that spares words which aren't revealing the join, and bits of one row of it.
BITS, ROW_BITS = 1 << 23, 1 << 15
#: Commonest terms that are known not to reveal anything; tasks leave them out early, the result doesn't depend on it.
COMMON = 20_000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+`` @ ``DOMAIN``, found from their @ in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted."""
    out = []
    out += emails(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if text.count(".") >= 3:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def words(text: str) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of every term as it is written."""
    for m in TERM.finditer(text):
        s, e = m.span()
        if e - s > 2 and DENSE.match(m[0]):
            yield from ((text[k : k + 2], k, k + 2) for k in range(s, e - 1))
        else:
            yield m[0], s, e


def distinct(text: str) -> set[str]:
    found = set(TERM.findall(text))
    if not text.isascii():
        for run in [w for w in found if DENSE.match(w)]:
            found.remove(run)
            found.update(run[k : k + 2] for k in range(len(run) - 1))
    return found


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The words that lie outside the base spans; both are sorted by their start."""
    k, reached = 0, 0
    for word, s, e in words(text):
        while k < len(spans) and spans[k][0] < e:
            reached = max(reached, spans[k][2])
            k += 1
        if s >= reached:
            yield word, s, e


def assigned(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(key as a term, start, end of its value) of what is assigned outside the base spans, left to right, without overlap."""
    k, reached, at = 0, 0, 0
    while m := ASSIGN.search(text, at):
        at = m.end()
        key = KEY.search(text[max(0, m.start() - 80) : m.start()])
        value = VALUE.match(text, at) if key else None
        if value:
            s, e = value.span(1)
            while k < len(spans) and spans[k][0] < e:
                reached = max(reached, spans[k][2])
                k += 1
            if s >= reached:
                yield f"{key[1].lower()} =", s, e
            at = e


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {digest(f"{KINDS[k]}:{text[s:e]}") for s, k, e in spans}


def schema(ddl: str) -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), SPANS: span}
    return pa.schema([(c, types[kind]) for c, kind in (x.split(" ", 1) for x in ddl.split(", "))])


SPANS = "array<struct<start:int,kind:int,end:int>>"
SEEN = "what string, row long, entity string, context string, term string, n long"
MARKED = f"row long, doc_id long, spans {SPANS}, term string, start int, end int"
SEEN_SCHEMA, MARKED_SCHEMA = schema(SEEN), schema(MARKED)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of what: ``clean`` (documents without an entity), ``plain`` (those of a term), ``text`` (kinds in a text, as bits), ``entity`` and ``near`` (entities and terms of a document with entities)."""
    counts: Counter = Counter()
    clean = 0

    def terms() -> pa.RecordBatch:
        n = len(counts)
        own = {"what": ["plain"] * n, "term": list(counts), "n": list(counts.values())}
        return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in SEEN_SCHEMA], schema=SEEN_SCHEMA)

    for batch in batches:
        rows = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(2)):
            text = text.as_py()
            spans = base_spans(text)
            if spans:
                about, own, bits = digest(text), entities(text, spans), 0
                for _, kind, _ in spans:
                    bits |= 1 << kind
                near = {w.lower() for w, _, _ in outside(text, spans)}
                near.update(key for key, _, _ in assigned(text, spans))
                rows.append({"what": "text", "context": about, "n": bits})
                rows += [{"what": "entity", "row": row, "entity": c, "context": about} for c in own]
                rows += [{"what": "near", "row": row, "entity": min(own), "context": about, "term": t, "n": bits} for t in near]
            else:
                clean += 1
                found = {w.lower() for w in distinct(text)}
                found.update(key for key, _, _ in assigned(text, spans))
                counts.update(found)
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_pylist(rows, SEEN_SCHEMA)
                rows = []
            if len(counts) >= HELD:
                yield terms()
                counts.clear()
        yield pa.RecordBatch.from_pylist(rows, SEEN_SCHEMA)
    yield terms()
    yield pa.RecordBatch.from_pylist([{"what": "clean", "n": clean}], SEEN_SCHEMA)


def place(text: Column) -> Column:
    """The bit of a term, as ``Maybe`` finds it."""
    return F.crc32(text.cast("binary")) % BITS


def bitmap(terms: DataFrame, col: str) -> bytes:
    """The bits of all values of a column: BITS bits on the driver, however many rows there are."""
    out = bytearray(BITS // 8)
    at = place(F.col(col))
    rows = terms.select(F.floor(at / ROW_BITS).alias("chunk"), (at % ROW_BITS).alias("bit")).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    for r in rows.toLocalIterator():
        out[r["chunk"] * ROW_BITS // 8 : (r["chunk"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)


class Maybe(dict):
    """term -> itself in lower case, or None where the bitmap rules it out."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, word: str) -> str | None:
        if len(self) >= HELD:
            self.clear()
        term = word.lower()
        at = zlib.crc32(term.encode("utf-8", "replace")) % BITS
        value = self[word] = term if self.bits[at >> 3] >> (at & 7) & 1 else None
        return value


def least(both: Column, n: Column) -> Column:
    """The lower end of the confidence interval (Wilson) of the share ``both / n``."""
    p, z = both / n, DEVIATIONS
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosed(both: Column, n_t: Column, n_c: Column, total: int) -> Column:
    """The share of the information of c that the term gives; null where the term is no clue at all, or c no secret."""
    p = least(both, n_t)
    return F.when((p >= LEAST) & (n_c < total), F.log(p * total / n_c) / F.log(F.lit(float(total)) / n_c))


def mark(bits):
    """Rows with ``spans`` (the base spans of a document) and rows with ``term, start, end`` (what may be a revealing term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = Maybe(bits.value)
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                spans = base_spans(text)
                rows.append({"row": row, "doc_id": doc_id, "spans": [{"start": s, "kind": k, "end": e} for s, k, e in spans]})
                if any(maybe[w] is not None for w in distinct(text)):
                    rows += [{"row": row, "term": t, "start": s, "end": e} for w, s, e in outside(text, spans) if (t := maybe[w]) is not None]
                rows += [{"row": row, "term": t, "start": s, "end": e} for w, s, e in assigned(text, spans) if (t := maybe[w]) is not None]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, MARKED_SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, MARKED_SCHEMA)

    return run


def revealing_terms(seen: DataFrame, scratch: Scratch, support: int, class_support: int, threshold: float) -> DataFrame:
    """``term, disclosure, route`` of the terms that disclose an entity or a class of entities."""
    texts = seen.filter("what = 'text'").groupBy("context").agg(F.max("n").alias("n"))
    held = texts.agg(F.count(F.lit(1)).alias("all"), *[F.coalesce(F.sum(F.shiftright("n", k).bitwiseAND(F.lit(1))), F.lit(0)).alias(KINDS[k]) for k in range(4)]).first().asDict()
    total = held["all"] + seen.filter("what = 'clean'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = {KINDS[k]: F.sum(F.shiftright("n", k).bitwiseAND(F.lit(1)).cast("long")).alias(KINDS[k]) for k in range(4)}
    # copies of a text first, then texts with the same least entity, then terms: none of the three gathers a term's rows
    near = seen.filter("what = 'near'").groupBy("term", "entity", "context").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    near = near.groupBy("term", "entity").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("all"), *kinds.values())
    near = near.groupBy("term").agg(F.count(F.lit(1)).alias("entities"), *[F.sum(c).alias(c) for c in ("copies", "all", *kinds)]).filter(F.col("all") >= support)
    plain = seen.filter("what = 'plain'").groupBy("term").agg(F.sum("n").alias("n"))
    counted = near.join(plain, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counted = counted.withColumn("n_t", F.col("copies") + F.col("n")).withColumn("n", F.col("all") + F.col("n"))
    counted = scratch.save(counted, "counted")
    by_class = [disclosed(F.col(c), F.col("n"), F.lit(held[c]), total) for c in ("all", *kinds) if held[c]]
    classes = counted.filter(F.col("entities") >= class_support).select("term", F.greatest(*by_class, F.lit(None), F.lit(None)).alias("disclosure"), F.lit("class").alias("route")) if by_class else None

    entity = seen.filter("what = 'entity'").select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= support)
    entity = scratch.save(entity, "entity")
    bound = (entity.agg(F.coalesce(F.max("n_c"), F.lit(0))).first()[0]) / LEAST
    common = counted.filter(F.col("n_t") > bound).orderBy(F.desc("n_t"), "term").limit(COMMON).select("term")
    held_by = seen.filter("what = 'entity'").select("row", "entity", "context").join(entity, "entity")
    terms = seen.filter("what = 'near'").select("row", "term").join(F.broadcast(common), "term", "left_anti")  # at most COMMON rows
    terms = terms.join(counted.filter(F.col("n_t") <= bound).select("term", "n_t"), "term")
    pairs = held_by.join(terms, "row").filter(F.col("n_t") <= F.col("n_c") / LEAST)
    pairs = pairs.select("entity", "term", "n_c", "n_t", "context").distinct().groupBy("entity", "term", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct"))
    pairs = pairs.filter(F.col("n_ct") >= support).select("term", disclosed(F.col("n_ct"), F.col("n_t"), F.col("n_c"), total).alias("disclosure"), F.lit("entity").alias("route"))
    both = (pairs.union(classes) if classes else pairs).filter(F.col("disclosure") >= threshold)
    best = F.max(F.struct("disclosure", "route"))
    out = both.groupBy("term").agg(best.alias("best")).select("term", "best.disclosure", "best.route")
    return scratch.save(out, "revealing")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD, class_support: int = CLASS_SUPPORT) -> DataFrame:
    """``row, doc_id, base, added`` of every row; spans are structs (start, kind, end[, disclosure, route]), sorted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = scratch.save(own.mapInArrow(scan, SEEN), "seen")
    revealing = revealing_terms(seen, scratch, support, class_support, threshold)
    for name in ("seen", "counted", "entity"):
        scratch.drop(name)
    bits = spark.sparkContext.broadcast(bitmap(revealing, "term"))
    marked = scratch.save(own.mapInArrow(mark(bits), MARKED), "marked")
    base = marked.filter("spans is not null").select("row", "doc_id", F.col("spans").alias("base"))
    spans = marked.filter("spans is null").select("row", "term", "start", "end", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = revealing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    added = spans.join(salted, ["term", "salt"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "disclosure", "route"))).alias("added"))
    return base.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,disclosure:double,route:string>>")))


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities and revealing terms generalised to ``[KIND]`` or, where they disclose nearly all, removed.

    Rows that repeat an identifier are told apart by their texts.
    """
    names = docs.columns
    mine = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    mine = mine.withColumn("_key", F.xxhash64(F.sha2(F.coalesce("_text", F.lit("")), 256)))
    found = find(mine, "_key", "_text").select(F.col("doc_id").alias("_key"), "base", "added").dropDuplicates(["_key"])

    @F.pandas_udf("string")
    def redact(text: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        def one(t: str | None, b, a) -> str | None:
            if t is None:
                return None
            spans = sorted([(s["start"], s["end"], f"[{KINDS[s['kind']].upper()}]") for s in b] + [(s["start"], s["end"], "" if s["disclosure"] >= REMOVE else "[TERM]") for s in a])
            out, at = [], 0
            for s, e, tag in spans:
                if s >= at:
                    out += [t[at:s], tag]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return pd.Series([one(*x) for x in zip(text, base, added)])

    clean = redact(F.col("_text"), "base", "added")
    return mine.join(found, "_key", "left").withColumn("_clean", clean).select(*[(F.col("_clean") if n == text_col else F.col("_row").getField(n)).alias(n) for n in names])
