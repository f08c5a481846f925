"""Phrase collocations against a direct count."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from corpus import clashing, frame, rows

from labelscan.llm import phrases

BREAKS = re.compile("[.,;:!?\n\x0b\x0c\r]")
SCHEMA = "doc_id long, text string, lang string"


def direct(data, least, longest, top, percent=80):
    """data: (text, lang) of every row."""
    counts, sizes = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in BREAKS.split(lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    candidates = {g: f for g, f in counts.items() if len(g) > 2 and f >= least}
    longer = defaultdict(int)
    for g, f in candidates.items():
        for size in range(2, len(g) - 1):
            for i in range(1, len(g) - size + 1):
                longer[(g[0], *g[i : i + size])] = max(longer[(g[0], *g[i : i + size])], f)
    out = defaultdict(list)
    for g, a in candidates.items():
        if 100 * longer[g] >= percent * a:
            continue
        cuts = [(2_000_000 * a // (l + r), k, l, r) for k in range(1, len(g) - 1) for l, r in [(counts[g[: k + 1]], counts[(g[0], *g[k + 1 :])])]]
        score, _, l, r = min(cuts)
        out[g[0]].append((-score, -a, " ".join(g[1:]).encode(), l, r))
    return {(lang, n, p.decode(), -a, l, r, sizes[lang], -s) for lang, own in out.items() for n, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)}


def prose(seed, n):
    """Few words, so that phrases come often; odd spaces, breaks, capitals, no text, no language, repeated rows."""
    rnd = random.Random(seed)
    words = ["the", "of", "River", "bank", "new", "york", "City", "é x", "ß", "日本", "a\0b", "x-y", " "]
    out = []
    for k in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", " \t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "?!"]) for _ in range(rnd.randrange(0, 60)))
        out.append((None if k % 17 == 0 else k // 2, [None, "", " . , ", text][3 if k % 9 else k % 3], [None, "en", "de", "und", "en"][k % 5]))
    return out + out[5:40]


def test_against_direct_counts(spark):
    data = prose(1, 300)
    for longest, top in ((4, 2000), (3, 7), (2, 1)):
        got = [tuple(r) for r in phrases.collocations(frame(spark, data, SCHEMA), least=5, longest=longest, top=top).collect()]
        want = direct([r[1:] for r in data], 5, longest, top)
        assert len(got) == len(want) and set(got) == want and want


def test_ties_and_hot_parts(spark):
    """Equal scores go by count, then by bytes; of equal cuts the shortest first part counts; every part here is hot."""
    data = [(k, f"{x} {y}. {y} {x} z. {x} {y} z q", "l") for k in range(40) for x, y in (("a", "b"), ("é", "c"), ("Z", "d"))]
    got = {tuple(r) for r in phrases.collocations(frame(spark, data, SCHEMA)).collect()}
    assert got == direct([r[1:] for r in data], 30, 4, 2000) and got


def test_other_columns_very_long_texts_and_empty_table(spark):
    long = [(1, "one two three four " * 50_000 + "." + "five six " * 100, None)]
    assert {tuple(r) for r in phrases.collocations(frame(spark, long, SCHEMA)).collect()} == direct([r[1:] for r in long], 30, 4, 2000)
    assert {tuple(r) for r in phrases.collocations(clashing(spark), least=3).collect()} == direct([(t, None) for _, t, _ in rows()], 3, 4, 2000)
    assert phrases.collocations(frame(spark, [], SCHEMA)).collect() == []


def test_counts_beyond_32_bits_and_products_beyond_64(spark):
    big = 5_000_000_000_000
    answers = [("l", "a b c", big, k, left, f) for k, left, f in ((1, True, 2 * big), (1, False, big + 1), (2, True, 2 * big + 1), (2, False, big))]
    df = spark.createDataFrame(answers, "lang string, phrase string, a long, k int, left boolean, f long")
    (row,) = phrases.scored(df, 4).collect()
    assert tuple(row) == ("l", "a b c", big, 2 * big, big + 1, 2_000_000 * big // (3 * big + 1))


def test_a_bucket_spills_and_stays_exact(monkeypatch):
    monkeypatch.setattr(phrases, "MEMORY", "16MB")
    batches = (pa.RecordBatch.from_arrays([pa.array(["l"] * 20_000), pa.array([f"word{i % 300_000:09d} x{i % 300_000:020d}" for i in range(k, k + 20_000)]), pa.array([3] * 20_000, pa.int64())], schema=phrases.COUNTED) for k in range(0, 600_000, 20_000))
    out = [b for b in phrases.added(6)(batches)]
    assert sum(len(b) for b in out) == 300_000 and {f for b in out for f in b.column(2).to_pylist()} == {6}
