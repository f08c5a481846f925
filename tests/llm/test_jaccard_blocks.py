"""Words and n-grams hashed over many texts at once, and rows that don't pass through Python."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from corpus import frame

from labelscan.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PARTS = ["a", "B", "Z", "[", "@", "é", "Ü", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", "x" * 70, "y" * 64, "Y" * 65, "q" * 9, "\x00"]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def grams(text, n):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_sets_of_odd_texts():
    """Sets of texts side by side are equal where the sets of their words are, whatever the blocks' edges."""
    rnd = random.Random(3)
    texts = [None, "", " ", "a", "A b", "a b c", *("".join(rnd.choices(PARTS, k=rnd.randrange(60))) for _ in range(700)), "é " * 700_000, "b"]
    for n in (1, 3, 5):
        for start in (0, 3):
            seen, found = {}, list(jaccard.shingles(batch(texts).slice(start), n))
            assert [i for i, _ in found] == list(range(start, len(texts)))
            for i, s in found:
                own = grams(texts[i], n)
                assert len(s) == len(own) and seen.setdefault(jaccard.key_of(s), own) == own
            assert len(seen) == len({frozenset(grams(t, n)) for t in texts[start:]})


def test_order_within_a_text():
    """``lowest`` keeps the order by (last, chance, n-gram), ties of chance included."""
    logs = np.log(np.random.default_rng(1).integers(1, 9, jaccard.SKETCH + 1)).astype(np.float32)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(i)) for i in range(120)]
    for _, s, chance, at in jaccard.weighed(batch(texts), 2, logs):
        last = (s & np.uint64(7)) == 0
        rank = jaccard.ranked(chance, at, last)
        for a, b in zip(at, at[1:]):
            for most in {1, (b - a) // 2, b - a} - {0} if b > a else ():
                assert (jaccard.lowest(rank[a:b], most) == np.lexsort((s[a:b], chance[a:b], last[a:b]))[:most]).all()


def test_words_make_no_python_objects():
    """op6: counting 400,000 different words holds arrays of a block, not an object of each word."""
    own = batch([" ".join(f"w{i}x{k}" for k in range(4000)) for i in range(100)])
    tracemalloc.start()
    (counts,) = jaccard.count_words(iter([own]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(np.frombuffer(b, np.int64).sum() for b in counts.column(1).to_pylist()) == 400_000
    assert peak < 45e6


def test_rows_that_stay_do_not_pass_through_python(spark):
    """pipeline, near_dedup: whole rows aren't sent to Python workers to be dropped."""
    text = " ".join(f"w{k}" for k in range(60))
    kept = jaccard.drop_near_copies(frame(spark, [(1, text, "a"), (2, f"{text} x", "a"), (3, "other words", "b"), (None, "null", "b")]))
    assert "InArrow" not in kept._jdf.queryExecution().toString()
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
