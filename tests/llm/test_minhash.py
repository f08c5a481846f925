"""MinHash near-duplicates against all pairs of whole sets."""

import random
import re
from math import comb

import numpy as np
import pytest
from corpus import clashing, frame, rows

from labelscan.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(data, n=5, percent=85):
    """(doc_id, text) -> Counter-like list of (doc_id, n_shingles, component_id, kept)."""
    sets = []
    for _, t in data:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(data)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and (100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    first = {}
    for k, (i, _) in enumerate(data):
        first.setdefault(find(k), []).append(i)
    names = {r: min((i for i in own if i is not None), default=None) for r, own in first.items()}
    return sorted(((i, len(s), names[find(k)], i == names[find(k)]) for k, ((i, _), s) in enumerate(zip(data, sets))), key=str)


def found(df, **more):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **more).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def families(seed):
    """Families of 60 near copies of one text each, their distance to it from none to too far; a chain of successive versions."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    for size in (12, 60, 400):
        base = [word() for _ in range(size)]
        for k in range(60):
            own = list(base)
            for _ in range(k % 8 * size // 250 + (k % 3 if k % 2 else 0)):
                own[rnd.randrange(size)] = word()
            texts.append(" ".join(own).title() if k % 5 else "\n".join(own))
    own = [word() for _ in range(300)]
    for k in range(40):
        own[7 * k % 300] = word()
        texts.append(" ".join(own))
    texts += [texts[3]] * 70 + ["", None, "one", "one", "one two", "a b c d e", "A\tB\x0bc\r\nd e "]
    ids = list(range(5, 5 + len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("percent", (85, 70))
def test_families(spark, percent):
    data = families(percent)
    assert found(frame(spark, data, "doc_id long, text string"), percent=percent) == direct(data, percent=percent)


def test_hot_buckets_and_open_ones(spark, monkeypatch):
    """Every bucket is hot; pivots find nothing, so all links come from the join of open buckets."""
    monkeypatch.setattr(minhash, "HOT", 1)
    data = families(9)
    want = direct(data)
    assert found(frame(spark, data, "doc_id long, text string")) == want
    pivots = minhash.Run.pivots
    monkeypatch.setattr(minhash.Run, "pivots", lambda self: pivots(self).limit(0))
    assert found(frame(spark, data, "doc_id long, text string")) == want


def test_other_columns_repeated_rows_nulls_and_empty_table(spark):
    assert found(clashing(spark)) == direct([(i, t) for i, t, _ in rows()])
    assert found(frame(spark, [])) == []
    words = " ".join(f"w{k}" for k in range(50))
    data = [(7, words, None), (7, words, None), (None, words, None), (None, "null alone", None), (None, None, None), (3, None, None), (3, "", None)]
    got = found(frame(spark, data))
    assert got == sorted([(7, 46, 7, True)] * 2 + [(None, 46, 7, False), (None, 1, None, True), (None, 0, None, True)] + [(3, 0, 3, True)] * 2, key=str)
    # an identifier with two texts is one node
    both = [(1, words, None), (2, words, None), (2, words.upper() + " X" * 200, None), (4, words.upper() + " X" * 200, None)]
    assert {r[2] for r in found(frame(spark, both))} == {1}


def test_posterior_bounds():
    for n, p in ((32, 0.85), (96, 0.85), (128, 0.925)):
        m = minhash.least_matches(n, p, 1e-6)
        below = lambda m: sum(comb(n + 1, k) * p**k * (1 - p) ** (n + 1 - k) for k in range(m + 1))  # noqa: E731, B023
        assert below(m) >= 1e-6 > below(m - 1)
        # the same by integrating the posterior density
        x = (np.arange(400_000) + 0.5) / 400_000
        for k in (m - 1, m):
            density = x**k * (1 - x) ** (n - k)
            assert density[x >= p].sum() / density.sum() == pytest.approx(below(k), rel=1e-3)


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    factors = minhash.multipliers()
    agreed = []
    for _ in range(200):
        s = rnd.integers(0, 1 << 63, 230, dtype=np.uint64) * np.uint64(2)
        a, b = minhash.minimal(s[:215], factors), minhash.minimal(s[15:], factors)
        agreed.append((a == b).mean())
        assert (minhash.minimal(s[::-1], factors) == minhash.minimal(s, factors)).all()
    assert np.mean(agreed) == pytest.approx(200 / 230, abs=0.01)
