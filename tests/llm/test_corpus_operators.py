"""Every operator against a brute-force version, on texts of all odd kinds, on empty tables and with clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpus import clashing, frame, rows
from pyspark.sql import functions as F

from labelscan.llm import exact_dedup, jaccard, mixing, packing, pii, quality, sharding, suffix, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_dedup(spark, docs, empty):
    groups = defaultdict(list)
    for i, t, _ in rows():
        groups[t or ""].append(i)
    for digest in (exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)):  # the second makes collisions
        found = exact_dedup.exact_dedup(docs, digest=digest).collect()
        assert len(found) == len(rows())
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found}
        for i, t, _ in rows():
            own = groups[t or ""]
            assert got[i] == (max(own), len(own), i == max(own), hashlib.sha256((t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {max(g) for g in groups.values()}


def test_exact_dedup_repeated_rows(spark):
    df = frame(spark, [(7, "x", "a"), (7, "x", "a"), (None, "x", None), (None, None, None)])
    found = exact_dedup.exact_dedup(df).collect()
    assert sum(r["kept"] for r in found) == 2 and sorted(r["group_size"] for r in found) == [1, 3, 3, 3]


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    state, landed = f"file://{tmp_path}/state", f"file://{tmp_path}/landed"
    batch = lambda *ids: spark.createDataFrame([(i, i, f"d{i % 2}", None) for i in ids], "doc_id long, row_key long, digest string, locator string")
    batch(1, 2).write.parquet(landed)
    exact_dedup.drain(spark, landed, batch(1).schema, state, 1).collect()
    batch(5, 9).write.mode("append").parquet(landed)
    got = {r["digest"]: (r["held"]["doc_id"], r["n"]) for r in exact_dedup.drain(spark, landed, batch(1).schema, state, 1).collect()}
    assert got == {"d0": (2, 1), "d1": (9, 3)}


def test_packing(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    plain = packing.byte_bpe(path)
    want = {i: plain(t or "") + [1] for i, t, _ in rows()}
    found = packing.packed(docs, lambda: packing.byte_bpe(path, ranks)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, size in [*((p, len(want[i])) for i, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == size if size is not None else at <= packing.WINDOW
    padded = sum(1 for s in sequences.values() if (n := sum(x for _, x in s)) & (n - 1))
    assert set(pieces) == set(want) and padded <= 3
    assert packing.packed(empty, lambda: packing.byte_bpe(path, ranks)).count() == 0


def test_packing_cuts_nothing_from_ids():
    public = pytest.importorskip("public_tokenizers")
    path, ranks = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
    plain, fast = packing.byte_bpe(path), packing.byte_bpe(path, ranks)
    for t in ["a  b", " a", "a ", "a \nb", "x\u00a0 y", "don't 12 3.5!! <|endoftext|> z", "\x1c a", "a\n b\n\nc", "  ", "日本 語"]:
        assert plain(t) == fast(t) == fast(t), t


def test_toxicity(spark):
    clean = [(i, f"the quiet reader number{i} went home.", "s") for i in range(400)]
    bad = [(1000 + i, f"the reader went. you are a{' stupid' if i % 2 else ' worthless'} one{i}. fine", "s") for i in range(100)]
    docs = frame(spark, clean + bad + [(5000, None, "s"), (5001, "", "s"), (None, "you stupid", "s")])
    labels = spark.createDataFrame([(i, int(i >= 1000), 1) for i, _, _ in clean + bad], "doc_id long, toxic int, quality int")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == 503
    for r in found:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == int(1000 <= r["doc_id"] < 2000) == int(r["score"] >= 0.5)
    assert toxicity.score(docs, labels.limit(0)).filter("score between 0 and 1").count() == 503
    assert toxicity.score(frame(spark, []), labels).count() == 0


def test_toxicity_grammar():
    s = toxicity.Scorer({"scum": 1.0, "trash*": 0.8})
    plain, negated, reported, aimed = (s.evidence(t)[0] for t in ("one scum here", "it is not scum", "someone said scum", "you are scum"))
    assert negated < plain and reported < plain < aimed and s.evidence("trashy. fine. scum!")[1] == 2 and s.evidence("") == (0.0, 0)


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t, _ in rows():
        r, want = found[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in found.items() if r["kept"]}


def test_quality_fit(spark):
    """The fold against the same rounds in Python."""
    from math import exp, log

    patterns = [(2 * 3**7 + 3**6, 90), (3**7 + 1, 20), (0, 7), (5, 3)]
    votes = lambda p: [p // 3 ** (7 - j) % 3 for j in range(8)]
    prior, w = 0.0, [[-4.0, 0.0, 0.5] for _ in range(8)]
    judge = lambda: {p: 1 / (1 + exp(-(prior + sum(w[j][v] for j, v in enumerate(votes(p)))))) for p, _ in patterns}
    for _ in range(quality.ROUNDS):
        q = judge()
        good, bad = (1 + sum(n * x for n, x in ((n, f(q[p])) for p, n in patterns)) for f in (lambda x: x, lambda x: 1 - x))
        share = lambda j, v, f, of: log((1 + sum(n * f(q[p]) for p, n in patterns if votes(p)[j] == v)) / (of + 2))
        w = [[min(share(j, 0, lambda x: x, good) - share(j, 0, lambda x: 1 - x, bad), 0), 0.0, max(share(j, 2, lambda x: x, good) - share(j, 2, lambda x: 1 - x, bad), 0)] for j in range(8)]
        prior = log(good / bad)
    got = {r["pattern"]: r["posterior"] for r in quality.fit(spark.createDataFrame(patterns, "pattern int, n long")).collect()}
    assert got == pytest.approx(judge())


def brute_url(url, rules):
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0] if url and "://" in url else ""
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
    top = max(fits, default=(0, None, None))
    return host, slash + path, top[1], top[2] or "allow"


def test_urls(spark):
    from labelscan.llm.queries import URL_RULES

    rules = [*URL_RULES, ("a.example.net", "/en/x", "block"), ("xample.net", "/", "block")]
    hosts = ["net", "example.net", "EXAMPLE.net", "a.example.net", "b.a.example.net", "xample.net", "yexample.net", "example.com", "w.example.com", "org", "q.org", "example.net:80", "ü.net", ".net", "", "a..net"]
    paths = ["", "/", "/en/", "/en/x/y", "/en", "/de/1", "/fr/a?b=/en/", "?x=/", "#/", "/EN/", "/fr/#x"]
    data = [(k, f"https://{h}{p}") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(900, None), (901, ""), (902, "no scheme/"), (903, "a://b://c/net/"), (903, "a://b://c/net/")]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in data], "page_id long, url string, html string, part int")
    for n in (1, 7):
        found = urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), partitions=n).collect()
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found) == sorted((i, *(x or "" for x in brute_url(u, rules))) for i, u in data)
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def grams(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(words)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(data, n, percent):
    sets = {i: grams(t, n) for i, t, *_ in data}
    name = {i: i for i in sets}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                name[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, empty, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, n=n, percent=percent).collect()}
    assert got == brute_components(rows(), n, percent)
    assert jaccard.join(empty, n=n, percent=percent).count() == 0


def test_jaccard_family(spark):
    """A family of near-copies whose members link only in chains, and copies of each."""
    import random

    rnd = random.Random(1)
    base = [f"w{k}" for k in range(70)]
    data = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randrange(5)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(1000)}"
        data += [(2 * i, " ".join(own), "a")] + [(2 * i + 1, " ".join(own), "a")] * (i % 5 == 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, data)).collect()}
    assert got == brute_components(data, 3, 90)
    kept = jaccard.drop_near_copies(frame(spark, data), n=3, percent=90)
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_jaccard_rows_that_repeat_an_identifier(spark):
    """Rows of one identifier are one node, so what links with either text is one component."""
    w, v = (" ".join(f"{c}{k}" for k in range(60)) for c in "wv")
    data = [(1, w, "a"), (2, v, "a"), (2, f"{w} x", "a"), (3, f"{v} y", "a"), (3, f"{v} y", "a"), (None, w, "b"), (None, "q r s t", "b"), (9, f"{w} x", None)]
    found = jaccard.join(frame(spark, data)).collect()
    assert len(found) == len(data) and {r["doc_id"]: r["component_id"] for r in found if r["doc_id"]} == {1: 1, 2: 1, 3: 1, 9: 1}
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == ["1", "None"]


def test_jaccard_links(spark):
    """Every link between classes, and each document's number of them, against all pairs."""
    import random

    rnd = random.Random(5)
    base = [f"w{k}" for k in range(250)]
    data = [*rows()]
    for i in range(80):
        own = list(base)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(1000)}"
        data.append((5000 + i, " ".join(own), "a"))
    sets = defaultdict(list)
    for i, t, _ in data:
        sets[frozenset(grams(t, 3))].append(i)
    name = {min(ids): s for s, ids in sets.items() if s}
    want = {(a, b) for a in name for b in name if a < b and 100 * len(name[a] & name[b]) >= 90 * len(name[a] | name[b])}
    members, pairs = jaccard.links(frame(spark, data))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and len(want) > 200
    count = Counter(x for p in want for x in p)
    for r in members.collect():
        own = next(ids for s, ids in sets.items() if r["doc_id"] in ids)
        assert r["n_links"] == count[min(own)]


def test_components_of_a_long_chain(spark):
    import random

    from labelscan.llm.common import Scratch

    nodes = list(range(400))
    random.Random(2).shuffle(nodes)
    links = spark.createDataFrame([*zip(nodes, nodes[1:]), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(links, Scratch(spark, "chain"), "chain").collect()}
    assert got == {**dict.fromkeys(nodes, 0), 1000: 1000, 1001: 1000}


def test_mixing(spark, docs, empty):
    parts, pieces = mixing.mix(docs, block=64, shards=5)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs, block=64, shards=5)[0].collect()}
    assert again != {(r["doc_id"], r["taken"]) for r in mixing.mix(docs, block=64, shards=5, seed=8)[0].collect()}
    found, drawn = parts.collect(), pieces.collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows()}
    sources = defaultdict(int)
    for i, _, s in rows():
        sources[s] += sizes[i]
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sources[s]}
        for s in over or free:
            target[s] = 3.0 * sources[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for r in found:
        s = next(s for i, _, s in rows() if i == r["doc_id"])
        taken[s] += r["taken"]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == sources[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(target[s]) and (r["doc_id"], r["taken"]) in again
    assert len(found) == len(rows()) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    seen = Counter()
    for r in drawn:
        seen[r["doc_id"]] += r["length"]
        assert 0 <= r["start"] and r["start"] + r["length"] <= sizes[r["doc_id"]] and 0 <= r["shard"] < 5
    assert all(seen[r["doc_id"]] == r["taken"] for r in found)
    per = Counter(r["shard"] for r in pieces.select("shard", "block_order").distinct().collect())
    assert len(per) == 5 and max(per.values()) - min(per.values()) <= 2
    assert mixing.mix(empty)[0].count() == 0
    out = mixing.mixed(docs)
    words = Counter()
    for r in out.select("doc_id", "text").collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert out.columns == docs.columns and sum(words.values()) == sum(taken.values())


def test_mixed_follows_the_drawn_order(spark):
    """On a corpus laid out by source, rows come in the order of the pieces, so sources alternate."""
    data = [(k, " ".join(f"{'abc'[k // 40]}{k}w{j}" for j in range(10)), "abc"[k // 40]) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(1)
    texts = {i: t.split() for i, t, _ in data}
    pieces = mixing.mix(df, block=40, shards=4)[1].collect()
    want = [" ".join(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in sorted(pieces, key=lambda r: (r["shard"], r["block_order"], r["u"]))]
    got = mixing.mixed(df, block=40, shards=4).collect()
    assert [r["text"] for r in got] == want
    assert sum(x["source"] != y["source"] for x, y in zip(got, got[1:])) > 10


def test_split_tree_draws_hypergeometrically(spark):
    """Each block lies in either half equally often; halves have exact sizes."""
    from labelscan.llm.common import Scratch

    blocks = spark.range(40).select((F.col("id") % 4).alias("src"), F.col("id").alias("block"))
    left = Counter()
    for seed in range(12):
        got = mixing.split_tree(blocks, 40, 2, seed, Scratch(spark, "tree")).collect()
        assert Counter(r["shard"] for r in got) == {0: 20, 1: 20}
        left.update(r["src"] for r in got if r["shard"] == 0)
    assert all(abs(n - 60) <= 22 for n in left.values())


def brute_repeats(data, length=50):
    first = {}
    texts = sorted((i, (t or "").encode()) for i, t, *_ in data)
    for i, b in texts:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    return out


def test_suffix(spark, docs, empty):
    for memory in (suffix.MEMORY, 1 << 10):  # the second puts queues and arrays on disk
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.repeats(docs, memory=memory).collect()}
        assert got == brute_repeats(rows())
    assert suffix.repeats(empty).count() == 0


def test_suffix_rows_that_repeat_an_identifier(spark):
    """Rows of one identifier, equal or not, are cut each for itself; equal rows and a null identifier keep their places."""
    a, b, c = ("".join(f"{x}{k}-" for k in range(40)) for x in "abc")
    data = [(1, a, "s"), (2, b, "s"), (5, f"{a}x{c}", "s"), (5, f"y{b}", "s"), (5, f"y{b}", "s"), (2, a, "s"), (None, a, "s")]
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix.repeats(frame(spark, data)).collect())
    n = len(a)
    assert found == sorted([("1", n, 0), ("2", n, 0), ("5", 2 * n + 1, n), ("5", n + 1, n), ("5", n + 1, n), ("2", n, n), ("None", n, 0)])


def test_suffix_memory_stays_below_the_shard():
    """A shard of 12 MB with 1 MB of memory: arrays and queues are files, so what is allocated stays far below the in-memory form."""
    import tempfile
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 105, 12_000_000, np.uint8)
    text[::80] = 0
    text[-1] = 0
    ends = np.flatnonzero(text == 0)
    peaks = {}
    for memory in (1 << 20, 1 << 30):
        tracemalloc.start()
        with tempfile.TemporaryDirectory() as folder:
            for _ in suffix.least_documents(text, ends, np.arange(len(ends)), folder, 50, memory):
                pass
        peaks[memory] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peaks[1 << 20] < 0.7 * peaks[1 << 30]


def test_suffix_order():
    """The sorted suffixes and their common prefixes, in memory and from disk."""
    import random
    import tempfile

    import numpy as np

    rnd = random.Random(2)
    for t in range(120):
        length, letters = rnd.choice([3, 8, 50]), rnd.choice([1, 2, 3, 26])
        pieces = [bytes(rnd.randrange(letters) + 97 for _ in range(rnd.randrange(length, length + 30))) for _ in range(rnd.choice([1, 2, 5, 30]))]
        raw = b"\0".join(pieces) + b"\0"
        with tempfile.TemporaryDirectory() as folder:
            waves = list(suffix.Inducer(np.frombuffer(raw, np.uint8), folder, length, rnd.choice([64, 1 << 27])).suffixes())
        out = [(int(p), int(c)) for pos, lcp in waves for p, c in zip(pos, lcp)]
        assert sorted(p for p, _ in out) == list(range(len(raw)))
        for (p, _), (q, common) in zip(out, out[1:]):
            x, y = raw[p : p + length], raw[q : q + length]
            shared = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            assert x >= y and common == shared


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(s):
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(s))]
        return sum(x - 9 * (x > 9) for x in twice) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_pii_base():
    import random

    rnd = random.Random(4)
    parts = ["a@b.c", "%d@e.f", "x.y-z@q.w.e.", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 010-9999", "+", "@", "é", "  ", "00001", "a@b", "@c.d", ".", "-", "9" * 15, "word"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(12)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("7" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_pii(spark, docs, empty):
    plain = [(i, f"ordinary words number {i} of the usual text", "s") for i in range(60)]
    told = [(100 + k, f"{'lorem ' * k}the secret falconer wrote from jo@mail.example about the text {k}", "s") for k in range(4)]
    copies = [(200 + k, "only copies mention zanzibar near al@mail.example here", "s") for k in range(5)]
    data = [*plain, *told, *copies, (300, None, "s"), (300, None, "s"), (None, "x@y.z", "s")]
    found = pii.find(frame(spark, data)).collect()
    assert len(found) == len(data)
    texts = dict((i, t) for i, t, _ in data)
    added = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]} for r in found}
    assert all("falconer" in added[100 + k] and "the" not in added[100 + k] for k in range(4))
    assert not any(added[200 + k] for k in range(5)) and not any(added[i] for i, _, _ in plain)
    for r in found:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == brute_spans(texts[r["doc_id"]] or "")
    assert pii.find(docs).count() == len(rows()) and pii.find(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, [*plain, *told])).collect()}
    assert all("[EMAIL]" in clean[i] and "falconer" not in clean[i] and "jo@" not in clean[i] for i, _, _ in told) and all(clean[i] == t for i, t, _ in plain)


def test_pii_marks_every_occurrence(spark):
    """A revealing term is marked far from the entity, and in documents without it, but not inside base spans."""
    plain = [(i, f"ordinary words number {i} of the usual text", "s") for i in range(60)]
    told = [(100 + k, f"{'lorem ' * k}the secret falconer wrote from jo@mail.example about {'long talk ' * 40} Falconer {k}", "s") for k in range(4)]
    data = [*plain, *told, (200, "who is the FALCONER, not falconer@mail.example", "s")]
    texts = dict((i, t) for i, t, _ in data)
    found = pii.find(frame(spark, data)).collect()
    marked = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in found}
    assert all([w.lower() for w in marked[100 + k]].count("falconer") == 2 for k in range(4))
    assert marked[200] == ["FALCONER"] and not any(marked[i] for i, _, _ in plain)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, data)).collect()}
    assert not any("falconer" in clean[i].lower() for i, _, _ in data)


def test_pii_counts_all_terms_of_a_document(spark):
    """Names many words before the entity, short ones, identifiers and names in scripts without spaces."""
    plain = [(i, f"ordinary words number {i} of the usual text", "s") for i in range(60)]
    told = [(100 + k, f"Re: Bo falconer, account K9X0, 請田中実聞\n{'of the usual text ' * 50}{'number ' * k} jo@mail.example", "s") for k in range(4)]
    copies = [(200 + k, "Re: only zanzibar \n" + "of the usual text " * 50 + " al@mail.example", "s") for k in range(5)]
    data = [*plain, *told, *copies]
    texts = dict((i, t) for i, t, _ in data)
    found = pii.find(frame(spark, data)).collect()
    marked = {r["doc_id"]: {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]} for r in found}
    assert all({"Bo", "falconer", "K9X0", "請田", "田中", "中実", "実聞"} <= marked[100 + k] and "the" not in marked[100 + k] for k in range(4))
    assert not any(marked[i] for i, _, _ in [*plain, *copies])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, data)).collect()}
    assert not any(w in clean[i] for i, _, _ in told for w in ("Bo", "falconer", "K9X0", "請", "田", "中", "実", "聞")) and all(clean[i] == t for i, t, _ in plain)


def test_sharding(spark, docs, empty):
    data = [*rows(), *((5000 + k, "copied text", "a") for k in range(300))]
    found = sharding.shard(frame(spark, data)).collect()
    texts = {i: (t or "").encode() for i, t, _ in data}
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[texts[r["doc_id"]]].add(r["shard"])
    biggest = max(r["size"] for r in found)
    assert len(found) == len(data) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads[s] for s in range(8)) - min(loads[s] for s in range(8)) <= 2 * biggest
    assert sum(len(s) > 1 for s in groups.values()) <= 8
    assert sharding.shard(docs).count() == len(rows()) and sharding.shard(empty).count() == 0


def brute_taken(data, block=None, seed=mixing.SEED):
    """doc_id -> words that the mix takes, from (doc_id, text, source), in plain Python."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in data}
    per = defaultdict(int)
    for i, _, s in data:
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(per.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * per[s]}
        for s in over or free:
            target[s] = 3.0 * per[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    block = block or min(mixing.MOST_BLOCK, max(mixing.LEAST_BLOCK, sum(per.values()) // mixing.BLOCKS))
    md5 = lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()
    taken = Counter()
    for src, s in enumerate(order, 1):
        line = [i for i, _ in sorted(((i, md5(i)) for i, _, z in data if z == s), key=lambda x: (x[1], x[0])) for _ in range(size[i])] * 3
        left = int(target[s] + 0.5)
        for k in sorted(range(-(-len(line) // block)), key=lambda k: (md5(f"{src}:{k}"), k)):
            drawn = line[k * block : (k + 1) * block][: max(left, 0)]
            taken.update(drawn)
            left -= len(drawn)
    return taken


def test_mixing_against_brute_force(spark, docs):
    for block in (None, 40):
        got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=block)[0].collect()}
        want = brute_taken(rows(), block)
        assert got == {i: want[i] for i, _, _ in rows()}


def test_pipeline(spark, tmp_path):
    """Every stage against brute force, and run() against the stages: who stays, words that are mixed, ids that are packed."""
    import corpus_pipeline

    public = pytest.importorskip("public_tokenizers")
    data = [(i, t, "en", s, len(t or "")) for i, t, s in rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("full", data), ("none", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
    good = {r["doc_id"] for r in quality.judge(frame(spark)).filter("kept").collect()}
    groups = defaultdict(list)
    for i, t, *_ in data:
        if i in good:
            groups[t].append(i)
    once = [(i, t, s) for i, t, _, s, _ in data if i in good and i == max(groups[t])]
    single = {c for _, c in brute_components(once, 5, 80).values()}
    kept = [x for x in once if x[0] in single]
    mixed = mixing.mixed(frame(spark, kept)).collect()
    words, taken = Counter(), brute_taken(kept)
    for r in mixed:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == +taken and len(single) > 20
    encode = packing.byte_bpe(public.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in mixed:
        ids[r["doc_id"]].append(len(encode(r["text"])) + 1)
    packed = defaultdict(Counter)
    for r in out:
        assert r["offset"] + r["length"] <= packing.WINDOW
        packed[r["doc_id"]][r["doc_tokens"]] += r["length"]
    assert set(packed) == set(ids) and all(packed[i][n] == n * c for i, own in ids.items() for n, c in Counter(own).items())


def test_clashing_columns_and_repeated_rows(spark, docs):
    """Columns named as inner ones don't get in the way, and equal rows are rows of their own."""
    for c in ("_locator", "_id", "_key", "_row", "_text", "_kept_at", "base", "added"):
        docs = docs.withColumn(c, F.lit(None).cast("string"))
    assert exact_dedup.drop_copies(docs).columns == docs.columns and pii.sanitised(docs).columns == docs.columns == mixing.mixed(docs).columns
    twice = [(1, "a b c " * 30, "s")] * 3 + [(2, None, None)] * 2 + [(3, "x " * 70, "s")]
    df = frame(spark, twice)
    assert exact_dedup.drop_copies(df).count() == 3 and quality.judge(df).count() == sharding.shard(df).count() == pii.find(df).count() == len(twice)
    assert mixing.mix(df)[0].count() == len(twice) and sum(r["taken"] for r in mixing.mix(df)[0].collect()) == sum(len(r["text"].split()) for r in mixing.mixed(df).collect())
    assert pii.sanitised(df).count() == len(twice)


def test_pii_shapes(spark):
    """Values that are written once are found by their key, which keeps company with personal data; ordinary words are left alone."""
    import random

    rnd = random.Random(9)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    plain = [(i, f"ordinary words number {i} of the usual text {rnd.randrange(99)}", "s") for i in range(300)]
    told = [(1000 + i, f"some text {i} token = \"{key()}\" and {'write jo%d@mail.example' % i if i % 2 else 'no more'}", "s") for i in range(30)]
    texts = dict((i, t) for i, t, _ in plain + told)
    added = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["added"]] for r in pii.find(frame(spark, plain + told)).collect()}
    assert all(any(len(w) == 40 for w in added[i]) for i, _, _ in told) and not any(added[i] for i, _, _ in plain)


def brute_disclosures(data, support=pii.SUPPORT, class_support=pii.CLASS_SUPPORT):
    """term -> (disclosure, route), by counting in plain sets."""
    from math import log, sqrt

    docs, held, by_class, texts_of, docs_of, near = [], defaultdict(set), defaultdict(set), defaultdict(set), Counter(), defaultdict(set)
    for i, (_, text, _) in enumerate(data):
        text = text or ""
        spans = brute_spans(text)
        own = {f"{pii.KINDS[k]}:{text[s:e]}" for s, k, e in spans}
        covered = {p for s, _, e in spans for p in range(s, e)}
        words = {m[0].lower() for m in re.finditer(r"\w+", text) if covered.isdisjoint(range(*m.span()))}
        words |= {m[1].lower() + " =" for m in re.finditer(r"([^\W\d]\w*)[\"']? *[=:] *[\"']?([^\s\"',;]+)", text) if covered.isdisjoint(range(*m.span(2)))}
        context = text if own else i
        docs.append(context)
        for c in own:
            held[c].add(context)
        for c in {c.split(":")[0] for c in own} | ({"all"} if own else set()):
            by_class[c].add(context)
        for w in words:
            texts_of[w].add(context)
            docs_of[w] += 1
            if own:
                near[w].add(min(pii.digest(c) for c in own))
    total, out = len(set(docs)), {}

    def disclosure(both, n_t, n_c):
        p, z = both / n_t, pii.DEVIATIONS
        p = (p + z * z / (2 * n_t) - z * sqrt(p * (1 - p) / n_t + z * z / (4 * n_t * n_t))) / (1 + z * z / n_t)
        return log(p * total / n_c) / log(total / n_c) if p >= pii.LEAST and n_c < total else 0

    for w, own in texts_of.items():
        found = [(disclosure(len(own & cs), docs_of[w], len(cs)), "entity") for cs in held.values() if len(own & cs) >= support]
        if len(near[w]) >= class_support:
            found += [(disclosure(len(own & cs), len(own), len(cs)), "class") for cs in by_class.values() if own & cs]
        if found and max(found)[0] >= pii.THRESHOLD:
            out[w] = max(found)
    return out


def test_pii_disclosures_against_brute_force(spark):
    """Both routes, keys, copies and near copies: every term's disclosure, and every occurrence that is marked."""
    import random

    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    data = []
    for i in range(500):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 15)))
        if i % 9 == 0:
            text += f" badge: 'B{i}' mail p{i % 45}@mail.example of rarity{i % 45}"
        elif i % 17 == 0:
            text += f" badge = C{i} host 10.0.{i % 200}.7 noted"
        data.append((i, text, "s"))
    data += [(600 + k, data[9][1], "s") for k in range(7)] + [(700 + k, data[18][1] + f" near {k}", "s") for k in range(9)] + [(800, None, "s")]
    want = brute_disclosures(data)
    assert {r for _, r in want.values()} == {"entity", "class"} and want["badge ="][1] == "class" and want["near"][1] == "entity"
    texts = {i: t or "" for i, t, _ in data}
    found = pii.find(frame(spark, data)).collect()
    got = {}
    for r in found:
        text = texts[r["doc_id"]]
        values = {(s, e): k for k, s, e in pii.assigned(text, [(b["start"], b["kind"], b["end"]) for b in r["base"]])}
        marked = {(s["start"], s["end"], s["disclosure"], s["route"]) for s in r["added"]}
        for s, e, d, route in marked:
            names = [n for n in (text[s:e].lower(), values.get((s, e))) if n in want and want[n] == (pytest.approx(d), route)]
            assert names, (text[s:e], d, route)
            got.update(dict.fromkeys(names, d))
        covered = {p for b in r["base"] for p in range(b["start"], b["end"])}
        due = {m.span() for m in re.finditer(r"\w+", text) if m[0].lower() in want and covered.isdisjoint(range(*m.span()))} | {x for x, k in values.items() if k in want}
        assert due == {(s, e) for s, e, _, _ in marked}
    assert set(got) == set(want)
    near = "".join(f"a{k}: x " for k in range(20_000))
    assert len(list(pii.assigned(near, []))) == 20_000 and not list(pii.assigned("=:" * 50_000, [])) and len(list(pii.assigned("a=" * 50_000, []))) == 1


def test_toxicity_product_automaton():
    """The composed grammar against its five machines run side by side."""
    import random

    rnd = random.Random(1)
    for _ in range(300):
        states, at = dict.fromkeys(toxicity.MACHINES, 0), 0
        for c in (rnd.randrange(6) for _ in range(12)):
            want = 1.0
            for name, m in toxicity.MACHINES.items():
                states[name], factor = m.get((states[name], c), (states[name], 1.0))
                want *= factor
            at, got = toxicity.GRAMMAR[at, c]
            assert got == pytest.approx(want)


def test_packing_gives_the_ids_of_added_tokens():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    fast, exact = packing.byte_bpe(path, public.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(path)
    for t in ["a<|endoftext|>b", "plain words, and more", "<|endoftext|>", "é\u00a0 日本  x"]:
        assert fast(t) == exact.encode(t, add_special_tokens=False).ids
