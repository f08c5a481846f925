"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the classes of a clause's words: *insult* and *threat* give the weight of a hit, *target* raises
it when someone is addressed, *negation* lowers it for the next words and *reported speech* for the rest of the clause.
They are composed into one automaton (the product of their states, weights multiplied), which is run over each clause that
holds an insult or a threat; a document's evidence is the sum over its matched clauses.

The insult lexicon is learned from labels: words and word beginnings that occur in enough toxic documents and hardly in others.
Evidence becomes a score by a logistic curve fitted to the same rows.  Both use a bounded sample of labelled rows
(``SAMPLE``, lowest hashes of the identifier); scoring covers every whole text.

Edge cases: null and empty texts have no evidence and get the score of none; a null identifier counts as held out;
labels that contradict each other count as toxic; without labels in both classes only the threat list scores; repeated rows
score alike; a text of any length is read whole, clause by clause; other columns are not looked at, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Most labelled rows that the lexicon and the curve are fitted on (which bounds the lexicon too).
SAMPLE = 10_000
#: Lengths of word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6)
#: An entry needs this share of the toxic documents, and may have this share of the others and this many for each toxic one.
#: ``PURE`` was chosen by four-fold cross-validation on labels that aren't held out; impure entries weigh less by their odds.
SUPPORT, STRAY, PURE = 0.01, 0.002, 0.4

THREAT = frozenset("kill murder hurt destroy burn hang shoot stab beat töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())
TARGET = frozenset("you your yours u he she they them him her his their people du dich dein ihr euch sie tu toi vous ton votre il elle tú usted vosotros ellos su".split())
NEGATION = frozenset("not no never nobody isn't aren't don't nicht kein keine nie niemals pas jamais ne non nunca jamás nadie".split())
REPORT = frozenset("said says say quoted wrote claims claimed reported allegedly sagte schrieb zitierte behauptete dit écrit cité affirmé dijo escribió citó afirma".split())
CLAUSES = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"\w+(?:'\w+)?")

OTHER, INSULT, THREATS, TARGETS, NEGATED, REPORTED = range(6)

#: Each transducer: (state, class) -> (next state, factor); missing arcs stay with factor 1.
HITS = (INSULT, THREATS)
MACHINES = {
    "insult": {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.1)},
    "threat": {(0, TARGETS): (1, 1.0), (0, THREATS): (0, 0.5), (1, THREATS): (1, 1.5)},
    "target": {(0, TARGETS): (1, 1.0), (1, INSULT): (1, 1.25)},
    "negation": {(0, NEGATED): (3, 1.0), **{(k, c): (k - 1, 0.4 if c in HITS else 1.0) for k in (1, 2, 3) for c in range(6) if c != NEGATED}, **{(k, NEGATED): (0, 1.0) for k in (1, 2, 3)}},
    "report": {(0, REPORTED): (1, 1.0), **{(1, c): (1, 0.6) for c in HITS}},
}


def compose(*machines: dict) -> dict:
    """The product automaton, reachable states only, numbered from 0: (state, class) -> (state, factor)."""
    start = (0,) * len(machines)
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        at = todo.pop()
        for c in range(6):
            steps = [m.get((s, c), (s, 1.0)) for m, s in zip(machines, at)]
            to, factor = tuple(s for s, _ in steps), 1.0
            for _, f in steps:
                factor *= f
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[at], c] = (number[to], factor)
    return arcs


GRAMMAR = compose(*MACHINES.values())


class Scorer:
    def __init__(self, lexicon: dict[str, float], threats: frozenset[str] = THREAT):
        self.threats = threats
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.starts = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.lengths = sorted({len(k) for k in self.starts}, reverse=True)

    def classify(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            weight = max(weight, self.starts.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        if word in self.threats:
            return THREATS, 1.0
        return (TARGETS if word in TARGET else NEGATED if word in NEGATION else REPORTED if word in REPORT else OTHER), 0.0

    def evidence(self, text: str) -> tuple[float, int]:
        """Sum over the clauses, and how many clauses matched."""
        lower = text.lower()
        words, lengths, starts = self.words, self.lengths, self.starts
        hot = {w for w in set(WORD.findall(lower)) if w in words or w in self.threats or any(w[:n] in starts for n in lengths)}
        total, matched = 0.0, 0
        if not hot:
            return total, matched
        for clause in CLAUSES.split(lower):
            tokens = WORD.findall(clause)
            if hot.isdisjoint(tokens):
                continue
            state, score = 0, 0.0
            for word in tokens:
                c, weight = self.classify(word)
                state, factor = GRAMMAR[state, c]
                score += weight * factor
            total += score
            matched += score > 0
        return total, matched


def features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, scratch: Scratch) -> tuple[Scorer, tuple[float, float]]:
    """(scorer, (intercept, slope)) from at most ``sample`` labelled rows that aren't held out."""
    toxic = labels.filter("toxic is not null").select(F.col(id_col).alias("doc_id"), "toxic").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    rows = scratch.save(rows.dropDuplicates(["text", "toxic"]).select("text", "toxic"), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["toxic"]):
                seen[int(label > 0)].update(features(text))
        terms = sorted(seen[1])
        yield pd.DataFrame({"term": terms, "pos": [seen[1][t] for t in terms], "neg": [seen[0][t] for t in terms]})
        terms = sorted(seen[0].keys() - seen[1].keys())
        yield pd.DataFrame({"term": terms, "pos": 0, "neg": [seen[0][t] for t in terms]})

    n = {bool(r["t"]): r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    npos, nneg = n.get(True, 0), n.get(False, 0)
    if not npos or not nneg:
        return Scorer({}), (-3.0, 2.0)
    terms = rows.mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    terms = scratch.save(terms.filter((F.col("pos") >= 3) | F.col("term").isin(sorted(THREAT))), "terms")
    good = terms.filter((F.col("pos") >= max(5, SUPPORT * npos)) & (F.col("neg") <= F.least(F.lit(STRAY * nneg), PURE * F.col("pos"))))
    best = good.collect()  # words of at most ``sample`` rows
    odds = {r["term"]: log((r["pos"] + 0.5) / (npos + 1)) - log((r["neg"] + 0.5) / (nneg + 1)) for r in best}
    lexicon = {t: min(w / 4, 1.0) for t, w in odds.items() if w > 2}
    # a threat that other documents use as an ordinary word is none here
    plain = terms.filter(F.col("term").isin(sorted(THREAT)) & (F.col("neg") > STRAY * nneg)).select("term").collect()
    scorer = Scorer(lexicon, THREAT - {r["term"] for r in plain})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [log(1 + scorer.evidence(t)[0]) for t in pdf["text"]], "y": (pdf["toxic"] > 0).astype("int64")})

    points = [(r["x"], r["y"]) for r in rows.mapInPandas(weigh, "x double, y long").collect()]  # at most ``sample``
    return scorer, curve(points)


def curve(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's steps, lightly regularised."""
    a, b = 0.0, 1.0
    grouped = Counter((round(x, 4), y) for x, y in sorted(points))
    for _ in range(40):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for (x, y), n in grouped.items():
            p = 1 / (1 + exp(-max(-30.0, min(30.0, a + b * x))))
            ga, gb = ga + n * (y - p), gb + n * (y - p) * x
            v = n * p * (1 - p)
            haa, hab, hbb = haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 4.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return a, max(b, 0.1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, clauses`` of every row."""
    scorer, (a, b) = learn(docs, labels, id_col, text_col, sample, Scratch(docs.sparkSession, "toxicity"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [scorer.evidence(t or "") for t in pdf["text"]]
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, a + b * log(1 + x))))) for x, _ in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "evidence": [x for x, _ in found], "clauses": [n for _, n in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, score double, evidence double, clauses long")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "clauses")
