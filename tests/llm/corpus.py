"""Small corpora of the corpus operators' tests."""

import random

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
CLASHING = "doc_id long, text string, source string, lang string, n_chars long, size int, row int, key string, f int, n int, kept boolean, base string, spans string, label string, part int, u double"


def rows(n: int = 120, seed: int = 3) -> list[tuple]:
    """(doc_id, text, source): copies, near copies, shared passages, nulls, empty and odd texts, one very long."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, texts = prose(40), []
    for k in range(n):
        kind = k % 8
        if kind == 1 and texts:
            texts.append(rnd.choice(texts))
        elif kind == 2 and texts and texts[0]:
            words = (texts[0] or "x").split(" ")
            words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append(f"{prose(rnd.randrange(5, 60))}\n{passage}\n{prose(rnd.randrange(60))}")
        elif kind == 4:
            texts.append(rnd.choice([None, "", " \t\n", "one", "one two", "é\u00a0ß 日本語 𝒳" * 3, "a" * 300, "\0 zero \0 " * 20, f"{prose(30)}\n" * 6, "### $$$ " * 60]))
        else:
            texts.append(prose(rnd.randrange(1, 200)))
    texts[0] = texts[0] or prose(150)
    texts.append(prose(12_000))
    return [(1000 - 3 * k, t, [None, "b", "a", "ü", ""][k % 5] if k % 3 else "hot") for k, t in enumerate(texts)]


def frame(spark, data=None, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows() if data is None else data, schema).repartition(3)


def clashing(spark):
    """The corpus with more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    df = frame(spark)
    for c in CLASHING.split(", "):
        name, kind = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
