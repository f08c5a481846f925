"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one property of a whole text and votes good (1), bad (-1) or abstains (0).  Documents with the
same votes are counted together, so the model sees at most 3^rules patterns, however large the corpus is.
Expectation-maximisation then runs as one fold over the pattern table: from the posterior of each
pattern (at first from fixed weights) it estimates how likely each rule votes which way on good and on bad
documents and how frequent good ones are, and from these the posteriors again.  A document is kept if its
posterior probability of being good is at least one half and it doesn't fail the base tests.

Everything is made of DataFrame functions; a document's work stays in its row, no words are shuffled.

Edge cases: a null text has no words and fails the base tests, as an empty one; repeated rows are judged each for
itself; equal votes have equal posteriors; a long text's windows are an array of its row; an empty table gives an empty result; columns
other than identifier and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words

#: Rules on junk vote bad from a bound on and abstain below it; some vote good too.
RULES = {
    "symbols": lambda c: _vote(c["n_symbols"] / c["w"], bad=0.1),
    "dup_lines": lambda c: _vote(F.when(c["n_dup_lines"] > 1, c["n_dup_lines"] / c["lines"]).otherwise(0.0), bad=0.3),
    "repetition": lambda c: _vote(c["n_repeat_words"] / c["w"], bad=0.3),
    "shouting": lambda c: _vote(c["n_upper"] / F.greatest(c["word_chars"], F.lit(1)), bad=0.3),
    "marks": lambda c: _vote(c["n_marks"] / c["w"], bad=0.15),
    "letters": lambda c: _vote(1 - c["n_letters"] / F.greatest(c["word_chars"], F.lit(1)), bad=0.3, good=0.12),
    "variety": lambda c: _vote(1 - c["n_distinct"] / F.pow(c["w"], F.lit(0.75)), bad=0.85),
    "length": lambda c: F.when(c["n_words"] < 50, -1).when(c["n_words"] >= 60, 1).otherwise(0),
}
ROUNDS = 20


def _vote(value: Column, bad: float, good: float = -1.0) -> Column:
    return F.when(value >= bad, -1).when(value <= good, 1).otherwise(0)


def properties(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and those that only rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_w", words(F.col(text_col))).withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn(
        "_k",
        F.when(F.col("n_words") < 3, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 3, F.lit(0)).cast("int")), lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
        ),
    ).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    twice = F.size(F.array_distinct("_k")) < F.size("_k")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(F.array().cast("array<struct<k:string,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("_s", j).getField("k") == x["k"], F.lit(False))
    repeated = F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.size("_s") == 0, 0).otherwise(F.size(covered)).cast("long"),
            "lines": F.greatest(F.size("_lines"), F.lit(1)),
            "n_distinct": F.size(F.array_distinct("_w")),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
            "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
            "n_marks": F.regexp_count(text, F.lit(r"[!?|]")),
        }
    )
    return df.drop("_w", "_k", "_s", "_lines")


def votes(props: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``pattern``: a base-3 number of all votes."""
    c = {n: F.col(n) for n in props.columns} | {"w": F.greatest(F.col("n_words"), F.lit(1)).cast("double")}
    code = F.lit(0)
    for rule in RULES.values():
        code = code * 3 + rule(c) + 1
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return props.withColumn("pattern", code.cast("int")).withColumn("base_failed", failed)


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, posterior`` from ``pattern, n``.

    All patterns, 3^rules at most, fit one row; the rounds run in it as one fold, whose state is the log odds of
    a good document (``prior``) and what each vote of each rule adds to them (``w``).  Shares are smoothed by one document;
    a good vote never counts against a document nor a bad one for it, and to abstain says nothing.
    """
    r = len(RULES)
    votes = ", ".join(f"cast({3 * j} + floor(pattern / {3 ** (r - 1 - j)}) % 3 as int)" for j in range(r))
    one = patterns.select(F.expr(f"struct(pattern, cast(n as double) as n, array({votes}) as c)").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    judged = "transform(ps, p -> struct(p.pattern as pattern, p.n as n, p.c as c, 1 / (1 + exp(-(s.prior + aggregate(p.c, 0D, (a, k) -> a + s.w[k])))) as q))"
    start = "named_struct('prior', 0D, 'w', transform(sequence(0, %d), k -> element_at(array(-4D, 0D, 0.5D), k %% 3 + 1)))" % (3 * r - 1)
    sums = "named_struct('good', aggregate(x, 1D, (a, y) -> a + y.n * y.q), 'bad', aggregate(x, 1D, (a, y) -> a + y.n * (1 - y.q)))"
    share = "ln(aggregate(x, 1D, (a, y) -> a + if(array_contains(y.c, k), y.n * {q}, 0D)) / ({of} + 2))"
    weight = f"({share.format(q='y.q', of='m.good')} - {share.format(q='(1 - y.q)', of='m.bad')})"
    clip = f"transform(array({weight}), d -> case k % 3 when 0 then least(d, 0D) when 2 then greatest(d, 0D) else 0D end)[0]"
    renewed = f"transform(array({sums}), m -> named_struct('prior', ln(m.good / m.bad), 'w', transform(sequence(0, {3 * r - 1}), k -> {clip})))[0]"
    step = f"transform(array({judged}), x -> {renewed})[0]"
    fold = f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})"
    out = one.select("ps", F.expr(fold).alias("s")).select(F.explode(F.expr(judged)).alias("p"))
    return out.select("p.pattern", F.col("p.q").alias("posterior"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Counts, ``base_failed``, ``posterior`` and ``kept`` of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    judged = scratch.save(votes(properties(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))).drop("text"), "votes")
    model = scratch.save(fit(judged.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), rounds), "model")
    out = judged.join(F.broadcast(model), "pattern")  # at most 3^8 = 6561 rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; texts are judged once, where they lie, and not shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    names = docs.columns
    mine = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    seen = votes(properties(mine)).select("pattern", "base_failed", F.when(~F.col("base_failed"), F.col("_row")).alias("_row"))
    seen = scratch.save(seen, "votes")
    model = scratch.save(fit(seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))), "model")
    good = seen.join(F.broadcast(model), "pattern").filter(~F.col("base_failed") & (F.col("posterior") >= 0.5))  # at most 3^8 rows
    return good.select(*[F.col("_row").getField(n).alias(n) for n in names])
