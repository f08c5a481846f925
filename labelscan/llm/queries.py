"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, infill, jaccard, minhash, mixing, packing, phrases, pii, quality, sharding, suffix, toxicity, urls
from .common import table

#: Fixed values of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer():
    """The packing query's encoder; the vocabulary files lie where the tokenizers' package says."""
    import public_tokenizers

    return packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].drop("row")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    plain = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.array_sort(F.concat("base", plain))).alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_packing, op3_toxicity, op4_quality_rules, op5_url_filters, op6_ngram_jaccard_join, op7_mixing, op8_suffix_array_dedup, op9_pii, op10_sharding, op11_phrase_collocations, op12_minhash_near_dedup, op13_fill_in_middle)
}



def linked_sql(n: int, percent: int) -> str:
    """Sets of word n-grams, links of all pairs that share one, and the smallest identifier that is reached."""
    return rf"""
        WITH RECURSIVE own AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), grams AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM own WHERE len(w) > 0)
        ), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM grams AS a JOIN grams AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * s >= {percent} * (x.n + y.n - s)),
        reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = other),
        found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN found USING (doc_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": linked_sql(3, 90),
    "op12_minhash_near_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({linked_sql(5, 85)})",
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_url_filters": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut
        ), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
    """,
    "op7_mixing": rf"""
        WITH own AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS perm FROM documents
        ), stats AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM stats),
        weighed AS (SELECT *, (src - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked),
        levels AS (SELECT *, cap::DOUBLE / weight AS level FROM weighed),
        shared AS (
            SELECT *, ((SELECT sum(source_size) FROM stats) - coalesce(sum(cap) OVER (ORDER BY level, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                   / (sum(weight) OVER (ORDER BY level, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM levels
        ), plan AS (
            SELECT source, src, source_size, CASE WHEN level > share
                THEN least((SELECT min_by(share, (level, src)) FROM shared WHERE level > share) * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target FROM shared
        ), line AS (
            SELECT doc_id, size, src, source_size, target,
                   coalesce(sum(size) OVER (PARTITION BY own.source ORDER BY perm, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
            FROM own JOIN plan ON own.source IS NOT DISTINCT FROM plan.source
        ), width AS (SELECT least({mixing.MOST_BLOCK}, greatest({mixing.LEAST_BLOCK}, sum(source_size)::BIGINT // {mixing.BLOCKS}))::BIGINT AS b FROM stats),
        blocks AS (
            SELECT src, b, floor(target + 0.5)::BIGINT AS goal, 3 * source_size AS whole, unnest(range(0, ((3 * source_size + b - 1) // b)::BIGINT)) AS block
            FROM plan, width WHERE floor(target + 0.5) > 0
        ), permuted AS (SELECT *, least(b, whole - block * b)::BIGINT AS len, md5('{mixing.SEED}:' || src || ':' || block) AS perm FROM blocks),
        ranked_blocks AS (
            SELECT *, coalesce(sum(len) OVER (PARTITION BY src ORDER BY perm, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM permuted
        ), drawn AS (SELECT src, block, block * b AS low, block * b + least(len, goal - ahead) AS high FROM ranked_blocks WHERE ahead < goal),
        laid AS (
            SELECT line.*, epoch * source_size + pos AS lo, epoch * source_size + pos + size AS hi FROM line, (SELECT unnest(range(0, 3)) AS epoch) WHERE size > 0
        ), met AS (
            SELECT doc_id, src, lo, hi, unnest(range((lo // b)::BIGINT, ((hi - 1) // b + 1)::BIGINT)) AS block FROM laid, width
        ), got AS (
            SELECT doc_id, sum(greatest(0, least(hi, high) - greatest(lo, low)))::BIGINT AS taken FROM met JOIN drawn USING (src, block) GROUP BY doc_id
        )
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM line LEFT JOIN got USING (doc_id)
    """,
    "op11_phrase_collocations": rf"""
        WITH lowered AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), pieces AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
            FROM (SELECT lang, unnest(string_split_regex(text, '{phrases.BREAKS}')) AS piece FROM lowered)
        ), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        placed AS (SELECT piece, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT lang, w, row_number() OVER () AS piece FROM pieces)),
        ahead AS (SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)),
        grams AS MATERIALIZED (
            SELECT lang, s, gram, count(*) AS f FROM (
                SELECT lang, 1 AS s, w1 AS gram FROM ahead UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
                UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
                UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL
            ) GROUP BY ALL HAVING count(*) >= 30
        ),
        inner_ AS (
            SELECT lang, f, array_to_string(string_split(gram, ' ')[i:i + m - 1], ' ') AS gram
            FROM grams, range(2, 4) AS inside(m), range(1, 4) AS begin_(i) WHERE m < s AND i + m - 1 <= s
        ), longer AS (SELECT lang, gram, max(f) AS f FROM inner_ GROUP BY ALL),
        candidates AS (
            SELECT lang, s, gram, g.f AS a, string_split(gram, ' ') AS w FROM grams AS g LEFT JOIN longer AS o USING (lang, gram)
            WHERE s >= 2 AND NOT coalesce(100 * o.f::HUGEINT >= 80 * g.f::HUGEINT, false)
        ), asked AS MATERIALIZED (
            SELECT lang, gram, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:s], ' ') AS rest
            FROM (SELECT *, unnest(range(1, s)) AS k FROM candidates)
        ), cuts AS (
            SELECT q.lang, q.gram, a, k, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score
            FROM asked AS q JOIN grams AS x ON x.lang = q.lang AND x.gram = first_part JOIN grams AS y ON y.lang = q.lang AND y.gram = rest
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
        FROM best JOIN n USING (lang) QUALIFY rank <= 2000
    """,
    "op13_fill_in_middle": rf"""
        WITH own AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest,
                   regexp_extract_all(coalesce(text, ''), '{infill.UNIT}') AS units FROM documents
        ), drawn AS (
            SELECT *, len(units) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM own
        ), formed AS (
            SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM drawn
        ), cut AS (
            SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:n], '') AS suffix FROM formed
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM cut
    """,
}
