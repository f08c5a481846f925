"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

from labelscan.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sql, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = sql.sql(ORACLE_SQL[name]).df()
    assert sorted(want.columns) == columns
    got = found.select(*columns).toPandas()
    float_cols = [c for c in columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"]
    for c in float_cols:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert plain(got.itertuples(index=False)) == plain(want[columns].itertuples(index=False))


def test_fuzzy_vocabulary(spark):
    from labelscan.functions.text import ratio

    found = QUERIES["fuzzy_vocab"](spark, FOLDER).collect()
    assert all(r["ratio"] >= 0.85 and r["ratio"] == pytest.approx(ratio(r["token"], r["term"])) for r in found)


def test_fuzzy_vocabulary_is_complete(spark, tmp_path):
    """Every spelling that is near enough is found, against all pairs."""
    from labelscan.functions.text import ratio
    from labelscan.sources.dims import VOCABULARY

    tokens = {t[:k] + x + t[k + j :] for t in VOCABULARY for k in range(len(t)) for x in ("", "q") for j in (0, 1)}
    spark.createDataFrame([(k, t) for k, t in enumerate(sorted(tokens))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spelled = {"".join(c for c in w if "a" <= c <= "z") for t in tokens for w in t.split(" ")}
    want = {(s, t) for s in spelled if len(s) >= 4 for t in VOCABULARY if abs(len(s) - len(t)) <= 2 and ratio(s, t) >= 0.85}
    assert {(r["token"], r["term"]) for r in QUERIES["fuzzy_vocab"](spark, f"file://{tmp_path}").collect()} == want and len(want) > 100
