"""Shares of answered results are rounded as their SQL does, on scores where the two engines' own rounding parts."""

import duckdb

from lodestone.plans import registry


def test_rounds_as_its_sql(spark, tmp_path):
    unit = lambda **c: [float(c.get(f"_{i}", 0)) for i in range(64)]
    scores = [50.05, 50.15, 50.65, 51.05, 74.85]
    rows = [unit(_0=1), unit(_1=1), unit(_2=1), unit(_3=1)] + [unit(_0=s / 100, _1=0.8) for s in scores]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 1)", list(enumerate(rows)))
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    assert sorted(r["score"] for r in registry.QUERIES["semantic_search"](spark, str(tmp_path)).collect()) == scores
    df = registry.QUERIES["review_from_search"](spark, str(tmp_path))
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES['review_from_search']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(theirs)
