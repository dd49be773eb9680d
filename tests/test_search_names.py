"""Searches over tiles with ids of six digits against their SQL, as two tiles may share a name there."""

import duckdb
import pytest

from lodestone.plans import registry

FROM = "'/root/testdata/sf0.001/embeddings.parquet'"


@pytest.fixture(scope="module")
def large_ids(tmp_path_factory):
    """Tiles from the tenth on are renumbered; each has a near copy whose id starts with the same five digits."""
    sf = tmp_path_factory.mktemp("ids")
    near = "list_transform(embedding, lambda v: (v * 0.99)::FLOAT)"
    duckdb.execute(f"""COPY (SELECT vec_id, embedding, label FROM {FROM} WHERE vec_id < 10
        UNION ALL SELECT 100007 + 10 * vec_id, embedding, label FROM {FROM} WHERE vec_id >= 10
        UNION ALL SELECT 100001 + 10 * vec_id, {near}, label FROM {FROM} WHERE vec_id >= 10) TO '{sf}/embeddings.parquet'""")
    return str(sf)


@pytest.mark.parametrize("name", ["semantic_search", "review_from_search", "semantic_search_15", "image_search"])
def test_same_names(spark, large_ids, name):
    df = registry.QUERIES[name](spark, large_ids)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{large_ids}/embeddings.parquet'")
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, theirs)) and theirs
