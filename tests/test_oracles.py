"""Every query with SQL gives the same rows and types on both engines."""

import duckdb
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(str(plain(v)) for v in r) for r in df.select(*cols).collect())
    found = duck.execute(registry.ORACLES[name])
    heads = {d[0]: (i, str(d[1])) for i, d in enumerate(found.description)}
    assert sorted(heads) == cols
    theirs = sorted(tuple(str(plain(r[heads[c][0]])) for c in cols) for r in found.fetchall())
    assert ours == theirs
    assert ours, "an oracle over no rows tells nothing"
    assert [TYPES[df.schema[c].dataType.simpleString()] for c in cols] == [heads[c][1] for c in cols]


def test_every_query_without_sql_is_known():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"kmeans", "change_events", "change_events_strict", "change_timeline", "event_first_dates", "search_geojson"}
