"""Each registered query over whole tables: its columns, its rows, and its SQL where it has any."""

import math
import zlib

import duckdb
import pytest

from lodestone.llm import pii, queries

SF = "/root/testdata/sf0.001"
#: The columns that each query is asked for, more may follow.
COLUMNS = {
    "op1_license_scan": "doc_id license containment first_word n_words",
    "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_jaccard_join": "doc_id n_shingles component_id",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_nearest_neighbours": "query_id rank vec_id score",
}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def of(name):
        if name not in held:
            df = queries.QUERIES[name](spark, SF)
            held[name] = df.columns, [r.asDict() for r in df.collect()]
        return held[name]

    return of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, texts, name):
    columns, rows = results(name)
    want = COLUMNS[name].split()
    assert [c for c in columns if c in want] == want and rows
    if "doc_id" in want and name != "op1_license_scan":
        assert {r["doc_id"] for r in rows} == set(texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(results, duck, name):
    columns, rows = results(name)
    found = duck.execute(queries.ORACLES[name])
    heads = [d[0] for d in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted(tuple(str(plain(r[c])) for c in heads) for r in rows)
    assert ours == sorted(tuple(str(plain(v)) for v in r) for r in found.fetchall()) and sorted(heads) == sorted(columns)


def test_packing_places_every_id_once(results):
    _, rows = results("op2_best_fit_packing")
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.02 + 2


def test_base_spans_count(results, texts):
    _, rows = results("op3_personal_data")
    for r in rows:
        spans = pii.base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(pii.told(spans).split(",")) - {""} <= set(r["spans"].split(","))


def test_folds(results):
    for name, n, own in (("op4_toxicity", 4, 2), ("op6_lm_scoring", 5, 1)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == own) for r in results(name)[1])


def test_mix_meets_targets(results):
    _, rows = results("op7_mixing")
    biggest = max(r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= biggest and sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
