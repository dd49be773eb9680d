"""The pipeline on a small corpus: every stage's decisions take effect."""

from collections import Counter

import corpus_pipeline
from lodestone.llm import jaccard, mixing, packing, pii, queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = held[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    kept = held["toxicity"].select("doc_id", "text").collect()
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(held["toxicity"]).collect()}
    assert sorted(r["doc_id"] for r in held["near_copies"].collect()) == sorted(set(groups.values())) and len(kept) == len(groups)
    assert all(not pii.base_spans(r["text"]) for r in held["personal_data"].collect())
    before, mixed = Counter(), Counter()
    for r in held["personal_data"].collect():
        before[r["doc_id"]] += 1
    for r in held["mixing"].collect():
        mixed[r["doc_id"]] += 1
    assert set(mixed) <= set(before) and max(mixed.values()) <= 2
    asked = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix_sources(held["personal_data"]).collect()}
    assert all(t <= 2 * n for t, n in asked.values()) and abs(sum(t for t, _ in asked.values()) - 1.5 * sum(n for _, n in asked.values())) < 1
    packed = held["packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    encode = packing.make_encoder(*queries.encoder_files())
    texts = {r["doc_id"]: r["text"] for r in held["mixing"].collect()}
    assert all(bytes(r["ids"]) == (encode(texts[r["doc_id"]] or "") + b"\0\0\0\0")[4 * r["start"] : 4 * (r["start"] + r["length"])] for r in packed)


def test_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, spans string, predicted string, component_id string"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1, "s", "z", "p", "q", "c"), (1, text, "en", "a", 1, "s", "z", "p", "q", "c"), (2, text, None, None, None, "s", "z", "p", "q", "c"), (3, None, None, "b", 0, *["k"] * 5), (4, "", "en", "b", 0, *["k"] * 5), (None, "mail a.b@c.de here", None, None, None, *[None] * 5)]
    rows += [(8, "first of one id", "en", "a", 1, *["k"] * 5), (8, "second text of that id", "en", "a", 1, *["k"] * 5), (9, "long " * 100_000 + "a.b@c.de", "en", "b", 1, *["k"] * 5)]
    docs = spark.createDataFrame(rows, schema)
    for held in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            told = out.collect()
            assert all(r["score"] in ("s", "k", None) and r["size"] in ("z", "k", None) for r in told)
            if name == "near_copies":
                assert sorted(str(r["doc_id"]) for r in told) == (sorted(["1", "3", "4", "8", "8", "9", "None"]) if held is docs else [])
            if name == "personal_data" and held is docs:
                assert "mail [EMAIL] here" in {r["text"] for r in told}
        assert corpus_pipeline.pack(spark, held, "").where("piece = 0").count() == held.count()


def test_survivors_are_chosen_by_row(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near, c = a + " end", "some other text without an id at all"
    rows = [(5, a), (5, b), (6, a), (5, near), (None, a), (None, near), (None, c), (None, c), (None, c + " too"), (None, None), (2, b + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        told = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), "").collect()]
        assert len([t for t in told if t in ((5, a), (5, near))]) == 1  # one of the group of a, by its hash
        rest = [t for t in told if t not in ((5, a), (5, near))]
        assert sorted(rest, key=str) == sorted([(2, b + " end"), (None, None), *[t for t in rest if t in ((None, c), (None, c + " too"))]], key=str) and len(rest) == 3


def test_names_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "packing"]
