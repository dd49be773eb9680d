"""A corpus from raw documents to packed sequences, stage by stage.

Each stage reads what the one before it wrote and works on all of it. To the
stage that drops near copies, an id and a text name one document: of each group
of near copies the row with the smallest id stays, then with the smallest hash
of its text; a null id comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, pii, toxicity
from lodestone.llm._shared import drop_staged, staged, staged_so_far
from lodestone.llm.queries import encoder_files, training_labels


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, stage) -> DataFrame:
    """``stage`` on ``docs`` with extra columns under names that no operator uses."""
    extra = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    return stage(docs.withColumnsRenamed(extra)).withColumnsRenamed({v: k for k, v in extra.items()}).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, training_labels(labels))
    return apart(docs, lambda d: toxicity.score(d, model).where("predicted = 0").select(*d.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = jaccard.join_components(docs.select(row.alias("row"), "text"), key="row")
    first = groups.where("row = component_id").select(F.col("row.id").alias("_id"), F.col("row.hash").alias("_first")).distinct()

    def firsts(d: DataFrame) -> DataFrame:
        kept = d.withColumn("_hash", F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_first")), "left_semi")
        return kept.dropDuplicates(["doc_id", "_hash"]).select(*d.columns)

    return apart(docs, firsts)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = pii.fit(docs)
    return apart(docs, lambda d: pii.redact(d, field).withColumn("n_chars", F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def repeated(d: DataFrame) -> DataFrame:
        rows = mixing.mix_sources(d, keep=d.columns)
        return rows.withColumn("_copy", F.explode(F.expr("array_repeat(0, copies)"))).select(*d.columns)

    return apart(docs, repeated)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "source", "text"), encoder_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained score, a trained field and a seeded choice have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_staged(spark, mark, 1)  # the stage before and this one's working tables
    return docs
