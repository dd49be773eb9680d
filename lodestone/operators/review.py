"""Review queue as events: candidates and decisions are appended, state is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ranked(candidates: DataFrame, k: int = 20, status: str = "pending") -> DataFrame:
    return candidates.where(F.col("status") == status).orderBy(F.desc("confidence"), "seq").limit(k)


def resolve(candidates: DataFrame, choice: str, status: str = "pending") -> DataFrame:
    """The candidate that an analyst names: its place in the ranked queue, from 1, or its id in any case; no row for neither."""
    named = choice.strip()
    if not (named.isascii() and named.isdigit()):
        return ranked(candidates.where(F.lower("id") == named.lower()), 1, status)
    place = int(named)
    page = ranked(candidates, place, status).withColumn("n", F.row_number().over(W.orderBy(F.desc("confidence"), "seq")))  # a page, as long as the place asked for
    return page.where(F.col("n") == place).drop("n")


def state(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each candidate with its latest decision; decisions on unknown ids fall away."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("decision"), F.max("at").alias("decision_at"))
    return candidates.join(last, "id", "left").withColumn("status", F.coalesce("decision", F.lit("pending"))).drop("decision")


def feedback_terms(candidates: DataFrame, status: str, k: int = 3) -> DataFrame:
    """The first labels of a status by order of entry."""
    first = candidates.where((F.col("status") == status) & (F.col("label") != "")).groupBy("label").agg(F.min("seq").alias("seq"))
    return first.orderBy("seq").limit(k)


def from_search(results: DataFrame, order: str, answer: str) -> DataFrame:
    """Candidates from a page of answered results: "y" confirms, all else rejects; confidence is the score as a share."""
    number = F.row_number().over(W.orderBy(order))  # a page of results, not a table
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 100))
    confidence = F.round(share * 1000) / 1000  # as SQL engines round a double; to three places Spark rounds its decimal text, which parts on halves
    return results.withColumn("n", number).select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("id"), confidence.alias("confidence"), F.when(F.lower(F.trim(answer)) == "y", "confirmed").otherwise("rejected").alias("status"))


def from_events(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("category").alias("label"), "confidence", F.lit("pending").alias("status"))
