"""Memories from texts: kinds by markers, with sentiment, topic and the parts of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.text import decision_part, marker_score, prose, sentiment, topics
from engram.operators.chunking import segments

#: Kinds in order of priority where scores are equal.
KINDS = {"Decision": L.DECISION_MARKERS, "Preference": L.PREFERENCE_MARKERS, "Milestone": L.MILESTONE_MARKERS, "Problem": L.PROBLEM_MARKERS, "Emotional": L.EMOTION_MARKERS}


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns so that what uses them, filters included, doesn't repeat their expressions."""
    held = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.withColumn("_held", held).select(*rows.columns, "_held.*")


def with_kind(rows: DataFrame, text: str) -> DataFrame:
    """Adds prose, the score of each kind, memory_type, confidence, sentiment, topic and matrix of a column of segments."""
    rows = _once(rows, {"prose": prose(F.col(text))})
    scores = {f"score_{k.lower()}": marker_score(F.col("prose"), p) for k, p in KINDS.items()}
    rows = _once(rows, scores | {"sentiment": sentiment("prose")})
    best = F.get(F.array_sort(F.array(*(F.struct((-F.col(f"score_{k.lower()}")).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)))), F.lit(0))
    bonus = F.when(F.octet_length(text) > 500, 2).when(F.octet_length(text) > 200, 1).otherwise(0)
    solved = F.rlike(F.lower("prose"), F.lit("|".join(f"(?:{p})" for p in L.RESOLUTION_MARKERS)))
    feels, built = F.col("score_emotional") > 0, F.col("score_milestone") > 0
    kind = (
        F.when(best["k"] != "Problem", best["k"])
        .when(solved & feels & (F.col("sentiment") > 0), "Emotional")
        .when(solved, "Milestone")
        .when((F.col("sentiment") > 0) & built, "Milestone")
        .when((F.col("sentiment") > 0) & feels, "Emotional")
        .otherwise(best["k"])
    )
    confidence = F.when(best["n"] < 0, F.least(F.lit(1.0), (-best["n"] + bonus) / 5.0)).otherwise(0.0)
    parts = F.map_filter(F.create_map(*(x for p in L.DECISION_PARTS for x in (F.lit(p), decision_part(F.col("prose"), p)))), lambda _, v: v.isNotNull())
    return rows.withColumns({"memory_type": kind, "confidence": F.round(confidence, 6), "topic": F.get(topics("prose", 1), F.lit(0)), "matrix": F.when(kind == "Decision", parts).otherwise(F.create_map().cast("map<string,string>"))})


def structured_memories(docs: DataFrame, id_col: str, text_col: str, least: float = 0.3) -> DataFrame:
    """Segments of 20 bytes or more with a kind of at least ``least`` confidence: id, chunk_index, content, memory_type, topic, matrix, sentiment, confidence."""
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(segments(F.col(text_col))).alias("chunk_index", "content")).where(F.octet_length("content") >= 20)
    return with_kind(parts, "content").where(F.col("confidence") >= least).select("id", "chunk_index", "content", "memory_type", "topic", "matrix", "sentiment", "confidence")


def best_kind(text: Column) -> Column:
    """For one expression only: the kind of marker that matches most, null without a match."""
    scores = F.array_sort(F.array(*(F.struct((-marker_score(text, p)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, p) in enumerate(KINDS.items()))))
    top = F.get(scores, F.lit(0))
    return F.when(top["n"] < 0, top["k"])
