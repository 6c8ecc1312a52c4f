"""The diary of agents: an appended table (id, agent, content, entry_ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 1000


def last_entries(diary: DataFrame, agent: str, n: int) -> DataFrame:
    """The agent's last n entries, in order of time."""
    last = diary.where(F.col("agent") == agent).orderBy(F.desc("entry_ts"), F.desc("id")).limit(min(n, MOST_ENTRIES))
    return last.orderBy("entry_ts", "id")


def all_entries(diary: DataFrame, agent: str) -> DataFrame:
    return diary.where(F.col("agent") == agent).orderBy("entry_ts", "id")


def diary_stats(diary: DataFrame) -> DataFrame:
    return diary.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("agent").alias("agents"))


def written_entry(diary: DataFrame, agent: str, content: str, at) -> DataFrame:
    """The diary with one more entry."""
    top = diary.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    new = diary.sparkSession.createDataFrame([(top + 1, agent, content, at)], "id long, agent string, content string, entry_ts timestamp")
    return diary.unionByName(new.select("id", "agent", "content", F.col("entry_ts").cast(diary.schema["entry_ts"].dataType).alias("entry_ts")))


def without_entry(diary: DataFrame, id: int) -> DataFrame:
    return diary.where(F.col("id") != id)
