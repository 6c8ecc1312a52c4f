"""Context for a session: the identity text, the essential story, recall by place, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import basename, decayed_importance, display_weight, snippet
from engram.operators.memories import recent
from engram.operators.search import knn

#: Fixed values of the essential story: memories looked at, shown, and characters in all.
STORY_POOL, STORY_TOP, STORY_CHARS = 100, 15, 3200


def identity(text: str | None) -> str:
    """The identity layer: the text of the identity file, or a placeholder."""
    return text.strip() if text and text.strip() else "## L0 — IDENTITY\nNo identity configured."


def story_top(memories: DataFrame, now: int, wing: str | None = None) -> DataFrame:
    """The most important of the latest memories: id, room, importance, source_file, text_content."""
    pool = recent(memories, wing, limit=STORY_POOL)
    boost = F.when(F.octet_length("text_content") > 0, F.lit(100.0) / F.octet_length("text_content") * 0.1).otherwise(0.0)
    score = decayed_importance(F.col("importance_score"), F.col("last_accessed"), F.col("access_count"), now) + boost
    scored = pool.withColumn("importance", F.round(score, 6))
    return scored.orderBy(F.desc("importance"), F.desc("valid_from"), F.desc("id")).limit(STORY_TOP).select("id", "room", "importance", "source_file", "text_content", "valid_from")


def story_lines(memories: DataFrame, now: int, wing: str | None = None) -> DataFrame:
    """The story's lines (place, line), room by room, as far as the characters go."""
    top = story_top(memories, now, wing)
    line = F.concat(F.lit("  - WT:"), display_weight(F.col("importance")).cast("string"), F.lit("| "), snippet("text_content", 200))
    line = F.when(basename("source_file") != "", F.concat(line, F.lit("  ("), basename("source_file"), F.lit(")"))).otherwise(line)
    order = Window.orderBy("room", F.desc("importance"), F.desc("valid_from"), F.desc("id"))
    first = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("importance"), F.desc("valid_from"), F.desc("id"))) == 1
    head = F.concat(F.lit("### "), F.upper("room"))
    rows = top.withColumns({"line": line, "head": F.when(first, head)}).withColumn("size", F.length("line") + F.coalesce(F.length("head"), F.lit(0)))
    rows = rows.withColumns({"place": F.row_number().over(order), "total": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where(F.col("total") <= STORY_CHARS).select("place", "room", "head", "line", "total")


def story(memories: DataFrame, now: int, wing: str | None = None) -> DataFrame:
    """The essential story as one text."""
    shown = story_lines(memories, now, wing)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\n", "head", "line").alias("t")))), lambda x: x["t"]), "\n")
    total = story_top(memories, now, wing).agg(F.count(F.lit(1)).alias("all"))
    joined = shown.agg(F.count(F.lit(1)).alias("shown"), text.alias("lines")).join(F.broadcast(total))
    full = F.concat_ws("\n", F.lit("## L1 — ESSENTIAL STORY"), "lines", F.when(F.col("shown") < F.col("all"), F.lit("  ... (more in L3 search)")))
    return joined.select(F.when(F.col("all") == 0, F.lit("## L1 — No memories yet.")).otherwise(full).alias("text"))


def wake_up(memories: DataFrame, now: int, identity_text: str | None = None, wing: str | None = None) -> DataFrame:
    return story(memories, now, wing).select(F.concat(F.lit(identity(identity_text)), F.lit("\n\n"), "text").alias("text"))


def recall_lines(memories: DataFrame, wing: str | None = None, room: str | None = None, limit: int = 10) -> DataFrame:
    """The latest memories of a place as lines: id, line."""
    rows = recent(memories, wing, room, limit)
    source = F.when(F.coalesce(basename("source_file"), F.lit("")) != "", F.concat(F.lit("  ("), basename("source_file"), F.lit(")"))).otherwise("")
    return rows.select("id", F.concat(F.lit("  ["), "room", F.lit("] "), snippet("text_content", 300), source).alias("line"))


def search_lines(memories: DataFrame, vectors: DataFrame, query: list[float], k: int = 5, **filters) -> DataFrame:
    """Search results as lines: rank, id, line."""
    found = knn(vectors, query, k, **filters).select("id", "score").join(memories, "id")
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    line = F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] "), "wing", F.lit("/"), "room", F.lit(" (sim="), F.format_number("score", 3), F.lit(") "), snippet("text_content", 300))
    return ranked.select("rank", "id", line.alias("line"))


def search_json(memories: DataFrame, vectors: DataFrame, query_text: str, query: list[float], k: int = 5, wing: str | None = None, room: str | None = None) -> DataFrame:
    """Search results as one JSON text: query, filters, results."""
    found = knn(vectors, query, k, wing, room).select("id", "score").join(memories.select("id", F.col("text_content").alias("text"), "wing", "room", "source_file"), "id")
    each = F.struct((-F.col("score")).alias("_o"), "id", F.struct("text", "wing", "room", "source_file", F.col("score").alias("similarity")).alias("r"))
    results = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["r"])
    filters = F.struct(F.lit(wing).cast("string").alias("wing"), F.lit(room).cast("string").alias("room"))
    return found.agg(results.alias("results")).select(F.to_json(F.struct(F.lit(query_text).alias("query"), filters.alias("filters"), "results")).alias("json"))


@dataclass(frozen=True)
class Stack:
    """The layers of context over one store's memories (with their vectors), at one time."""

    memories: DataFrame
    now: int
    identity: str | None = None

    def wake_up(self, wing: str | None = None) -> DataFrame:
        """Identity and essential story."""
        return wake_up(self.memories, self.now, self.identity, wing)

    def recall(self, wing: str | None = None, room: str | None = None, limit: int = 10) -> DataFrame:
        return recall_lines(self.memories, wing, room, limit)

    def search(self, query: list[float], k: int = 5, **filters) -> DataFrame:
        return search_lines(self.memories.drop("embedding"), self.memories.select("id", "embedding", "wing", "room", "valid_from", "valid_to"), query, k, **filters)
