"""Files of projects and conversations as tables (source_file, source_mtime, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.text import drawer_id, project_room
from engram.operators.chunking import chunked, conversation_chunks
from engram.operators.memories import new_or_changed


def _files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    glob = "*.{" + ",".join(extensions) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("path").alias("source_file"), F.col("modificationTime").cast("double").alias("source_mtime"), F.col("content"))


def _relative(folder: str) -> Column:
    return F.regexp_replace("source_file", f"^.*?{folder.rstrip('/').split('/')[-1]}/", "")


def ignored(patterns: list[str]) -> Column:
    """Whether a relative path matches one of the patterns of an ignore file (names, folders/, *.ending, /from/the/top)."""

    def one(p: str) -> Column:
        body = p.strip("/").replace(".", r"\.").replace("**/", "(.*/)?").replace("*", "[^/]*").replace("?", "[^/]")
        return F.rlike("_relative", F.lit(("^" if p.startswith("/") else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)")))

    tests = [one(p) for p in map(str.strip, patterns) if p and not p.startswith(("#", "!"))]
    return reduce(Column.__or__, tests, F.lit(False))


def project_files(spark: SparkSession, folder: str, ignore: list[str] | None = None, skipped: list[str] | None = None) -> DataFrame:
    """Readable files below a folder, without those in skipped folders or that an ignore file's patterns name."""
    rows = _files(spark, folder, L.READABLE_EXTENSIONS).withColumn("_relative", _relative(folder))
    inside = F.arrays_overlap(F.split("_relative", "/"), F.array(*map(F.lit, skipped or L.SKIPPED_FOLDERS)))
    kept = rows.where(~inside & ~F.rlike("_relative", F.lit(r"(^|/)\.")) & ~ignored(ignore or []))
    return kept.select("source_file", "source_mtime", F.col("_relative").alias("relative"), F.decode("content", "UTF-8").alias("content"))


def conversation_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = _files(spark, folder, L.CONVERSATION_EXTENSIONS).withColumn("_relative", _relative(folder))
    inside = F.arrays_overlap(F.split("_relative", "/"), F.array(*map(F.lit, L.SKIPPED_FOLDERS)))
    return rows.where(~inside).select("source_file", "source_mtime", F.col("_relative").alias("relative"), F.decode("content", "UTF-8").alias("content"))


def mined_project(files: DataFrame, memories: DataFrame | None, wing: str) -> DataFrame:
    """New memories from files that are new or changed: chunks with room, source and drawer id."""
    fresh = files if memories is None else new_or_changed(files, memories)
    chunks = chunked(fresh, "source_file", "content").withColumnRenamed("id", "source_file")
    placed = fresh.select("source_file", "source_mtime", project_room(F.col("relative"), F.col("content")).alias("room"))
    rows = chunks.join(placed, "source_file").withColumn("wing", F.lit(wing))
    return rows.select(F.col("chunk").alias("text_content"), "wing", "room", "source_file", "source_mtime", "chunk_index", drawer_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("chunk_index")).alias("drawer"))


def mined_conversations(files: DataFrame, memories: DataFrame | None, wing: str, room: str = "convos") -> DataFrame:
    """New memories from conversations: exchanges or paragraphs."""
    fresh = files if memories is None else new_or_changed(files, memories)
    rows = fresh.select("source_file", "source_mtime", F.posexplode(conversation_chunks(F.col("content"))).alias("chunk_index", "text_content"))
    rows = rows.withColumns({"wing": F.lit(wing), "room": F.lit(room)})
    return rows.withColumn("drawer", drawer_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("chunk_index")))


def replaced_by_source(memories: DataFrame, mined: DataFrame) -> DataFrame:
    """Memories of other sources, and the mined ones: a changed file leaves no old chunks."""
    rest = memories.join(mined.select("source_file").distinct(), "source_file", "left_anti")
    return rest.unionByName(mined, allowMissingColumns=True)
