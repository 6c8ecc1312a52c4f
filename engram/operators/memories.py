"""The table of memories: predicates, lookups, reports, and the current view over appended facts.

Facts are only appended: ``memories``, ``accesses`` (id, at), ``tombstones`` (id), ``rewrites``
(id, text_content, at). ``current_view`` derives what a store that is changed in place would hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.vector import hashed_embedding
from engram.session import kept

#: Most rows of a recency query, memories in a store, and rows of each report.
MOST_ROWS, MOST_MEMORIES = 10_000, 100_000
MOST_WINGS, MOST_ROOMS = 100, 500


def matching(wing: str | None = None, room: str | None = None) -> Column:
    """Equality on wing, room, both or neither."""
    tests = [F.col(c) == v for c, v in (("wing", wing), ("room", room)) if v is not None]
    return reduce(Column.__and__, tests, F.lit(True))


def where_clause(clause: dict | None) -> Column:
    """The predicate of {"wing": w}, {"room": r} or {"$and": [...]}."""
    if not clause:
        return F.lit(True)
    if "$and" in clause:
        return reduce(Column.__and__, map(where_clause, clause["$and"]))
    return reduce(Column.__and__, (F.col(k) == v for k, v in clause.items()))


def valid_at(at: Column | int, null_start: bool = False) -> Column:
    """Valid from the start to the end, both included; an open end is for ever, on request an open start since ever."""
    at = at if isinstance(at, Column) else F.lit(at)
    begun = F.col("valid_from") <= at
    if null_start:
        begun = F.col("valid_from").isNull() | begun
    return begun & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))


def recent(memories: DataFrame, wing: str | None = None, room: str | None = None, limit: int = 10) -> DataFrame:
    """The latest memories of a wing or room, later ids first where equal."""
    return memories.where(matching(wing, room)).orderBy(F.desc("valid_from"), F.desc("id")).limit(min(limit, MOST_ROWS))


def by_id(memories: DataFrame, id: int) -> DataFrame:
    return memories.where(F.col("id") == id)


def ids(memories: DataFrame, wing: str | None = None) -> DataFrame:
    return memories.where(matching(wing)).select("id")


def has_source(memories: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources (source_file) that the store knows."""
    return sources.join(memories.select("source_file"), "source_file", "left_semi")


def latest_mtimes(memories: DataFrame) -> DataFrame:
    """Of each source the modification time stored last."""
    return memories.where("source_file IS NOT NULL").groupBy("source_file").agg(F.max_by("source_mtime", "id").alias("source_mtime"))


def new_or_changed(files: DataFrame, memories: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Files (source_file, source_mtime, ...) that aren't stored, or with another modification time."""
    known = latest_mtimes(memories).withColumnRenamed("source_mtime", "_stored")
    same = F.coalesce(F.abs(F.col("_stored") - F.col("source_mtime")) < tolerance, F.lit(False))
    return files.join(known, "source_file", "left").where(~same).drop("_stored")


def wings_rooms(memories: DataFrame) -> DataFrame:
    return memories.select("wing", "room").distinct()


def list_wings(memories: DataFrame, most: int = MOST_WINGS) -> DataFrame:
    """Rooms of each wing, the first ``most`` wings by name; capped tells whether there are more."""
    counts = memories.groupBy("wing").agg(F.count_distinct("room").alias("rooms"))
    total = memories.agg((F.count_distinct("wing") > most).alias("capped"))
    return counts.orderBy("wing").limit(most).join(F.broadcast(total))


def list_rooms(memories: DataFrame, wing: str | None = None, most: int = MOST_ROOMS) -> DataFrame:
    return memories.where(matching(wing)).select("room").distinct().orderBy("room").limit(most)


def taxonomy(memories: DataFrame) -> DataFrame:
    """Memories of each room of each wing."""
    return memories.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("memories"))


def status(memories: DataFrame) -> DataFrame:
    return memories.agg(F.count(F.lit(1)).alias("memories"), F.count_distinct("wing").alias("wings"), F.count_distinct("room").alias("rooms"))


def touches(accesses: DataFrame) -> DataFrame:
    """Of each memory the number of accesses and the last."""
    return accesses.groupBy("id").agg(F.count(F.lit(1)).alias("access_count"), F.max("at").alias("last_accessed"))


def without(memories: DataFrame, tombstones: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """Memories that aren't deleted; those of protected wings can't be."""
    safe = F.col("wing").isin(protected if protected is not None else L.PROTECTED_WINGS)
    gone = tombstones.select("id").distinct().withColumn("_gone", F.lit(True))
    return memories.join(gone, "id", "left").where(safe | F.col("_gone").isNull()).drop("_gone")


def appended(memories: DataFrame, new: DataFrame, now: int, most: int | None = None) -> DataFrame:
    """``new`` rows (text_content, wing, room, ...) as memories, numbered on from those there are, in order of text, wing and room.

    The sorted rows are kept, each partition numbers its own, and numbers start after the rows of the
    partitions before, so no task sees more than a partition. With ``most``, too many are refused.
    """
    if most is not None and memories.count() + new.count() > most:
        raise ValueError(f"more than {most} memories")
    sorted_ = kept(new.orderBy("text_content", "wing", "room").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sorted_.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    starts = starts.crossJoin(memories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    numbered = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_top") + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = numbered.withColumn("id", place.cast("long")).drop("_at", "_part", "_before", "_top")
    filled = numbered.withColumns({"valid_from": F.lit(now).cast("long"), "last_accessed": F.lit(now).cast("long"), "access_count": F.lit(0).cast("long"), "importance_score": F.lit(5.0)})
    return memories.unionByName(filled, allowMissingColumns=True)


def current_view(memories: DataFrame, accesses: DataFrame | None = None, tombstones: DataFrame | None = None, rewrites: DataFrame | None = None, embed: Callable[[Column], Column] | None = hashed_embedding) -> DataFrame:
    """Memories after all rewrites, deletions and accesses. A rewritten text has a new vector, by ``embed``, if there are vectors."""
    out = memories
    if rewrites is not None:
        last = rewrites.groupBy("id").agg(F.max_by("text_content", "at").alias("_text"))
        out = out.join(last, "id", "left").withColumn("text_content", F.coalesce("_text", "text_content"))
        if embed is not None and "embedding" in out.columns:
            out = out.withColumn("embedding", F.when(F.col("_text").isNull(), F.col("embedding")).otherwise(embed(F.col("_text"))))
        out = out.drop("_text")
    if tombstones is not None:
        out = without(out, tombstones)
    if accesses is not None:
        seen = touches(accesses).select("id", F.col("access_count").alias("_n"), F.col("last_accessed").alias("_at"))
        out = out.join(seen, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.greatest("last_accessed", F.coalesce("_at", "last_accessed"))})
        out = out.drop("_n", "_at")
    return out
