"""The temporal knowledge graph, and the graph of rooms and wings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import predicate_slug, slug, triple_id
from engram.operators.memories import valid_at

MOST_HOPS, MOST_RESULTS = 5, 200


def query_entity(triples: DataFrame, entities: DataFrame, name: str, direction: str = "both", as_of: str | None = None) -> DataFrame:
    """Facts of an entity: direction, subject, predicate, object (names at the far end), dates, confidence, current.

    A fact from an entity to itself shows in both directions.
    """
    rows = triples if as_of is None else triples.where(valid_at(F.lit(as_of), null_start=True))
    this = F.lit(name.lower().replace(" ", "_").replace("'", ""))
    out = []
    for way, near, far in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (way, "both"):
            side = rows.where(F.col(near) == this).join(entities.select(F.col("id").alias(far), F.col("name").alias("_name")), far)
            ends = {near: F.lit(name), far: F.col("_name")}
            out.append(side.select(F.lit(way).alias("direction"), ends["subject"].alias("subject"), "predicate", ends["object"].alias("object"), "valid_from", "valid_to", "confidence", F.col("valid_to").isNull().alias("current"), "id"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def timeline(triples: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """All facts of an entity by start, those without one first."""
    return query_entity(triples, entities, name).orderBy(F.coalesce("valid_from", F.lit("")), "direction", "id")


def graph_stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias("entities")).join(F.broadcast(triples.agg(F.count(F.lit(1)).alias("triples"))))


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with the ``new`` (name, type) replacing those of the same id."""
    new = new.select(slug("name").alias("id"), "name", "type").dropDuplicates(["id"])
    return entities.join(new, "id", "left_anti").select("id", "name", "type").unionByName(new)


def add_triples(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Triples with ``new`` (subject, predicate, object, valid_from, valid_to, confidence) added; one that is open already isn't."""
    fresh = new.select(slug("subject").alias("subject"), predicate_slug("predicate").alias("predicate"), slug("object").alias("object"), "valid_from", "valid_to", "confidence")
    key = ["subject", "predicate", "object"]
    open_ = triples.where("valid_to IS NULL").select(*key)
    first = fresh.groupBy(*key).agg(F.min(F.struct(F.coalesce("valid_from", F.lit("")).alias("_from"), "valid_from", "valid_to", "confidence")).alias("t")).select(*key, "t.valid_from", "t.valid_to", "t.confidence")
    added = first.join(open_, key, "left_anti").withColumn("id", triple_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")))
    return triples.unionByName(added, allowMissingColumns=True)


def open_once(triples: DataFrame) -> DataFrame:
    """Of equal open triples only the first (by id); ended ones all."""
    key = ["subject", "predicate", "object"]
    first = triples.where("valid_to IS NULL").groupBy(*key).agg(F.min("id").alias("id"))
    return triples.where("valid_to IS NOT NULL").unionByName(triples.join(first.select("id"), "id", "left_semi"))


def invalidate(triples: DataFrame, ended: DataFrame) -> DataFrame:
    """Open triples that match ``ended`` (subject, predicate, object, ended) end then."""
    ends = ended.select(slug("subject").alias("subject"), predicate_slug("predicate").alias("predicate"), slug("object").alias("object"), "ended")
    ends = ends.groupBy("subject", "predicate", "object").agg(F.min("ended").alias("_ended"))
    joined = triples.join(ends, ["subject", "predicate", "object"], "left")
    return joined.withColumn("valid_to", F.coalesce("valid_to", "_ended")).drop("_ended").select(*triples.columns)


def rooms_graph(memories: DataFrame) -> DataFrame:
    """Edges (room, wing)."""
    return memories.select("room", "wing").distinct()


def fuzzy_room(edges: DataFrame, name: str, most: int = 2) -> DataFrame:
    """The room of that name: exactly, but for case, or within ``most`` edits."""
    rooms = edges.select("room").distinct()
    distance = F.levenshtein("room", F.lit(name), most)
    rank = F.when(F.col("room") == name, 0).when(F.lower("room") == name.lower(), 1).when(distance >= 0, 2)
    return rooms.withColumns({"_rank": rank, "_distance": distance}).where("_rank IS NOT NULL").orderBy("_rank", "_distance", "room").limit(1).select("room")


def connected_rooms(edges: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """Rooms within ``hops`` (5 at most) steps over shared wings, without the first, by name."""
    start_room = fuzzy_room(edges, start)
    frontier = seen = start_room
    for _ in range(min(hops, MOST_HOPS)):
        wings = edges.join(frontier, "room", "left_semi").select("wing").distinct()
        frontier = edges.join(wings, "wing", "left_semi").select("room").distinct().join(seen, "room", "left_anti")
        seen = seen.unionByName(frontier)
    return seen.join(start_room, "room", "left_anti").orderBy("room")


def tunnels(edges: DataFrame) -> DataFrame:
    """Rooms in several wings."""
    return edges.groupBy("room").agg(F.count_distinct("wing").alias("wings")).where("wings > 1").orderBy("room").select("room")


def rooms_stats(edges: DataFrame) -> DataFrame:
    """Rooms, wings, and rooms per wing."""
    counts = edges.agg(F.count_distinct("room").alias("total_rooms"), F.count_distinct("wing").alias("total_wings"))
    return counts.withColumn("avg_rooms_per_wing", F.when(F.col("total_wings") > 0, F.col("total_rooms") / F.col("total_wings")).otherwise(0.0))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"))
