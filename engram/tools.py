"""The twenty tools of an agent's memory by name, over the tables of a store.

``Store.call(name, **arguments)`` returns a DataFrame. Tools that write replace the store's
DataFrames by new ones; nothing is kept anywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import VERSION
from engram.functions.vector import hashed_embedding
from engram.operators import context, diary, graph, memories, prune, search

#: Bytes of a memory's text, and results of a search.
MOST_BYTES, MOST_FOUND = 1_000_000, 100
FORMAT = f"""{VERSION}
wing|room|date|title
0:ENTITIES|topics|"key sentence"|emotions|FLAGS
JSON:{{...}}
Decisions name WHO, WHAT, WHY and CONFIDENCE; otherwise the text stays raw."""


@dataclass
class Store:
    """Tables: memories with vectors, entities, triples, diary (see ``plans.views`` for their columns); ``now`` in seconds."""

    memories: DataFrame
    entities: DataFrame
    triples: DataFrame
    diary: DataFrame
    now: int
    embed: object = field(default=hashed_embedding)

    def call(self, tool: str, **arguments) -> DataFrame:
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool}")
        return TOOLS[tool](self, **arguments)

    def _one(self, **columns) -> DataFrame:
        return self.memories.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))

    def _query(self, text: str) -> list[float]:
        return list(self._one(t=text).select(self.embed(F.col("t")).alias("e")).first().e)


def _status(s: Store) -> DataFrame:
    return memories.status(s.memories).withColumn("format", F.lit(VERSION))


def _add(s: Store, wing: str, room: str, content: str, source_file: str | None = None) -> DataFrame:
    if len(content.encode()) > MOST_BYTES:
        raise ValueError("content is too long")
    new = s._one(text_content=content, wing=wing, room=room).withColumns({"source_file": F.lit(source_file).cast("string"), "embedding": s.embed(F.col("text_content"))})
    s.memories = memories.appended(s.memories, new, s.now, memories.MOST_MEMORIES)
    return s.memories.orderBy(F.desc("id")).limit(1).select("id", "wing", "room")


def _delete(s: Store, id: int) -> DataFrame:
    row = memories.by_id(s.memories, id).select("id", "wing")
    s.memories = memories.without(s.memories, row)
    return row.select("id", (~F.col("wing").isin(memories.L.PROTECTED_WINGS)).alias("deleted"))


def _search(s: Store, query: str, wing: str | None = None, room: str | None = None, n_results: int = 5) -> DataFrame:
    vectors = s.memories.select("id", "embedding", "wing", "room", "valid_from", "valid_to")
    return context.search_json(s.memories, vectors, query, s._query(query), min(n_results, MOST_FOUND), wing, room)


def _kg_add(s: Store, subject: str, predicate: str, object: str, valid_from: str | None = None) -> DataFrame:
    named = s._one(subject=subject, predicate=predicate, object=object).withColumns({"valid_from": F.lit(valid_from).cast("string"), "valid_to": F.lit(None).cast("string"), "confidence": F.lit(1.0)})
    ends = s._one(name=subject, type="unknown").unionByName(s._one(name=object, type="unknown")).select(graph.slug("name").alias("id"), "name", "type")
    s.entities = s.entities.unionByName(ends.join(s.entities.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    s.triples = graph.add_triples(s.triples, named)
    return named.select(graph.slug("subject").alias("subject"), graph.predicate_slug("predicate").alias("predicate"), graph.slug("object").alias("object"))


def _kg_invalidate(s: Store, subject: str, predicate: str, object: str, ended: str) -> DataFrame:
    row = s._one(subject=subject, predicate=predicate, object=object, ended=ended)
    s.triples = graph.invalidate(s.triples, row)
    return row


def _kg_query(s: Store, entity: str, direction: str = "both", as_of: str | None = None) -> DataFrame:
    found = graph.query_entity(s.triples, s.entities, entity, direction, as_of)
    return found.limit(graph.MOST_RESULTS).join(F.broadcast(found.agg((F.count(F.lit(1)) > graph.MOST_RESULTS).alias("capped"))))


def _diary_write(s: Store, agent: str, entry: str) -> DataFrame:
    import datetime

    s.diary = diary.written_entry(s.diary, agent, entry, datetime.datetime.fromtimestamp(s.now, datetime.UTC).replace(tzinfo=None))
    return diary.last_entries(s.diary, agent, 1)


def _prune(s: Store, threshold: float = 0.85, dry_run: bool = True, wing: str | None = None) -> DataFrame:
    found = prune.prune(s.memories.drop("embedding"), s.memories.select("id", "embedding"), s.now, threshold, wing)
    if not dry_run:
        s.memories = s.memories.join(found.where("NOT kept").select("id"), "id", "left_anti")
    return prune.report(found)


TOOLS = {
    "status": _status,
    "list_wings": lambda s: memories.list_wings(s.memories),
    "list_rooms": lambda s, wing=None: memories.list_rooms(s.memories, wing),
    "get_taxonomy": lambda s: memories.taxonomy(s.memories),
    "search": _search,
    "check_duplicate": lambda s, content, threshold=0.9: search.duplicate_check(s.memories.select("id", "embedding"), s._query(content), threshold),
    "get_format": lambda s: s._one(format=FORMAT),
    "traverse_graph": lambda s, start_room, max_hops=2: graph.connected_rooms(graph.rooms_graph(s.memories), start_room, max_hops),
    "find_tunnels": lambda s: graph.tunnels(graph.rooms_graph(s.memories)),
    "graph_stats": lambda s: graph.rooms_stats(graph.rooms_graph(s.memories)),
    "add_drawer": _add,
    "delete_drawer": _delete,
    "kg_query": _kg_query,
    "kg_add": _kg_add,
    "kg_invalidate": _kg_invalidate,
    "kg_timeline": lambda s, entity: graph.timeline(s.triples, s.entities, entity),
    "kg_stats": lambda s: graph.graph_stats(s.triples, s.entities),
    "diary_write": _diary_write,
    "diary_read": lambda s, agent, last_n=10: diary.last_entries(s.diary, agent, last_n),
    "prune": _prune,
}
