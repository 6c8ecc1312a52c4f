import pytest

from engram.plans.views import NOW, view
from engram.sources.store import empty_memories
from engram.tools import TOOLS, Store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    facts = "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double"
    return Store(empty_memories(spark), spark.createDataFrame([], "id string, name string, type string"), spark.createDataFrame([], facts), view(spark, SF, "diary"), NOW)


def test_twenty_tools(store):
    assert len(TOOLS) == 20
    with pytest.raises(ValueError):
        store.call("nothing")


def test_memories(store):
    for room in ("kitchen", "garden"):
        store.call("add_drawer", wing="home", room=room, content=f"the {room} door is green")
    store.call("add_drawer", wing="audit", room="garden", content="entry of the audit")
    assert store.call("status").first().memories == 3
    assert [r.rooms for r in store.call("list_wings").collect()] == [1, 2]
    assert [r.room for r in store.call("list_rooms", wing="home").collect()] == ["garden", "kitchen"]
    assert store.call("get_taxonomy").count() == 3
    assert "the kitchen door is green" in store.call("search", query="kitchen door", n_results=1).first().json
    assert store.call("check_duplicate", content="the kitchen door is green").first().is_duplicate
    assert [r.room for r in store.call("find_tunnels").collect()] == ["garden"]
    assert [r.room for r in store.call("traverse_graph", start_room="kitchen", max_hops=1).collect()] == ["garden"]
    assert store.call("graph_stats").first().total_rooms == 2
    assert not store.call("delete_drawer", id=3).first().deleted and store.call("delete_drawer", id=1).first().deleted
    assert store.call("status").first().memories == 2
    assert store.call("prune").first().merged == 0
    with pytest.raises(ValueError):
        store.call("add_drawer", wing="w", room="r", content="x" * 1_000_001)
    assert store.call("get_format").first().format.startswith("V:3.2")


def test_facts_and_diary(store):
    store.call("kg_add", subject="Ann", predicate="works at", object="Mill", valid_from="2020-01-01")
    store.call("kg_add", subject="Ann", predicate="works at", object="Mill")
    assert store.call("kg_stats").first().triples == 1 and store.call("kg_query", entity="Ann").first().object == "Mill"
    store.call("kg_invalidate", subject="Ann", predicate="works at", object="Mill", ended="2021-01-01")
    assert not store.call("kg_timeline", entity="Ann").first().current
    store.call("diary_write", agent="me", entry="today")
    assert store.call("diary_read", agent="me").first().content == "today"
