import random

import pytest
from pyspark.sql import functions as F

from engram.operators import context, diary, graph, memories, prune, search
from engram.plans.views import NOW, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mem(spark):
    return view(spark, SF, "mem")


def test_valid_at_is_closed_on_both_sides(spark):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, None), (3, 11, None), (4, None, 10)], "id int, valid_from int, valid_to int")
    at = lambda t, **k: {r.id for r in rows.where(memories.valid_at(t, **k)).collect()}
    assert at(5) == {1, 2} and at(10) == {1, 2} and at(11) == {2, 3}
    assert at(10, null_start=True) == {1, 2, 4}


def test_recent_is_ordered_and_bounded(mem):
    rows = memories.recent(mem, "en", limit=7).collect()
    assert len(rows) == 7 and [(-r.valid_from, -r.id) for r in rows] == sorted((-r.valid_from, -r.id) for r in rows)


def test_where_clause_and_protected_wings(spark, mem):
    assert mem.where(memories.where_clause(None)).count() == mem.count()
    both = memories.where_clause({"$and": [{"wing": "en"}, {"room": "src1"}]})
    assert {(r.wing, r.room) for r in mem.where(both).collect()} <= {("en", "src1")}
    held = spark.createDataFrame([(1, "audit"), (2, "x")], "id long, wing string")
    assert [r.id for r in memories.without(held, held.select("id")).collect()] == [1]


def test_append_counts_on_and_refuses_too_many(spark):
    store = spark.createDataFrame([(7, "old", "w", "r")], "id long, text_content string, wing string, room string")
    new = spark.createDataFrame([("a", "w", "r"), ("b", "w", "r")], "text_content string, wing string, room string")
    rows = memories.appended(store, new, NOW).orderBy("id").collect()
    assert [(r.id, r.importance_score) for r in rows] == [(7, None), (8, 5.0), (9, 5.0)]
    with pytest.raises(ValueError):
        memories.appended(store, new, NOW, most=2)


def test_append_numbers_rows_of_many_partitions(spark):
    store = spark.createDataFrame([(7, "old", "w", "r")], "id long, text_content string, wing string, room string")
    new = spark.range(1000).selectExpr("concat('t', lpad(id, 4, '0')) AS text_content", "'w' AS wing", "'r' AS room").repartition(9)
    rows = memories.appended(store, new, NOW).where("id > 7").orderBy("id").collect()
    assert [(r.id, r.text_content) for r in rows] == [(8 + i, f"t{i:04d}") for i in range(1000)]


def test_rewritten_texts_have_new_vectors(spark):
    from engram.functions.vector import hashed_embedding

    held = spark.createDataFrame([(1, "one two"), (2, "three")], "id long, text_content string").withColumn("embedding", hashed_embedding(F.col("text_content")))
    rewrites = spark.createDataFrame([(1, "four five", 3), (1, "old", 2)], "id long, text_content string, at int")
    got = {r.id: r for r in memories.current_view(held, rewrites=rewrites).withColumn("want", hashed_embedding(F.col("text_content"))).collect()}
    assert got[1].text_content == "four five" and all(r.embedding == r.want for r in got.values())


def test_a_judge_sees_batches(spark):
    from engram.operators import evaluate

    rows = spark.createDataFrame([("yes it is", "it"), ("no", "it")], "answer string, nugget string")
    judge = lambda answers, nuggets: answers.combine(nuggets, lambda a, n: float(n in a))
    assert [r.score for r in evaluate.judged(rows, judge).collect()] == [1.0, 0.0]


def test_search_finds_itself_first(spark):
    vec = view(spark, SF, "vec")
    one = vec.where("id = 42").first()
    top = search.knn(vec, list(one.embedding), 3).collect()
    assert top[0].id == 42 and top[0].score == 1.0 and search.knn(vec, list(one.embedding), 0).count() == 0
    assert search.duplicate_check(vec, list(one.embedding)).first().is_duplicate
    assert search.knn(vec, list(one.embedding), 5, wing="w1", honor_partial_filters=False).count() == 5
    batch = search.knn_batch(vec, vec.where("id < 30"), 5)
    joined = search.knn_join(vec, vec.where("id < 30"), 5, block=16)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, batch.collect()))
    assert batch.where("query_id = id AND rank = 1").count() == 30 and batch.count() == 150
    cells = search.knn_cells(vec, vec.where("id < 30"), 5, cells=8, probes=8)
    assert {tuple(r) for r in cells.select("query_id", "id").collect()} == {tuple(r) for r in batch.select("query_id", "id").collect()}


def test_prune_equals_a_visit_in_order(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
        owner = {}
        for i in range(40):
            if i not in owner:
                owner[i] = i
                for j in sorted(j for s, j in edges if s == i):
                    owner.setdefault(j, i)
        got = prune.clusters(spark.createDataFrame(list(edges), "src long, dst long"), spark.range(40))
        assert {r.id: r.seed for r in got.collect()} == owner


def test_knowledge_graph_over_time(spark):
    people = spark.createDataFrame([("alice", "Alice", "p"), ("london", "London", "c"), ("paris", "Paris", "c")], "id string, name string, type string")
    empty = spark.createDataFrame([], "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    new = spark.createDataFrame([("Alice", "Lives in", "London", "2020-01-01", "2022-01-01", 1.0), ("Alice", "Lives in", "Paris", "2022-01-02", None, 1.0)], "subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    facts = graph.add_triples(empty, new)
    assert graph.add_triples(facts, new.where("valid_to IS NULL")).count() == 2
    where = lambda t: [r.object for r in graph.query_entity(facts, people, "Alice", "outgoing", t).collect()]
    assert where("2021-05-05") == ["London"] and where("2023-01-01") == ["Paris"]
    ended = graph.invalidate(facts, spark.createDataFrame([("alice", "lives_in", "paris", "2024-01-01")], "subject string, predicate string, object string, ended string"))
    assert [r.current for r in graph.query_entity(ended, people, "Alice", "outgoing").collect()] == [False, False]
    assert [r.object for r in graph.timeline(facts, people, "Alice").collect()] == ["London", "Paris"]


def test_rooms(spark):
    edges = spark.createDataFrame([("Kitchen", "Main"), ("Living Room", "Main"), ("Living Room", "West Wing"), ("Bedroom", "West Wing")], "room string, wing string")
    reach = lambda start, hops: [r.room for r in graph.connected_rooms(edges, start, hops).collect()]
    assert reach("Kitchen", 1) == ["Living Room"] and reach("kitchin", 2) == ["Bedroom", "Living Room"] and reach("Unknown", 2) == []
    assert [r.room for r in graph.tunnels(edges).collect()] == ["Living Room"]


def test_diary(spark):
    book = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "id long, agent string, content string").withColumn("entry_ts", F.timestamp_seconds(F.col("id")))
    assert [r.id for r in diary.last_entries(book, "a", 5).collect()] == [1, 3]
    assert tuple(diary.diary_stats(book).first()) == (3, 2)
    assert diary.without_entry(book, 2).count() == 2


def test_story_stays_within_its_budget(mem):
    lines = context.story_lines(mem, NOW).collect()
    assert lines and lines[-1].total <= context.STORY_CHARS
    assert context.story(mem.limit(0), NOW).first().text == "## L1 — No memories yet."
    assert context.wake_up(mem, NOW, "I am").first().text.startswith("I am\n\n## L1 — ESSENTIAL STORY\n### ")


def test_layers_of_context(spark):
    vec = view(spark, SF, "vec").select("id", "embedding", "valid_from", "valid_to")
    held = view(spark, SF, "mem").drop("valid_from", "valid_to").join(vec, "id")
    stack = context.Stack(held, NOW, "I am")
    assert stack.wake_up().first().text.startswith("I am")
    assert stack.recall("en", limit=3).count() == 3
    one = held.first()
    assert stack.search(list(one.embedding), 1).first().id == one.id


def test_vectors_in_few_bits(spark):
    from engram.functions import vector as V

    rng = random.Random(2)
    rows = [([rng.uniform(-1, 1) for _ in range(100)], [rng.uniform(-1, 1) for _ in range(100)]) for _ in range(5)]
    for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select("a", "b", V.hamming_words(V.to_bits(F.col("a")), V.to_bits(F.col("b"))).alias("n"), V.from_i8(V.to_i8(F.col("a"))).alias("near")).collect():
        assert r.n == sum((x > 0) != (y > 0) for x, y in zip(r.a, r.b))
        assert max(abs(x - y) for x, y in zip(r.a, r.near)) <= 0.5 / 127 + 1e-6
