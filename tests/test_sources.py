import os

from engram.plans.catalogue import oracle_sql, queries
from engram.sources import files, store
from engram.streaming import events


def tree(tmp_path):
    for name, text in {"technical/code.py": "x = 1\n" * 60, "notes.md": "family and kids " * 10, ".git/config.md": "no", "node_modules/a.js": "no", "skip/me.txt": "no", "pic.bin": "no"}.items():
        path = tmp_path / "project" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "project")


def test_project_files_and_mining(spark, tmp_path):
    folder = tree(tmp_path)
    found = files.project_files(spark, folder, ignore=["# comment", "skip/"])
    assert sorted(r.relative for r in found.collect()) == ["notes.md", "technical/code.py"]
    mined = files.mined_project(found, None, "w")
    assert {(r.room, r.wing) for r in mined.collect()} == {("technical", "w"), ("family", "w")}
    assert files.mined_project(found, mined.withColumn("id", mined["chunk_index"]), "w").count() == 0
    assert files.replaced_by_source(mined, mined).count() == mined.count()


def test_conversations(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("> one question\nan answer of many words to keep\n" * 4)
    rows = files.mined_conversations(files.conversation_files(spark, str(tmp_path / "c")), None, "w").collect()
    assert len(rows) == 4 and {r.room for r in rows} == {"convos"}


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "text one", "a", "x"), (2, "text two", "b", "y")], "id long, text_content string, wing string, room string")
    full = store.empty_memories(spark).unionByName(rows, allowMissingColumns=True)
    fixed = store.repaired(full)
    assert all(len(r.embedding) == 64 for r in fixed.collect())
    store.write_memories(fixed, str(tmp_path / "s"))
    plan = store.read_memories(spark, str(tmp_path / "s")).where("wing = 'a'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(wing" in plan._jdf.queryExecution().toString()


def test_config(tmp_path):
    assert store.Config.load(str(tmp_path / "none.json")) == store.Config.load()
    path = tmp_path / "c.json"
    path.write_text('{"topic_wings": ["only"], "people": null, "other": 1}')
    config = store.Config.load(str(path))
    assert config.topic_wings == ["only"] and config.people == {}
    path.write_text("broken")
    assert store.Config.load(str(path)).topic_wings == store.Config().topic_wings
    config.save(str(path))
    assert store.Config.load(str(path)).topic_wings == ["only"]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(2):
        spark.createDataFrame([(i, f"t{i}") for i in range(k * 5, k * 5 + 8)], "id long, text string").write.mode("append").parquet(source)
        events.ingest(events.read_stream(spark, source, "id long, text string"), table, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(13))


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 70
    assert not os.path.exists("spark-warehouse/none")
