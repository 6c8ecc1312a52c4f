"""The store on disk: Parquet by wing and room, sessions as text files, metrics as JSON, configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.vector import hashed_embedding

MEMORY_SCHEMA = (
    "id long, text_content string, wing string, room string, source_file string, source_mtime double, valid_from long, valid_to long, "
    "last_accessed long, access_count long, importance_score double, embedding array<float>"
)


def write_memories(memories: DataFrame, path: str, mode: str = "append") -> None:
    """Memories in folders of their wing and room, so that filters on either read those only."""
    memories.repartition("wing", "room").write.mode(mode).partitionBy("wing", "room").parquet(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def empty_memories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMORY_SCHEMA)


#: The tables of a store by name.
SCHEMAS = {
    "memories": MEMORY_SCHEMA,
    "entities": "id string, name string, type string",
    "triples": "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double",
    "diary": "id long, agent string, content string, entry_ts timestamp",
    "people": "name string, confidence double, aliases array<string>, ambiguous boolean",
}


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a table, ascending."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [x.getPath().getName() for x in files.listStatus(top)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and files.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def read_table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The last complete version of a table of a store, with all columns of its schema; empty if there is none."""
    empty = spark.createDataFrame([], SCHEMAS[name])
    versions = _versions(spark, f"{store}/{name}")
    if not versions:
        return empty
    return empty.unionByName(spark.read.schema(SCHEMAS[name]).parquet(f"{store}/{name}/v{versions[-1]}"), allowMissingColumns=True)


def write_table(table: DataFrame, store: str, name: str) -> None:
    """A new version beside the ones there are: readers of those, this table among them, aren't disturbed."""
    versions = _versions(table.sparkSession, f"{store}/{name}")
    parts = [c for c in ("wing", "room") if c in table.columns]
    written = table.repartition(*parts).write.partitionBy(*parts) if parts else table.write
    written.parquet(f"{store}/{name}/v{versions[-1] + 1 if versions else 0}")


def repaired(memories: DataFrame, dimension: int = 64, everything: bool = False) -> DataFrame:
    """Memories with vectors for those that have none, or for all."""
    fresh = hashed_embedding(F.col("text_content"), dimension)
    return memories.withColumn("embedding", fresh if everything else F.coalesce("embedding", fresh))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A folder of text for each session's name."""
    sessions.select("name", F.col("content").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Config:
    """Settings; a file may give some of them, and one that can't be read gives none."""

    store_path: str = "~/.engram/store"
    topic_wings: list[str] = field(default_factory=lambda: list(L.TOPIC_WINGS))
    hall_keywords: dict[str, list[str]] = field(default_factory=lambda: dict(L.HALL_KEYWORDS))
    people: dict[str, str] = field(default_factory=dict)
    emotions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, environment: str = "ENGRAM_STORE_PATH") -> Config:
        found = {}
        try:
            data = json.loads(Path(os.path.expanduser(path)).read_text(encoding="utf-8")) if path else {}
            found = {f.name: data[f.name] for f in fields(cls) if isinstance(data, dict) and isinstance(data.get(f.name), type(getattr(cls(), f.name)))}
        except (OSError, ValueError):
            pass
        config = replace(cls(), **found)
        return replace(config, store_path=os.path.expanduser(os.environ.get(environment, config.store_path)))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, indent=2), encoding="utf-8")
