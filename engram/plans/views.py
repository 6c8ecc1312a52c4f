"""Views that read the test tables as memories, vectors, facts, rooms, a diary and transcripts.

Each is SQL that Spark and DuckDB read alike; names of tables stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The time at which decay is taken.
NOW = 1710000000

VIEWS = {
    "mem": """
        SELECT doc_id AS id, text AS text_content, lang AS wing, source AS room,
          concat('corpus/', source, '/doc_', CAST(doc_id AS STRING), '.txt') AS source_file,
          CAST(1704067200 + doc_id * 3600 AS BIGINT) AS valid_from,
          CASE WHEN doc_id % 5 = 0 THEN CAST(1704067200 + doc_id * 3600 + 2592000 AS BIGINT) END AS valid_to,
          CAST(1704067200 + doc_id * 3600 + (doc_id % 11) * 86400 AS BIGINT) AS last_accessed,
          CAST(doc_id % 7 AS BIGINT) AS access_count, CAST(1.0 + doc_id % 9 AS DOUBLE) AS importance_score FROM {documents}""",
    "vec": """
        SELECT vec_id AS id, embedding, concat('w', CAST(label AS STRING)) AS wing, concat('r', CAST(vec_id % 3 AS STRING)) AS room,
          CAST(1704067200 + vec_id * 3600 AS BIGINT) AS valid_from,
          CASE WHEN vec_id % 4 = 0 THEN CAST(1704067200 + vec_id * 3600 + 864000 AS BIGINT) END AS valid_to FROM {embeddings}""",
    "kg_entities": """
        SELECT replace(lower(c_name), ' ', '_') AS id, c_name AS name, 'customer' AS type FROM {customer}
        UNION ALL SELECT concat('segment_', lower(c_mktsegment)), c_mktsegment, 'segment' FROM (SELECT DISTINCT c_mktsegment FROM {customer}) s
        UNION ALL SELECT concat('priority_', replace(lower(o_orderpriority), ' ', '_')), o_orderpriority, 'priority' FROM (SELECT DISTINCT o_orderpriority FROM {orders}) p""",
    "kg_triples": """
        SELECT concat('t_o_', CAST(o.o_orderkey AS STRING)) AS id, replace(lower(c.c_name), ' ', '_') AS subject, 'ordered_with' AS predicate,
          concat('priority_', replace(lower(o.o_orderpriority), ' ', '_')) AS object, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS valid_from,
          CASE WHEN o.o_orderstatus = 'F' THEN CAST(CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 365 DAY AS DATE) AS STRING) END AS valid_to,
          CAST(1.0 AS DOUBLE) AS confidence FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        UNION ALL SELECT concat('t_s_', CAST(c_custkey AS STRING)), replace(lower(c_name), ' ', '_'), 'in_segment', concat('segment_', lower(c_mktsegment)),
          CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(0.9 AS DOUBLE) FROM {customer}""",
    "rooms": """
        SELECT DISTINCT concat('wing_', CAST(vec_id % 40 AS STRING)) AS wing, concat('room_', CAST((vec_id * 7 + label) % 150 AS STRING)) AS room
        FROM {embeddings}""",
    "diary": "SELECT event_id AS id, concat('agent_', CAST(user_id AS STRING)) AS agent, event_type AS content, ts AS entry_ts FROM {events}",
    "access": "SELECT user_id AS id, ts AS at FROM {events}",
    "transcript": "SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('> ', text) ELSE text END AS line FROM {conversations} WHERE role <> 'system'",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a test table itself."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views that it names in front."""
    used = [f"{n} AS ({v.format(**{t: t for t in TABLES})})" for n, v in VIEWS.items() if f"FROM {n}" in sql or f"JOIN {n}" in sql]
    return f"WITH {', '.join(used)} {sql}" if used else sql
