"""The queries over the test tables, one or more for each operator, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions import text as T
from engram.functions import vector as V
from engram.operators import chunking, context, diary, entities, evaluate, extract, graph, memories, prune, search, sessions, spelling, summary, transcripts
from engram.plans.views import NOW, view, with_views
from engram.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A query vector of the tests' dimension, by rule.
PROBE = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_PROBE = "[" + ",".join(map(str, PROBE)) + "]::DOUBLE[]"
_EMB = "list_transform(embedding, lambda x: x::DOUBLE)"


def _cos(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


_SCORE = _cos(_EMB, _PROBE)


def query(oracle: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = with_views(oracle)
        return run

    return add


def values(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _values_sql(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(texts)) + ") v(id, text)"


# --- vectors ---------------------------------------------------------------------------------


@query(f"SELECT id, wing, room, valid_from, valid_to, {_SCORE} AS score FROM vec WHERE wing = 'w3' AND valid_from <= 1705500000 AND (valid_to IS NULL OR valid_to >= 1705500000) ORDER BY score DESC, id LIMIT 10")
def vec_filtered_knn(spark, d):
    return search.knn(view(spark, d, "vec"), PROBE, 10, wing="w3", at=1705500000)


@query(f"SELECT id, wing, room, valid_from, valid_to, {_SCORE} AS score FROM vec ORDER BY score DESC, id LIMIT 10")
def vec_global_knn(spark, d):
    return search.knn(view(spark, d, "vec"), PROBE, 10)


@query(f"SELECT id, {_SCORE} AS score, {_SCORE} >= 0.9 AS is_duplicate FROM vec ORDER BY score DESC, id LIMIT 1")
def vec_duplicate_check(spark, d):
    return search.duplicate_check(view(spark, d, "vec"), PROBE)


_PAIRS = f"SELECT q.id AS query_id, v.id, {_cos('q.e', 'v.e')} AS score FROM (SELECT id, {_EMB} AS e FROM vec WHERE id % 20 = 0) q, (SELECT id, {_EMB} AS e FROM vec) v"


@query(f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_PAIRS}) QUALIFY rank <= 10")
def vec_knn_batch(spark, d):
    vec = view(spark, d, "vec")
    return search.knn_batch(vec, vec.where("id % 20 = 0"), 10)


@query()
def vec_knn_cells(spark, d):
    vec = view(spark, d, "vec")
    return search.knn_cells(vec, vec.where("id % 20 = 0"), 10, cells=16, probes=12)


def _distance(name: str, sql: str):
    def run(spark, d):
        return view(spark, d, "vec").select("id", F.round(V.DISTANCES[name](F.col("embedding"), F.array(*map(F.lit, PROBE))), 6).alias("distance"))

    run.__name__ = f"vec_distance_{name}"
    query(f"SELECT id, round({sql}, 6) AS distance FROM vec")(run)


_distance("cosine", f"1 - list_dot_product({_EMB}, {_PROBE}) / (sqrt(list_dot_product({_EMB}, {_EMB})) * sqrt(list_dot_product({_PROBE}, {_PROBE})))")
_distance("inner", f"1 - list_dot_product({_EMB}, {_PROBE})")
_distance("sqeuclidean", f"list_sum(list_transform(list_zip({_EMB}, {_PROBE}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))")


_CENTRED = f"SELECT id, e, p, list_avg(e) AS m, list_avg(p) AS n FROM (SELECT id, {_EMB} AS e, {_PROBE} AS p FROM vec)"


@query(f"SELECT id, round(1 - list_sum(list_transform(list_zip(e, p), lambda z: (z[1] - m) * (z[2] - n))) / sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) * list_sum(list_transform(p, lambda x: (x - n) * (x - n)))), 6) AS distance FROM ({_CENTRED})")
def vec_distance_pearson(spark, d):
    return view(spark, d, "vec").select("id", F.round(V.pearson_distance(F.col("embedding"), F.array(*map(F.lit, PROBE))), 6).alias("distance"))


def _shares(column: str) -> str:
    """Squares as parts of their sum: a distribution."""
    return f"list_transform({column}, lambda x: x * x / list_dot_product({column}, {column}))"


_PART = "CASE WHEN z[{a}] > 0 THEN z[{a}] * ln(2 * z[{a}] / (z[1] + z[2])) ELSE 0 END / 2"


@query(f"SELECT id, round(list_sum(list_transform(list_zip(a, b), lambda z: {_PART.format(a=1)} + {_PART.format(a=2)})), 6) AS distance FROM (SELECT id, {_shares('e')} AS a, {_shares('p')} AS b FROM ({_CENTRED}))")
def vec_distance_divergence(spark, d):
    def shares(v):
        return F.transform(v, lambda x: x.cast("double") * x.cast("double") / V.dot(v, v))

    rows = view(spark, d, "vec").select("id", shares(F.col("embedding")).alias("a"), shares(F.array(*map(F.lit, PROBE))).alias("b"))
    return rows.select("id", F.round(V.divergence(F.col("a"), F.col("b")), 6).alias("distance"))


@query("""SELECT c_custkey, round(1 - bit_count(c_custkey & 12345) / bit_count(c_custkey | 12345), 6) AS jaccard, round(1 - 2 * bit_count(c_custkey & 12345) / (bit_count(c_custkey) + bit_count(12345)), 6) AS sorensen,
    len(list_filter(range(1, greatest(length(c_name), length(c_mktsegment)) + 1), lambda i: c_name[i] <> c_mktsegment[i])) AS unlike,
    round(1 - len(list_intersect(string_split(lower(c_name), ''), string_split(lower(c_mktsegment), ''))) / len(list_distinct(list_concat(string_split(lower(c_name), ''), string_split(lower(c_mktsegment), '')))), 6) AS letters FROM customer""")
def fn_set_distances(spark, d):
    c, other = view(spark, d, "customer"), F.lit(12345).cast("long")
    key = F.col("c_custkey").cast("long")
    letters = V.jaccard_sets(*(F.array_distinct(F.split(F.lower(x), "")) for x in ("c_name", "c_mktsegment")))
    return c.select("c_custkey", F.round(V.jaccard_bits(key, other), 6).alias("jaccard"), F.round(V.sorensen_bits(key, other), 6).alias("sorensen"), V.hamming_unicode(F.col("c_name"), F.col("c_mktsegment")).alias("unlike"), F.round(letters, 6).alias("letters"))


@query("SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(s - c) / 2), 2) + cos(radians(c)) * cos(radians(s)) * pow(sin(radians(n - m) / 2), 2)))), 3) AS meters, levenshtein(c_name, c_mktsegment) AS edits, bit_count(xor(c_custkey, 12345)) AS bits FROM (SELECT *, c_custkey % 90 AS c, c_nationkey AS s, c_custkey % 180 AS m, c_nationkey * 3 AS n FROM customer)")
def fn_distances(spark, d):
    c = view(spark, d, "customer")
    lat, lon = F.col("c_custkey") % 90, F.col("c_custkey") % 180
    meters = V.haversine_meters(lat.cast("double"), lon.cast("double"), F.col("c_nationkey").cast("double"), (F.col("c_nationkey") * 3).cast("double"))
    return c.select("c_custkey", F.round(meters, 3).alias("meters"), F.levenshtein("c_name", "c_mktsegment").alias("edits"), V.hamming_bits(F.col("c_custkey"), F.lit(12345)).alias("bits"))


@query()
def vec_prune_clusters(spark, d):
    vec, mem = view(spark, d, "vec"), view(spark, d, "mem").select("id", "text_content", "last_accessed", "access_count", "importance_score")
    return prune.prune(vec.select("id", "wing").join(mem, "id"), vec.select("id", "embedding"), NOW, theta=0.3)


@query()
def vec_prune_report(spark, d):
    return prune.report(vec_prune_clusters(spark, d))


# --- memories --------------------------------------------------------------------------------

_MEM = "id, wing, room, source_file, valid_from, valid_to, last_accessed, access_count, importance_score"
_DECAY = f"importance_score * pow(0.9, greatest(({NOW} - last_accessed) / 86400.0::DOUBLE, 0)) * greatest(ln(1.0 + access_count), 1.0)"


@query(f"SELECT {_MEM} FROM mem WHERE wing = 'en' AND room = 'src1' ORDER BY valid_from DESC, id DESC LIMIT 20")
def mem_by_wing_room(spark, d):
    return memories.recent(view(spark, d, "mem"), "en", "src1", 20).drop("text_content")


@query(f"SELECT {_MEM} FROM mem WHERE valid_from <= 1706000000 AND (valid_to IS NULL OR valid_to >= 1706000000)")
def mem_valid_at(spark, d):
    return view(spark, d, "mem").where(memories.valid_at(1706000000)).drop("text_content")


@query(f"SELECT {_MEM} FROM mem WHERE wing = 'fr' AND room = 'src3'")
def mem_where_clause(spark, d):
    return view(spark, d, "mem").where(memories.where_clause({"$and": [{"wing": "fr"}, {"room": "src3"}]})).drop("text_content")


@query(f"SELECT {_MEM} FROM mem WHERE id = 77")
def mem_by_id(spark, d):
    return memories.by_id(view(spark, d, "mem"), 77).drop("text_content")


@query("SELECT id FROM mem WHERE wing = 'de'")
def mem_ids(spark, d):
    return memories.ids(view(spark, d, "mem"), "de")


@query(f"SELECT id, round({_DECAY}, 6) AS importance, least(round(importance_score * 2), 9)::INT AS weight FROM mem")
def mem_decayed_importance(spark, d):
    score = T.decayed_importance(F.col("importance_score"), F.col("last_accessed"), F.col("access_count"), NOW)
    return view(spark, d, "mem").select("id", F.round(score, 6).alias("importance"), T.display_weight(F.col("importance_score")).alias("weight"))


@query("SELECT DISTINCT wing, room FROM mem")
def mem_wings_rooms(spark, d):
    return memories.wings_rooms(view(spark, d, "mem"))


@query("SELECT wing, count(DISTINCT room) AS rooms, false AS capped FROM mem GROUP BY wing")
def mem_list_wings(spark, d):
    return memories.list_wings(view(spark, d, "mem"))


@query("SELECT DISTINCT room FROM mem WHERE wing = 'en'")
def mem_list_rooms(spark, d):
    return memories.list_rooms(view(spark, d, "mem"), "en")


@query("SELECT wing, room, count(*) AS memories FROM mem GROUP BY ALL")
def mem_taxonomy(spark, d):
    return memories.taxonomy(view(spark, d, "mem"))


@query("SELECT count(*) AS memories, count(DISTINCT wing) AS wings, count(DISTINCT room) AS rooms FROM mem")
def mem_status(spark, d):
    return memories.status(view(spark, d, "mem"))


@query("SELECT id, count(*) AS access_count, max(access.\"at\") AS last_accessed FROM access GROUP BY id")
def mem_touch_rollup(spark, d):
    return memories.touches(view(spark, d, "access"))


@query("SELECT source_file, max_by(last_accessed::DOUBLE, id) AS source_mtime FROM mem GROUP BY source_file")
def mem_latest_mtimes(spark, d):
    return memories.latest_mtimes(view(spark, d, "mem").withColumn("source_mtime", F.col("last_accessed").cast("double")))


@query("SELECT source_file, last_accessed::DOUBLE AS source_mtime FROM mem WHERE id % 3 <> 0 OR id % 2 = 0")
def mem_incremental_new(spark, d):
    mem = view(spark, d, "mem").withColumn("source_mtime", F.col("last_accessed").cast("double"))
    stored = mem.where("id % 3 = 0").withColumn("source_mtime", F.col("source_mtime") + F.when(F.col("id") % 2 == 0, 5.0).otherwise(0.0005))
    return memories.new_or_changed(mem.select("source_file", "source_mtime"), stored)


@query("SELECT id, wing FROM mem WHERE id % 4 <> 0 OR wing = 'es'")
def mem_after_delete(spark, d):
    mem = view(spark, d, "mem")
    return memories.without(mem, mem.where("id % 4 = 0").select("id"), ["es"]).select("id", "wing")


@query("SELECT m.id, CASE WHEN m.id % 10 = 3 THEN 'rewritten' ELSE m.text_content END AS text_content, m.access_count + coalesce(a.n, 0) AS access_count FROM mem m LEFT JOIN (SELECT id, count(*) AS n FROM access GROUP BY id) a ON m.id = a.id WHERE m.id % 10 <> 4")
def mem_current_view(spark, d):
    mem = view(spark, d, "mem")
    accesses = view(spark, d, "access").select("id", F.lit(0).cast("long").alias("at"))
    rewrites = mem.where("id % 10 = 3").select("id", F.lit("rewritten").alias("text_content"), F.lit(1).alias("at"))
    return memories.current_view(mem, accesses, mem.where("id % 10 = 4").select("id"), rewrites).select("id", "text_content", "access_count")


# --- context ---------------------------------------------------------------------------------

_TOP = f"SELECT id, room, source_file, text_content, valid_from, round({_DECAY} + CASE WHEN strlen(text_content) > 0 THEN 100.0::DOUBLE / strlen(text_content) * 0.1 ELSE 0 END, 6) AS importance FROM (SELECT * FROM mem ORDER BY valid_from DESC, id DESC LIMIT 100) ORDER BY importance DESC, valid_from DESC, id DESC LIMIT 15"
_SNIP = "CASE WHEN length(t) > {n} THEN substr(t, 1, {n} - 3) || '...' ELSE t END"


@query(f"SELECT id, room, importance, source_file FROM ({_TOP})")
def ctx_l1_top15(spark, d):
    return context.story_top(view(spark, d, "mem"), NOW).drop("text_content", "valid_from")


_LINES = f"""SELECT place, room, head, line, total FROM (SELECT *, sum(length(line) + coalesce(length(head), 0)) OVER (ORDER BY place) AS total FROM (
    SELECT room, row_number() OVER (ORDER BY room, importance DESC, valid_from DESC, id DESC) AS place,
      CASE WHEN row_number() OVER (PARTITION BY room ORDER BY importance DESC, valid_from DESC, id DESC) = 1 THEN '### ' || upper(room) END AS head,
      '  - WT:' || least(round(importance * 2), 9)::INT || '| ' || {_SNIP.format(n=200)} || '  (' || regexp_extract(source_file, '[^/]*$') || ')' AS line
    FROM (SELECT *, replace(regexp_replace(text_content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM ({_TOP})))) WHERE total <= 3200"""


@query(_LINES)
def ctx_l1_budget(spark, d):
    return context.story_lines(view(spark, d, "mem"), NOW)


@query(f"""SELECT '## L0 — IDENTITY' || chr(10) || 'No identity configured.' || chr(10) || chr(10) || '## L1 — ESSENTIAL STORY' || chr(10)
    || string_agg(concat_ws(chr(10), head, line), chr(10) ORDER BY place) || CASE WHEN count(*) < (SELECT count(*) FROM ({_TOP})) THEN chr(10) || '  ... (more in L3 search)' ELSE '' END AS text FROM ({_LINES})""")
def ctx_l1_story(spark, d):
    return context.wake_up(view(spark, d, "mem"), NOW)


@query(f"SELECT id, '  [' || room || '] ' || {_SNIP.format(n=300)} || '  (' || regexp_extract(source_file, '[^/]*$') || ')' AS line FROM (SELECT *, replace(regexp_replace(text_content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM mem WHERE wing = 'en' ORDER BY valid_from DESC, id DESC LIMIT 25)")
def ctx_l2_lines(spark, d):
    return context.recall_lines(view(spark, d, "mem"), "en", limit=25)


_FOUND = f"""SELECT v.id, score, row_number() OVER (ORDER BY score DESC, v.id) AS rank, m.wing, m.room, m.source_file, text_content, replace(regexp_replace(text_content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t
    FROM (SELECT id, {_SCORE} AS score FROM vec ORDER BY score DESC, id LIMIT 5) v JOIN mem m ON v.id = m.id"""


@query(f"SELECT rank, id, '  [' || rank || '] ' || wing || '/' || room || ' (sim=' || printf('%.3f', score) || ') ' || {_SNIP.format(n=300)} AS line FROM ({_FOUND})")
def ctx_search_lines(spark, d):
    return context.search_lines(view(spark, d, "mem"), view(spark, d, "vec").select("id", "embedding", "wing", "room", "valid_from", "valid_to"), PROBE)


@query(f"""SELECT '{{"query":"probe","filters":{{}},"results":' || to_json(coalesce(list({{'text': text_content, 'wing': wing, 'room': room, 'source_file': source_file, 'similarity': score}} ORDER BY score DESC, id), []))::VARCHAR || '}}' AS json FROM ({_FOUND})""")
def ctx_search_json(spark, d):
    return context.search_json(view(spark, d, "mem"), view(spark, d, "vec"), "probe", PROBE)


# --- knowledge graph and rooms ---------------------------------------------------------------

_WHO = "Customer#000000007"
_OUT = "SELECT 'outgoing' AS direction, '{w}' AS subject, t.predicate, e.name AS object, t.valid_from, t.valid_to, t.confidence, t.valid_to IS NULL AS current, t.id FROM kg_triples t JOIN kg_entities e ON t.object = e.id WHERE t.subject = '{s}'"
_IN = "SELECT 'incoming' AS direction, e.name AS subject, t.predicate, '{w}' AS object, t.valid_from, t.valid_to, t.confidence, t.valid_to IS NULL AS current, t.id FROM kg_triples t JOIN kg_entities e ON t.subject = e.id WHERE t.object = '{s}'"


def _who(sql: str, name: str) -> str:
    return sql.format(w=name, s=name.lower().replace(" ", "_"))


def _facts(spark, d, *args, **options):
    return graph.query_entity(view(spark, d, "kg_triples"), view(spark, d, "kg_entities"), *args, **options)


@query(_who(_OUT, _WHO))
def kg_outgoing(spark, d):
    return _facts(spark, d, _WHO, "outgoing")


@query(_who(_IN, "segment_BUILDING"))
def kg_incoming(spark, d):
    return _facts(spark, d, "segment_BUILDING", "incoming")


@query(_who(_OUT, _WHO) + " UNION ALL " + _who(_IN, _WHO))
def kg_both(spark, d):
    return _facts(spark, d, _WHO)


@query(_who(_OUT, _WHO) + " AND (t.valid_from IS NULL OR t.valid_from <= '1999-06-30') AND (t.valid_to IS NULL OR t.valid_to >= '1999-06-30')")
def kg_as_of(spark, d):
    return _facts(spark, d, _WHO, "outgoing", "1999-06-30")


@query("SELECT * FROM (" + _who(_OUT, _WHO) + " UNION ALL " + _who(_IN, _WHO) + ") ORDER BY coalesce(valid_from, ''), direction, id")
def kg_timeline(spark, d):
    return graph.timeline(view(spark, d, "kg_triples"), view(spark, d, "kg_entities"), _WHO)


@query("SELECT (SELECT count(*) FROM kg_entities) AS entities, (SELECT count(*) FROM kg_triples) AS triples")
def kg_stats(spark, d):
    return graph.graph_stats(view(spark, d, "kg_triples"), view(spark, d, "kg_entities"))


@query("SELECT id, subject, predicate, object FROM kg_triples QUALIFY valid_to IS NOT NULL OR row_number() OVER (PARTITION BY subject, predicate, object, valid_to IS NULL ORDER BY id) = 1")
def kg_dedupe_open(spark, d):
    return graph.open_once(view(spark, d, "kg_triples")).select("id", "subject", "predicate", "object")


@query("SELECT id, CASE WHEN predicate = 'in_segment' AND subject LIKE '%7' AND valid_to IS NULL THEN '2001-01-01' ELSE valid_to END AS valid_to FROM kg_triples")
def kg_invalidate(spark, d):
    triples = view(spark, d, "kg_triples")
    ended = triples.where("predicate = 'in_segment' AND subject LIKE '%7'").select("subject", "predicate", "object", F.lit("2001-01-01").alias("ended"))
    return graph.invalidate(triples, ended).select("id", "valid_to")


@query("""SELECT subject, predicate, object FROM kg_triples WHERE predicate = 'in_segment' UNION ALL
    SELECT DISTINCT replace(lower(c_name), ' ', '_'), 'lives_in', 'nation_' || c_nationkey FROM customer""")
def kg_add_triples(spark, d):
    triples = view(spark, d, "kg_triples").where("predicate = 'in_segment'")
    c = view(spark, d, "customer")
    start, end, sure = F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(1.0).alias("confidence")
    homes = c.select(F.col("c_name").alias("subject"), F.lit("Lives in").alias("predicate"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("object"), start, end, sure)
    again = triples.select("subject", "predicate", "object", "valid_from", "valid_to", "confidence")
    return graph.add_triples(triples, homes.unionByName(homes).unionByName(again)).select("subject", "predicate", "object")


@query("SELECT room FROM rooms GROUP BY room HAVING count(DISTINCT wing) > 1")
def graph_tunnels(spark, d):
    return graph.tunnels(view(spark, d, "rooms"))


@query("SELECT DISTINCT room FROM (SELECT r3.room FROM rooms r0 JOIN rooms r1 ON r0.wing = r1.wing JOIN rooms r2 ON r1.room = r2.room JOIN rooms r3 ON r2.wing = r3.wing WHERE r0.room = 'room_7') WHERE room <> 'room_7'")
def graph_bfs(spark, d):
    return graph.connected_rooms(view(spark, d, "rooms"), "Room_7", 2)


@query("SELECT count(DISTINCT room) AS total_rooms, count(DISTINCT wing) AS total_wings, count(DISTINCT room) / count(DISTINCT wing) AS avg_rooms_per_wing FROM rooms")
def graph_stats(spark, d):
    return graph.rooms_stats(view(spark, d, "rooms"))


@query("SELECT room FROM (SELECT DISTINCT room, levenshtein(room, 'rom_12') AS dist FROM rooms) WHERE dist <= 2 ORDER BY dist, room LIMIT 1")
def graph_fuzzy(spark, d):
    return graph.fuzzy_room(view(spark, d, "rooms"), "rom_12")


@query("SELECT room, list_sort(list(DISTINCT wing)) AS wings FROM rooms GROUP BY room")
def graph_adjacency(spark, d):
    return graph.adjacency(view(spark, d, "rooms"))


@query("SELECT * FROM (SELECT * FROM diary WHERE agent = 'agent_5' ORDER BY entry_ts DESC, id DESC LIMIT 10) ORDER BY entry_ts, id")
def diary_last_n(spark, d):
    return diary.last_entries(view(spark, d, "diary"), "agent_5", 10)


@query("SELECT count(*) AS entries, count(DISTINCT agent) AS agents FROM diary")
def diary_stats(spark, d):
    return diary.diary_stats(view(spark, d, "diary"))


# --- texts -----------------------------------------------------------------------------------

_TOKENS = "greatest(1, round(len(regexp_extract_all({t}, '[^\\s]+')) * 1.3))::BIGINT"


@query(f"SELECT doc_id, {_TOKENS.format(t='text')} AS tokens FROM documents")
def txt_token_count(spark, d):
    return view(spark, d, "documents").select("doc_id", T.count_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, {_TOKENS.format(t='text')} AS original_tokens_est, {_TOKENS.format(t='substr(text, 1, 60)')} AS summary_tokens_est, round({_TOKENS.format(t='text')} / {_TOKENS.format(t='substr(text, 1, 60)')}, 1) AS size_ratio, strlen(text) AS original_chars, strlen(substr(text, 1, 60)) AS summary_chars FROM documents")
def txt_compression_stats(spark, d):
    stats = T.compression_stats(F.col("text"), F.substring("text", 1, 60))
    return view(spark, d, "documents").select("doc_id", stats.alias("s")).select("doc_id", "s.*")


_STOP = "[" + ",".join(f"'{w}'" for w in L.TOPIC_STOP_WORDS) + "]"


@query(f"""SELECT doc_id, list(w ORDER BY n DESC, w)[1:5] AS topics FROM (
    SELECT doc_id, lower(x) AS w, sum(1 + CASE WHEN regexp_matches(x, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '[_-]|^.+[A-Z]') THEN 2 ELSE 0 END) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS x FROM documents) WHERE NOT list_contains({_STOP}, lower(x)) GROUP BY ALL) GROUP BY doc_id""")
def txt_topics(spark, d):
    docs = view(spark, d, "documents")
    return docs.select("doc_id", T.topics("text", 5).alias("topics")).where("size(topics) > 0")


_SENT = "SELECT doc_id, i, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS i FROM documents)"


def _hits(words: list[str], points: int) -> str:
    return " + ".join(f"CASE WHEN contains(lower(s), '{w}') THEN {points} ELSE 0 END" for w in words)


@query(f"""SELECT doc_id, CASE WHEN strlen(q) > 55 THEN substr(q, 1, 52) || '...' ELSE q END AS quote FROM (
    SELECT doc_id, replace(replace(replace(arg_min(s, (-score, i)), '|', ' '), chr(10), ' '), '"', '''') AS q FROM (
    SELECT doc_id, i, s, {_hits(L.KEY_WORDS, 2)} + CASE WHEN strlen(s) < 80 THEN 1 ELSE 0 END + CASE WHEN strlen(s) < 40 THEN 1 ELSE 0 END - CASE WHEN strlen(s) > 150 THEN 2 ELSE 0 END AS score
    FROM ({_SENT}) WHERE strlen(s) > 10) GROUP BY doc_id)""")
def txt_key_sentence(spark, d):
    return view(spark, d, "documents").select("doc_id", T.key_sentence("text").alias("quote")).where("quote <> ''")


@query(f"""SELECT doc_id, s AS proposition, rank - 1 AS place FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM (
    SELECT doc_id, i, s, CASE WHEN regexp_matches(s, '\\s\\p{{Lu}}') THEN 2 ELSE 0 END + {_hits(L.FACT_SIGNALS, 1)} + CASE WHEN strlen(s) > 150 THEN -2 WHEN strlen(s) < 80 THEN 1 ELSE 0 END AS score
    FROM ({_SENT}) WHERE strlen(s) >= 20)) WHERE rank <= 5""")
def txt_propositions(spark, d):
    return view(spark, d, "documents").select("doc_id", F.posexplode(T.propositions("text", 5)).alias("place", "proposition"))


def _signal_sql(mapping: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{v}' END" for k, v in mapping.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _planted(words) -> str:
    """For each document one or two words of a lexicon, by its id, as the test texts hold none."""
    listed = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    return f"{listed}[doc_id % {len(words)} + 1] || ' ' || {listed}[doc_id * 7 % {len(words)} + 1]"


def _plant(words) -> Column:
    listed = F.array(*map(F.lit, words))
    return F.concat(F.get(listed, (F.col("doc_id") % len(words)).cast("int")), F.lit(" "), F.get(listed, (F.col("doc_id") * 7 % len(words)).cast("int")))


def _first_three(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)[1:3]"


_FLAGGED = f"SELECT doc_id, text || ' ' || {_planted(L.FLAG_SIGNALS)} AS text FROM documents"


@query(f"SELECT doc_id, {_first_three('f')} AS flags, {_first_three('e')} AS emotions FROM (SELECT doc_id, {_signal_sql(L.FLAG_SIGNALS)} AS f, {_signal_sql(L.EMOTION_SIGNALS)} AS e FROM ({_FLAGGED}))")
def txt_flags_emotions(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), _plant(L.FLAG_SIGNALS)).alias("text"))
    return docs.select("doc_id", T.flags("text").alias("flags"), T.emotions("text").alias("emotions"))


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_MOODS = [*L.POSITIVE_WORDS, *L.NEGATIVE_WORDS]


@query(f"SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE round((p - n) / (p + n), 6) END AS sentiment FROM (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_listed(L.POSITIVE_WORDS)}, x))) AS p, len(list_filter(w, lambda x: list_contains({_listed(L.NEGATIVE_WORDS)}, x))) AS n FROM (SELECT doc_id, regexp_split_to_array(lower(text || ' ' || {_planted(_MOODS)}), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents))")
def txt_sentiment(spark, d):
    docs = view(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), _plant(_MOODS)).alias("text"))
    return docs.select("doc_id", F.round(T.sentiment("text"), 6).alias("sentiment"))


_ROOMS = {"alpha": ["the", "tion"], "beta": ["of", "est"], "gamma": ["que", "und"]}


def _room_sql(distinct: bool, chars: int) -> str:
    low = f"lower(substr(text, 1, {chars}))"
    one = (lambda w: f"CASE WHEN contains({low}, '{w}') THEN 1 ELSE 0 END") if distinct else (lambda w: f"((length({low}) - length(replace({low}, '{w}', ''))) // {len(w)})")
    rows = ", ".join(f"{{'n': -({' + '.join(map(one, ws))}), 'r': '{r}'}}" for r, ws in _ROOMS.items())
    return f"(SELECT CASE WHEN (list_sort([{rows}])[1]).n < 0 THEN (list_sort([{rows}])[1]).r ELSE 'general' END)"


@query(f"SELECT doc_id, {_room_sql(True, 3000)} AS conversation_room, {_room_sql(False, 2000)} AS keyword_room FROM documents")
def txt_room_detect(spark, d):
    docs = view(spark, d, "documents")
    return docs.select("doc_id", T.keyword_room("text", _ROOMS, 3000, True).alias("conversation_room"), T.keyword_room("text", _ROOMS, 2000, False).alias("keyword_room"))


@query("SELECT id, 'drawer_' || wing || '_' || room || '_' || sha256(source_file || '0') AS drawer, substr(sha256(lower(wing)), 1, 5) AS shadow, regexp_extract(source_file, '[^/]*$') AS base, regexp_extract(source_file, '([^/]*)\\.[^.]*$', 1) AS stem, upper(rpad(substr(wing, 1, 3), 3, 'X')) AS code FROM mem")
def txt_ids(spark, d):
    mem = view(spark, d, "mem")
    return mem.select("id", T.drawer_id(F.col("wing"), F.col("room"), F.col("source_file"), F.lit(0)).alias("drawer"), T.shadow_id("wing").alias("shadow"), T.basename("source_file").alias("base"), T.stem("source_file").alias("stem"), T.person_code("wing").alias("code"))


@query("""SELECT doc_id, i - 1 AS place, p AS paragraph FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, list_filter(CASE WHEN n <= 20 OR len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) > 1 THEN [regexp_replace(text, '^\\s+|\\s+$', '', 'g')]
      ELSE list_transform(range(0, (len(ls) + 24) // 25), lambda k: regexp_replace(array_to_string(ls[k * 25 + 1 : k * 25 + 25], chr(10)), '^\\s+|\\s+$', '', 'g')) END, lambda x: strlen(x) >= 31) AS ps
    FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS n, string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10)) AS ls FROM documents)))""")
def txt_paragraph_chunks(spark, d):
    return view(spark, d, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("place", "paragraph"))


@query()
def txt_exchange_chunks(spark, d):
    lines = view(spark, d, "transcript").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return lines.select("conv_id", F.posexplode(chunking.conversation_chunks(F.col("text"))).alias("place", "chunk"))


@query()
def ing_chunks(spark, d):
    return chunking.chunked(view(spark, d, "documents"), "doc_id", "text")


#: Sentences whose kinds are known.
_SENTENCES = [
    "We decided to use Postgres because it keeps our data consistent.",
    "I prefer short functions and always use plain names.",
    "At last it works! That search index is a breakthrough.",
    "The importer has a bug and keeps crashing on empty files.",
    "The importer had a bug, but we fixed it and now it works.",
    "I prefer tea.",
    "I love you and I miss you, I feel so happy",
    "WHO: Alice decided. WHAT: use Spark. WHY: it scales. CONFIDENCE: high",
    "Nothing to see here at all, move along please",
]


def _marker_sql(patterns: list[str]) -> str:
    return " + ".join("len(regexp_extract_all(lower(text), '" + p.replace("'", "''") + "'))" for p in patterns)


@query(f"""SELECT doc_id, {', '.join(f'({_marker_sql(p)}) AS score_{k.lower()}' for k, p in extract.KINDS.items())} FROM documents""")
def txt_marker_scores(spark, d):
    return view(spark, d, "documents").select("doc_id", *(T.marker_score(F.col("text"), p).alias(f"score_{k.lower()}") for k, p in extract.KINDS.items()))


@query("SELECT * FROM (VALUES (0, 'Decision'), (1, 'Preference'), (2, 'Milestone'), (3, 'Problem'), (4, 'Milestone'), (6, 'Emotional'), (7, 'Decision')) v(id, memory_type)")
def txt_memory_type(spark, d):
    return extract.structured_memories(values(spark, _SENTENCES), "id", "text").select("id", "memory_type")


@query()
def txt_structured_memories(spark, d):
    docs = view(spark, d, "documents")
    return extract.structured_memories(docs, "doc_id", "text").select("id", "chunk_index", "memory_type", "topic", "sentiment", "confidence")


# --- summaries -------------------------------------------------------------------------------


def _entities_sql(text: str, most: int) -> str:
    """Codes of the capitalised words but the first, each once."""
    words = f"list_transform(regexp_extract_all({text}, '[^\\s]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{M}}]', '', 'g'))"
    kept = f"list_filter({words}[2:], lambda w: strlen(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}*$') AND NOT list_contains({_STOP}, lower(w)))"
    coded = f"list_transform({kept}, lambda w: upper(replace(w[1:3], 'ß', 'ss')) || '[#' || sha256(lower(w))[1:5] || ']')"
    return f"list_filter({coded}, lambda x, i: list_position({coded}, x) = i)[1:{most}]"


def _topics_sql(rows: str, key: str, most: int) -> str:
    return f"""SELECT {key}, list(w ORDER BY n DESC, w)[1:{most}] AS topics FROM (
    SELECT {key}, lower(x) AS w, sum(1 + CASE WHEN regexp_matches(x, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '[_-]|^.+[A-Z]') THEN 2 ELSE 0 END) AS n
    FROM (SELECT {key}, unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS x FROM {rows}) WHERE NOT list_contains({_STOP}, lower(x)) GROUP BY ALL) GROUP BY {key}"""


_FIELDS = f"""SELECT d.doc_id AS id, d.text, e.entities, coalesce(t.topics, []) AS topics, coalesce(q.quote, '') AS quote, {_first_three('s.e')} AS emotions, {_first_three('s.f')} AS flags,
      CASE WHEN d.text = '' THEN 1.0::DOUBLE ELSE round(least(0.5, len(e.entities) * 0.2::DOUBLE) + least(0.5, len(coalesce(t.topics, [])) * 0.1::DOUBLE), 2) END AS faithfulness
    FROM documents d JOIN (SELECT doc_id, {_entities_sql('text', 3)} AS entities FROM documents) e ON d.doc_id = e.doc_id
    JOIN (SELECT doc_id, {_signal_sql(L.EMOTION_SIGNALS)} AS e, {_signal_sql(L.FLAG_SIGNALS)} AS f FROM documents) s ON d.doc_id = s.doc_id
    LEFT JOIN ({_topics_sql('documents', 'doc_id', 3)}) t ON d.doc_id = t.doc_id LEFT JOIN ({ORACLES['txt_key_sentence']}) q ON d.doc_id = q.doc_id"""


@query(f"SELECT * EXCLUDE (text) FROM ({_FIELDS})")
def dia_compress_fields(spark, d):
    docs = view(spark, d, "documents")
    return summary.fields(docs, "doc_id", "text").drop("text")


def _line_sql(head: str) -> str:
    part = lambda c, sep, other: f"CASE WHEN len({c}) = 0 THEN {other} ELSE array_to_string({c}, '{sep}') END"
    quote = "CASE WHEN quote <> '' THEN '\"' || quote || '\"' END, " if head == "'0:'" else ""
    return f"concat_ws('|', {head} || {part('entities', '+', chr(39) + '???' + chr(39))}, {part('topics', '_', chr(39) + 'misc' + chr(39))}, {quote}{part('emotions', '+', 'NULL')}, {part('flags', '+', 'NULL')})"


#: For texts that decide nothing, as those of the test tables (a test checks that).
_SUMMARIES = f"""SELECT id, 'V:3.2' || chr(10) || wing || '|' || room || '|?|doc_' || id || chr(10) || {_line_sql("'0:'")} || chr(10)
      || 'JSON:{{"version":"V:3.2","wing":"' || wing || '","room":"' || room || '","source_file":"' || source_file || '","extra":{{"faithfulness":' || faithfulness::VARCHAR || '}}}}' AS summary
    FROM (SELECT f.*, m.wing, m.room, m.source_file FROM ({_FIELDS}) f JOIN mem m ON f.id = m.id)"""


@query(_SUMMARIES)
def dia_summaries(spark, d):
    mem = view(spark, d, "mem")
    return summary.summarised(mem, "id", "text_content", wing="wing", room="room", source="source_file")


_PROPOSED = f"SELECT doc_id, place, row_number() OVER (ORDER BY doc_id, place) AS nth, proposition AS text FROM ({ORACLES['txt_propositions']})"


@query(f"""SELECT doc_id AS id, place, {_line_sql("'P' || place || ':'")} AS line FROM (
    SELECT p.doc_id, p.place, {_entities_sql('p.text', 3)} AS entities, coalesce(t.topics, []) AS topics, {_first_three('e')} AS emotions, {_first_three('f')} AS flags
    FROM (SELECT *, {_signal_sql(L.EMOTION_SIGNALS)} AS e, {_signal_sql(L.FLAG_SIGNALS)} AS f FROM ({_PROPOSED})) p LEFT JOIN ({_topics_sql(f'({_PROPOSED})', 'nth', 3)}) t ON p.nth = t.nth)""")
def dia_propositions(spark, d):
    return summary.proposition_lines(view(spark, d, "documents"), "doc_id", "text")


_OLD, _NEW = "V:3.2\n0:ABC|alpha_beta_gamma_delta|\"q\"", ["V:3.2\n0:ABC|alpha_beta_gamma_delta|\"q\"", "V:3.2\n0:ABC|alpha_beta_gamma_omega|\"q\"", "V:3.2\n0:ABC|one_two_three_four"]


@query("SELECT * FROM (VALUES (0, 'DELTA:(no change)'), (1, 'V:3.2' || chr(10) || '0:ABC|alpha_beta_gamma_omega|\"q\"'), (2, 'V:3.2' || chr(10) || '0:ABC|one_two_three_four')) v(id, delta)")
def dia_delta(spark, d):
    return values(spark, _NEW).select("id", summary.delta(F.lit(_OLD), F.col("text")).alias("delta"))


@query(f"""SELECT f.id AS doc_id, round(len(list_filter(coalesce(t.topics, []), lambda x: contains(lower(f.line), x))) / greatest(len(coalesce(t.topics, [])), 1), 6) AS coverage
    FROM (SELECT id, 'V:3.2' || chr(10) || {_line_sql("'0:'")} || chr(10) || 'JSON:{{"version":"V:3.2","extra":{{"faithfulness":' || faithfulness::VARCHAR || '}}}}' AS line FROM ({_FIELDS})) f
    LEFT JOIN ({_topics_sql('documents', 'doc_id', 10)}) t ON f.id = t.doc_id""")
def dia_faithfulness(spark, d):
    docs = view(spark, d, "documents")
    made = summary.summarised(docs, "doc_id", "text")
    return docs.join(made, docs["doc_id"] == made["id"]).select("doc_id", F.round(summary.coverage(F.col("text"), F.col("summary")), 6).alias("coverage"))


@query(f"""SELECT id, split_part(s, chr(10), 1)[3:] AS version, split_part(split_part(s, chr(10), 2), '|', 1) AS wing, split_part(split_part(s, chr(10), 2), '|', 4) AS title, 1 AS zettels, split_part(s, chr(10), 4)[6:] AS overlay
    FROM (SELECT id, summary AS s FROM ({_SUMMARIES}))""")
def dia_decode(spark, d):
    made = dia_summaries(spark, d)
    return made.select("id", summary.decoded(F.col("summary")).alias("x")).select("id", "x.version", "x.header.wing", "x.header.title", F.size("x.zettels").alias("zettels"), "x.overlay")


@query()
def dia_merge(spark, d):
    made = dia_summaries(spark, d).where("summary NOT LIKE 'RAW%'")
    return summary.merged(made.select((F.col("id") % 25).alias("cluster"), F.col("id").alias("rank"), "summary"))


# --- entities, transcripts, sessions, spelling ------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`.*?`', '', 'g'), '(?m)^\\$\\s+.*', '', 'g') AS t FROM documents),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM t),
    single AS (SELECT doc_id, w FROM runs WHERE regexp_full_match(w, '[A-Z][a-zA-Z0-9]{{1,19}}') AND NOT list_contains({_STOP}, lower(w))),
    phrase AS (SELECT doc_id, regexp_split_to_array(p, '\\s+') AS p FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1)) AS p FROM t)),
    parts AS (SELECT doc_id, p[i : i + n - 1] AS p FROM (SELECT doc_id, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM (SELECT doc_id, p, unnest(range(2, least(len(p), 12) + 1)) AS n FROM phrase))),
    named AS (SELECT doc_id, array_to_string(p, ' ') AS w FROM parts WHERE len(list_filter(p, lambda x: NOT list_contains({_STOP}, lower(x)))) >= 2),
    files AS (SELECT doc_id, split_part(f, '.', 1) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\b([a-z0-9_-]+\\.(?:rs|py|js|ts|sh))\\b', 1)) AS f FROM t) WHERE length(split_part(f, '.', 1)) > 1)
    SELECT doc_id AS id, w AS name, count(*) AS frequency FROM (SELECT * FROM single UNION ALL SELECT * FROM named UNION ALL SELECT * FROM files) GROUP BY ALL HAVING count(*) >= 3""")
def ent_candidates(spark, d):
    return entities.candidates(view(spark, d, "documents"), "doc_id", "text")


_PEOPLE = ["Alice said hello.\nShe laughed. Alice said so.\nThanks Alice, Alice told him everything.", "We deploy Orion today. The Orion pipeline is built. import Orion", "SomeWord here. SomeWord there. SomeWord again. SomeWord too. SomeWord last."]


@query("SELECT * FROM (VALUES (0, 'Alice', 'Person', 0.99::DOUBLE), (1, 'Orion', 'Project', 0.99::DOUBLE), (2, 'SomeWord', 'Term', 0.1::DOUBLE)) v(id, name, type, confidence)")
def ent_entities(spark, d):
    return entities.entities(values(spark, _PEOPLE), "id", "text").select("id", "name", "type", "confidence")


@query("SELECT * FROM (VALUES ('max', 'Maxwell'), ('MAXWELL', 'Maxwell'), ('rose', 'Rose'), ('nobody', NULL)) v(asked, name)")
def ent_registry(spark, d):
    people = spark.createDataFrame([("Maxwell", 0.7, ["Max"])], "name string, confidence double, aliases array<string>")
    new = spark.createDataFrame([("maxwell", 0.9, ["Maxi"]), ("Rose", 0.8, [])], "name string, confidence double, aliases array<string>")
    names = spark.createDataFrame([("max",), ("MAXWELL",), ("rose",), ("nobody",)], "name string")
    return entities.canonical(entities.registered(people, new), names)


@query("""SELECT conv_id AS id, regexp_replace(string_agg(sep || body, '' ORDER BY turn), '^\\n+', '') AS transcript FROM (
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN '> ' || text ELSE text END AS body,
      CASE WHEN role = 'assistant' AND lag(role) OVER w = 'user' THEN chr(10) ELSE chr(10) || chr(10) END AS sep
    FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def nrm_transcript(spark, d):
    return transcripts.joined_messages(view(spark, d, "conversations"))


@query(f"""SELECT id, CASE WHEN n < 2 THEN export ELSE transcript END AS transcript FROM ({ORACLES['nrm_transcript']}) t
    JOIN (SELECT conv_id, count(*) AS n, to_json(list({{'role': role, 'content': text}} ORDER BY turn))::VARCHAR AS export FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id) c ON t.id = c.conv_id""")
def nrm_flat_exports(spark, d):
    said = view(spark, d, "conversations").where("role IN ('user', 'assistant')")
    each = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return transcripts.transcripts(said.groupBy("conv_id").agg(F.to_json(each).alias("text")), "conv_id", "text")


_EXPORTS = [
    '{"type":"human","message":{"content":"hello"}}\n{"type":"assistant","message":{"content":[{"type":"text","text":"hi there"}]}}',
    '[{"role":"human","content":"hello"},{"role":"ai","content":{"text":"hi"}}]',
    '{"mapping":{"a":{"parent":null,"children":["b"]},"b":{"parent":"a","message":{"author":{"role":"user"},"content":{"parts":["hello"]}},"children":["c"]},"c":{"parent":"b","message":{"author":{"role":"assistant"},"content":{"parts":["hi","there"]}},"children":[]}}}',
    '[{"type":"message","user":"U1","text":"hello"},{"type":"message","user":"U2","text":"hi"},{"type":"message","user":"U1","text":"bye"}]',
    "plain text",
]


@query("SELECT * FROM (VALUES (0, '> hello' || chr(10) || 'hi there'), (1, '> hello' || chr(10) || 'hi'), (2, '> hello' || chr(10) || 'hi there'), (3, '> hello' || chr(10) || 'hi' || chr(10) || chr(10) || '> bye'), (4, 'plain text')) v(id, transcript)")
def nrm_exports(spark, d):
    return transcripts.transcripts(values(spark, _EXPORTS), "id", "text")


@query("SELECT * FROM (VALUES (0, 'please check it before the switch'), (1, 'Keep CamelCase and v2.0 as wre they')) v(id, text)")
def spell_correct(spark, d):
    return spelling.corrected(values(spark, ["pleese chekc it befor the swicth", "Keep CamelCase and v2.0 as wre they"]), "id", "text", spelling.default_dictionary() | {"the": 100, "and": 100})


def _log() -> list[str]:
    lines = []
    for k, marker in enumerate(["", "previous messages", ""]):
        lines += [f"{L.SESSION_BANNER}1.{k}", marker, "> please plan the next release now", "10:0" + str(k) + " AM Monday, March 4, 2024", "Alice and Ben"] + [f"line {i}" for i in range(10)]
    return lines


@query("SELECT * FROM (VALUES ('big.txt', 1, 30, '2024-03-04_1000AM', 'please-plan-the-next-release-now', 'big_2024-03-04_1000AM_Alice-Ben_please-plan-the-next-release-now.txt'), ('big.txt', 2, 15, '2024-03-04_1002AM', 'please-plan-the-next-release-now', 'big_2024-03-04_1002AM_Alice-Ben_please-plan-the-next-release-now.txt')) v(file, session, n_lines, stamp, subject, name)")
def ing_sessions(spark, d):
    lines = spark.createDataFrame([("big.txt", i, x) for i, x in enumerate(_log())], "file string, line_no int, line string")
    return sessions.sessions(lines).select("file", "session", "n_lines", "stamp", "subject", "name")


# --- evaluation and extensions ---------------------------------------------------------------


@query(f"""SELECT query_id, gold, hits, hits / gold AS recall, round(dcg / ideal, 6) AS ndcg FROM (
    SELECT g.query_id, count(*) AS gold, count(r.rank) AS hits, coalesce(sum(1 / log2(r.rank + 1)), 0) AS dcg, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS ideal
    FROM (SELECT q.id AS query_id, v.id FROM vec q JOIN vec v ON q.wing = v.wing WHERE q.id % 20 = 0) g
    LEFT JOIN (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_PAIRS}) QUALIFY rank <= 10) r ON g.query_id = r.query_id AND g.id = r.id GROUP BY g.query_id)""")
def eval_recall_ndcg(spark, d):
    vec = view(spark, d, "vec")
    asked = vec.where("id % 20 = 0")
    gold = asked.select(F.col("id").alias("query_id"), "wing").join(vec.select("id", "wing"), "wing").select("query_id", "id")
    return evaluate.ranked_quality(search.knn_batch(vec, asked, 10), gold).withColumn("ndcg", F.round("ndcg", 6))


@query()
def eval_trials(spark, d):
    out = None
    for make in (evaluate.variable_tracking, evaluate.needle_aggregation, evaluate.state_tracking):
        mem, probes, gold = make()
        frames = spark.createDataFrame(mem, "id long, text string"), spark.createDataFrame(probes, "query_id long, text string"), spark.createDataFrame(gold, "query_id long, id long")
        each = evaluate.mean_quality(evaluate.ranked_quality(evaluate.trial(frames[0], frames[1]), frames[2])).withColumn("trial", F.lit(make.__name__))
        out = each if out is None else out.unionByName(each)
    return out


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_counts(spark, d):
    return streams.tumbling_counts(view(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")
def ext_session_counts(spark, d):
    return streams.session_counts(view(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
