"""Semantic pruning: memories join the cluster of the smallest earlier seed that has them among its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import decayed_importance
from engram.operators.search import knn_join
from engram.session import kept


def clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, seed) for all nodes, as a visit in order of ids would claim them, by rounds.

    ``edges`` (src, dst) go to larger ids; a node is a seed unless a smaller seed has an edge to
    it, and then belongs to the smallest such seed. Each round settles the nodes whose smaller
    neighbours are settled.
    """
    edges = kept(edges.where("src < dst"))
    state = kept(nodes.select("id", F.lit(None).cast("boolean").alias("seed")))
    while True:
        incoming = edges.join(state.select(F.col("id").alias("src"), F.col("seed").alias("src_seed")), "src")
        seen = incoming.groupBy(F.col("dst").alias("id")).agg(F.max(F.coalesce("src_seed", F.lit(False))).alias("claimed"), F.max(F.col("src_seed").isNull()).alias("open"))
        new = state.join(seen, "id", "left").select("id", F.coalesce("seed", F.when(F.col("claimed"), F.lit(False)).when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(F.lit(True))).alias("seed"))
        state = kept(new)
        if state.where("seed IS NULL").isEmpty():
            break
    seeds = state.where("seed").select(F.col("id").alias("src"))
    owner = edges.join(seeds, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("owner"))
    return state.join(owner, "id", "left").select("id", F.when(F.col("seed"), F.col("id")).otherwise(F.col("owner")).alias("seed"))


def neighbours(vectors: DataFrame, theta: float, k: int = 10) -> DataFrame:
    """Edges (src, dst) from each vector to those of its k nearest (itself included) that are closer than 1 - theta."""
    near = knn_join(vectors, vectors, k)
    return near.where((F.col("query_id") != F.col("id")) & (F.lit(1.0) - F.col("score") < 1 - theta)).select(F.col("query_id").alias("src"), F.col("id").alias("dst"))


def prune(memories: DataFrame, vectors: DataFrame, now: int, theta: float = 0.85, wing: str | None = None, k: int = 10) -> DataFrame:
    """(id, seed, winner, kept) for memories in clusters of several: the most important of each stays."""
    nodes = memories if wing is None else memories.where(F.col("wing") == wing)
    edges = neighbours(vectors, theta, k)
    inside = nodes.select("id")
    edges = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    placed = clusters(edges, nodes).join(nodes, "id")
    by = Window.partitionBy("seed")
    score = decayed_importance(F.col("importance_score"), F.col("last_accessed"), F.col("access_count"), now)
    ranked = placed.withColumn("_score", score).withColumn("_n", F.count(F.lit(1)).over(by)).where("_n > 1")
    ranked = ranked.withColumn("winner", F.first("id").over(by.orderBy(F.desc("_score"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("id", "seed", "winner", (F.col("id") == F.col("winner")).alias("kept"), F.octet_length("text_content").alias("bytes"))


def report(pruned: DataFrame) -> DataFrame:
    """clusters_found, merged, tokens_saved_est (a fourth of the losers' bytes, by cluster)."""
    each = pruned.groupBy("seed").agg(F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("merged"), F.floor(F.sum(F.when(F.col("kept"), 0).otherwise(F.col("bytes"))) / 4).alias("saved"))
    return each.agg(F.count(F.lit(1)).alias("clusters_found"), F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"), F.coalesce(F.sum("saved"), F.lit(0)).alias("tokens_saved_est"))
