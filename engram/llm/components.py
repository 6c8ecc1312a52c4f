"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import drop, noted, small, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) for each end of the links (a, b); comp is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours, then the label of the label, so
    that chains shorten by halves. Rounds are written tables; minima are combined before they are
    shuffled, so a node with very many links is no burden to one task.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("comp")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("_low"))
        lower = label.join(near, label["node"] == near["a"]).select("node", F.col("comp").alias("_was"), F.least("comp", "_low").alias("comp"))
        jump = lower.select(F.col("node").alias("_at"), F.col("comp").alias("_to"))
        new = written(lower.join(jump, lower["comp"] == jump["_at"]).select("node", "_was", F.col("_to").alias("comp")))
        label = new.select("node", "comp")
        if new.where(F.col("_was") != F.col("comp")).isEmpty():
            return label


def with_links(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links (a, b): only components that these connect are labelled anew."""
    if component is None:
        return connected_components(links)
    known = [component.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    ends = links.join(known[0], "a", "left").join(known[1], "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = written(ends)
    new = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
    nodes = component.unionByName(ends.select(F.col("a").alias("node"), F.col("ca").alias("comp"))).unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("comp"))).distinct()
    return written(nodes.join(new, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")))


#: Of a node's shared keys so many are told to the buckets of its other keys.
_TOLD = 32
#: Times as many pivots of a bucket from round to round, at most.
_PIVOTS = 16
#: So many rounds merge the components that they connect at once; later ones find few links, which are merged at the end.
_MERGED = 2


def parted(entries: DataFrame) -> DataFrame:
    """The entries (key, node, comp, ...) of buckets that hold several components."""
    keys = entries.groupBy("key").agg(F.min("comp").alias("_c"), F.max("comp").alias("_d")).where("_c <> _d").select("key")
    return entries.join(keys, "key", "left_semi")


def bucket_entries(each: DataFrame, signs: DataFrame | None = None) -> DataFrame:
    """(key, node, earlier, rank, sign) for each of ``each`` (node, key: a long) whose key another row has too.

    The signs stand in ``each`` or are those of ``signs`` (node, sign). ``earlier`` are the node's
    lowest shared keys below this one, at most as many as are told; ``rank`` is the lower, the more
    nodes share its keys.
    """
    own = [] if signs is not None else ["sign"]
    shared = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    each = written(each.join(small(shared), "key").select("key", "node", "_n", *own), release=True)
    mine = each.groupBy("node").agg((-F.sum("_n")).alias("rank"), F.slice(F.sort_array(F.collect_set("key")), 1, _TOLD).alias("_told"))
    held = mine if signs is None else signs.join(mine, "node").select("node", "sign", "rank", "_told")
    entries = each.join(held, "node")
    return entries.select("key", "node", F.filter("_told", lambda k: k < F.col("key")).alias("earlier"), "rank", "sign")


def shared_keys(each: DataFrame) -> DataFrame:
    """(key, node, tag, _n) of rows (node, key: a long, tag) whose key _n > 1 rows have.

    Only these short rows are dealt by key, whatever else is known of a node, and all at once.
    """
    return each.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_n > 1")


def signed_entries(shared: DataFrame, signs: DataFrame) -> DataFrame:
    """As ``bucket_entries``, of the rows of ``shared_keys``; a node has a sign for each of its tags: signs (node, tag, sign)."""
    mine = shared.groupBy("node").agg((-F.sum("_n")).alias("rank"), F.slice(F.sort_array(F.collect_set("key")), 1, _TOLD).alias("_told"))
    entries = shared.join(mine, "node").join(signs, ["node", "tag"])
    return entries.select("key", "node", F.filter("_told", lambda k: k < F.col("key")).alias("earlier"), "rank", "sign")


def bucket_components(entries: DataFrame, close: Callable[[Column, Column], Column], similar: Callable[[DataFrame], DataFrame], possible: Callable[[DataFrame], DataFrame] | None = None, spare: bool = False) -> DataFrame | None:
    """Components (node, comp) of the links among nodes that share a bucket; None without links.

    ``entries`` come from ``bucket_entries``; ``close`` tells from two signs whether a pair may be a
    link, and ``similar`` takes such pairs (a, b) and returns those that are. No bucket is expanded
    into pairs: in each round some of its members are pivots, those of lowest rank first, which are
    compared with those in other components and then leave the bucket, until it is one component or
    empty. A pair is left out where an earlier bucket that both share has it. So links within what is
    already connected cost nothing, hardly a pair is compared twice, and no link between unconnected
    nodes is left out. Before the second round ``possible`` may drop entries (with their comp) of nodes
    that can't have links to other components of their buckets.

    With ``spare`` each step of a round is written, which gives back what the one before shuffled,
    and the table of ``entries`` is dropped: more and smaller jobs that hold less disk at once.
    """
    step = (lambda df: written(df, release=True)) if spare else (lambda df: df)
    component, columns, spark = None, entries.columns, entries.sparkSession
    late: list[DataFrame] = []
    with noted() as made:
        for round_ in count():
            former = list(made)
            if round_:
                entries = step(entries)
            if spare and round_:
                drop(spark, former, entries, component, *late)
            now = entries if component is None else entries.join(component, "node", "left")
            now = now.withColumn("comp", F.col("node") if component is None else F.coalesce("comp", "node"))
            now = written(parted(now if component is None else step(now)), release=True)
            if spare and not round_:
                drop(spark, [f.rsplit("/", 1)[0] for f in entries.inputFiles()[:1]])
            if round_ == 1 and possible is not None:
                now = possible(now)
            # tables of former rounds are done with, but for the components and the late links
            drop(spark, former, component, *late)
            if now.isEmpty():
                return component if not late else with_links(component, reduce(DataFrame.unionByName, late))
            chosen = now.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(_PIVOTS ** min(round_, 8))).alias("_choice")).agg(F.min(F.struct("rank", "node", "comp", "earlier", "sign")).alias("p"))
            pivots = written(chosen.select("key", *(F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("node", "comp", "earlier", "sign"))), release=True)
            # the cheaper tests first
            tried = F.expr("comp <> pivot_comp") & close(F.col("sign"), F.col("pivot_sign")) & ~F.expr("arrays_overlap(earlier, pivot_earlier)")
            pairs = now.join(pivots, "key").where(tried).select(F.least("node", "pivot_node").alias("a"), F.greatest("node", "pivot_node").alias("b")).distinct()
            found = written(similar(pairs))
            if not found.isEmpty() and (component is None or round_ < _MERGED):
                component = with_links(component, found)
            elif not found.isEmpty():
                late.append(found)
            entries = now.join(pivots.select("key", F.col("pivot_node").alias("node")), ["key", "node"], "left_anti").select(*columns)
