"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed for each source; shares of the whole by weight are limited to a number of passes
over a source, and what a limited source can't take is shared among the others (a level is found
from prefix sums over the sources, ordered by the weight at which each reaches its limit). A source's
repetition rate is its target over its size: each document is emitted floor(rate) times, and once
more if a hash of its id and a seed, as a number from 0 to 1, is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import small, written

#: A size is the number of words: maximal runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets for a table (source, source_size) with a row per source.

    Sources weigh ``weights`` in turn, in order of their code points, null last. Targets add up to
    ``share`` times all sizes, but none is above ``most`` times its source's size. The windows run
    over the table of sources only, in one task.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    level = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.col("_level"))
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_level", rest / F.sum("_weight").over(after))
        .withColumn("_level", F.max(level).over(everything))
        .select("source", "source_size", F.least("_limit", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_limit"))).alias("target"))
    )


def chance(key: Column, seed: int) -> Column:
    """A number from 0 to 1 from a hash of the key: 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each row of ``docs``: doc_id, source, size, source_size, target, copies; also ``carry``.

    A null text has size 0; a null source is a source of its own; a source of size 0 has target 0
    and its documents aren't taken. Rows with equal ids get the same chance; a null id has a chance
    too. An empty table gives an empty plan. Each pass over the texts reads those columns only.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *(F.struct(*carry).alias("_carried") for _ in carry[:1]))
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = small(written(source_targets(sizes, weights, share, most)).withColumnRenamed("source", "_source"))
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(most)))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    copies = F.floor(rate) + (chance(key, seed) < rate - F.floor(rate)).cast("long")
    planned = rows.join(targets, rows["source"].eqNullSafe(targets["_source"]), "left").drop("_source")
    return planned.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *(["_carried.*"] if carry else []))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as ``mix_plan`` says."""
    columns = docs.columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    name = {f: f"c{columns.index(options.pop(f, d))}" for f, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    plan = mix_plan(renamed, carry=tuple(renamed.columns), **name, **options)
    taken = plan.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
