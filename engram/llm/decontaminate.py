"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is ``window`` consecutive words of an item, or the whole of a shorter item. Its set is that
of its shingles (``shingle`` consecutive words; fewer where the item has fewer). One pass over the
documents counts how often they have each shingle of a window; that orders shingles by rarity. A
document can hold a window only if it holds the window's rarest shingle, the prefix that containment
of 1 needs, so only prefixes are joined with the documents, and a window has to fit into the document
around its prefix (length and position). What is left are candidates: places of a document where a
window may stand. There the document's words are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import row_key, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _runs_of(letters: str) -> str:
    """Runs of digits, of letters and of all beyond ASCII. What is left out is listed one by one, which the matcher looks up in a table."""
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in "0123456789" + letters) + "]+"


#: Words of texts with A-Z in lower case, and of texts as they are: the same places.
WORDS, ANY_WORDS = _runs_of(LOWER), _runs_of(LOWER + UPPER)


def words(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _shingles(df: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """A row for each place where n words of the array column ``w`` follow one another: keep, pos, id (a hash of n and the words in lower case)."""
    # an explode of one element keeps an expression from being evaluated for each of its uses
    hashed = df.where(F.size("w") >= n).select(*keep, F.explode(F.array(F.transform("w", lambda x: F.xxhash64(F.lower(x))))).alias("h"))
    parts = [F.slice("h", k + 1, F.size("h") - (n - 1)).alias(f"h{k}") for k in range(n)]
    each = hashed.select(*keep, F.posexplode(F.arrays_zip(*parts)).alias("pos", "s"))
    return each.select(*keep, "pos", F.xxhash64(F.lit(n), *(f"s.h{k}" for k in range(n))).alias("id"))


def _of_sizes(df: DataFrame, sizes: list[int], keep: list[str], own: bool) -> DataFrame:
    """The shingles of all sizes; with ``own``, of each row those of its column ``m`` only."""
    out = None
    for n in sizes:
        part = _shingles(df.where(F.col("m") == n) if own else df, n, keep)
        out = part if out is None else out.unionByName(part)
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Occurrences of windows in documents: doc_id, _k (tells rows apart), item_id, first, last (word positions).

    Items that share an id count as one. Items without words have no windows. A window that several
    items have is looked for once.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.explode(F.array(words(F.col(item_text_col)))).alias("all")).where(F.size("all") > 0)
    cut = items.select("item_id", F.explode(F.expr(f"transform(sequence(0, size(all) - least(size(all), {window})), i -> slice(all, i + 1, {window}))")).alias("w"))
    owners = written(cut.select("item_id", F.unhex(F.md5(F.array_join("w", " "))).alias("window"), "w").distinct())
    windows = written(owners.select("window", "w").distinct().withColumn("m", F.least(F.size("w"), F.lit(shingle))).withColumn("length", F.size("w")))
    sizes = sorted(r.m for r in windows.select("m").distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("text"))
    if not sizes:
        return rows.select("doc_id", "_k", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("first"), F.lit(0).alias("last")).where(F.lit(False))
    of_windows = written(_of_sizes(windows, sizes, ["window", "length"], True))
    # words in any case: shingles are hashed in lower case throughout, beyond A-Z too, which only adds candidates
    found = rows.where("text IS NOT NULL").select("doc_id", "_k", F.regexp_extract_all("text", F.lit(ANY_WORDS), F.lit(0)).alias("w"))

    # rarity: how often documents have each shingle; a window with one that none has can't occur
    wanted = small(written(of_windows.select("id").distinct()))
    counts = written(_of_sizes(found, sizes, [], False).join(wanted, "id").groupBy("id").agg(F.count(F.lit(1)).alias("seen")))
    ranked = of_windows.join(small(counts), "id", "left").groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "id", "pos")).alias("rarest")
    )
    prefixes = small(written(ranked.where("rarest.seen > 0").select("window", "length", F.col("rarest.id").alias("id"), F.col("rarest.pos").alias("at"))))

    # candidates: where the rarest shingle of a window stands and the window fits around it
    sized = found.withColumn("n_words", F.size("w"))
    at = _of_sizes(sized, sizes, ["doc_id", "_k", "n_words"], False).join(prefixes, "id").withColumn("first", F.col("pos") - F.col("at"))
    fits = (F.col("first") >= 0) & (F.col("first") + F.col("length") <= F.col("n_words"))
    places = at.where(fits).groupBy("doc_id", "_k").agg(F.collect_set(F.struct("first", "length", "window")).alias("places"))
    places = small(written(places.select(F.col("doc_id").alias("_doc"), F.col("_k").alias("_row"), "places")))

    # exact: the words that stand there
    held = rows.join(places, (rows["_k"] == places["_row"]) & rows["doc_id"].eqNullSafe(places["_doc"]))
    held = held.select("doc_id", "_k", F.explode(F.array(words(F.col("text")))).alias("w"), "places").select("doc_id", "_k", "w", F.explode("places").alias("p"))
    held = held.select("doc_id", "_k", "p.window", "p.first", (F.col("p.first") + F.col("p.length") - 1).alias("last"), F.slice("w", F.col("p.first") + 1, F.col("p.length")).alias("here"))
    # rows that are wholly equal are the same here, and are judged once
    return held.join(small(owners), "window").where("here = w").select("doc_id", "_k", "item_id", "first", "last").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 4, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and _k.

    A word inside any occurrence of a window is hit; a document is contaminated if it has hit words,
    one in ``share`` at least. Null and empty texts have no words. Rows that share an id and differ
    in their texts are judged each by itself; equal rows get equal results. An empty benchmark hits
    nothing. Other columns are ignored.
    """
    runs = find_windows(docs, benchmark, window, shingle, id_col, text_col, item_col, item_text_col)
    order = Window.partitionBy("doc_id", "_k").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reached), F.lit(0))
    hit = (
        runs.withColumn("fresh", fresh)
        .groupBy("doc_id", "_k")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select(F.col("doc_id").alias("_doc"), F.col("_k").alias("_row"), "n_hit", "items")
    )
    hit = small(written(hit))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("_k"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_WORDS)), F.lit(0)).cast("long").alias("n_words"))
    joined = rows.join(hit, (rows["_k"] == hit["_row"]) & rows["doc_id"].eqNullSafe(hit["_doc"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "_k", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` doesn't find contaminated, as they are."""
    judged = decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    dirty = small(written(judged.where("contaminated").select(F.col("doc_id").alias("_doc"), F.col("_k").alias("_row")).distinct()))
    on = (row_key(id_col, text_col) == dirty["_row"]) & F.col(id_col).eqNullSafe(dirty["_doc"])
    return docs.join(dirty, on, "left_anti")
