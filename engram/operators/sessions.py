"""Files that hold many sessions: where each begins, when it was, who took part, what it was about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicon as L

_WHEN = r"(\d{1,2}:\d{2} [AP]M) \w+, (\w+) (\d{1,2}), (\d{4})"


def session_lines(lines: DataFrame, banner: str = L.SESSION_BANNER, restores: list[str] | None = None) -> DataFrame:
    """Lines (file, line_no, line) with the number of their session, from 1; lines before the first are left out.

    A session begins at a banner unless that line or one of the five after it tells of a restore.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    restored = reduce(Column.__or__, (F.contains("line", F.lit(r)) for r in (restores or L.RESTORE_MARKERS)))
    near = F.max(restored).over(order.rowsBetween(0, 5))
    begins = (F.contains("line", F.lit(banner)) & ~near).cast("int")
    return lines.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("session > 0").drop("begins")


def sessions(lines: DataFrame, people: list[str] | None = None, least_lines: int = 10, **options) -> DataFrame:
    """Sessions of ``least_lines`` or more: file, session, n_lines, stamp, iso_date, people, subject, name, content."""
    rows = session_lines(lines, **options)
    order = Window.partitionBy("file", "session").orderBy("line_no")
    rows = rows.withColumn("n", F.row_number().over(order))
    when = F.when((F.col("n") <= 50) & F.rlike("line", F.lit(_WHEN)), F.struct("n", *(F.regexp_extract("line", _WHEN, k).alias(f"g{k}") for k in range(1, 5))))
    prompt = F.regexp_replace(F.substring("line", 3, 1 << 30), r"^\s+|\s+$", "")
    asks = F.when(F.startswith("line", F.lit("> ")) & (F.octet_length(prompt) > 5) & ~F.rlike(prompt, F.lit(L.COMMAND_PROMPTS)), F.struct("n", prompt.alias("p")))
    each = rows.groupBy("file", "session").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min(when).alias("w"), F.min(asks).alias("q"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"),
    ).where(F.col("n_lines") >= least_lines)
    month = F.lpad(F.array_position(F.array(*map(F.lit, L.MONTHS)), F.col("w.g2")).cast("string"), 2, "0")
    iso = F.concat_ws("-", "w.g4", month, F.lpad("w.g3", 2, "0"))
    stamp = F.coalesce(F.when(F.col("w").isNotNull(), F.concat(iso, F.lit("_"), F.translate("w.g1", ": ", ""))), F.concat(F.lit("part"), F.lpad(F.col("session").cast("string"), 2, "0")))
    head = F.array_join(F.slice(F.split("content", "\n"), 1, 100), "\n")
    names = sorted(people if people is not None else L.KNOWN_PEOPLE)
    found = F.array_compact(F.array(*(F.when(F.rlike(head, F.lit(rf"(?iU)\b{n}\b")), F.lit(n)) for n in names)))
    words = F.filter(F.split(F.regexp_replace("q.p", r"[^\p{IsAlphabetic}\p{N}-]", " "), " +"), lambda w: w != "")
    subject = F.coalesce(F.substring(F.array_join(words, "-"), 1, 60), F.lit("session"))
    who = F.when(F.size(found) == 0, "unknown").otherwise(F.array_join(F.slice(found, 1, 3), "-"))
    base = F.substring(F.regexp_replace(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""), r"(?U)[^\w-]", "_"), 1, 40)
    name = F.regexp_replace(F.regexp_replace(F.concat(base, F.lit("__"), stamp, F.lit("_"), who, F.lit("_"), subject, F.lit(".txt")), r"(?U)[^\w.\-]", "_"), "_+", "_")
    return each.select("file", "session", "n_lines", stamp.alias("stamp"), F.when(F.col("w").isNotNull(), iso).alias("iso_date"), found.alias("people"), subject.alias("subject"), name.alias("name"), "content")
