"""Symbolic summaries: a header, one line of entities, topics, quote, emotions and flags, and an overlay in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.text import VERSION, emotions, flags, key_sentence, propositions, shadow_id, stem, strings, topics
from engram.operators.extract import structured_memories


def density_limits(density: int) -> tuple[int, int]:
    """Most entities and topics at a density from 1 to 10."""
    for most, limits in ((2, (1, 2)), (4, (2, 3)), (5, (3, 3)), (8, (4, 5))):
        if density <= most:
            return limits
    return 5, 7


def entities_in(text: Column, most: int, codes: dict[str, str] | None = None) -> Column:
    """Codes with shadow ids: of known names in the text if there are any, else of its capitalised words but the first."""
    low = F.lower(text)
    names = [n for n in sorted(codes or {}, key=lambda n: (-len(n), n)) if n != n.lower()]
    known = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(n.lower())), F.concat(F.lit(f"{codes[n]}[#"), shadow_id(F.lit(n)), F.lit("]"))) for n in names))) if names else F.array().cast("array<string>")
    words = F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}]", ""))
    stop = strings(L.TOPIC_STOP_WORDS)
    kept = F.filter(F.slice(words, 2, 1 << 30), lambda w: (F.octet_length(w) >= 2) & F.rlike(w, F.lit(r"^\p{Lu}\p{Ll}*$")) & ~F.array_contains(stop, F.lower(w)))
    coded = F.array_distinct(F.transform(kept, lambda w: F.concat(F.upper(F.substring(w, 1, 3)), F.lit("[#"), shadow_id(w), F.lit("]"))))
    return F.slice(F.when(F.size(known) > 0, known).otherwise(coded), 1, most)


def faithfulness(entities: Column, found: Column, text: Column) -> Column:
    """From the numbers of entities and topics, to two places; 1 for an empty text."""
    score = F.least(F.lit(0.5), F.size(entities) * 0.2) + F.least(F.lit(0.5), F.size(found) * 0.1)
    return F.when(text == "", F.lit(1.0)).otherwise(F.round(score, 2))


def fields(docs: DataFrame, id_col: str, text_col: str, density: int = 5, codes: dict[str, str] | None = None) -> DataFrame:
    """The parts of each summary as columns: id, text, entities, topics, quote, emotions, flags, faithfulness."""
    most_entities, most_topics = density_limits(density)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"entities": entities_in(F.col("text"), most_entities, codes), "topics": topics("text", most_topics), "quote": key_sentence("text"), "emotions": emotions("text"), "flags": flags("text")})
    return rows.withColumn("faithfulness", faithfulness(F.col("entities"), F.col("topics"), F.col("text")))


def _or(array: str, sep: str, other: str) -> Column:
    return F.when(F.size(array) == 0, F.lit(other)).otherwise(F.array_join(array, sep))


def summarised(docs: DataFrame, id_col: str, text_col: str, density: int = 5, codes: dict[str, str] | None = None, wing: str | None = None, room: str | None = None, date: str | None = None, source: str | None = None) -> DataFrame:
    """(id, summary). ``wing``, ``room``, ``date``, ``source`` name columns of ``docs``.

    A text that decides something must say who, what, why and how sure; if it doesn't, at a density
    of 5 or more it stays as it is, marked as raw.
    """
    meta = {"wing": wing, "room": room, "date": date, "source_file": source}
    rows = fields(docs, id_col, text_col, density, codes)
    # only texts with that flag need their memories
    flagged = docs.where(F.array_contains(flags(F.col(text_col)), "DECISION"))
    decided = structured_memories(flagged, id_col, text_col).where("memory_type = 'Decision'")
    first = decided.groupBy("id").agg(F.min_by(F.size("matrix") == 4, "chunk_index").alias("_whole"))
    rows = rows.join(first, "id", "left")
    extra = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"_{k}") for k, c in meta.items() if c))
    rows = rows.join(extra, "id") if len(extra.columns) > 1 else rows
    is_decision = F.array_contains("flags", "DECISION") & F.col("_whole").isNotNull()
    whole = is_decision & F.col("_whole")
    named = F.when(whole, F.transform("flags", lambda f: F.when(f == "DECISION", "DECISION[v1]").otherwise(f))).otherwise(F.col("flags"))
    line = F.concat_ws(
        "|", F.concat(F.lit("0:"), _or("entities", "+", "???")), _or("topics", "_", "misc"), F.when(F.col("quote") != "", F.concat(F.lit('"'), "quote", F.lit('"'))),
        F.when(F.size("emotions") > 0, F.array_join("emotions", "+")), F.when(F.size(named) > 0, F.array_join(named, "+")),
    )
    value = lambda k, c=None: F.coalesce(F.replace(c if c is not None else F.col(f"_{k}"), F.lit("|"), F.lit(" ")), F.lit("?")) if meta[k] else F.lit("?")
    header = F.concat_ws("|", value("wing"), value("room"), value("date"), value("source_file", stem("_source_file") if source else None)) if wing or source else F.lit(None)
    overlay = F.struct(F.lit(VERSION).alias("version"), *(F.col(f"_{k}").alias(k) for k, c in meta.items() if c), F.struct(F.col("faithfulness"), F.when(whole, F.lit("v1")).alias("grammar_reg")).alias("extra"))
    summary = F.concat_ws("\n", F.lit(VERSION), header, line, F.concat(F.lit("JSON:"), F.to_json(overlay)))
    raw = is_decision & ~F.col("_whole") & F.lit(density >= 5)
    return rows.select("id", F.when(raw, F.concat(F.lit("RAW|FBF|"), "text")).otherwise(summary).alias("summary"))


def decoded(summary: Column) -> Column:
    """A summary's parts: version, header, arc, zettels, tunnels, overlay (JSON text)."""
    all_lines = F.split(F.regexp_replace(summary, r"^\s+|\s+$", ""), "\n")
    kind = lambda l: (
        F.when(F.startswith(l, F.lit("V:")), "version").when(F.startswith(l, F.lit("ARC:")), "arc").when(F.startswith(l, F.lit("T:")), "tunnel").when(F.startswith(l, F.lit("JSON:")), "overlay")
        .when(F.contains(l, F.lit("|")) & F.contains(F.substring_index(l, "|", 1), F.lit(":")), "zettel").when(F.contains(l, F.lit("|")), "header")
    )
    of = lambda name: F.filter(all_lines, lambda l: kind(l) == name)
    last = lambda name, skip: F.substring(F.try_element_at(of(name), F.lit(-1)), skip + 1, 1 << 30)
    header = F.split(F.try_element_at(of("header"), F.lit(-1)), r"\|")
    return F.struct(
        last("version", 2).alias("version"), F.struct(*(F.get(header, F.lit(i)).alias(n) for i, n in enumerate(("wing", "room", "date", "title")))).alias("header"),
        F.coalesce(last("arc", 4), F.lit("")).alias("arc"), of("zettel").alias("zettels"), of("tunnel").alias("tunnels"), last("overlay", 5).alias("overlay"),
    )


def merged(summaries: DataFrame, key: str = "cluster", rank: str = "rank", text: str = "summary") -> DataFrame:
    """(key, summary): of each group the first summary, with all its members' entities and topics."""
    zettels = F.flatten(F.collect_list(decoded(F.col(text))["zettels"]))
    each = summaries.groupBy(key).agg(F.min_by(text, rank).alias("_first"), zettels.alias("_z"), F.count(F.lit(1)).alias("_n"))
    part = lambda i, sep: F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("_z", lambda z: F.split(F.regexp_replace(F.get(F.split(z, r"\|"), F.lit(i)), "^[^|:]*:", "") if i == 0 else F.get(F.split(z, r"\|"), F.lit(i)), sep))), lambda x: (x != "") & (x != "???"))))
    names, words = F.array_join(part(0, r"\+"), "+"), F.array_join(part(1, "_"), "_")

    def renewed(l: Column) -> Column:
        p = F.split(l, r"\|")
        zettel = F.contains(l, F.lit("|")) & ~F.startswith(l, F.lit("JSON:")) & ~F.startswith(l, F.lit("V:")) & F.contains(F.get(p, F.lit(0)), F.lit(":"))
        head = F.concat(F.substring_index(F.get(p, F.lit(0)), ":", 1), F.lit(":"), names)
        return F.when(zettel, F.concat_ws("|", head, words, F.when(F.size(p) > 2, F.array_join(F.slice(p, 3, 1 << 30), "|")))).otherwise(l)

    new = F.array_join(F.transform(F.split("_first", "\n"), renewed), "\n")
    return each.select(key, F.when(F.col("_n") == 1, F.col("_first")).otherwise(new).alias("summary"))


def proposition_lines(docs: DataFrame, id_col: str, text_col: str, most: int = 5, density: int = 5) -> DataFrame:
    """(id, place, line): each of the best propositions as a line of entities, topics, emotions and flags."""
    most_entities, most_topics = density_limits(density)
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(propositions(text_col, most)).alias("place", "p"))
    rows = rows.withColumns({"entities": entities_in(F.col("p"), most_entities), "topics": topics("p", most_topics), "emotions": emotions("p"), "flags": flags("p")})
    line = F.concat_ws("|", F.concat(F.lit("P"), F.col("place").cast("string"), F.lit(":"), _or("entities", "+", "???")), _or("topics", "_", "misc"), F.when(F.size("emotions") > 0, F.array_join("emotions", "+")), F.when(F.size("flags") > 0, F.array_join("flags", "+")))
    return rows.select("id", "place", line.alias("line"))


def coverage(text: Column, summary: Column) -> Column:
    """The fraction of the ten weightiest topics that the summary holds."""
    all_topics, low = topics(text, 10), F.lower(summary)
    return F.size(F.filter(all_topics, lambda t: F.contains(low, t))) / F.greatest(F.size(all_topics), F.lit(1))


def summary_tokens(summary: Column) -> Column:
    """The parts of a summary that a delta compares."""
    parts = F.transform(F.split(summary, r"[|\n_]"), lambda t: F.lower(F.regexp_replace(t, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & ~F.startswith(t, F.lit("0:")) & ~F.startswith(t, F.lit("v:"))))


def delta(old: Column, new: Column) -> Column:
    """The change between two summaries if it is below 40 % of the old one's parts, else the new one."""
    before, after = summary_tokens(old), summary_tokens(new)
    added, removed = F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))
    changes = F.concat(F.transform(added, lambda t: F.concat(F.lit("+"), t)), F.transform(removed, lambda t: F.concat(F.lit("-"), t)))
    small = (F.size(before) > 0) & (F.size(changes) / F.greatest(F.size(before), F.lit(1)) < 0.4)
    return F.when(small & (F.size(changes) == 0), "DELTA:(no change)").when(small, F.concat(F.lit("DELTA:"), F.array_join(changes, ","))).otherwise(new)
