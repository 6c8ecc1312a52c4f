"""Text functions on columns: counts, tags, topics, codes, ids. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions import lexicon as L

#: The format's version, first line of each symbolic summary.
VERSION = "V:3.2"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(items) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def count_tokens(text: Column | str) -> Column:
    """Estimated tokens: 1.3 for each word between white space, 1 at least."""
    words = F.regexp_count(_col(text), F.lit(r"\S+"))
    return F.greatest(F.lit(1), F.round(words * 1.3).cast("long"))


def compression_stats(text: Column, summary: Column) -> Column:
    """Token estimates of both, their ratio to one place, and sizes in bytes."""
    a, b = count_tokens(text), count_tokens(summary)
    return F.struct(a.alias("original_tokens_est"), b.alias("summary_tokens_est"), F.round(a / b, 1).alias("size_ratio"), F.octet_length(text).cast("long").alias("original_chars"), F.octet_length(summary).cast("long").alias("summary_chars"))


def decayed_importance(base: Column, last_accessed: Column, access_count: Column, now: Column | int) -> Column:
    """Importance less a tenth for each day since the last access, more with the number of accesses."""
    days = F.greatest((_lit(now) - last_accessed) / F.lit(86400.0), F.lit(0.0))
    return base * F.pow(F.lit(0.9), days) * F.greatest(F.log(F.lit(1.0) + access_count), F.lit(1.0))


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def display_weight(importance: Column) -> Column:
    return F.least(F.round(importance * 2), F.lit(9)).cast("int")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path: Column | str) -> Column:
    """The file name without its last extension; a name that only begins with a dot stays."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def snippet(text: Column | str, most: int = 300) -> Column:
    """On one line, trimmed, of at most ``most`` characters with an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(_col(text), r"^\s+|\s+$", ""), "\n", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def slug(name: Column | str) -> Column:
    """Identifier of an entity: lower case, spaces as underscores, no apostrophes."""
    return F.replace(F.replace(F.lower(_col(name)), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_slug(name: Column | str) -> Column:
    return F.replace(F.lower(_col(name)), F.lit(" "), F.lit("_"))


def shadow_id(name: Column | str) -> Column:
    """Five hex digits from the lower-cased name."""
    return F.substring(F.sha2(F.lower(_col(name)), 256), 1, 5)


def drawer_id(wing: Column, room: Column, source: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("drawer"), wing, room, F.sha2(F.concat(source, index.cast("string")), 256))


def triple_id(subject: Column, predicate: Column, obj: Column, valid_from: Column) -> Column:
    """Deterministic: the same triple and start give the same id."""
    return F.concat_ws("_", F.lit("t"), subject, predicate, obj, F.substring(F.sha2(F.concat_ws(":", subject, predicate, obj, F.coalesce(valid_from, F.lit(""))), 256), 1, 8))


def person_code(name: Column | str) -> Column:
    """Three capital letters of a name, padded with X."""
    return F.rpad(F.upper(F.substring(F.regexp_replace(_col(name), r"[^\p{L}]", ""), 1, 3)), 3, "X")


def signals(text: Column | str, mapping: dict[str, str], most: int = 3) -> Column:
    """Codes of the signals that the text contains, in order of declaration, each once, ``most`` at most."""
    low = F.lower(_col(text))
    found = F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in mapping.items()))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def emotions(text: Column | str, mapping: dict[str, str] | None = None) -> Column:
    return signals(text, mapping or L.EMOTION_SIGNALS)


def flags(text: Column | str, mapping: dict[str, str] | None = None) -> Column:
    return signals(text, mapping or L.FLAG_SIGNALS)


def encode_emotions(names: Column, custom: dict[str, str] | None = None) -> Column:
    """Codes of named emotions (unknown ones by their first four letters), each once, three at most, joined by +."""
    table = F.create_map(*(F.lit(x) for kv in (L.EMOTION_CODES | (custom or {})).items() for x in kv))
    codes = F.transform(names, lambda e: F.coalesce(F.try_element_at(table, e), F.substring(e, 1, 4)))
    return F.array_join(F.slice(F.array_distinct(codes), 1, 3), "+")


def encode_entity(name: Column, codes: dict[str, str], skip: list[str] | None = None) -> Column:
    """A name's code: its own, that of the longest key that contains it or is contained in it, or its first three letters."""
    low = F.lower(name)
    table = dict(codes) | {k.lower(): v for k, v in codes.items()}
    tries = [F.when(name == k, F.lit(v)) for k, v in table.items()] + [F.when(low == k, F.lit(v)) for k, v in table.items()]
    keys = sorted(table, key=lambda k: (-len(k), k))
    tries += [F.when(F.contains(F.lit(k.lower()), low) | F.contains(low, F.lit(k.lower())), F.lit(table[k])) for k in keys]
    short = F.when(F.octet_length(name) >= 3, F.upper(F.substring(name, 1, 3))).otherwise(F.upper(name))
    code = F.coalesce(*tries, short)
    for s in skip or []:
        code = F.when(~F.contains(low, F.lit(s.lower())), code)
    return code


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_where(items: Column, changes) -> Column:
    """The places (from 0) of an array where ``changes`` (element, the one before) says so, and its first one."""
    at = F.sequence(F.lit(0), F.size(items) - 1)
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: (i == 0) | changes(F.get(items, i), F.get(items, i - 1))))


def pieces_at(items: Column, starts: Column, body) -> Column:
    """``body`` of each part of an array that begins at one of the (ascending) places and ends before the next."""
    return F.transform(starts, lambda a, j: body(F.slice(items, a + 1, F.coalesce(F.get(starts, j + 1), F.size(items)) - a)))


def topics(text: Column | str, most: int = 3, stop_words: list[str] | None = None) -> Column:
    """The weightiest words: 1 for each occurrence, 2 more if capitalised, 2 more if compound; ties in order of letters.

    Occurrences are sorted and summed from one word to the next, so a text takes time in proportion to its length.
    """
    stop = strings(stop_words if stop_words is not None else L.TOPIC_STOP_WORDS)
    words = F.regexp_extract_all(_col(text), F.lit("[a-zA-Z][a-zA-Z_-]{2,}"), F.lit(0))
    heavy = lambda w: 1 + F.when(F.rlike(w, F.lit("^[A-Z]")), 2).otherwise(0) + F.when(F.rlike(w, F.lit("[_-]|^.+[A-Z]")), 2).otherwise(0)
    pairs = F.sort_array(F.transform(words, lambda w: F.struct(F.lower(w).alias("w"), heavy(w).alias("n"))))
    summed = lambda part: F.struct((-F.aggregate(part, F.lit(0), lambda n, p: n + p["n"])).alias("n"), F.get(part, F.lit(0))["w"].alias("w"))
    sums = let(pairs, lambda all_: let(starts_where(all_, lambda x, y: x["w"] != y["w"]), lambda at: pieces_at(all_, at, lambda part: let(part, summed))))
    ranked = F.sort_array(F.filter(sums, lambda p: ~F.array_contains(stop, p["w"])))
    return F.transform(F.slice(ranked, 1, most), lambda p: p["w"])


def sentences(text: Column | str) -> Column:
    return F.transform(F.split(_col(text), r"[.!?\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def _best(scored: Column) -> Column:
    return F.array_sort(scored)


def key_sentence(text: Column | str, words: list[str] | None = None) -> Column:
    """The sentence with most decision words, shorter ones first; made safe and cut to 55 characters."""
    words = words or L.KEY_WORDS

    def score(s: Column) -> Column:
        n, low = F.octet_length(s), F.lower(s)
        hits = reduce(Column.__add__, (F.when(F.contains(low, F.lit(w)), 2).otherwise(0) for w in words))
        return hits + F.when(n < 80, 1).otherwise(0) + F.when(n < 40, 1).otherwise(0) - F.when(n > 150, 2).otherwise(0)

    long = F.filter(sentences(text), lambda s: F.octet_length(s) > 10)
    best = F.get(_best(F.transform(long, lambda s, i: F.struct((-score(s)).alias("n"), i.alias("i"), s.alias("s")))), F.lit(0))["s"]
    safe = F.replace(F.translate(best, "|\n", "  "), F.lit('"'), F.lit("'"))
    return F.coalesce(F.when(F.octet_length(safe) > 55, F.concat(F.substring(safe, 1, 52), F.lit("..."))).otherwise(safe), F.lit(""))


def propositions(text: Column | str, most: int = 5, words: list[str] | None = None) -> Column:
    """Sentences of 20 bytes or more that state facts, the best first, in order where they are as good."""
    words = words or L.FACT_SIGNALS

    def score(s: Column) -> Column:
        n, low = F.octet_length(s), F.lower(s)
        named = F.when(F.rlike(s, F.lit(r"\s\p{Lu}")), 2).otherwise(0)
        hits = reduce(Column.__add__, (F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words))
        return named + hits + F.when(n > 150, -2).when(n < 80, 1).otherwise(0)

    long = F.filter(sentences(text), lambda s: F.octet_length(s) >= 20)
    ranked = _best(F.transform(long, lambda s, i: F.struct((-score(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["s"])


def sentiment(text: Column | str, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """(good - bad) / (good + bad) words; 0 without either."""
    words = F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+")

    def count(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: F.array_contains(strings(listed), w)))

    good, bad = count(positive or L.POSITIVE_WORDS), count(negative or L.NEGATIVE_WORDS)
    return F.when(good + bad == 0, F.lit(0.0)).otherwise((good - bad) / (good + bad))


def keyword_room(text: Column | str, keywords: dict[str, list[str]], chars: int, distinct: bool) -> Column:
    """The room whose keywords the text's beginning holds most (each once, or each occurrence); first by letters on ties; else general."""
    low = F.lower(F.substring(_col(text), 1, chars))

    def score(words: list[str]) -> Column:
        each = (F.when(F.contains(low, F.lit(w)), 1).otherwise(0) if distinct else ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words)
        return reduce(Column.__add__, each)

    best = F.get(F.array_sort(F.array(*(F.struct((-score(w)).alias("n"), F.lit(r).alias("r")) for r, w in keywords.items()))), F.lit(0))
    return F.when(best["n"] < 0, best["r"]).otherwise("general")


def project_room(path: Column, text: Column, wings: list[str] | None = None, keywords: dict[str, list[str]] | None = None) -> Column:
    """Room of a file: a folder of its (relative) path that matches a wing, its name that does, or keywords of its text."""
    wings, keywords = wings or L.TOPIC_WINGS, keywords or L.HALL_KEYWORDS
    low = F.lower(path)
    parts = F.split(low, r"[/\\]")
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    match = lambda p: F.coalesce(*(F.when(F.contains(p, F.lit(w.lower())) | F.contains(F.lit(w.lower()), p), F.lit(w)) for w in wings))
    folder = F.get(F.array_compact(F.transform(folders, match)), F.lit(0))
    name = stem(low)
    return F.coalesce(folder, F.when(name != "", match(name)), keyword_room(text, keywords, 2000, False))


def is_code_line(line: Column) -> Column:
    """A shell, code or table line, or one with few letters."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    pattern = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in L.CODE_LINE_PATTERNS)
    letters = F.length(F.regexp_replace(s, r"[^\p{IsAlphabetic}]", ""))
    return (s != "") & (F.rlike(s, F.lit(pattern)) | ((letters / F.octet_length(s) < 0.4) & (F.octet_length(s) > 10)))


def prose(text: Column) -> Column:
    """The text without fenced blocks and code lines; as it is if nothing else is there.

    A block goes from a line that begins with three back-ticks to the next such line, or to the end.
    """
    # a last line of its own is cut off again: it, or what an open block leaves of it
    marked = F.concat(text, F.lit("\n\0"))
    open_ = F.regexp_replace(marked, r"(?dms)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*\n|\z)", "")
    kept = let(F.split(open_, r"\r?\n"), lambda all_: F.filter(F.slice(all_, 1, F.size(all_) - 1), lambda l: ~is_code_line(l)))
    return let(kept, lambda k: F.when(F.size(k) == 0, text).otherwise(F.regexp_replace(F.array_join(k, "\n"), r"^\s+|\s+$", "")))


def needed_literal(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds; empty if its form doesn't tell."""
    best = run = ""
    depth = at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "|" and depth == 0:
            return ""
        if depth == 0 and re.match(r"[a-z0-9 :%'-]", c):
            run += c
        else:
            if c in "?*{" and depth == 0:
                run = run[:-1]
            best, run = max(best, run, key=len), ""
            depth += (c == "(") - (c == ")")
            if c == "\\":
                at += 1
            elif c == "[":
                at = pattern.index("]", at + 2)
        at += 1
    return max(best, run, key=len)


def marker_score(text: Column, patterns: list[str]) -> Column:
    """How often the patterns match the lower-cased text. A pattern is only tried where its plain text occurs."""
    low = F.lower(text)

    def count(pattern: str) -> Column:
        matches, literal = F.regexp_count(low, F.lit(f"(?U){pattern}")), needed_literal(pattern)
        return F.when(F.contains(low, F.lit(literal)), matches).otherwise(0) if literal else matches

    return reduce(Column.__add__, map(count, patterns))


def decision_part(text: Column, part: str) -> Column:
    """The first match of a part of a decision, null without one."""
    found = F.regexp_extract(text, f"(?i){L.DECISION_PARTS[part]}", 2)
    return F.when(found != "", F.regexp_replace(found, r"^\s+|\s+$", ""))


def spelling_skip(word: Column) -> Column:
    """Words that aren't checked: short, with digits, capitals inside, symbols, or parts of paths."""
    return (F.octet_length(word) < 4) | reduce(Column.__or__, (F.rlike(word, F.lit(p)) for p in L.SPELLING_SKIPS))


def strip_code(text: Column) -> Column:
    """Without fenced blocks, inline code and shell lines. Lines end at newlines only."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?s)```.*?```", ""), "(?d)`.*?`", ""), r"(?md)^\$[\t\n\f\r ]+.*", "")
