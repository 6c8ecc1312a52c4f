"""Texts into parts: overlapping chunks, exchanges, paragraphs, segments for classification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicon as L
from engram.functions.text import let, pieces_at, starts_where

#: Fixed values of the chunker, in bytes.
CHUNK, OVERLAP, LEAST = 800, 100, 50


def overlapping(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of at most ``size`` bytes that end at a paragraph or line in their second half where there is one."""
    data = text.strip().encode()
    start, out = 0, []

    def snapped(at: int, step: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at += step
        return at

    while start < len(data):
        end = snapped(min(start + size, len(data)), -1)
        if end < len(data):
            cut = data.rfind(b"\n\n", start, end)
            cut = cut if cut >= 0 else data.rfind(b"\n", start, end)
            if cut - start > size // 2:
                end = cut
        chunk = data[start:end].decode().strip()
        if len(chunk.encode()) >= least:
            out.append(chunk)
        if end >= len(data):
            break
        back = snapped(end - overlap, 1) if end > overlap else 0
        start = back if start < back < end else end
    return out


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """A row per chunk: the id, chunk_index, chunk. The cut depends on the one before, so it is made in Arrow batches."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, chunks = [], [], []
            for i, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                parts = overlapping(text or "", size, overlap, least)
                ids += [i] * len(parts)
                index += range(len(parts))
                chunks += parts
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(chunks, pa.string())], names=["id", "chunk_index", "chunk"])

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, chunk_index int, chunk string")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one doesn't count."""
    return F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")


def _groups(all_lines: Column, size: int = 25) -> Column:
    count = F.ceil(F.size(all_lines) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: trimmed(F.array_join(F.slice(all_lines, i * size + 1, size), "\n")))


def paragraphs(text: Column, least: int = 31) -> Column:
    """Parts between blank lines of ``least`` bytes or more; of one long part groups of 25 lines."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda p: p != "")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    parts = F.when((F.size(parts) <= 1) & (breaks > 20), _groups(lines(text))).otherwise(parts)
    return F.filter(parts, lambda p: F.octet_length(p) >= least)


def exchanges(text: Column, least: int = 31, answer_lines: int = 8) -> Column:
    """Each line that begins with > with the answer below it, until the next or a rule; at most 8 lines of answer."""
    opens = lambda l: F.startswith(l, F.lit(">"))

    def exchange(part: Column) -> Column:
        answer = F.array_join(F.slice(F.filter(F.slice(part, 2, 1 << 30), lambda l: l != ""), 1, answer_lines), " ")
        return F.concat(F.get(part, F.lit(0)), F.when(answer != "", F.concat(F.lit("\n"), answer)).otherwise(""))

    all_ = F.transform(lines(text), trimmed)
    turn = lambda part: F.when(opens(F.get(part, F.lit(0))), let(part, exchange))
    parts = let(all_, lambda x: let(starts_where(x, lambda l, _: opens(l) | F.startswith(l, F.lit("---"))), lambda at: pieces_at(x, at, lambda part: let(part, turn))))
    return F.filter(F.array_compact(parts), lambda x: F.octet_length(trimmed(x)) >= least)


def conversation_chunks(text: Column) -> Column:
    """Exchanges where three lines or more begin with >, else paragraphs."""
    quoted = F.regexp_count(text, F.lit(r"(?m)^[ \t]*>"))
    return F.when(quoted >= 3, exchanges(text)).otherwise(paragraphs(text))


def segments(text: Column) -> Column:
    """Parts to classify: turns where three lines or more are turns, else paragraphs, else groups of 25 lines."""
    all_lines = lines(text)
    is_turn = lambda l: F.rlike(trimmed(l), F.lit("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in L.TURN_PATTERNS)))
    turns = let(all_lines, lambda x: let(starts_where(x, lambda l, _: is_turn(l)), lambda at: pieces_at(x, at, lambda part: F.array_join(part, "\n"))))
    parts = F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda p: p != "")
    grouped = F.filter(_groups(all_lines), lambda p: p != "")
    return F.when(F.size(F.filter(all_lines, is_turn)) >= 3, turns).when((F.size(parts) <= 1) & (F.size(all_lines) > 20), grouped).otherwise(parts)
