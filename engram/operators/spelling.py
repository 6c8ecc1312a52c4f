"""Spelling of what users write, against a dictionary with frequencies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicon as L

_SKIPS = [regex.compile(p) for p in L.SPELLING_SKIPS]
_TOKEN = regex.compile(r"(\S+)")


def edits(a: str, b: str, most: int) -> int:
    """Edits from a to b, with swaps of neighbours, or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return rows[-1][-1]


class Speller:
    """Corrections by the nearest word of a dictionary (word: frequency), the more frequent where as near."""

    def __init__(self, dictionary: dict[str, int]):
        self.dictionary = dictionary
        self.word = lru_cache(100_000)(self._word)

    def _word(self, word: str, most: int) -> str | None:
        if word in self.dictionary:
            return word
        found = ((edits(word, w, most), -f, w) for w, f in self.dictionary.items() if abs(len(w) - len(word)) <= most)
        best = min(((d, f, w) for d, f, w in found if d <= most), default=None)
        return best and best[2]

    def text(self, text: str, known: frozenset[str] = frozenset()) -> str:
        """The text with its lower-case words corrected; white space and punctuation stay."""

        def corrected(match) -> str:
            token = match[0]
            core = token.rstrip(".,!?;:'\")")
            if not core or len(core.encode()) < 4 or core in known or core[0].isupper() or any(p.search(core) for p in _SKIPS):
                return token
            return (self.word(core, 2 if len(core.encode()) <= 7 else 3) or core) + token[len(core) :]

        return _TOKEN.sub(corrected, text)

    def transcript(self, text: str) -> str:
        """Only lines after > are corrected."""
        out = []
        for line in text.splitlines():
            head, mark, rest = line.partition(">")
            out.append(head + mark + self.text(rest) if mark and not head.strip() else line)
        return "\n".join(out)


def default_dictionary() -> dict[str, int]:
    return {w: 100 for w in L.SPELLING_WORDS}


def corrected(docs: DataFrame, id_col: str, text_col: str, dictionary: dict[str, int] | None = None, transcript: bool = False) -> DataFrame:
    """(id, text) with corrected words. Swapped letters are one edit, which no built-in function counts, so this is made in Arrow batches."""
    words = dictionary or default_dictionary()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(words)
        fix = speller.transcript if transcript else speller.text
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if t is None else fix(t) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
