"""Quality rules on repetition, by suffix arrays over the words of each document.

The suffixes of all documents of a block are sorted at once by prefix doubling over word hashes;
groups that are already told apart are left out of later rounds. Ranks of every round are kept, and
common prefixes of neighbours in the suffix array come from them by halving steps. A suffix's
deepest interval of common prefixes gives the longest repeat that starts at it; the maximal
repeats of at least ``min_words`` words are laid over the document, and a document is rejected if
they cover too much of it or one of them alone is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.textblock import WORD, Block, RollingHash, blocks, mix, runs

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """``min_words``: repeats below it don't count. A document goes if repeats cover more than
    ``max_covered`` of its words, or the longest has more than ``max_longest`` of them."""

    min_words: int = 8
    max_covered: float = 0.3
    max_longest: float = 0.2


def suffix_ranks(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of each text after 1, 2, 4, ... words; in the last all differ.

    ``words`` are word values, ``text`` the text of each word, ascending. A rank is the place of
    the suffix's group among all sorted suffixes, so later rounds only split groups.
    """
    n = len(words)
    last = np.searchsorted(text, text, side="right")
    levels, rank, active, step = [], np.zeros(n, np.int32), np.arange(n), 1
    key = mix(words ^ mix(text.astype(np.uint64)))
    low = np.zeros(n, np.uint64)
    while len(active):
        order = np.lexsort((low, key)) if step > 1 else np.argsort(key, kind="stable")
        at, k, l = active[order], key[order], low[order]
        new = np.ones(len(at), bool)
        new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        if step > 1:
            first = np.ones(len(at), bool)
            first[1:] = k[1:] != k[:-1]
            place += rank[at] - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        rank = rank.copy()
        rank[at] = place
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        active = np.sort(at[~alone])
        there = active + step
        key = rank[active].astype(np.uint64)
        low = np.where(there < last[active], rank[np.minimum(there, n - 1)] + 1, 0).astype(np.uint64)
        step *= 2
    return levels


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, how many words of the suffix there also start elsewhere in its text."""
    n = len(words)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels = suffix_ranks(words, text)
    if not levels:
        return out
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    a, b = array[:-1], array[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (x < n) & (y < n)
        same = fits & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        common += same.astype(np.int64) << k
    for side in (a, b):
        # each suffix stands at most once on either side
        out[side] = np.maximum(out[side], common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(block: Block, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The figures of each text of the block."""
    data, offsets, texts = block.data, block.offsets, len(block.lengths)
    hashed = RollingHash(data)
    starts, ends = block.words(WORD)
    text = block.text_of(starts)
    n_words = np.bincount(text, minlength=texts)
    whole = (data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    repeat = longest_repeats(hashed(starts, ends), text)
    n = len(starts)

    def words_in(least: int) -> np.ndarray:
        at = np.flatnonzero(repeat >= least)
        span = np.full(len(at), least) if least == 3 else repeat[at]
        return np.bincount(text[covered(at, span, n)], minlength=texts)

    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, np.where(repeat >= rules.min_words, repeat, 0))

    line_starts, line_ends = runs(data != 0x0A, offsets)
    held = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[held], line_ends[held]
    line_text = block.text_of(line_starts)
    key = mix(hashed(line_starts, line_ends) ^ mix(line_text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    return {
        "n_words": n_words,
        "word_chars": block.per_text(WORD[data] & whole),
        "n_symbols": block.per_text(symbol[data]),
        "n_dup_lines": np.bincount(line_text[again], minlength=texts),
        "n_repeat_words": words_in(3),
        "n_covered_words": words_in(rules.min_words),
        "longest_repeat": longest,
    }


def score_repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Figures and verdict for each row of ``docs``.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_covered_words, longest_repeat (words, 0 below ``rules.min_words``), kept. With
    ``keep_columns`` the columns of ``docs`` of the kept rows instead, and nothing else.

    A null or empty text, or one without words, has zeros everywhere and fails the base rules.
    Equal rows get equal results, each by itself; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result. A text longer than a block is one block.
    """
    rows = docs if keep_columns else docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    text = text_col if keep_columns else "text"
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            m = measure(block, rules)
            n = m["n_words"]
            failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
            kept = ~failed & (m["n_covered_words"] <= rules.max_covered * n) & (m["longest_repeat"] <= rules.max_longest * n)
            if keep_columns:
                yield block.rows.filter(pa.array(kept))
            else:
                cols = [block.rows.column(0), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(kept)]
                yield pa.record_batch(cols, names=["doc_id", *counts, "base_failed", "kept"])

    if keep_columns:
        return rows.mapInArrow(score, docs.schema)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean")
