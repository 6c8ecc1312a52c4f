import random
from collections import Counter

import numpy as np

from engram.llm.repetition import RepetitionRules, longest_repeats, score_repetition
from tests.llm.helpers import WORD, docs_of, sample_texts, stored


def brute_longest(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def brute(text, rules):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeat = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(repeat) > 50 * n
    base = [n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), failed]
    if n > 700:
        return base
    longest = brute_longest(words)
    covered = {j for i, k in enumerate(longest) if k >= rules.min_words for j in range(i, i + k)}
    top = max([k for k in longest if k >= rules.min_words], default=0)
    return [*base, len(covered), top, not failed and len(covered) <= rules.max_covered * n and top <= rules.max_longest * n]


def test_figures_equal_brute_force(spark):
    rules = RepetitionRules()
    texts = sample_texts() + [r["text"] for r in stored()]
    got = {r.doc_id: r for r in score_repetition(docs_of(spark, texts), rules).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], brute(text, rules)
        have = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_covered_words, r.longest_repeat, r.kept]
        assert have[: len(want)] == want, text


def test_suffix_arrays_of_several_texts():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        words = np.array([w for t in texts for w in t], np.uint64)
        text = np.repeat(np.arange(4), [len(t) for t in texts])
        assert longest_repeats(words, text).tolist() == [x for t in texts for x in brute_longest(t)]


def test_filter_keeps_rows_as_they_are(spark):
    docs = docs_of(spark)
    kept = {r.doc_id for r in score_repetition(docs).where("kept").collect()}
    out = score_repetition(docs, keep_columns=True)
    assert out.schema == docs.schema
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect() if r.doc_id in kept}
    assert score_repetition(docs.limit(0)).count() == 0
