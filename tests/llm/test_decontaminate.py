import hashlib

import pytest

from engram.llm.decontaminate import decontaminate
from tests.llm.helpers import SF, docs_of, sample_texts, stored, terms


def brute(text, items, window=13):
    words, hit, found = terms(text), set(), set()
    for item, item_text in items:
        w = terms(item_text)
        k = min(window, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def check(spark, texts, items, ids=None):
    docs = docs_of(spark, texts, ids)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    got = decontaminate(docs, bench).drop("_k").collect()
    want = sorted((i if ids is None else ids[i], *brute(t, items)) for i, t in enumerate(texts))
    assert sorted(map(tuple, got)) == want


def test_equals_brute_force(spark):
    texts = sample_texts()
    items = [(1, texts[8]), (2, "one two three"), (3, None), (4, ""), (5, "Onan"), (6, texts[5]), (7, texts[12][:800]), (7, "x1 42"), (8, texts[8]), (9, texts[9])]
    check(spark, texts, items)
    check(spark, texts[:16] * 2, items, [k // 2 for k in range(32)])


def test_equals_brute_force_on_stored_tables(spark):
    texts = [r["text"] for r in stored()]
    items = [(r["item_id"], r["text"]) for r in stored("benchmark")]
    assert any(brute(t, items)[4] for t in texts)
    check(spark, texts, items)


@pytest.mark.parametrize("case", ["docs", "items", "wordless"])
def test_empty_tables(spark, case):
    texts = ["a b c"] if case != "docs" else []
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(1, " . ")] if case == "wordless" else [], "item_id long, text string")
    rows = decontaminate(docs, bench).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(3, 0, False)] * len(texts)


def test_no_python_in_the_plan(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_windows_that_items_share_and_very_common_words(spark):
    same = " ".join(f"w{i}" for i in range(20))
    items = [(i, same + f" end{i}") for i in range(40)] + [(100, "the"), (101, "the the the the the"), (102, "of the"), (103, same)]
    texts = ["the " * 3000, "of the " + same, same.upper() + " END7 the", "w1 " + same[3:], "of " * 50, None, ""]
    check(spark, texts, items)


def test_other_columns_are_ignored(spark):
    from engram.llm.decontaminate import clean_documents

    docs = spark.createDataFrame([(1, "a b c", "x", 1, None), (2, "other words", "y", 2, "z"), (None, None, None, 3, "z")], "doc_id long, text string, item_id string, n_words int, `a.b` string")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert sorted(r[3] for r in clean_documents(docs, bench).collect()) == [2, 3]
