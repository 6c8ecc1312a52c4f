import random
from collections import Counter, defaultdict

import numpy as np

from engram.llm.components import connected_components
from engram.llm.minhash import NearRules, keep_one, near_duplicates, probability_jaccard, signatures, similarity
from tests.llm.helpers import docs_of, sample_texts, stored, terms


def shingled(text):
    w = terms(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(x, y):
    both = len(x.keys() & y.keys())
    return both / max(1, len(x) + len(y) - both)


def weighted(x, y):
    """Probability Jaccard by its definition; 0 where shared weights already rule out 0.8."""
    if sum(min(x[d] / x.total(), y[d] / y.total()) for d in x.keys() & y.keys()) < 0.79:
        return 0
    every = sorted(x.keys() | y.keys(), key=str)
    nx, ny = (np.array([c[d] for d in every], float) for c in (x, y))
    return sum(1 / np.maximum(nx / nx[k], ny / ny[k]).sum() for k in np.flatnonzero((nx > 0) & (ny > 0)))


def link(x, y):
    return alike(x, y) >= 0.8 or max([*x.values(), *y.values()]) > 1 and weighted(x, y) >= 0.8


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [shingled(t) for _, t in rows]
    held = defaultdict(set)
    for i, bag in enumerate(bags):
        for s in bag or {("", rows[i][1] or ""): 1}:
            held[s].add(i)
    seen = set()
    for group in held.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    if root(i) != root(j) and (not bags[i] or link(bags[i], bags[j])):
                        parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    return {min(c): sorted(c) for c in classes.values()}


def found_classes(spark, texts, ids=None):
    out = defaultdict(list)
    for r in near_duplicates(docs_of(spark, texts, ids)).collect():
        out[r.class_id].append(r.doc_id)
        assert r.class_size > 0
    return {c: sorted(m) for c, m in out.items()}


def edited(rng, text, share):
    return " ".join(rng.choice(["alpha", "beta", "gamma"]) if rng.random() < share else w for w in text.split())


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    texts = sample_texts()
    for base in [5, 8, 21]:
        texts += [edited(rng, texts[base], share) for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(6)]
    assert found_classes(spark, texts) == brute_classes(list(enumerate(texts)))


def test_classes_equal_brute_force_on_stored_table(spark):
    texts = [r["text"] for r in stored()]
    want = brute_classes(list(enumerate(texts)))
    assert max(map(len, want.values())) > 1
    assert found_classes(spark, texts) == want


def test_similarity_is_the_brute_one():
    rng = random.Random(4)
    for _ in range(100):
        x, y = (Counter(rng.choices(range(12), k=15)) for _ in range(2))
        assert abs(similarity(*(np.array(sorted(c), np.uint64) for c in (x, y))) - alike(x, y)) < 1e-12


def test_probability_jaccard_is_the_brute_one():
    rng = random.Random(14)
    for _ in range(300):
        x, y = (Counter(rng.choices(range(9), k=rng.randint(1, 25))) for _ in range(2))
        want = sum(1 / sum(max(x[j] / x[d], y[j] / y[d]) for j in x.keys() | y.keys()) for d in x.keys() & y.keys())
        sides = [z for c in (x, y) for z in (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))]
        assert abs(probability_jaccard(*sides) - want) < 1e-9


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(6)
    errors = []
    for _ in range(40):
        x = Counter(rng.choices(range(60), k=90))
        y = Counter({k: v for k, v in x.items() if rng.random() < 0.8}) + Counter(rng.choices(range(60, 80), k=9))
        value = np.array([*sorted(x), *sorted(y)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(rng.getrandbits(60))
        weight = np.array([x[k] for k in sorted(x)] + [y[k] for k in sorted(y)])
        text = np.array([0] * len(x) + [1] * len(y))
        s = signatures(value, weight, text, 2, 512)
        both, union = x.keys() & y.keys(), x.keys() | y.keys()
        errors.append((s[0] == s[1]).mean() - sum(1 / sum(max(x[j] / x[d], y[j] / y[d]) for j in union) for d in both))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_members_that_only_some_pivots_reach(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        w[(k * 3) % 200 : (k * 3) % 200 + 12] = [f"e{k}x{j}" for j in range(12)]
        texts.append(" ".join(w))
    assert found_classes(spark, texts) == brute_classes(list(enumerate(texts)))


def test_null_repeated_ids_and_empty_table(spark):
    got = found_classes(spark, ["a b c d e f", "a b c d e f", "x", None], [5, 5, 3, 4])
    assert got == {5: [5, 5], 3: [3], 4: [4]}
    assert [r.class_id for r in near_duplicates(docs_of(spark, ["a b", None], [None, None])).collect()] == [None, None]
    assert near_duplicates(docs_of(spark).limit(0), NearRules()).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, 2, "x", 3.0), (2, "A b c d e, f", 3, None, "y", 1.0), (2, "A b c d e, f", 3, None, "y", 1.0), (0, "a b c d e f g", 0, 0, None, 0.0), (0, "a b c d e f g", 0, 0, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _times int, _doc int, _engram_key string, `a.b` double")
    out = keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[3], rows[0]]


def test_rows_kept_are_the_first_of_their_classes(spark):
    texts = [*sample_texts(), *sample_texts()]
    docs = docs_of(spark, texts)
    want = brute_classes(list(enumerate(texts)))
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(want)
    assert keep_one(docs.limit(0)).count() == 0
