import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from engram.llm import induced, suffix_dedup
from engram.llm.induced import permuted_prefixes, suffix_array
from engram.llm.suffix_dedup import remove_repeats
from tests.llm.helpers import docs_of, sample_texts, stored


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=200, ids=None):
    got = sorted(map(tuple, remove_repeats(docs_of(spark, texts, ids), length).collect()), key=str)
    want = sorted(((i if ids is None else ids[i], *w) for i, w in enumerate(brute(texts, length))), key=str)
    assert got == want


@pytest.mark.parametrize("bucket", [0, 64, 10**9])
def test_suffix_arrays_and_prefixes(monkeypatch, bucket):
    monkeypatch.setattr(induced, "BUCKET", bucket)
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 26])
        text = bytes(rng.randrange(k) + 65 for _ in range(rng.randint(0, 60)))
        text = text[:10] * rng.randint(1, 6) if rng.random() < 0.3 else text
        data = np.frombuffer(text, np.uint8)
        array = suffix_array(data)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text) < 2:
            continue
        prefix, before = permuted_prefixes(data, array)
        for r, i in enumerate(array):
            j = array[r - 1] if r else -1
            k = 0
            while r and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert (before[i], prefix[i]) == (j, k)


@pytest.mark.parametrize("many", [3000, 2])
def test_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    texts = sample_texts()
    rng = random.Random(8)
    for k in range(25):
        base = texts[5 + k % 4] or ""
        i, n = rng.randrange(50), rng.randint(150, 420)
        texts.append(f"own beginning {k} " * 9 + base[i : i + n] + f" own end {k} é" * 7)
    check(spark, texts)
    check(spark, texts, ids=[None, 3] * (len(texts) // 2) + [4] * (len(texts) % 2))


def test_equals_brute_force_on_stored_table(spark):
    check(spark, [r["text"] for r in stored()])


def test_repeated_rows_are_copies(spark):
    text = "x".join(map(str, range(200)))
    check(spark, [text, text, "other " * 20], ids=[1, 1, 2])


def test_kept_bytes_and_empty_table(spark):
    assert remove_repeats(docs_of(spark).limit(0)).count() == 0
    row = remove_repeats(docs_of(spark, ["ab" * 300 + "é end"]), with_kept=True).first()
    assert row.kept.decode().endswith("é end") and row.n_removed == row.spans[0].b - row.spans[0].a == 600
