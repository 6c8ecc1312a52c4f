import random

from tests.llm.test_minhash import brute_classes, found_classes


def test_a_passage_repeated_many_times(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(w), " ".join(w[:100] + w[80:100] * 19 + w[100:])]
    want = brute_classes(list(enumerate(texts)))
    assert sorted(map(len, want.values())) == [2] * 30
    assert found_classes(spark, texts) == want


def test_a_line_repeated_many_times(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(20):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(w), " ".join(w + [f"w{rng.randrange(10**6)}" for _ in range(6)] * 60)]
    want = brute_classes(list(enumerate(texts)))
    assert sorted(map(len, want.values())) == [2] * 20
    assert found_classes(spark, texts) == want


def test_texts_alike_by_weights_only(spark):
    rng = random.Random(15)
    texts = []
    for _ in range(20):
        line = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        texts += [" ".join(line * 40 + [f"w{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(2)]
    want = brute_classes(list(enumerate(texts)))
    assert sorted(map(len, want.values())) == [2] * 20
    assert found_classes(spark, texts) == want
