import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from engram.llm.common import written
from engram.llm.mixing import mix_plan
from engram.llm.repetition import RepetitionRules
from tests.llm.helpers import SF, docs_of, stored
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_minhash import brute_classes
from tests.llm.test_repetition import brute as quality


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    texts = {r["doc_id"]: r["text"] for r in stored()}
    want = set()
    for i, t in texts.items():
        q = quality(t, RepetitionRules())
        if len(q) == 9 and q[8] or len(q) == 6 and not q[5]:
            want.add(i)
    steps = [written(pipeline.quality_rules(spark, docs, SF))]
    assert {r.doc_id for r in steps[0].collect()} == want and len(want) > 50

    want = set(brute_classes([(i, texts[i]) for i in sorted(want)]))
    steps.append(written(pipeline.near_dedup(spark, steps[-1], SF)))
    assert sorted(r.doc_id for r in steps[-1].collect()) == sorted(want)

    items = [(r["item_id"], r["text"]) for r in stored("benchmark")]
    want = {i for i in want if not contamination(texts[i], items)[4]}
    steps.append(written(pipeline.decontamination(spark, steps[-1], SF)))
    assert {r.doc_id for r in steps[-1].collect()} == want

    copies = {r.doc_id: r.copies for r in mix_plan(steps[-1]).collect()}
    steps.append(written(pipeline.source_mixing(spark, steps[-1], SF)))
    mixed = sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted(r.doc_id for r in steps[-1].collect()) == mixed
    for step in steps:
        assert step.columns == names and all(r.text == texts[r.doc_id] for r in step.collect())

    library, start, rows = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i in mixed:
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        rows.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == rows


def test_stages_stand_awkward_rows_and_empty_tables(spark):
    bench = f"{SF}"
    for docs in (docs_of(spark, extra=False), docs_of(spark, ids=[None, 3] * 11, extra=False), docs_of(spark, extra=False).limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, bench))
            assert out.columns == docs.columns and out.count() <= max(1, 2 * docs.count())
        assert pipeline.token_output(spark, docs, bench).count() == docs.count()


def test_repeated_rows_are_kept_once(spark):
    docs = docs_of(spark, ["a b c d e f g"] * 3 + ["other words here that differ"], ids=[1, 1, 2, None], extra=False)
    assert sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, SF).collect() if r.doc_id) == [(1, "a b c d e f g")]
    assert pipeline.near_dedup(spark, docs, SF).count() == 2


def test_stages_stand_columns_that_clash(spark):
    names = ["_times", "_doc", "_row", "_key", "_k", "_comp", "node", "n_words", "size", "_copy", "copies", "places", "w", "n_hit"]
    docs = docs_of(spark, extra=False)
    for n in names:
        docs = docs.withColumn(n, docs["doc_id"].cast("string"))
    for _, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF))
        assert out.columns == docs.columns and all(r[n] == str(r.doc_id) for r in out.collect() for n in names)
    assert pipeline.token_output(spark, docs, SF).count() == docs.count()
