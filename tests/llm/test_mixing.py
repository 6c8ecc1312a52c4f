import pytest

from engram.llm.mixing import mix_documents, mix_plan
from tests.llm.helpers import SF, WORD, docs_of, sample_texts


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_plan(spark):
    docs = docs_of(spark)
    plan = mix_plan(docs).collect()
    texts = sample_texts()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    assert len(plan) == len(texts)
    for r in plan:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= min(2, int(rate) + 1)
    assert sorted(plan) == sorted(mix_plan(docs.repartition(5)).collect())


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    rows = mix_plan(docs).groupBy("source").agg({"target": "max", "source_size": "max"}).collect()
    taken = {r.source: r.t for r in mix_plan(docs).selectExpr("source", "size * copies AS n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "t").collect()}
    want = brute_targets({r.source: r["max(source_size)"] for r in rows})
    for r in rows:
        assert r["max(target)"] == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r["max(target)"]) < 0.1 * r["max(target)"]


def test_mix_keeps_columns_and_repeats_rows(spark):
    docs = docs_of(spark)
    copies = {r.doc_id: r.copies for r in mix_plan(docs).collect()}
    out = mix_documents(docs)
    assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes
    got = [r.doc_id for r in out.collect()]
    assert {i: got.count(i) for i in copies} == copies


def test_empty_null_and_wordless(spark):
    assert mix_plan(docs_of(spark).limit(0)).count() == 0
    rows = mix_plan(docs_of(spark, [None, "", " "], [None, None, 1])).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 3


def test_no_python_in_the_plan(spark):
    plan = mix_plan(docs_of(spark, extra=False))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
