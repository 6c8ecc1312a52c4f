import duckdb
import pytest
from pyspark.sql import functions as F

from engram.operators import entities
from engram.plans import catalogue

ODD = [
    "H²Alice ½Alice ⅧAlice " * 3,  # numerals that aren't digits belong to a word
    "éAlice Bob Smithé, Ann Leeé. " * 3 + "Ann Lee日 " * 3,  # phrases end beside letters of other scripts
    "éfoo.py bar.rsé F-oo.ts -q.js " * 3,
    "Ann\x0bLee Ann Lee Ann\x1cLee " * 3,  # a vertical tab is no space within a name
    "`Ann\rLee` `Bob Lee` `Ann\u0085Bob` " * 3,  # only a newline ends a line
    "x\r$ Alice $ Alice\u0085$ Bob\n$ Ann\rAlice\n$\x0bAlice Bob\n" * 3,
    "Anń Annः Ann⃝ " * 3,
    None,
]


@pytest.mark.parametrize("text", ODD)
def test_candidates_of_odd_texts_are_those_of_the_sql(spark, tmp_path, text):
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        wanted = con.execute(catalogue.ORACLES["ent_candidates"]).fetchall()
    assert sorted(tuple(r) for r in catalogue.ent_candidates(spark, str(tmp_path)).collect()) == sorted(wanted)


def test_a_phrase_of_very_many_words(spark):
    docs = spark.range(1).select("id", F.repeat(F.lit("Ann Lee "), 8000).alias("text"))
    assert {r.name: r.frequency for r in entities.candidates(docs, "id", "text", most_words=2).collect()} == {"Ann": 8000, "Lee": 8000, "Ann Lee": 8000, "Lee Ann": 7999}
