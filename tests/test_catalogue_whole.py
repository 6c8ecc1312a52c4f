from pyspark.sql import functions as F

from engram.plans import catalogue
from engram.plans.views import view

D = "/root/testdata/sf0.1"


def test_rooms_read_the_whole_table(spark):
    rows = view(spark, D, "embeddings").select("vec_id", "label").collect()
    assert view(spark, D, "rooms").count() == len({(r.vec_id % 40, (r.vec_id * 7 + r.label) % 150) for r in rows})


def test_cells_find_nine_of_ten_neighbours(spark):
    found, true = (q(spark, D).select("query_id", "id") for q in (catalogue.vec_knn_cells, catalogue.vec_knn_batch))
    assert found.intersect(true).count() >= 0.9 * true.count()


def test_summaries_and_counts_read_every_document(spark):
    small = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in view(spark, small, "documents").select("doc_id").collect()}
    for name in ("txt_token_count", "txt_compression_stats", "dia_compress_fields", "dia_faithfulness"):
        assert {r[0] for r in catalogue.QUERIES[name](spark, small).select(F.col("id" if name == "dia_compress_fields" else "doc_id")).collect()} == ids
    assert {r.id for r in catalogue.dia_summaries(spark, small).select("id").collect()} == ids
