import os

from engram.llm.common import scratch, scratch_dropped, written
from engram.llm.minhash import near_duplicates
from tests.llm.helpers import docs_of


def _folders(spark):
    top = os.path.dirname(scratch(spark).removeprefix("file://"))
    return {x for x in os.listdir(top) if x.startswith("engram-")} if os.path.isdir(top) else set()


def test_scratch_folders_go_with_their_block(spark, tmp_path):
    before = _folders(spark)
    with scratch_dropped(spark):
        near_duplicates(docs_of(spark, ["a b c d e f g", "a b c d e f g", "x y"])).write.parquet(str(tmp_path / "out"))
        assert len(_folders(spark)) > len(before)
    assert _folders(spark) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_written_tables_stay_otherwise(spark):
    table = written(spark.range(3))
    assert len(_folders(spark)) > 0 and table.count() == 3
