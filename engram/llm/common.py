"""What the corpus operators share: scratch tables, size-checked broadcasts, row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many bytes, by the written size of its table.
BROADCAST_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, as in tests, a temporary folder is used, and only if the session runs in
    this process.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/engram-scratch"
    path = f"{top.rstrip('/')}/engram-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


#: Of each ``noted`` that is open, the folders made since.
_MADE: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The scratch folders that are made inside, as they are made."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def drop(spark: SparkSession, paths: list[str], *but: DataFrame | None) -> None:
    """Deletes scratch folders, but for those that some tables are read from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    needed = " ".join(f for table in but if table is not None for f in table.inputFiles())
    for path in paths:
        if path.rsplit("/", 1)[-1] not in needed:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders that are made inside, at the end: results must have been written by then."""
    with noted() as made:
        try:
            yield
        finally:
            drop(spark, made)


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and a lost executor costs nothing.

    With ``release`` the files of shuffles that are done with are given back now: Spark deletes them
    once the driver has collected its garbage, which may be long after.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        # what is told to listeners refers to the plan
        with suppress(Py4JJavaError):
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """The optimizer's size estimate; for a written table, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its files are below ``limit``; else left to a shuffled join."""
    return F.broadcast(table) if bytes_of(table) < limit else table


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id; equal for equal rows, whose results are equal too."""
    return F.xxhash64(F.col(id_col), F.col(text_col))
