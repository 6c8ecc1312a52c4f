"""The command line: init, mine, search, wakeup, compress, split, status, prune over a store's folder."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.vector import hashed_embedding
from engram.operators import context, memories, prune, sessions, summary
from engram.session import session
from engram.sources import files
from engram.sources.store import SCHEMAS, Config, read_table, repaired, write_sessions, write_table


def init(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    """Empty tables where there are none."""
    for name, schema in SCHEMAS.items():
        if read_table(spark, store, name).isEmpty():
            write_table(spark.createDataFrame([], schema), store, name)
    return status(spark, store, args)


def mine(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    """Memories of new and changed files take the place of their sources' former ones."""
    held = read_table(spark, store, "memories")
    wing = args.wing or Path(args.folder).name
    if args.conversations:
        found = files.mined_conversations(files.conversation_files(spark, args.folder), held, wing)
    else:
        found = files.mined_project(files.project_files(spark, args.folder), held, wing)
    columns = [c for c in found.columns if c in held.columns]
    rest = held.join(found.select("source_file").distinct(), "source_file", "left_anti").select(*held.columns)
    grown = repaired(memories.appended(rest, found.select(*columns), args.now))
    write_table(grown.select(*held.columns), store, "memories")
    return status(spark, store, args)


def search(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    held = read_table(spark, store, "memories")
    query = list(spark.range(1).select(hashed_embedding(F.lit(args.query)).alias("e")).first().e)
    return context.search_lines(held, held.select("id", "embedding", "wing", "room", "valid_from", "valid_to"), query, args.k, wing=args.wing, room=args.room)


def wakeup(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    identity = Path(args.identity).read_text(encoding="utf-8") if args.identity else None
    return context.wake_up(read_table(spark, store, "memories"), args.now, identity, args.wing)


def compress(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    held = read_table(spark, store, "memories").where(memories.matching(args.wing, args.room))
    return summary.summarised(held, "id", "text_content", args.density, wing="wing", room="room", source="source_file")


def split(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    """A file of several sessions as a folder of one file each."""
    text = spark.read.text(args.file, wholetext=True).select(F.lit(Path(args.file).name).alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    found = sessions.sessions(text)
    write_sessions(found, args.to)
    return found.select("session", "n_lines", "name")


def status(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    return memories.status(read_table(spark, store, "memories"))


def pruned(spark: SparkSession, store: str, args: argparse.Namespace) -> DataFrame:
    """What pruning would merge; with --apply the losers go."""
    held = read_table(spark, store, "memories")
    found = prune.prune(held, held.select("id", "embedding"), args.now, args.theta, args.wing)
    if args.apply:
        write_table(held.join(found.where("NOT kept").select("id"), "id", "left_anti").select(*held.columns), store, "memories")
    return prune.report(found)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="engram", description=__doc__)
    top.add_argument("--store", help="the store's folder; by default that of the configuration")
    top.add_argument("--config", help="a configuration file")
    top.add_argument("--master", default=None, help="Spark's master; left to spark-submit by default")
    top.add_argument("--now", type=int, default=int(time.time()), help="the time, in seconds")
    verbs = top.add_subparsers(required=True)

    def verb(name: str, run, *positional: str, **options) -> None:
        sub = verbs.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for p in positional:
            sub.add_argument(p)
        for option, default in options.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default) if default is not None else str, "default": default}
            sub.add_argument(f"--{option}", **kind)

    verb("init", init)
    verb("mine", mine, "folder", wing=None, conversations=False)
    verb("search", search, "query", k=5, wing=None, room=None)
    verb("wakeup", wakeup, identity=None, wing=None)
    verb("compress", compress, density=5, wing=None, room=None)
    verb("split", split, "file", "to")
    verb("status", status)
    verb("prune", pruned, theta=0.85, wing=None, apply=False)
    return top


def main(arguments: list[str] | None = None) -> DataFrame:
    args = parser().parse_args(arguments)
    out = args.run(session(args.master), args.store or Config.load(args.config).store_path, args)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
