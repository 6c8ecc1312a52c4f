"""Token counts without token ids: distinct pre-tokens encoded once, joined to each document's frequencies.

One pass finds the distinct pre-tokens of all documents; each is encoded once and only its number of
ids is kept. Another pass counts each document's pre-tokens, and these frequencies are joined to that
table and summed. Pre-tokens travel as 64-bit hashes; if two of the table share one, all are hashed
with another seed.

The table of all pre-tokens of a large corpus has no bound. Those that most tasks met, as many as
``BROADCAST_BYTES`` allow, go to all workers and are joined where the frequencies are counted, by
binary search; only occurrences of the others are exchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import written
from engram.llm.textblock import blocks
from engram.llm.tokenizing import pieces

#: Pre-tokens that a task remembers to have told already, or the hashes of; beyond it the memory starts anew.
_REMEMBERED = 300_000
#: Of the pre-tokens so many bytes go to all workers, at this size of an entry (hash, number of ids).
BROADCAST_BYTES, _ENTRY = 8 << 20, 16


def distinct_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, met): the distinct pre-tokens of the texts, and how many times a task told of each."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = pieces(tokenizer), set()
        for block in blocks(batches):
            new = set()
            for text in block.rows.column(0).to_pylist():
                new.update(known.cut_up(text or "")[0])
            new = new - told
            if len(told) > _REMEMBERED:
                told.clear()
            told |= new
            yield pa.record_batch([pa.array(new, pa.string())], names=["piece"])

    return docs.select("text").mapInArrow(tell, "piece string").groupBy("piece").agg(F.count(F.lit(1)).alias("met"))


def encoded(found: DataFrame, tokenizer: str, seed: int) -> DataFrame:
    """(key, n, met): the hash of each pre-token and its number of ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in texts], np.uint64).astype(np.int64)
            yield pa.record_batch([pa.array(keys), pa.array([known.known[x] for x in texts], pa.int64()), batch.column(1)], names=["key", "n", "met"])

    return found.mapInArrow(encode, "key long, n long, met long")


def frequencies(docs: DataFrame, tokenizer: str, seed: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_bytes, digest of the text, tokens, keys, times.

    ``tokens`` are those of special strings and of the ``common`` pre-tokens (ascending hashes, and
    their numbers of ids); the others' hashes and times follow.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashed = pieces(tokenizer), {}
        held, ids = shared.value
        for block in blocks(batches):
            digests, tokens, keys, times, sizes = [], [], [], [], []
            for text in block.rows.column(1).to_pylist():
                found, special = known.cut_up(text or "")
                tallied = Counter(found)
                for piece in tallied:
                    if piece not in hashed:
                        hashed[piece] = xxhash.xxh3_64_intdigest(piece, seed)
                keys += map(hashed.__getitem__, tallied)
                times += tallied.values()
                sizes.append(len(tallied))
                digests.append(xxhash.xxh3_128_digest(text or ""))
                tokens.append(special)
                if len(hashed) > _REMEMBERED:
                    hashed.clear()
            key, n, owner = np.array(keys, np.uint64).astype(np.int64), np.array(times, np.int64), np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
            here = held[at] == key if len(held) else np.zeros(len(key), bool)
            total = np.array(tokens, np.int64) + np.bincount(owner[here], n[here] * ids[at[here]], len(sizes)).astype(np.int64)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[~here], minlength=len(sizes)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~here])) for x in (key, n)]
            yield pa.record_batch([block.rows.column(0), pa.array(block.lengths, pa.int64()), pa.array(digests, pa.binary()), pa.array(total), *lists], names=["doc_id", "n_bytes", "digest", "tokens", "keys", "times"])

    return docs.mapInArrow(tally, f"doc_id {kind}, n_bytes long, digest binary, tokens long, keys array<long>, times array<long>")


def _hot(table: DataFrame, most: int) -> int:
    """The least ``met`` for which the pre-tokens that were met as often are ``most`` at most, a power of 2."""
    sizes = {r.level: r.n for r in table.groupBy(F.floor(F.log2("met")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        least = level
    return 0 if least == min(sizes, default=0) else 1 << least


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Ids may be null or repeat: each row is counted
    by itself. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    ``tokenizer`` is the path of a tokenizer file that every worker can read. Texts of a tokenizer
    that isn't byte-level BPE have no known pre-tokens and are encoded whole.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = written(distinct_pieces(rows, tokenizer))
    for seed in count():
        table = written(encoded(found, tokenizer, seed))
        if table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    hot = _hot(table, broadcast_bytes // _ENTRY)
    common = table.where(F.col("met") >= hot).select("key", "n").toPandas().sort_values("key")

    # equal rows are one group, and come apart again at the end; a row of their own keeps rows without pieces
    row = ["doc_id", "n_bytes", "digest"]
    tallied = frequencies(rows, tokenizer, seed, (common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))
    if hot:
        own = F.struct(F.xxhash64("digest").alias("key"), F.lit(0).cast("long").alias("times"), F.lit(1).alias("rows"), F.col("tokens"))
        each = F.transform(F.arrays_zip("keys", "times"), lambda x: F.struct(x["keys"].alias("key"), x["times"].alias("times"), F.lit(0).alias("rows"), F.lit(0).cast("long").alias("tokens")))
        parts = tallied.select(*row, F.inline(F.concat(F.array(own), each)))
        rest = table.where(F.col("met") < hot).select(F.col("key").alias("_key"), "n")
        parts = parts.join(rest, F.col("key") == F.col("_key"), "left")
        parts = parts.select(*row, "rows", (F.col("tokens") + F.coalesce(F.col("n"), F.lit(0)) * F.col("times")).alias("tokens"))
    else:
        parts = tallied.select(*row, F.lit(1).alias("rows"), "tokens")
    summed = parts.groupBy(*row).agg(F.sum("rows").cast("int").alias("rows"), F.sum("tokens").alias("tokens"))
    n_tokens = F.floor(F.col("tokens") / F.col("rows")).cast("long")
    out = summed.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), F.explode(F.sequence(F.lit(1), "rows")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
