"""Removal of byte strings that occur more than once, with suffix arrays over shards.

Equal strings have to meet in one shard, and most of a corpus has no equal. So each window (of
``length`` bytes) is dealt to the place in it whose ``gram`` bytes have the smallest hash, which
depends on the window's bytes alone; the windows of one place follow one another and make a
stretch. Stretches whose hash no other has are dropped, and those whose bytes equal another's whole
are repeats without more ado. What is left are the stretches, each only once, that share a hash and
differ somewhere. They are dealt to shards by that hash; a shard's suffix array is made by induced
sorting, and windows whose permuted common prefix with a neighbour is as long as a window are
repeats. A hash with more different stretches than a shard should hold is parted: the windows of its
stretches are halved by their distance from the place, and the halves are dealt anew, by a hash of
the bytes that all windows of a half have in common, until what is left is small or single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import row_key, written
from engram.llm.induced import permuted_prefixes, suffix_array
from engram.llm.textblock import U64, Block, RollingHash, blocks

#: Bytes of a gram; a window must be longer.
GRAM = 80
#: A hash with more different stretches is parted before it is sorted.
MANY = 3000
#: Bytes of stretches in one suffix array, if a hash doesn't have more: at most 3000 times 320.
SHARD_BYTES = 1 << 18
#: Bytes of text hashed at once.
HASH_BYTES = 2 << 20
#: Ends a stretch in a shard; no byte of UTF-8.
BREAK = 0xFF


def stretches(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """The stretches of a block: text, first and last window start and dealing place (in the text), hash, and two hashes of all bytes."""
    data, offsets = block.data, block.offsets
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64, U64))
    one, two = RollingHash(data, 1), RollingHash(data, 2)
    gram = min(GRAM, length)
    places = np.arange(len(data) - gram + 1)
    hashes = one(places, places + gram)
    key = (hashes & ~U64(0xFFFFFFFF)) | places.astype(U64)
    least = _sliding_min(key, length - gram + 1)
    starts = np.arange(len(least))
    text = block.text_of(starts)
    inside = starts + length <= offsets[text + 1]
    starts, text = starts[inside], text[inside]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64, U64))
    place = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, text = starts[first], starts[last], text[first]
    end = b + length
    place = place[first]
    return text, a - offsets[text], b - offsets[text], place - offsets[text], hashes[place], one(a, end), two(a, end)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: of a block's rest and the next block's beginning."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - width + 1], ahead[width - 1 : n])


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch, whether each of its windows also starts elsewhere among the stretches."""
    data = np.frombuffer(b"".join(p + bytes([BREAK]) for p in parts), np.uint8)
    prefix, before = permuted_prefixes(data, suffix_array(data))
    sizes = np.array([len(p) for p in parts])
    firsts = np.append(0, np.cumsum(sizes + 1)[:-1])
    end = np.repeat(firsts + sizes, sizes + 1)
    whole = np.arange(len(data)) + length <= end
    hit = np.flatnonzero(whole & (prefix >= length))
    hit = hit[whole[before[hit]]]
    found = np.zeros(len(data), bool)
    found[hit] = True
    found[before[hit]] = True
    return [found[f : f + max(0, s - length + 1)] for f, s in zip(firsts, sizes, strict=True)]


def _spans(found: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield a, b - 1 + length


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """Spans (doc_id, _k, a, b) of bytes that repeated windows cover, for rows (doc_id, _k, text); they may overlap."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}, _k long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=HASH_BYTES):
            text, a, b, p, h, one, two = stretches(block, length)
            own = block.rows.select(["doc_id", "_k"]).take(pa.array(text))
            cols = [pa.array(x.astype(np.int64)) for x in (h, one, two)] + [pa.array(x.astype(np.int32)) for x in (a, b, p)]
            yield pa.record_batch([*own.columns, *cols], names=["doc_id", "_k", "h", "g1", "g2", "a", "b", "p"])

    all_ = rows.mapInArrow(cut, f"{ids}, h long, g1 long, g2 long, a int, b int, p int")
    shared = all_.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    shared = written(all_.join(shared, "h"))

    distinct = shared.groupBy("h", "g1", "g2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "_k", "a", "b", "p")).alias("at"))
    distinct = written(distinct.join(_kinds(shared), "h").select("h", "g1", "g2", "times", "at", "mixed", "many"))
    again = distinct.where("times > 1").select("h", "g1", "g2")
    whole = shared.join(again, ["h", "g1", "g2"]).select("doc_id", "_k", "a", (F.col("b") + length).alias("b"))

    asked = distinct.where("mixed").groupBy(F.col("at.doc_id").alias("_doc"), F.col("at._k").alias("_row")).agg(F.collect_list(F.struct("h", F.col("at.a").alias("a"), F.col("at.b").alias("b"), F.col("at.p").alias("p"), "times", "many")).alias("asked"))
    texts = rows.join(asked, (rows["_k"] == asked["_row"]) & rows["doc_id"].eqNullSafe(asked["_doc"])).select("doc_id", "_k", "text", "asked")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch]):
                data, out = block.data.tobytes(), []
                own, own_k = block.rows.column("doc_id").to_pylist(), block.rows.column("_k").to_pylist()
                for t, asked_here in enumerate(block.rows.column("asked").to_pylist()):
                    at = int(block.offsets[t])
                    out += [(own[t], own_k[t], x["h"], x["a"], x["p"], x["times"], x["many"], data[at + x["a"] : at + x["b"] + length]) for x in asked_here]
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = [block.rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "_k", "h", "a", "p", "times", "many", "bytes"])

    parts = written(texts.mapInArrow(extract, f"{ids}, h long, a int, p int, times long, many boolean, bytes binary").dropDuplicates(["doc_id", "_k", "h", "a"]))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(held: list[dict]) -> pa.RecordBatch:
            out = []
            for row, found in zip(held, repeated_windows([r["bytes"] for r in held], length), strict=True):
                if row["times"] == 1:
                    out += [(row["doc_id"], row["_k"], row["a"] + a, row["a"] + b) for a, b in _spans(found, length)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, [doc_type[0], pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["doc_id", "_k", "a", "b"])

        held, size, doc_type = [], 0, [pa.int64()]
        for batch in batches:
            doc_type[0] = batch.schema.field("doc_id").type
            for row in batch.to_pylist():
                if held and size >= SHARD_BYTES and row["h"] != held[-1]["h"]:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield shard(held)

    few, spans, many = parts.where("NOT many"), whole, parts.where("many")
    width = length - min(GRAM, length) + 1
    while width > 1 and not many.isEmpty():
        width = -(-width // 2)
        halves = written(many.mapInArrow(_parted(length, width), f"{ids}, times long, a int, p int, h long, g1 long, g2 long, bytes binary"))
        one = halves.groupBy("h", "g1", "g2").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "_k", "a", "p", "bytes")).alias("at"))
        one = written(one.join(_kinds(halves), "h").select("h", "g1", "g2", "at.*", "times", "mixed", "many"))
        again = one.where("times > 1").select("h", "g1", "g2")
        spans = spans.unionByName(halves.where("times = 1").join(again, ["h", "g1", "g2"]).select("doc_id", "_k", "a", (F.col("a") + F.length("bytes")).alias("b")))
        parts = one.where("mixed").select(*parts.columns)
        few, many = few.unionByName(parts.where("NOT many")), parts.where("many")
    few = few.select("doc_id", "_k", "h", "a", "times", "bytes").repartition("h").sortWithinPartitions("h")
    return spans.unionByName(few.mapInArrow(sort, f"{ids}, a int, b int"))


def _kinds(rows: DataFrame) -> DataFrame:
    """Of each hash, whether its stretches (by g1, g2) differ and whether they are many."""
    kinds = rows.groupBy("h").agg(F.min(F.struct("g1", "g2")).alias("_low"), F.max(F.struct("g1", "g2")).alias("_high"), F.approx_count_distinct("g1").alias("_n"))
    return kinds.select("h", (F.col("_low") != F.col("_high")).alias("mixed"), (F.col("_n") > MANY).alias("many"))


def _parted(length: int, width: int):
    """Cuts stretches into parts of at most ``width`` windows, by the windows' distance before the dealing place."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch], "bytes", HASH_BYTES):
                rows, starts, ends, common = [], [], [], []
                first, place = (np.asarray(block.rows.column(c)).tolist() for c in ("a", "p"))
                for r, (at, size) in enumerate(zip(block.offsets.tolist(), block.lengths.tolist(), strict=False)):
                    p = place[r] - first[r]
                    last = size - length
                    for j in range(max(0, p - last) // width, p // width + 1):
                        rows.append(r)
                        starts.append(at + max(0, p - (j + 1) * width + 1))
                        ends.append(at + min(last, p - j * width) + length)
                        common.append((at + p - j * width, at + p - (j + 1) * width + 1 + length, j))
                rows, starts, ends, (a, b, j) = (np.array(x, np.int64) for x in (rows, starts, ends, list(zip(*common, strict=True)) or [(), (), ()]))
                one, two = (RollingHash(block.data, s) for s in (1, 2))
                offset = (starts - a).astype(U64)
                own = block.rows.select(["doc_id", "_k", "times"]).take(pa.array(rows))
                at = np.asarray(block.rows.column("a"))[rows] + starts - block.offsets[rows]
                p = np.asarray(block.rows.column("p"))[rows]
                data = block.data.tobytes()
                keys = [pa.array(x.astype(np.int64)) for x in (one(a, b) + j.astype(U64), one(starts, ends) + offset, two(starts, ends) + offset)]
                parts = pa.array([data[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                cols = [*own.columns, pa.array(at.astype(np.int32)), pa.array(p.astype(np.int32)), *keys, parts]
                yield pa.record_batch(cols, names=["doc_id", "_k", "times", "a", "p", "h", "g1", "g2", "bytes"])

    return part


def remove_repeats(docs: DataFrame, length: int = 200, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request also spans and kept (bytes).

    Every byte that a string of ``length`` bytes covers which also starts anywhere else (in the same
    text or another, overlaps included) is removed; strings are judged on the input and don't
    cross texts. Equal rows are copies of each other. A null text is empty; ids may be null or
    repeat; other columns are ignored; an empty table gives an empty result. Hashes of strings have
    128 bits where they alone decide. Cutting whole bytes may cut a character: kept is binary.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_k", row_key("doc_id", "text")).select("doc_id", "_k", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows.where(F.octet_length("text") >= length), length)
    spans = written(spans).groupBy(F.col("doc_id").alias("_doc"), F.col("_k").alias("_row")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans, (rows["_k"] == spans["_row"]) & rows["doc_id"].eqNullSafe(spans["_doc"]), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, out = block.data.tobytes(), []
            for t, found in enumerate(block.rows.column("spans")):
                text = data[block.offsets[t] : block.offsets[t + 1]]
                merged: list[list[int]] = []
                if found.is_valid and len(found):
                    a = np.asarray(found.values.field("a"))
                    b = np.asarray(found.values.field("b"))
                    order = np.argsort(a, kind="stable")
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                cuts = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), [{"a": x, "b": y} for x, y in merged], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            take = 6 if with_kept else 4
            yield pa.record_batch([block.rows.column("doc_id"), *cols[:take]], names=["doc_id", *names[:take]])

    more = ", spans array<struct<a:long,b:long>>, kept binary" if with_kept else ""
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
