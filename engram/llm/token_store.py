"""Token ids in binary files with a shared compression dictionary.

A file holds consecutive documents in ascending order of their ids: for each, its token ids as
little-endian integers in a zstandard frame of its own, then an index (document id, place of the
frame, number of tokens) and a footer with the hash of the dictionary. The dictionary is trained
on the id arrays of a bounded sample of short documents, so that even short documents compress
well and any one of them is read with two small range reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import scratch, written
from engram.llm.textblock import blocks
from engram.llm.tokenizing import pieces

#: Start of a file; its footer (place and size of the index, hash of the dictionary).
MAGIC = b"ENGTOK01"
FOOTER = "<QQ32s8s"

#: The dictionary is trained on this many documents at most, the first so many characters of each,
#: chosen by hashes of their ids and texts.
SAMPLE, SAMPLE_CHARS = 400, 20_000
DICTIONARY_BYTES = 1 << 16
#: Bytes that a reader takes at once.
READ_BYTES = 4 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _width(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _packed(width: str) -> str:
    """The width as struct writes it."""
    return {"<u2": "<H", "<u4": "<I"}[width]


def train_dictionary(docs: DataFrame, tokenizer: str, width: str, end_id: int) -> bytes:
    """The dictionary, from the sample; of one that is too small to train on, its ids themselves."""
    import zstandard

    chance = F.xxhash64("doc_id", "text")
    sample = docs.where(F.pmod(chance, F.lit(max(1, docs.select("doc_id").count()))) < 2 * SAMPLE)
    texts = [r.t or "" for r in sample.select(chance.alias("c"), F.substring("text", 1, SAMPLE_CHARS).alias("t")).orderBy("c", "t").limit(SAMPLE).collect()]
    end = np.array([end_id], width).tobytes()
    arrays = [b"".join(pieces(tokenizer, _packed(width)).values(t)) + end for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICTIONARY_BYTES]


def write_token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every whole text, ``end_id`` after each, and returns the manifest.

    The manifest, a written table, has a row per file: part (their order), file, n_docs, n_tokens,
    dictionary (the file that holds it), dictionary_bytes. Only files that it names count; those of failed tasks are never named.
    A null or empty text has the end id alone. A null document id comes first; documents that
    share an id stand in order of their texts. An empty table gives an empty manifest.
    """
    import zstandard

    spark = docs.sparkSession
    folder = folder or scratch(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    width = _width(tokenizer, end_id)
    dictionary = train_dictionary(rows, tokenizer, width, end_id)
    digest = hashlib.sha256(dictionary).digest()
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer, _packed(width))
        end = np.array([end_id], width).tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=shared)
        part = TaskContext.get().partitionId()
        fs, top = _open(folder)
        out, index, at, tokens = None, [], len(MAGIC), 0
        for block in blocks(batches):
            if out is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = fs.open_output_stream(f"{top}/{name}")
                out.write(MAGIC)
            places, counts = [], []
            for text in block.rows.column(1).to_pylist():
                ids = b"".join(known.values(text or "")) + end
                frame = press.compress(ids)
                out.write(frame)
                places.append(at)
                counts.append(len(ids) // int(width[-1]))
                at += len(frame)
            tokens += sum(counts)
            index.append(pa.record_batch([block.rows.column(0), pa.array(places, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "place", "n_tokens"]))
        if out is None:
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index[0].schema) as stream:
            for batch in index:
                stream.write_batch(batch)
        body = sink.getvalue()
        out.write(body)
        out.write(struct.pack(FOOTER, at, len(body), digest, width.encode().ljust(8)))
        out.close()
        row = [pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([sum(map(len, index))], pa.int64()), pa.array([tokens], pa.int64()), pa.array([f"{folder}/dictionary"]), pa.array([len(dictionary)], pa.int64())]
        yield pa.record_batch(row, names=["part", "file", "n_docs", "n_tokens", "dictionary", "dictionary_bytes"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts of one id go on in later parts; their beginnings bound what the planner samples
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "part long, file string, n_docs long, n_tokens long, dictionary string, dictionary_bytes long"))


class TokenFile:
    """One file of a store: its index, and its documents by number."""

    def __init__(self, path: str, dictionary_path: str):
        import zstandard

        fs, name = _open(dictionary_path)
        with fs.open_input_file(name) as file:
            dictionary = file.read()
        fs, name = _open(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.end, length, digest, width = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if self.file.read_at(len(MAGIC), 0) != MAGIC or hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path} isn't a token file of this dictionary")
        self.width = width.decode().strip()
        self.index = pa.ipc.open_stream(self.file.read_at(length, self.end)).read_all().combine_chunks()
        self.places = np.append(self.index.column("place").to_numpy(), self.end)
        self.unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, number: int) -> np.ndarray:
        """The ids of one document, by one range read."""
        return self._ids(self.file.read_at(int(self.places[number + 1] - self.places[number]), int(self.places[number])))

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.unpress.decompress(frame), self.width).astype("<u4")

    def chunks(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, some at a time: the number of the first, and their ids."""
        k, n = 0, len(self.places) - 1
        while k < n:
            to = min(max(int(np.searchsorted(self.places, self.places[k] + READ_BYTES, side="right")) - 1, k + 1), n)
            data = self.file.read_at(int(self.places[to] - self.places[k]), int(self.places[k]))
            cut = self.places[k : to + 1] - self.places[k]
            yield k, [self._ids(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            k = to


def read_token_store(spark: SparkSession, manifest: DataFrame, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """The documents of a store from its files: doc_id, start (ids of all before it), n_tokens, ids_crc32; also ids on request."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("file", "before", "dictionary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store = TokenFile(row["file"], row["dictionary"])
                at = row["before"]
                for k, arrays in store.chunks():
                    sizes = np.array([len(a) for a in arrays])
                    starts = at + np.append(0, np.cumsum(sizes)[:-1])
                    at += int(sizes.sum())
                    cols = [store.index.column("doc_id").slice(k, len(arrays)).combine_chunks(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([a.tolist() for a in arrays], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.record_batch(cols, names=names)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
