"""WARC records in ZIP packages: writing them, and range-reading them without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose records
are gzip members of their own, and ``indexes/index.cdxj`` with the place of each. A reader parses
the end record, the ZIP64 end record where there is one and the central directory, finds a stored
member's bytes from its local header, and then reads only the ranges that the index names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import scratch, small, written

#: Fixed values of the formats.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

#: A package is closed and another begun beyond so many bytes; a reader takes ranges of about so many.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Record:
    """A response with its payload, or a revisit (``refers_to`` is set) with the payload's size and digest only."""

    page_id: int | None
    url: str | None
    size: int
    digest: str
    payload: bytes | None = None
    refers_to: int | None = None

    def pack(self, date: str) -> bytes:
        revisit = self.refers_to is not None
        fields = {
            "WARC-Type": "revisit" if revisit else "response",
            "WARC-Record-ID": f"<urn:page:{self.page_id}>",
            "WARC-Date": date,
            "WARC-Target-URI": quote(self.url, safe="!#$%&'()*+,/:;=?@[]~") if self.url else f"urn:page:{self.page_id}",
            "WARC-Payload-Digest": f"sha1:{self.digest}",
            "Content-Type": "application/http; msgtype=response",
        }
        if revisit:
            fields |= {"WARC-Refers-To": f"<urn:page:{self.refers_to}>", "WARC-Profile": REVISIT}
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.size}\r\n\r\n".encode()
        block += b"" if revisit else self.payload
        fields["Content-Length"] = str(len(block))
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
        press = zlib.compressobj(4, wbits=31)
        return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()

    @classmethod
    def parse(cls, member: bytes) -> Record:
        """The record of a gzip member; a response's size and digest are its payload's own."""
        data = zlib.decompress(member, wbits=31)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        if not version.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        block = rest[: int(fields["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        page = lambda name: None if (x := fields[name][len("<urn:page:") : -1]) == "None" else int(x)
        claimed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "revisit":
            size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
            return cls(page("WARC-Record-ID"), fields["WARC-Target-URI"], size, claimed, None, page("WARC-Refers-To"))
        if digest_of(payload) != claimed:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
        return cls(page("WARC-Record-ID"), fields["WARC-Target-URI"], len(payload), claimed, payload)


class PackageWriter:
    """Writes one package to an output stream that need not be seekable."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index, self.size, self.stream = [], 0, stream

    def add(self, record: Record, date: str) -> None:
        member = record.pack(date)
        self.archive.write(member)
        self.index.append((record.page_id, self.size, len(member), record.digest))
        self.size += len(member)

    def close(self) -> int:
        self.archive.close()
        lines = (f"urn:page:{page} - " + json.dumps({"offset": at, "length": n, "digest": f"sha1:{d}", "filename": ARCHIVE}) + "\n" for page, at, n, d in self.index)
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
        self.zip.close()
        return len(self.index)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """A ZIP file that is read by ranges: ``read_at(n, offset)`` of ``file``, of ``size`` bytes."""

    def __init__(self, file, size: int):
        self.file = file
        self.members = {m.name: m for m in self._directory(size)}

    def _directory(self, size: int) -> Iterator[Member]:
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = self.file.read_at(size - tail_at, tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of a central directory")
        entries, length, start = struct.unpack_from("<HII", tail, end + 10)
        if tail[max(0, end - 20) : end][:4] == LOCATOR64:
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            record = self.file.read_at(56, at)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            entries, length, start = struct.unpack_from("<QQQ", record, 32)
        data, at = self.file.read_at(length, start), 0
        for _ in range(entries):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, plain, n, extra, comment, header = struct.unpack_from("<H8xIIHHH8xI", data, at + 10)
            name = data[at + 46 : at + 46 + n].decode()
            packed, header = self._wide(data[at + 46 + n : at + 46 + n + extra], plain, packed, header)
            yield Member(name, method, packed, header)
            at += 46 + n + extra + comment

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
        """Size and place, from the ZIP64 field where 32 bits are too few."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if plain == 0xFFFFFFFF:
                    wide.pop(0)
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            at += 4 + n
        return packed, header

    def place(self, name: str) -> tuple[int, int]:
        """First byte and number of bytes of a stored member."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} isn't stored")
        local = self.file.read_at(30, m.header)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        n, extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n + extra, m.size

    def ranges(self, limit: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
        """Ranges of whole records that follow one another: the first byte, and the records' lengths."""
        base, _ = self.place(ARCHIVE)
        at, size = self.place(INDEX)
        first, lengths, total = base, [], 0
        for line in self.file.read_at(size, at).decode().splitlines():
            entry = json.loads(line.split(" ", 2)[2])
            if lengths and (total + entry["length"] > limit or base + entry["offset"] != first + total):
                yield first, lengths
                lengths, total = [], 0
            if not lengths:
                first = base + entry["offset"]
            lengths.append(entry["length"])
            total += entry["length"]
        if lengths:
            yield first, lengths


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_packages(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row of ``pages`` and returns the manifest, a written table: file, n_records.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest page id are
    responses and the others revisits of it; a null id is below all others. A null html is an empty
    payload. Only packages that the manifest names count; those of failed tasks are never named.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    long_enough = rows.select("page_id", "sha1", F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    again = long_enough.groupBy("sha1").agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_times")).where("_times > 1").select(F.col("sha1").alias("_sha1"), "_keep")
    # a small table of repeated payloads is broadcast, so that pages aren't shuffled to learn of it
    again = small(written(again))
    joined = rows.join(again, rows["sha1"] == again["_sha1"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_keep")), F.col("_keep"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        package, files = None, []

        def close():
            n = package.close()
            package.stream.close()
            files[-1].append(n)

        for batch in batches:
            for page, url, html, sha1, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if package is None:
                    fs.create_dir(top, recursive=True)
                    name = f"pages-{TaskContext.get().partitionId():06d}-{len(files):04d}-{uuid.uuid4().hex}.zip"
                    package = PackageWriter(fs.open_output_stream(f"{top}/{name}"))
                    files.append([f"{folder}/{name}"])
                payload = html.encode()
                package.add(Record(page, url, len(payload), base64.b32encode(bytes.fromhex(sha1)).decode(), payload, refers_to), date)
                if package.size >= package_bytes:
                    close()
                    package = None
        if package is not None:
            close()
        if files:
            yield pa.record_batch([pa.array([f for f, _ in files]), pa.array([n for _, n in files], pa.int64())], names=["file", "n_records"])

    return written(joined.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).mapInArrow(write, "file string, n_records long"))


def read_packages(manifest: DataFrame, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """The records of the packages that the manifest names.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to; on request also payload
    (null in revisits). A response's digest is computed from its payload and must be the recorded one.
    """
    spark = manifest.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    found = list(Package(file, file.size()).ranges())
                yield pa.record_batch(
                    [pa.array([path] * len(found)), pa.array([f for f, _ in found], pa.int64()), pa.array([n for _, n in found], pa.list_(pa.int64()))], names=["file", "first", "lengths"]
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _open(row["file"])
                with fs.open_input_file(name) as file:
                    data, at, records = file.read_at(sum(row["lengths"]), row["first"]), 0, []
                for n in row["lengths"]:
                    records.append(Record.parse(data[at : at + n]))
                    at += n
                ids = pa.int64()
                cols = [
                    pa.array([r.page_id for r in records], ids).cast(to),
                    pa.array([r.size for r in records], pa.int64()),
                    pa.array([r.digest for r in records]),
                    pa.array(["response" if r.refers_to is None else "revisit" for r in records]),
                    pa.array([r.refers_to for r in records], ids).cast(to),
                ]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    cols, names = [*cols, pa.array([r.payload for r in records], pa.binary())], [*names, "payload"]
                yield pa.record_batch(cols, names=names)

    to = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64()}[id_type]
    ranges = manifest.select("file").repartition(parts).mapInArrow(locate, "file string, first long, lengths array<long>").repartition(parts)
    return ranges.mapInArrow(read, f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}" + ", payload binary" * with_payload)
