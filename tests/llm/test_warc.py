import io
import zipfile

import pytest

from engram.llm.warc import ARCHIVE, INDEX, Package, PackageWriter, Record, digest_of, read_packages, write_packages
from tests.llm.helpers import sample_texts, stored

SCHEMA = "page_id long, url string, html string, sha1 string, _keep int"


def brute(rows, least=0):
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        same = [p for p, h in rows if (h or "").encode() == payload and p is not None]
        keep = max(same, default=None) if len(payload) >= least else None
        refers = keep if keep is not None and (page is None or page < keep) else None
        out.append((page, len(payload), digest_of(payload), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


class Ranges:
    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    rows = [(k, t) for k, t in enumerate(sample_texts() * 2)] + [(None, "same"), (None, "same"), (900, "same"), (None, "only null"), (901, "tie"), (901, "tie")]
    rows += [(1000 + r["page_id"], r["html"]) for r in stored("pages")]
    pages = spark.createDataFrame([(p, [None, "http://x/ä\r\n"][i % 2], h, "clash", 1) for i, (p, h) in enumerate(rows)], SCHEMA).repartition(4)
    manifest = write_packages(pages, least_bytes=least, package_bytes=8_000)
    assert manifest.count() > 4
    got = read_packages(manifest, with_payload=True).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows, least)
    whole = {(p, len((h or "").encode()), digest_of((h or "").encode())): h for p, h in rows}
    for r in got:
        want = (whole[r.page_id, r.payload_bytes, r.payload_digest] or "").encode()
        assert r.payload == (want if r.record_type == "response" else None)


def test_empty_table(spark):
    manifest = write_packages(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and read_packages(manifest).count() == 0


def package(n=50):
    out = io.BytesIO()
    writer = PackageWriter(out)
    for k in range(n):
        payload = bytes([k]) * 300
        writer.add(Record(k, f"http://x/{k}", 300, digest_of(payload), payload), "1970-01-01T00:00:00Z")
    writer.close()
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 100])
def test_directories_with_and_without_zip64(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    data = package()
    assert (b"PK\x06\x06" in data) == bool(limit)
    reader = Package(Ranges(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert {m.name: m.size for m in reader.members.values()} == {i.filename: i.compress_size for i in z.infolist()}
        for name in (ARCHIVE, INDEX):
            at, n = reader.place(name)
            assert data[at : at + n] == z.read(name)
    ranges = list(reader.ranges(2000))
    assert len(ranges) > 3 and sum(len(x) for _, x in ranges) == 50


def test_one_record_needs_little_reading():
    file = Ranges(package())
    reader = Package(file, len(file.data))
    first, lengths = list(reader.ranges(1))[30]
    assert Record.parse(file.read_at(lengths[0], first)).payload == bytes([30]) * 300
    at, n = reader.place(ARCHIVE)
    before = file.read
    Record.parse(file.read_at(lengths[0], first))
    assert file.read - before < n / 20


def test_comment_and_foreign_members():
    out = io.BytesIO(package())
    with zipfile.ZipFile(out, "a") as z:
        z.writestr(zipfile.ZipInfo("datapackage.json"), "{}", zipfile.ZIP_DEFLATED)
        z.comment = b"about PK\x05 this"
    data = out.getvalue()
    reader = Package(Ranges(data), len(data))
    assert set(reader.members) == {ARCHIVE, INDEX, "datapackage.json"}
    with pytest.raises(ValueError):
        reader.place("datapackage.json")
    with pytest.raises(ValueError):
        Package(Ranges(b"no zip here"), 11)


def test_wrong_payload_is_noticed():
    record = Record(1, None, 3, digest_of(b"abd"), b"abc")
    with pytest.raises(ValueError):
        Record.parse(record.pack("1970-01-01T00:00:00Z"))
