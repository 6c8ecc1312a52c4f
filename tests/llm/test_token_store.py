import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from engram.llm.token_store import TokenFile, read_token_store, write_token_store
from tests.llm.helpers import docs_of, sample_texts, stored

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(texts):
    library = Tokenizer.from_file(PATH)
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_round_trip(spark):
    texts = sample_texts() + [r["text"] for r in stored()]
    docs = docs_of(spark, texts).repartition(3, "text")
    want, start = [], 0
    for i, ids in enumerate(encoded(texts)):
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    manifest = write_token_store(docs, PATH)
    assert manifest.count() > 1
    assert sorted(map(tuple, read_token_store(spark, manifest, with_ids=True).collect())) == want
    row = manifest.orderBy("part").first()
    store = TokenFile(row.file, row.dictionary)
    for k in (0, row.n_docs - 1):
        assert store.ids(k).tolist() == want[k][4]
    dictionary = open(row.dictionary.removeprefix("file://"), "rb").read()
    assert len(dictionary) > 0 and hashlib.sha256(dictionary).digest() in open(row.file.removeprefix("file://"), "rb").read()[-100:]


def test_another_dictionary_is_refused(spark):
    row = write_token_store(docs_of(spark), PATH).first()
    try:
        TokenFile(row.file, row.file)
    except ValueError:
        return
    raise AssertionError


def test_null_and_repeated_ids(spark):
    docs = docs_of(spark, ["b", "a", "a", None], [1, 1, None, None])
    rows = read_token_store(spark, write_token_store(docs, PATH)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1]
    assert [r.n_tokens for r in rows] == [1, 2, 2, 2]
    assert np.diff([r.start for r in rows]).tolist() == [1, 2, 2]


def test_empty_table(spark):
    manifest = write_token_store(docs_of(spark).limit(0), PATH)
    assert manifest.count() == 0 and read_token_store(spark, manifest).count() == 0


def _files(spark, docs):
    rows = write_token_store(docs, PATH).orderBy("part").collect()
    assert all(r.dictionary_bytes > 0 for r in rows)
    return [open(r.file.removeprefix("file://"), "rb").read() for r in rows]


def test_one_id_for_all_and_long_texts_only(spark):
    long = [" ".join(f"w{k * j % 997}" for k in range(9000)) for j in range(1, 4)]
    docs = docs_of(spark, [*long, *long, *sample_texts()[1:12]], [7] * 17).repartition(5)
    files = _files(spark, docs)
    assert len(files) > 1 and files == _files(spark, docs.repartition(3))
    got = read_token_store(spark, write_token_store(docs, PATH), with_ids=True).orderBy("start").collect()
    assert [r.ids for r in got] == encoded(sorted([*long, *long, *sample_texts()[1:12]]))


def test_a_dictionary_of_few_documents(spark):
    docs = docs_of(spark, ["two words", "two more words"])
    assert _files(spark, docs)
    assert [r.n_tokens for r in read_token_store(spark, write_token_store(docs, PATH)).orderBy("start").collect()] == [len(x) for x in encoded(["two words", "two more words"])]
