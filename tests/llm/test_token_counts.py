import public_tokenizers
import pytest
from tokenizers import Tokenizer

from engram.llm.token_counts import count_tokens
from engram.llm.tokenizing import Pieces
from tests.llm.helpers import docs_of, sample_texts, stored

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = sample_texts() + [r["text"] for r in stored()]
    got = {r.doc_id: r for r in count_tokens(docs_of(spark, texts), PATH, limit=100).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100), text


def test_every_character_is_cut_as_the_library_does():
    pieces, library = Pieces(PATH), Tokenizer.from_file(PATH)
    texts = ["a " + chr(c) + "1" + chr(c) + "b !" + chr(c) + " " + chr(c) for c in [*range(1, 0x3000, 1), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(texts), 2000):
        part = texts[k : k + 2000]
        assert [sum(pieces.values(t)) for t in part] == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_pieces_are_those_of_the_library():
    pieces, library = Pieces(PATH), Tokenizer.from_file(PATH)
    for text in [t for t in sample_texts() if t] + [r["text"] for r in stored()] + ["हिन्दी में \u0e01\u0e02 👩‍🚀!! it's 5\u00b2 <|endoftext|>  x", "<|endoftext|>" * 3]:
        found, special = pieces.cut_up(text)
        assert sum(pieces.known[p] for p in found) + special == len(library.encode(text, add_special_tokens=False).ids)
        if not special:
            assert "".join(found) == text and found == pieces.library_pieces(text)


@pytest.mark.parametrize("most", [0, 16 * 40])
def test_counts_with_few_or_no_broadcast_pieces(spark, most):
    library = Tokenizer.from_file(PATH)
    texts = sample_texts()
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs_of(spark, texts).repartition(4), PATH, broadcast_bytes=most).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_equal_rows_and_long_texts(spark):
    library = Tokenizer.from_file(PATH)
    long = " ".join(f"w{k % 9973} été" for k in range(200_000))
    texts = ["a b", "a b", long, None, "", None]
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs_of(spark, texts, [1, 1, 2, 3, 3, 3]), PATH).collect())
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert got == [(1, 3, 2), (1, 3, 2), (2, len(long.encode()), n), (3, 0, 0), (3, 0, 0), (3, 0, 0)]


def test_the_plan_joins_frequencies(spark):
    plan = count_tokens(docs_of(spark), PATH, broadcast_bytes=16 * 40)._jdf.queryExecution().toString()
    assert "Join" in plan and "Aggregate" in plan


def test_memory_of_pieces_is_bounded():
    pieces = Pieces(PATH, remembered=5)
    for k in range(20):
        assert sum(pieces.values(f"w{k} x{k}")) == len(pieces.ids(f"w{k} x{k}"))
    assert len(pieces.known) < 30


@pytest.mark.parametrize("ids", [None, [None] * 22, [7] * 22])
def test_ids_may_be_null_or_repeat(spark, ids):
    assert count_tokens(docs_of(spark, ids=ids), PATH).count() == 22


def test_empty_table(spark):
    out = count_tokens(docs_of(spark).limit(0), PATH)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0
