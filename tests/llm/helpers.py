"""Small tables that hold the awkward cases, and readers of the test tables."""

import random
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sample_texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "ereth", "a", "onan", "it's", "Éta", "l'été", "x1", "42", "don't", "…", "ça", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(90)
    long = "\n".join(prose(rng.randint(3, 40)) for _ in range(400))
    return [
        None, "", " \n\t ", "one", "one two three", prose(60), prose(60) + "\n" + passage, passage + " " + prose(30), passage,
        "same line here\n" * 30, "a" * 5000, "aaaa bbbb " * 300, long, long, long + " tail", "All rights reserved.\nCC BY, cc-by; GNU general\npublic license",
        "Released under the MIT License.", "<|endoftext|>x <|endoftext|>  y", "tab\there\r\nnew  spaces   \n\n", "\x00\x01 # * $$$ %& <b>|", "՘\U00018d00 rare 12²    x", prose(2000),
    ]


def docs_of(spark, texts=None, ids=None, extra=True):
    texts = sample_texts() if texts is None else texts
    rows = [(i if ids is None else ids[i], t, None if i % 5 == 4 else "en", [None, "b", "a", "ä"][i % 4], None, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size int")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def stored(name="documents"):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()
