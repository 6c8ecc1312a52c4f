import json
import random
import re
from collections import Counter

import pytest

from engram.functions import lexicon as L
from engram.functions import text as T
from engram.operators import chunking, entities, extract, summary, transcripts
from engram.operators.spelling import Speller, default_dictionary
from engram.plans import catalogue
from engram.plans.views import view


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def one(spark, texts, column):
    return [r.x for r in rows(spark, texts).select("id", column.alias("x")).orderBy("id").collect()]


def test_overlapping_chunks():
    assert [len(c) for c in chunking.overlapping("A" * 50)] == [50] and chunking.overlapping("Hello world") == []
    assert len(chunking.overlapping("A" * 450 + "\n\n" + "B" * 450)[0]) == 450
    parts = chunking.overlapping("A" * 600 + "\n\n" + "B" * 600)
    assert len(parts) == 2 and "B" not in parts[0]
    assert all(len(c.encode()) <= 800 for c in chunking.overlapping("é" * 3000))


def test_conversation_chunks(spark):
    turn = "> question number {}\nan answer that is long enough to be kept here\n\n"
    three = "".join(turn.format(i) for i in range(3))
    got = one(spark, [three, three + "---\nnot kept at all, as it stands after a rule", "para one is long enough to keep around\n\npara two is long enough to keep around", "x"], chunking.conversation_chunks(T.F.col("text")))
    assert [len(x) for x in got] == [3, 3, 2, 0]
    assert got[0][0] == "> question number 0\nan answer that is long enough to be kept here"


def test_segments(spark):
    turns = "Human: one\nreply\nAssistant: two\nHuman: three\nAssistant: four"
    got = one(spark, [turns, "\n".join(f"line {i}" for i in range(30)), "a\n\nb"], chunking.segments(T.F.col("text")))
    assert [len(x) for x in got] == [4, 2, 2]


@pytest.mark.parametrize(("text", "kind"), [(t, k) for t, k in zip(catalogue._SENTENCES, ["Decision", "Preference", "Milestone", "Problem", "Milestone", None, "Emotional", "Decision", None], strict=True)])
def test_kinds_of_memories(spark, text, kind):
    got = extract.structured_memories(rows(spark, [text]), "id", "text").collect()
    assert [r.memory_type for r in got] == ([kind] if kind else [])


def test_prose_leaves_out_code(spark):
    text = "Words come first.\n```\ncode()\n```\n$ ls -la\nimport os\nAnd words again."
    assert one(spark, [text, "$ ls"], T.prose(T.F.col("text"))) == ["Words come first.\nAnd words again.", "$ ls"]


def test_literals_are_needed_by_their_patterns():
    import re

    for patterns in extract.KINDS.values():
        for p in patterns:
            literal = T.needed_literal(p)
            for text in catalogue._SENTENCES:
                if re.search(p, text.lower()):
                    assert literal in text.lower()


def test_codes(spark):
    codes = {"Alice": "ALC"}
    assert one(spark, ["Alice", "Bob", "Xi", "A"], T.encode_entity(T.F.col("text"), codes)) == ["ALC", "BOB", "XI", "ALC"]
    assert one(spark, ["x"], T.encode_emotions(T.F.array(*map(T.F.lit, ["joy", "anger", "fear", "hope"])))) == ["joy+rage+fear"]
    assert one(spark, ["Al", "O'Brien"], T.person_code("text")) == ["ALX", "OBR"]
    assert one(spark, ["Dr Bob's Place"], T.slug("text")) == ["dr_bobs_place"]


def test_rooms_of_files(spark):
    paths = spark.createDataFrame([("technical/a.py", ""), ("x/family_trip.md", ""), ("x/zz.md", "a bug and an error in python"), ("x/zz.md", "")], "path string, text string")
    assert [r.x for r in paths.select(T.project_room(T.F.col("path"), T.F.col("text")).alias("x")).collect()] == ["technical", "family", "technical", "general"]


def test_summaries(spark):
    good = "WHO: Alice decided. WHAT: use Spark. WHY: it scales. CONFIDENCE: high"
    got = {r.id: r.summary for r in summary.summarised(rows(spark, ["", "We decided to use it because it is better", good]), "id", "text").collect()}
    assert got[0].split("\n")[:2] == ["V:3.2", "0:???|misc"]
    assert got[1].startswith("RAW|FBF|We decided")
    assert "DECISION[v1]" in got[2] and json.loads(got[2].split("JSON:")[1])["extra"]["grammar_reg"] == "v1"
    low = {r.id: r.summary for r in summary.summarised(rows(spark, ["We decided to use it because it is better"]), "id", "text", density=3).collect()}
    assert low[0].startswith("V:3.2")


def test_decode_and_merge(spark):
    text = "V:3.2\nwing|room|2024|title\nARC:arc\n0:ABC+DEF|one_two|\"q\"\nT:tunnel\nJSON:{\"a\":1}"
    x = one(spark, [text], summary.decoded(T.F.col("text")))[0]
    assert (x.version, x.header.title, x.arc, len(x.zettels), x.tunnels, x.overlay) == ("3.2", "title", "arc", 1, ["T:tunnel"], '{"a":1}')
    parts = spark.createDataFrame([(1, 0, "V:3.2\n0:B|y|q"), (1, 1, "V:3.2\n0:A+B|x_y"), (2, 0, "plain")], "cluster int, rank int, summary string")
    assert {r.cluster: r.summary for r in summary.merged(parts).collect()} == {1: "V:3.2\n0:A+B|x_y|q", 2: "plain"}


def test_entities(spark):
    got = entities.entities(rows(spark, catalogue._PEOPLE + ["Zed Zed"]), "id", "text").collect()
    assert [(r.name, r.type) for r in got] == [("Alice", "Person"), ("Orion", "Project"), ("SomeWord", "Term")]
    asked = spark.createDataFrame([("Max", "with Max yesterday"), ("Will", "what will you do, not will again"), ("Rose", "nothing")], "name string, context string")
    assert [r.meaning for r in entities.in_context(asked).collect()] == ["Person", "Term", None]


@pytest.mark.parametrize(("text", "want"), [
    ("", ""), ("plain", "plain"), ("> a\n> b\n> c", "> a\n> b\n> c"), ('[{"role":"user","content":"only one"}]', '[{"role":"user","content":"only one"}]'),
    ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', "> a\nb"), ("{broken", "{broken"), ("[1,2,3]", "[1,2,3]"),
])
def test_transcripts(text, want):
    assert transcripts.normalised(text) == want


def test_spelling():
    speller = Speller(default_dictionary())
    assert speller.text("I alwready knwo it, Bob's pleese!") == "I already know it, Bob's please!"
    assert speller.transcript("> pleese\npleese") == "> please\npleese"


def _awkward(n=400):
    rng = random.Random(7)
    parts = ["> q", ">ask more things here please", "an answer line that is long enough", "---", "--- x", "", "  ", "```", "``` py", "  ```", "import os", "$ ls", "Plain words here.", "Human: one", "Assistant: two", "text\r", "| a | b |", "My Alpha_Beta gammaDelta alpha the"]
    return ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)] + [""]


def test_topics_equal_counting(spark):
    texts = [*_awkward(), " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{chr(97 + k % 7)}" for k in range(30000))]

    def topics(text):
        n = Counter()
        for w in re.findall("[a-zA-Z][a-zA-Z_-]{2,}", text):
            n[w.lower()] += 1 + 2 * w[0].isupper() + 2 * bool(re.search("[_-]|^.+[A-Z]", w))
        return [w for _, w in sorted((-k, w) for w, k in n.items() if w not in L.TOPIC_STOP_WORDS)][:5]

    assert one(spark, texts, T.topics("text", 5)) == [topics(t) for t in texts]


def test_exchanges_and_segments_equal_a_walk(spark):
    def walk(text, opens, ends):
        out, now = [], None
        for line in re.sub(r"\r?\n$", "", text).split("\n"):
            line = line.removesuffix("\r") if not text.endswith(line) or "\n" in text else line
            if opens(line) or ends(line):
                out += [now] if now else []
                now = [line] if opens(line) else None
            elif now is not None:
                now.append(line)
        return out + ([now] if now else [])

    def exchanges(text):
        found = []
        for first, *rest in walk(text, lambda x: x.strip().startswith(">"), lambda x: x.strip().startswith("---")):
            answer = " ".join([x.strip() for x in rest if x.strip()][:8])
            found.append(first.strip() + ("\n" + answer if answer else ""))
        return [x for x in found if len(x.encode()) >= 31]

    texts = [t for t in _awkward() if "\r" not in t]
    assert one(spark, texts, chunking.exchanges(T.F.col("text"))) == [exchanges(t) for t in texts]


def test_prose_equals_a_walk(spark):
    plain = [t for t in _awkward() if "\r" not in t]
    is_code = dict(zip(sorted({x for t in plain for x in t.split("\n")}), one(spark, sorted({x for t in plain for x in t.split("\n")}), T.is_code_line(T.F.col("text")))))

    def prose(text):
        kept, code = [], False
        for line in text.split("\n"):
            if line.lstrip().startswith("```"):
                code = not code
            elif not code and not is_code[line]:
                kept.append(line)
        return "\n".join(kept).strip() if kept else text

    assert one(spark, plain, T.prose(T.F.col("text"))) == [prose(t) for t in plain]


def test_no_text_of_the_tables_decides(spark):
    """The SQL of dia_summaries leaves out the part for texts that are flagged as decisions."""
    docs = view(spark, "/root/testdata/sf0.01", "documents")
    assert docs.where(T.F.array_contains(T.flags("text"), "DECISION")).count() == 0
