import random

from engram.llm.license_scan import PHRASES, TEMPLATES, LicenseRules, Scanner, SuffixAutomaton, rules_from, scan_licenses, words_of
from tests.llm.helpers import docs_of, sample_texts, stored, terms


def test_base_places_equal_brute_force(spark):
    texts = sample_texts() + [r["text"] for r in stored()] + ["cc by cc by all rights reserved", "CC-BY 4.0 general public public license"]
    got = {r.doc_id: r for r in scan_licenses(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words, places, labels = terms(text), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_whole_templates_are_found(spark):
    cases = [(label, text) for label, texts in sorted(TEMPLATES.items()) for text in texts]
    texts = [f"Some words first. {text.upper()}\nAnd more words after the end" for _, text in cases]
    rows = sorted(scan_licenses(docs_of(spark, texts)).collect())
    for r, (label, text) in zip(rows, cases, strict=True):
        assert label in r.labels.split(",") and r.score == 1.0
        assert (label, 3, 3 + len(words_of(text)), 1.0) in [tuple(s) for s in r.spans]


def test_edited_template_is_chained(spark):
    words = TEMPLATES["mit"][2].split()
    words[14:16] = ["some", "other", "inserted"]
    r = scan_licenses(docs_of(spark, [" ".join(words), "of the and the of and is a"])).orderBy("doc_id").collect()
    assert r[0].labels == "mit" and 0.6 < r[0].score < 1
    assert r[1].labels == "" and r[1].spans == []


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(300):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = SuffixAutomaton(seqs)
        text = [rng.randint(0, 3) for _ in range(20)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        best = [max([k for k in range(e + 1) if tuple(text[e - k : e]) in subs], default=0) for e in range(21)]
        want = [(e, best[e]) for e in range(1, 21) if best[e] >= 2 and (e == 20 or best[e + 1] != best[e] + 1)]
        got = list(automaton.matches(text, 2))
        assert [(e, k) for e, k, _ in got] == want
        for e, k, state in got:
            assert automaton.ends[state] == {(n, i + k - 1) for n, s in enumerate(seqs) for i in range(len(s) - k + 1) if s[i : i + k] == text[e - k : e]}


def test_empty_table_and_other_rules(spark):
    assert scan_licenses(docs_of(spark).limit(0)).count() == 0
    rules = LicenseRules(min_match=2, templates={"own": ["alpha beta gamma"]}, phrases={})
    assert scan_licenses(docs_of(spark, ["x alpha beta y"]), rules).first().labels == "own"
    assert Scanner(rules).sizes == [3]


def brute_cover(words, template, rules):
    """The most words of the template that any chain of matches covers, over all chains."""
    n = len(words)
    stands = lambda e, k, at: words[e - k : e] == template[at : at + k]
    best = {e: max(k for k in range(e + 1) if any(stands(e, k, at) for at in range(len(template) - k + 1))) for e in range(1, n + 1)}
    ends = [(e, best[e]) for e in range(1, n + 1) if best[e] >= rules.min_match and (e == n or best[e + 1] != best[e] + 1)]
    places = [(e, k, at + k - 1) for e, k in ends for at in range(len(template) - k + 1) if stands(e, k, at)]

    def onwards(place, covered):
        end, _, last = place
        return max([covered, *(onwards((e, k, l), covered + min(k, e - end, l - last)) for e, k, l in places if e > end and l > last and e - k - end <= rules.max_gap)])

    return max([0, *(onwards(p, p[1]) for p in places)])


def test_scores_equal_all_chains(spark):
    rng = random.Random(8)
    for _ in range(12):
        template = " ".join(rng.choice("abcde") for _ in range(rng.randint(5, 14)))
        rules = LicenseRules(min_match=2, max_gap=3, min_cover=0.6, templates={"own": [template]}, phrases={})
        texts = [" ".join(rng.choice("abcdexy") for _ in range(rng.randint(3, 18))) for _ in range(25)] + [template, template + " x " + template]
        for r in scan_licenses(docs_of(spark, texts), rules).collect():
            cover = brute_cover(texts[r.doc_id].split(), template.split(), rules) / len(template.split())
            assert abs(r.score - cover) < 1e-12, (template, texts[r.doc_id])
            assert r.labels == ("own" if cover >= 0.6 else "") and bool(r.spans) == (cover >= 0.6)
            for s in r.spans:
                assert 0 <= s.start < s.end <= r.n_words and 0.6 <= s.cover <= cover


def test_a_piece_counts_once(spark):
    rules = LicenseRules(templates={"own": ["alpha beta gamma delta one alpha beta gamma delta"]}, phrases={})
    rows = sorted(scan_licenses(docs_of(spark, ["x alpha beta gamma delta y", "alpha beta gamma delta or alpha beta gamma delta"]), rules).collect())
    assert [round(r.score, 3) for r in rows] == [0.444, 0.889]
    assert [r.labels for r in rows] == ["", "own"]


def test_templates_of_a_table(spark):
    table = spark.createDataFrame([("own", "one two three four five six"), ("own", None), (None, "x"), ("none", " . ")], "label string, text string")
    r = scan_licenses(docs_of(spark, ["zero one two three four five six seven " * 3]), rules_from(table)).first()
    assert r.labels == "own" and r.score == 1.0 and [(s.start, s.end) for s in r.spans] == [(1, 7), (9, 15), (17, 23)]
    try:
        rules_from(table, most_words=3)
    except ValueError:
        return
    raise AssertionError("too large a table was taken")
