import random
import re

import numpy as np
from evalspark.llm import licenses
from evalspark.llm.license_texts import TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places = [(j, label) for phrase, label in licenses.PHRASES for j in range(len(words)) if words[j : j + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((j for j, _ in places), default=None), max((j for j, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def scanned(docs, texts, ids=None):
    return licenses.summary(licenses.scan(docs(texts, ids)))


def test_base_places_against_brute_force(docs):
    rng = random.Random(4)
    vocabulary = "gnu General public LICENSE license apache cc by mit MIT-license a. b, é cc_by under the terms of".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    texts += ["", None, "...", "cc by", "CC-BY cc,by", "x" * 200_000 + " mit license", "mit license " * 50_000, "ccé by", "apache\nlicense", "cc by by cc by"]
    got = {r.doc_id: tuple(r)[1:6] for r in scanned(docs, texts).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_templates_are_found_in_parts_and_with_changes(docs):
    mit = TEMPLATES[0][1]
    words = mit.split()
    texts = [
        "Some intro. " + mit + " More text.",
        " ".join(words[:60]),
        " ".join(w if i % 20 else "changed" for i, w in enumerate(words)),
        "Licensed under CC BY-NC 4.0. Ask first.",
        "This work is licensed under the GNU General Public License, version 3 or so",
        "an ordinary text about the software and the conditions of use",
        " ".join(words[:12]),
        "Permission is hereby denied to any person.",
    ]
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in scanned(docs, texts).collect()}
    assert got[0] == ("mit", 1.0)
    assert got[1][0] == "mit" and 0.3 < got[1][1] < 0.5
    assert got[2][0] == "mit" and 0.9 < got[2][1] < 1
    assert got[3] == ("cc-by,cc-by-nc", 1.0) and got[4] == ("gpl,gpl-3.0", 1.0)
    assert got[5] == got[6] == got[7] == ("", 0.0)


def test_span_is_where_the_passage_is(docs):
    isc = next(t for label, t in TEMPLATES if label == "isc")
    n = len(WORD.findall(isc.translate(LOW)))
    spans = licenses.scan(docs(["one two three " + isc + " four", "one " + isc + " x " * 100 + isc])).orderBy("doc_id").collect()
    assert [(s.label, s.first_word, s.last_word, s.covered) for s in spans[0].spans if s.label == "isc"] == [("isc", 3, 2 + n, n)]
    assert [(s.first_word, s.last_word) for s in spans[1].spans if s.label == "isc"] == [(1, n), (101 + n, 100 + 2 * n)]


def test_every_template_names_its_label():
    scanner = licenses.Scanner(TEMPLATES, licenses.PHRASES)
    for label, text in TEMPLATES:
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, anchors = scanner.scan(np.array([0, len(data)]), data)
        assert (label, 1.0) in {(x[0], x[4]) for x in scanner.spans(anchors[0])}


def test_null_ids_repeated_rows_empty_table(docs):
    got = scanned(docs, ["mit license", "mit license", None], [None, None, 5]).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.labels, r.score) for r in got) == [("5", 0, 0, "", 0.0), ("None", 2, 1, "mit", 1.0), ("None", 2, 1, "mit", 1.0)]
    assert scanned(docs, []).collect() == []


def test_matching_statistics_against_all_passages():
    rng = random.Random(1)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(6)]
    automaton = licenses.SuffixAutomaton(sequences, 4)
    passages: dict = {}
    for t, q in enumerate(sequences):
        for i in range(len(q)):
            for j in range(i + 1, len(q) + 1):
                passages.setdefault(tuple(q[i:j]), set()).add((t, j))
    for _ in range(100):
        text = [rng.randrange(4) for _ in range(25)]
        states, lengths = automaton.walk(text, [i % 11 == 0 for i in range(25)])
        for i in range(25):
            longest = max(k for k in range(i % 11 + 2) if k == 0 or tuple(text[i - k + 1 : i + 1]) in passages)
            assert lengths[i] == longest
            assert set(automaton.ends[states[i]]) == passages[tuple(text[i - longest + 1 : i + 1])]


def test_chains_against_all_subsets():
    rng = random.Random(2)
    for _ in range(200):
        places = sorted({(rng.randrange(3, 30), rng.randrange(3, 30), rng.randrange(1, 4)) for _ in range(7)})
        best = 0
        for mask in range(1, 1 << len(places)):
            chosen = [p for k, p in enumerate(places) if mask >> k & 1]
            total = chosen[0][2]
            for (e, t, _), (e2, t2, n) in zip(chosen, chosen[1:]):
                if e2 <= e or t2 <= t or e2 - e - n > 5 or t2 - t - n > 5:
                    break
                total += min(n, e2 - e, t2 - t)
            else:
                best = max(best, total)
        assert max(c for _, _, c in licenses.chains(places, 5)) == best
