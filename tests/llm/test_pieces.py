import random

import pytest

from evalspark.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)


ODD = [" x", "  hello  world ", "\n\nA\tb", "", "ﬁ\u3000a\xa0b\x00c", "😀𐍈", "a" * 500, "    " * 20, "-" * 300, "a_b__c", "don't. stop,now|x", "ééé ñ ü", "1234567890123"]


def test_ids_are_the_librarys(vocabulary, library, table):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("abcdefg hintos\n-=_.éè1 ", k=rng.randint(0, 400))) for _ in range(200)]
    texts += [r.text for r in table("documents").collect()]
    for t in texts:
        ids = pieces.encode(vocabulary, t)
        assert list(ids) == library.encode(t), t[:80]
        assert pieces.decode(vocabulary, ids) == t == library.decode(list(ids))


def test_texts_searched_together_have_the_same_ids(library, table, monkeypatch):
    """Also where words share beginnings, hold characters without a piece, and the bound on known ones is passed."""
    rng = random.Random(7)
    v = pieces.Vocabulary.read(pieces.MODEL)
    texts = ODD + [" ".join("".join(rng.choices("theinosr.é𐍈☃", k=rng.randint(1, 9))) for _ in range(300)) for _ in range(8)]
    texts += [r.text for r in table("documents").limit(80).collect()]
    for most in (500_000, 200):
        v.known.most = most
        for k in range(0, len(texts), 7):
            assert [list(x) for x in pieces.encode_all(v, texts[k : k + 7])] == [library.encode(t) for t in texts[k : k + 7]]


def test_unigram_texts_searched_together(vocabulary):
    rng = random.Random(5)
    own = list({"".join(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(30)})
    v = pieces.Vocabulary(["<unk>", *own], [0.0, *(-rng.random() * 5 - 0.1 for _ in own)], ["other"] + ["normal"] * len(own), False)
    search = pieces.SharedBeginnings(v)
    for t in sorted("".join(rng.choices("abcd▁", k=rng.randint(1, 12))) for _ in range(500)):
        plain = pieces.StreamingViterbi(v)
        assert list(search.ids(t)) == plain.push(t) + plain.finish()


def test_streaming_gives_the_same_ids_and_holds_little(vocabulary):
    rng = random.Random(2)
    text = "".join(rng.choices("theinosr", k=20_000))
    search, out, most = pieces.StreamingViterbi(vocabulary), [], 0
    for c in text:
        out += search.push(c)
        most = max(most, len(search.text))
    out += search.finish()
    whole = pieces.StreamingViterbi(vocabulary)
    assert out == whole.push(text) + whole.finish()
    assert most < 1000 and len(out) > 5000


def test_unigram_paths_have_the_best_score():
    rng = random.Random(3)
    for t in range(150):
        own = list({"".join(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(12)} | ({"a", "b", "▁"} if t % 2 else {"a"}))
        scores = [-rng.random() * 5 - 0.1 for _ in own]
        v = pieces.Vocabulary(["<unk>", *own], [0.0, *scores], ["other"] + ["normal"] * len(own), False)
        text = "".join(rng.choices("ab cd", k=rng.randint(1, 60)))
        marked = (" " + text).replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(marked)
        for i in range(1, len(marked) + 1):
            for j in range(i):
                s = v.score.get(marked[j:i], v.unknown_score if i - j == 1 else None)
                if s is not None:
                    best[i] = max(best[i], best[j] + s)
        got = sum(v.unknown_score if i == 0 else v.scores[i] for i in pieces.encode(v, text))
        assert got == pytest.approx(best[-1])


def test_tables(docs, library):
    texts = [None, "", "Hello, world", "x" * 100_000, "tabs\tand\nlines", "▁"]
    encoded = pieces.encode_table(docs(texts, [None, 1, 2, 3, 4, 5]))
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[None].ids == got[1].ids == [] and got[2].ids == library.encode("Hello, world") and got[3].n_ids == len(got[3].ids)
    assert [got[k].round_trip for k in (None, 1, 2, 3, 4, 5)] == [True, True, True, True, True, False]
    back = {r.doc_id: r.text for r in pieces.decode_table(encoded).collect()}
    assert back[4] == texts[4] and back[3] == texts[3] and back[1] == ""
    assert pieces.encode_table(docs([])).count() == 0
