import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from evalspark.llm import alignment
from hypothesis import given, settings
from hypothesis import strategies as st


FILES = tuple(open(p, "rb").read() for p in (alignment.BYTE_LEVEL, alignment.PIECES))


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers.load((*FILES, False))


def test_merging_by_rank_is_proven_before_it_is_used():
    assert alignment.merges_by_rank(FILES[0])
    model = json.loads(FILES[0])
    merges = model["model"]["merges"]
    k = next(i for i, m in enumerate(merges) if len((m.split(" ") if isinstance(m, str) else m)[0]) > 2)
    x, y = merges[k].split(" ") if isinstance(merges[k], str) else merges[k]
    merges[k] = [x[0], x[1:] + y] if not isinstance(merges[k], str) else f"{x[0]} {x[1:]}{y}"
    assert not alignment.merges_by_rank(json.dumps(model).encode())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" 's\n\t.,;éßñŁ01aethNW"), st.characters(max_codepoint=0x24F)), min_size=1, max_size=30))
def test_both_ways_to_merge_give_the_same_ids(text):
    slow, fast = (alignment.Tokenizers.load((*FILES, x)) for x in (False, True))
    assert slow.encode([text]) == fast.encode([text])


def groups(t, text):
    """Token by token, with the libraries alone."""
    if not text:
        return []
    (a,), (b,) = t.encode([text])
    want = (" " + text).encode()
    sides = []
    for ids, spelled in ((a, t.spelled_a), (b, t.spelled_b)):
        raw = [spelled.data[spelled.start[i] : spelled.start[i] + spelled.size[i]].tobytes() for i in ids]
        if b"".join(raw) != want:
            return []
        sides.append(np.cumsum([len(x) for x in raw]).tolist())
    out, i, j = [], 0, 0
    for end in sorted(set(sides[0]) & set(sides[1])):
        x, y = [], []
        while i < len(a) and sides[0][i] <= end:
            x.append(a[i])
            i += 1
        while j < len(b) and sides[1][j] <= end:
            y.append(b[j])
            j += 1
        out.append((x, y))
    return out


def brute(t, rows):
    found = [(i, groups(t, text)) for i, text in rows]
    links = [Counter((u, v) for a, b in g for u in a for v in b) for _, g in found]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), c.total(), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str), {(*p, n, n == most[p[0]]) for p, n in count.items()}


TEXTS = ["Hello world", "", None, "▁x", "ﬁ  b", "日本語 テキスト", "😀😀 x\r\n", "<|endoftext|> <s></s>", "\n\n\t x ", "a" * 3000, "= " * 300, "x\x00y", " lead", "trail  ", "don't we'll I'M"]


def same(t, docs, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows, pairs = alignment.align(docs(texts, ids))
    want, want_pairs = brute(t, list(zip(ids, texts, strict=True)))
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == want
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_edge_cases(both, docs):
    same(both, docs, TEXTS + TEXTS[:3], [*range(len(TEXTS)), 0, None, None])
    same(both, docs, [])
    same(both, docs, [None, ""])


def test_long_texts_are_composed_from_parts(both, docs, table, monkeypatch):
    texts = [r.text for r in table("documents").orderBy("n_chars", ascending=False).limit(4).collect()]
    texts += ["x" * 5000, "日本語 " * 900, "ab cd " * 700 + "▁" + " ab cd" * 500, "word " * 40, "one two"]
    monkeypatch.setattr(alignment, "LONG_BYTES", 500)
    monkeypatch.setattr(alignment, "PART_BYTES", 300)
    monkeypatch.setattr(alignment, "RANGE_BYTES", 64)
    monkeypatch.setattr(alignment, "FAN", 3)
    same(both, docs, texts)


def test_chunks_of_many_documents(both, docs, table, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CELLS", 2000)
    texts = [r.text for r in table("documents").orderBy("doc_id").limit(60).collect()]
    same(both, docs, texts)


def test_wide_groups_count_every_link(both, monkeypatch):
    text = [t for t in TEXTS if t] + ["ab cd ef " * 20]
    fits, f = alignment.tokenised(both, text)
    want = alignment._cells(both, f)
    monkeypatch.setattr(alignment, "WIDE", 0)
    for x, y in zip(want, alignment._cells(both, f), strict=True):
        assert np.array_equal(x, y)


def test_words_compose_to_what_whole_texts_give(both, table, monkeypatch):
    """Also with a bound on known words that is passed all the time, and with fragments of short byte ranges."""
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 50)
    monkeypatch.setattr(alignment, "RANGE_BYTES", 5)
    texts = [t for t in TEXTS if t] + ["a;\r\nb \n c \t d\n\n  e \u3000f\x1c g;\r", "ab " * 40 + "\n", "\n;\r x", "ab▁ cd"]
    texts += [r.text for r in table("documents").orderBy("doc_id").limit(40).collect() if r.text]
    known = alignment.Words(both)
    fits, f = alignment.tokenised(both, texts)
    want = alignment._cells(both, f)
    for k in range(0, len(texts), 9):
        own, found = known.summed(texts[k : k + 9])
        assert own.tolist() == fits[k : k + 9].tolist()
        at = np.flatnonzero(fits)
        a, b = np.searchsorted(at, k), np.searchsorted(at, k + 9)
        for i in range(4):
            assert np.array_equal(found[i], want[i][a:b])
        assert found[4] == want[4][a:b]
        inside = (want[5] >= a) & (want[5] < b)
        for x, y in zip(found[5:], (want[5][inside] - a, want[6][inside], want[7][inside]), strict=True):
            assert np.array_equal(x, y)
    monkeypatch.setattr(alignment, "RANGE_BYTES", 1 << 20)
    own, g = known.fragment(texts)
    assert np.array_equal(own, fits) and all(np.array_equal(getattr(f, c), getattr(g, c)) for c in ("a", "b", "in_a", "in_b", "parts"))


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fragments_compose_associatively_to_the_whole(data):
    size = data.draw(st.integers(1, 40))
    a, b = (np.array(sorted(data.draw(st.sets(st.integers(1, size), min_size=1)) | {size})) for _ in range(2))
    whole = alignment.fragment(np.arange(len(a)), a, np.arange(len(b)), b, np.array([0, size]))
    cut = np.array(sorted({0, size} | data.draw(st.sets(st.integers(0, size)))))
    pieces = alignment.fragment(np.arange(len(a)), a, np.arange(len(b)), b, cut)
    assert len(pieces.parts) == len(cut) - 1
    runs = np.sort([data.draw(st.integers(0, 3)) for _ in pieces.parts])  # any bracketing: first runs, then their results
    for made in (alignment.compose(pieces), alignment.compose(alignment.compose(pieces, runs))):
        for c in ("a", "b", "in_a", "in_b", "parts"):
            assert np.array_equal(getattr(made, c), getattr(whole, c)), c
    joint = [set(a.tolist()) & set(b.tolist())][0]
    assert whole.parts[0] == len(joint) + 1 and whole.in_a[-1] == whole.in_b[-1] == 0


def test_the_empty_fragment_is_neutral():
    f = alignment.fragment(np.arange(2), np.array([2, 3]), np.arange(2), np.array([1, 3]), np.array([0, 3]))
    none = alignment.Fragments.empty()
    for order in ((f, none), (none, f)):
        made = alignment.compose(alignment.Fragments(*(np.concatenate([getattr(x, c) for x in order]) for c in ("a", "b", "in_a", "in_b", "parts"))))
        assert all(np.array_equal(getattr(made, c), getattr(f, c)) for c in ("a", "b", "in_a", "in_b", "parts"))
