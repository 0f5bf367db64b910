import math
import re
from collections import Counter

import numpy as np
import pytest
from evalspark.llm import lexical
from hypothesis import given, settings
from hypothesis import strategies as st

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, top=20):
    docs = [(i, Counter(w := TERM.findall((t or "").translate(LOW))), len(w)) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, held, n in docs:
            score = 0
            for t in TERM.findall((text or "").translate(LOW)):
                if tf := held.get(t, 0):
                    m = 100 - 25 + (25 * n * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, -(2**63) if i is None else i))
        out += [(item, k + 1, None if i == -(2**63) else i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, rows, items, **more):
    table = spark.createDataFrame([(a, b, "x", 1) for a, b in items], "item_id int, text string, query string, rank int")
    got = lexical.search(docs([t for _, t in rows], [i for i, _ in rows]), table, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_edge_cases(spark, docs):
    rows = [(1, "apple Pie apple"), (2, None), (3, ""), (4, "..."), (5, "pie pie pie É"), (None, "apple"), (6, "apple"), (6, "apple"), (7, "été under_score"), (8, "w " * 300_000 + "apple")]
    items = [(1, "Apple pie"), (2, None), (3, ""), (1, "apple"), (1, "apple"), (4, "absent words"), (5, "under ÉTÉ été score pie pie"), (None, "w")]
    assert found(spark, docs, rows, items) == brute(rows, items)


def test_ties_go_to_the_smallest_ids(spark, docs):
    rows = [(i, "same words here") for i in range(100, 0, -1)] + [(1000 + i, f"other {i}") for i in range(100)]
    items = [(1, "words"), (2, "other")]
    assert found(spark, docs, rows, items) == brute(rows, items)


def test_no_documents_or_no_items(spark, docs):
    assert found(spark, docs, [], [(1, "a")]) == []
    assert found(spark, docs, [(1, "a")], []) == []
    assert found(spark, docs, [(1, "a")], [(1, "a"), (2, None)]) == brute([(1, "a")], [(1, "a"), (2, None)])


def test_several_blocks_and_trees(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 200)) for i in range(700)]
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 200, 12))) for k in range(25)]
    assert found(spark, docs, rows, items, block_bytes=200) == brute(rows, items)


def _tree(rows, n_terms, leaf):
    cut = np.r_[0, np.cumsum([len(t) for _, _, t in rows])]
    rank = np.concatenate([np.sort(list(t)) for _, _, t in rows]).astype(np.int64)
    count = np.concatenate([[t[x] for x in sorted(t)] for _, _, t in rows]).astype(np.int64)
    return lexical.Tree(np.array([i for i, _, _ in rows]), np.array([m for _, m, _ in rows]), cut, rank, count, n_terms, leaf)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_branch_and_bound_leaves_out_nothing(data):
    n_terms = data.draw(st.integers(1, 12))
    terms = st.dictionaries(st.integers(0, n_terms - 1), st.integers(1, 5), min_size=1)
    rows = [(i, m, t) for i, (m, t) in enumerate(data.draw(st.lists(st.tuples(st.integers(75, 200), terms), min_size=1, max_size=60)))]
    tree = _tree(rows, n_terms, data.draw(st.integers(1, 5)))
    query = sorted(data.draw(st.sets(st.integers(0, n_terms - 1), min_size=1)))
    weight = [data.draw(st.integers(0, 50)) for _ in query]
    top = data.draw(st.integers(1, 8))
    best, spread = lexical.Best(top), np.zeros(n_terms, np.int64)
    tree.search(np.array(query), np.array(weight), spread, best)
    scored = sorted((-s, i) for i, m, t in rows if (s := sum(w * (10**9 * t[q] // (1000 * t[q] + 12 * m)) for q, w in zip(query, weight, strict=True) if q in t)) > 0)[:top]
    assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == scored
    assert not spread.any()


def test_most_branches_are_left_out():
    rng = np.random.default_rng(1)
    rows = [(i, 100, {int(x): 1 for x in rng.integers(0, 300, 20)} | ({7: 4, 11: 4} if i % 500 == 0 else {})) for i in range(4000)]
    tree = _tree(rows, 300, 32)
    scored = []
    score = tree._score
    tree._score = lambda node, spread, best: (scored.append(node), score(node, spread, best))
    tree.search(np.array([7, 11]), np.array([5000, 5000]), np.zeros(300, np.int64), lexical.Best(5))
    assert len(scored) < 0.5 * sum(x is None for x in tree.below)


@pytest.mark.parametrize("n", [0, 1])
def test_queries_without_terms(n):
    block = lexical.Queries(["..."] * n)
    assert block.n_terms == 0 and block.table.find(np.zeros(3, np.uint8), np.array([0]), np.array([3]))[0].size == 0
