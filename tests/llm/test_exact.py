import hashlib
import random

from evalspark.llm import cuckoo


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = [(i, (t or "").translate(low)) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edge_cases(docs):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (None, "lone"), (9, "a b"), (10, "a  b")]
    found = [tuple(r) for r in cuckoo.exact_duplicates(docs([t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sorted(found, key=str) == brute(rows)
    assert cuckoo.exact_duplicates(docs([])).count() == 0


def test_repeated_rows_share_their_fate(docs):
    found = cuckoo.exact_duplicates(docs(["a", "a", "b"], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in found) == [(1, 2, True), (1, 2, True), (2, 1, True)]


def test_kept_rows_have_all_columns(docs):
    found = cuckoo.keep_one_of_each(docs(["a", "A", "b"]))
    assert found.columns == docs([]).columns
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]


def test_index_inserts_deletes_and_grows():
    rng = random.Random(5)
    index, live = cuckoo.CuckooIndex(8), {}
    pool = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(20_000):
        key = rng.choice(pool)
        if rng.random() < 0.3:
            assert index.delete(key) == (live.pop(key, None) is not None)
        else:
            doc = rng.randrange(1000)
            assert index.insert(key, doc) == (key not in live)
            keep, size = live.get(key, (doc, 0))
            live[key] = max(keep, doc), size + 1
    assert index.resizes > 3
    assert {k: (a, b) for k, a, b in index.rows()} == live and len(index) == len(live)
    assert all((k in index) == (k in live) for k in pool)


def test_fingerprint_clashes_are_told_apart_by_content():
    index = cuckoo.CuckooIndex(16)
    tail = b"\1" * 10  # the same fingerprint and the same two buckets
    keys = [bytes([i]) * 22 + tail for i in range(6)]
    for k in keys:
        assert index.insert(k, 1)
    assert all(k in index for k in keys) and b"\7" * 22 + tail not in index


def test_update_of_a_written_index(spark, docs):
    first = cuckoo.digests(docs(["a", "b", "B", "c"], [1, 2, 3, 4]))
    index = cuckoo.build_index(first)
    gone = first.where("doc_id = 4").select("digest")
    now = cuckoo.update_index(index, cuckoo.digests(docs(["b", "d"], [9, 8])), gone)
    assert sorted((r.keep_id, r.group_size) for r in now.collect()) == [(1, 1), (8, 1), (9, 3)]
