import math
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import bagminhash, components, egojoin, windows


def classes(n, links):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


# --- components


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = classes(500, links)
    assert got == {k: want[k] for p in links for k in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- embeddings


def vectors(rng, d=16):
    x = rng.normal(size=(120, d))
    copies = [x[3]] * 40 + [x[3] * 7] * 3 + [x[5] + rng.normal(size=d) * s for s in np.linspace(0, 0.4, 60)]
    return [v.tolist() for v in [*x, *copies]]


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, near), (1, far), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (4, [0.0, 1.0, 0.01]), (1, [0.0, 0.0, 1.0]), (1, near)]
    got = egojoin.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), leaf=2).collect()
    # the two equal rows link with each other, 2 and 3; the second row of id 1 with 4; the third with none
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 0, 1), (1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 1)]


def test_distant_leaves_are_skipped_and_travel_once_a_tile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    x = np.repeat(centers, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    seen = {}
    plain = egojoin._links
    monkeypatch.setattr(egojoin, "_links", lambda leaves, near, *more: seen.update(leaves=leaves.count(), pairs=near.count(), sent=near.selectExpr("block_l", "block_r", "explode(array(left, right)) AS leaf").distinct().count()) or plain(leaves, near, *more))
    got = {r.vec_id: (r.n_links, r.component_id) for r in egojoin.near_vectors(df, leaf=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T) >= 0.95
    assert {k: v[0] for k, v in got.items()} == dict(enumerate((links.sum(axis=1) - 1).tolist()))
    assert seen["pairs"] < 0.5 * seen["leaves"] * (seen["leaves"] + 1) / 2 and seen["sent"] < 2 * seen["pairs"]


def test_tiles_are_compared_in_rounds(spark, monkeypatch):
    """Random vectors, where no leaf is skipped: every tile once, a few groups' tiles at a time, and no round's table stays."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8))
    x[::2] = x[::2].astype(np.float32)  # half of them need only four bytes a number
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = classes(1500, list(zip(*np.nonzero(near), strict=True)))
    plain, sent = egojoin._links, []
    monkeypatch.setattr(egojoin, "_links", lambda leaves, pairs, *more: sent.append([(r.block_l, r.block_r, r.leaf) for r in pairs.selectExpr("block_l", "block_r", "explode(array(left, right)) AS leaf").distinct().collect()]) or plain(leaves, pairs, *more))
    folder = spark._jvm.org.apache.hadoop.fs.Path(egojoin.common.shared_folder(spark)).getParent()
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {x.getPath().getName() for f in (files.listStatus(folder) if files.exists(folder) else []) for x in files.listStatus(f.getPath())}
    before = tables()
    got = {r.vec_id: (r.n_links, r.component_id) for r in egojoin.near_vectors(df, 0.9, leaf=4, round_bytes=1).collect()}
    assert got == {i: (near[i].sum(), want[i]) for i in range(1500)}
    every = [t for r in sent for t in r]
    assert len(sent) > 8 and len(set(every)) == len(every) and max(map(len, sent)) < len(every) / 3
    assert not {"vectors", "different", "leaves", "directory"} & {n.split("-")[0] for n in tables() - before}


@pytest.mark.parametrize("leaf", [7, 1024])
def test_links_and_components(spark, leaf, monkeypatch):
    monkeypatch.setattr(egojoin, "_LEAF", 5)
    rows = vectors(np.random.default_rng(1))
    n = len(rows)
    extra = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], rows[0]]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in enumerate(rows + extra)], "vec_id bigint, embedding array<double>, label int, key string")
    got = {r.vec_id: r for r in egojoin.near_vectors(df, leaf=leaf).collect()}
    x = np.array([*rows, [0.0] * 16])
    x[n] = rows[0]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    index = [*range(n), n + 8]
    want = classes(n + 1, list(zip(*np.nonzero(near), strict=True)))
    for k, i in enumerate(index):
        assert got[i].n_links == near[k].sum() and got[i].component_id == index[want[k]] and got[i].kept == (index[want[k]] == i)
    assert (got[n + 6].n_links, got[n + 7].component_id) == (1, n + 6)
    for k in range(n, n + 6):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert egojoin.near_vectors(df.limit(0)).count() == 0


def test_nothing_near_is_skipped():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = np.eye(8)[:, :4]
    epsilon = math.sqrt(2 - 2 * 0.8)
    order = np.lexsort(np.floor(x @ axes / epsilon).T[::-1])
    x = x[order]
    side = (x, x @ axes, np.arange(500))
    found = np.zeros((500, 500), bool)
    for i, j, m in egojoin.join_intervals(side, side, axes, epsilon, 0.8, True):
        found[np.ix_(i, j)] |= m
    assert (found == np.triu(x @ x.T >= 0.8, 1)).all()


# --- documents


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    off = []
    for _ in range(30):
        n = rng.integers(5, 200)
        shingle = np.sort(rng.integers(1, 2**63, n).astype(np.uint64))
        w = [rng.integers(0, 20, n), rng.integers(0, 20, n)]
        w[1] = np.where(rng.random(n) < 0.7, w[0], w[1])
        w[0][0] = w[1][0] = 1
        row = np.concatenate([np.full((x > 0).sum(), k) for k, x in enumerate(w)])
        sign = bagminhash.signatures(row, np.concatenate([shingle[x > 0] for x in w]), np.concatenate([x[x > 0] for x in w]), 3, 512)
        off.append((sign[0] == sign[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum())
        assert (sign[2] == 0).all()
    assert abs(np.mean(off)) < 0.012


def jaccard(a, b):
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.fixture(scope="module")
def crowd(words):
    rng = np.random.default_rng(4)
    texts = [words(int(rng.integers(5, 200)), s) for s in range(40)]
    base = words(300, 99).split()
    for k in range(60):  # one large group whose members differ in up to ten places
        w = list(base)
        for at in rng.integers(0, 300, int(rng.integers(0, 11))):
            w[at] = f"x{k}"
        texts.append(" ".join(w))
    for cut in range(0, 100, 12):  # a chain: neighbours are near, the ends are not
        texts.append(" ".join(base[cut : cut + 200]))
    texts += [texts[0].upper(), texts[1], "same four words here", "Same four words HERE", "ha " * 50, "ha " * 55, "ha " * 200, None, "", "!!!", "???", "z " * 100_000]
    return texts


def test_near_duplicates_against_brute_force(docs, crowd):
    texts = [t or "" for t in crowd]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = classes(len(texts), links)
    got = {r.doc_id: r for r in bagminhash.near_duplicates(docs(crowd), group=7).collect()}
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].kept for k in range(len(texts))] == [w == k for k, w in enumerate(want)]
    assert all(got[k].group_size == want.count(want[k]) for k in range(len(texts)))


def test_near_duplicates_edges(docs, words):
    assert bagminhash.near_duplicates(docs([])).count() == 0
    got = bagminhash.near_duplicates(docs([words(30, 1), words(30, 1), None], [None, 4, 5])).toPandas()
    assert got.kept.sum() == 2 and got[got.doc_id == 4].component_id.isna().all()


# --- passages


def test_rows_of_one_id_are_documents_of_their_own(docs, words):
    """(1, A), (1, B), and near copies of each: both are linked, whichever row comes first."""
    a, b = words(100, 1), words(100, 2)
    near = [f"{t} one more" for t in (a, b)]
    for order in ([a, b], [b, a]):
        got = bagminhash.near_duplicates(docs([*order, *near, a, "other words here", ""], [1, 1, 2, 3, 1, 1, 1])).collect()
        # A twice and its near copy; B and its near copy; two more rows with the id 1
        assert sorted((r.doc_id, r.component_id, r.group_size) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 2)]
        assert all(r.kept == (r.doc_id == 1) for r in got)


def test_a_bucket_of_many_different_copies(spark, docs, monkeypatch):
    """2,000 variants of one text: far ones are not linked directly, and no more links come out of a chunk than it ties."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    texts = []
    for _ in range(2000):
        own = list(base)
        for at in rng.integers(0, 300, 9):
            own[at] = f"v{rng.integers(0, 10**9)}"
        texts.append(" ".join(own))
    rows = docs(texts)
    seen = []
    plain = bagminhash._open_links
    monkeypatch.setattr(bagminhash, "_open_links", lambda *args: seen.append(plain(*args)) or seen[0])
    got = {r.doc_id: r.component_id for r in bagminhash.near_duplicates(rows).select("doc_id", "component_id").collect()}
    grams = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    root = list(range(2000))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = {}
    for i, g in enumerate(grams):
        for x in g:
            index.setdefault(x, []).append(i)
    shared = np.zeros((2000, 2000), np.int32)
    for who in index.values():
        if len(who) > 1:
            shared[np.ix_(who, who)] += 1
    sizes = np.array([len(g) for g in grams])
    for x, y in zip(*np.nonzero(np.triu(shared / (sizes[:, None] + sizes - shared) >= 0.8, 1)), strict=True):
        root[max(find(x), find(y))] = min(find(x), find(y))
    assert got == {i: find(i) for i in range(2000)}
    assert seen[0].count() < 24 * 5 * 2000


def test_chunks_give_out_only_links_that_tie_classes():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(120)]
    ones = [np.ones(len(x), np.int64) for x in sets]
    chunk = bagminhash._Chunk(0, 0.5)
    for i in range(100):
        chunk.hold(i, i, bytes(bagminhash.FINE), bagminhash._pack(sets[i], ones[i]))
    links = [x for i in range(100, 120) for x in chunk.links(i, i, bytes(bagminhash.FINE), bagminhash._pack(sets[i], ones[i]))]
    assert len(links) < 120
    near = {(i, j) for i in range(100, 120) for j in range(100) if bagminhash.overlap((sets[i], ones[i]), (sets[j], ones[j])) >= 0.5}
    assert set(links) <= near
    for i, j in near:
        assert chunk.find(i) == chunk.find(j)


def test_bags_survive_packing():
    shingle, weight = np.array([3, 9, 2**63 + 5], np.uint64), np.array([1, 7, 2])
    for n in range(4):
        a, b = bagminhash._unpack(bagminhash._pack(shingle[:n], weight[:n]))
        assert np.array_equal(a, shingle[:n]) and np.array_equal(b, weight[:n])


def test_compact_windows_hold_every_passage_once():
    rng = np.random.default_rng(5)
    for _ in range(60):
        least = int(rng.integers(1, 6))
        edges = np.r_[0, np.cumsum(rng.integers(0, 25, 5))]
        shingles = rng.integers(0, 40, edges[-1]).astype(np.uint64)
        value = windows.common.mix(shingles ^ np.uint64(0x9E3779B97F4A7C15 * 4 & (2**64 - 1)))
        got, want = {}, {}
        for a, c, b, _, _ in zip(*windows.compact_windows(shingles, edges, 3, least), strict=True):
            for left in range(a, c + 1):
                for right in range(max(c, left + least - 1), b + 1):
                    assert got.setdefault((left, right), c) == c
        for d in range(5):
            for left in range(edges[d], edges[d + 1]):
                for right in range(left + least - 1, edges[d + 1]):
                    want[left, right] = left + int(np.argmin(value[left : right + 1]))
        assert got == want


def test_planted_passages(docs, words):
    passage = words(60, 500)
    changed = passage.split()
    changed[30] = "other"
    texts = [words(200, k) for k in range(30)]
    texts[3] += " " + passage
    texts[7] = passage.upper().replace(" ", ",  ") + " " + texts[7]
    texts[9] = texts[9] + " " + " ".join(changed) + " " + words(50, 600)
    texts[11] = words(20, 700) + " " + passage + " " + words(20, 701) + " " + passage
    texts[12] = " ".join(passage.split()[:49])
    texts += [None, "", "one", "la " * 3000, "la " * 70]
    got = {r.doc_id: r for r in windows.repeated_passages(docs(texts)).collect()}
    assert {k for k, r in got.items() if r.n_spans} == {7, 9, 11, 34}
    assert got[7].spans[0].start == 0 and got[7].spans[0].stop == 60 and got[7].source_ids[0] == 3
    assert got[11].n_spans == 2 and [s.start for s in got[11].spans] == [20, 100]
    span = got[9].spans[0]
    assert texts[9].encode()[span.start_byte : span.stop_byte].decode() == " ".join(changed)
    assert got[12].n_words == 49 and got[30].n_words == 0
    assert windows.repeated_passages(docs([])).count() == 0


def test_no_passage_in_clean_documents(docs, words):
    got = windows.repeated_passages(docs([words(300, k) for k in range(50)]))
    assert got.where("n_spans > 0").count() == 0


def test_every_exact_repeat_of_fifty_words_in_a_table(table):
    import re

    docs = table("documents", "sf0.01")
    got = {r.doc_id: r.spans for r in windows.repeated_passages(docs).collect()}
    seen, missed, total = set(), 0, 0
    for r in docs.orderBy("doc_id").collect():
        w = re.findall("[0-9a-z_\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        covered = {k for s in got[r.doc_id] for k in range(s.start, s.stop)}
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        again = {k for i, g in enumerate(own) if g in seen for k in range(i, i + 50)}
        missed, total = missed + len(again - covered), total + len(again)
        seen.update(own)
    assert missed <= 0.002 * total


def near_places(w, others):
    """Words of windows of 50 that are near copies (matched shingles to all of both) of a window in another text, by trying all pairs."""
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = set()
    own = cut(w)
    for o in others:
        theirs = cut(o)
        if len(set(own) & set(theirs)) < 41:  # 41 of 46 and 46 are needed
            continue
        for i in range(len(own) - 45):
            a = set(own[i : i + 46])
            if any(len(a & b) >= 0.8 * (92 - len(a & b)) for b in (set(theirs[j : j + 46]) for j in range(len(theirs) - 45)) if not a.isdisjoint(b)):
                covered |= set(range(i, i + 50))
    return covered


@pytest.fixture(scope="module")
def variants(words):
    """Variants of one passage that are below 0.8 of each other, and near copies of each variant, which only that one explains."""
    rng = np.random.default_rng(6)
    base = words(60, 900).split()
    first = []
    for k in range(24):
        w = list(base)
        for at in (15 + k % 5, 35 + k // 5):
            w[at] = f"v{k}"
        first.append(w)
    again = []
    for k in rng.permutation(24):
        w = list(first[k])
        w[25 + int(rng.integers(0, 5))] = f"c{k}"
        again.append(w)
    return [words(30, 910 + k).split() + w + words(30, 950 + k).split() for k, w in enumerate(first + again)]


def test_near_copies_of_variants_against_brute_force(docs, variants):
    got = {r.doc_id: r.spans for r in windows.repeated_passages(docs([" ".join(w) for w in variants])).collect()}
    missed, total = 0, 0
    for k, w in enumerate(variants):
        want = near_places(w, variants[:k])
        assert not want or k >= 24
        missed += len(want - {p for s in got[k] for p in range(s.start, s.stop)} - {min(want) + e for e in range(5)} - {max(want) - e for e in range(5)}) if want else 0
        total += len(want)
    assert total >= 24 * 50 and missed <= 0.01 * total, (missed, total)


def test_evidence_split_between_holders_counts_together(docs, words):
    """Every holder has the whole passage, in windows of its own: with tiny buffers each copied window names another one."""
    passage = words(60, 970).split()
    whole = [" ".join(words(5, 971 + k).split() + passage[k % 6 :] + words(40, 990 + k).split()) for k in range(12)]
    table = docs(whole)
    want = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in windows.repeated_passages(table).collect()}
    assert all(want[k] for k in range(1, 12))
    named = windows._meetings(windows._keys(windows.common.texts(table), 46, 10, 16, buffer=1), 16)
    heads = {}
    for r in windows._headed(named).collect():
        heads.setdefault((r.doc_id, r.key), set()).add(r.other)
    first = {}
    for (_, key), others in heads.items():
        first[key] = min(first.get(key, 10**9), *others)
    assert all(first[key] in others for (_, key), others in heads.items())


def test_open_pairs_in_parts_give_the_same_spans(docs, variants):
    table = docs([" ".join(w) for w in variants])
    whole, parts = ([(r.doc_id, r.n_spans, r.spans) for r in windows.repeated_passages(table, slice_keys=k).orderBy("doc_id").collect()] for k in (10**9, 2500))
    assert [(d, n, [(s.start, s.stop) for s in x]) for d, n, x in whole] == [(d, n, [(s.start, s.stop) for s in x]) for d, n, x in parts]
    assert sum(n for _, n, _ in whole) >= 24


def test_pairs_are_named_in_parts(spark):
    """40 open documents that all meet each other and 30 earlier ones, and pairs of two: no part's rows grow with the square."""
    met = [(d, k, 0) for d in range(1, 70) for k in range(8)] + [(1000 + 2 * i + 1, 100 + 8 * i + k, 1000 + 2 * i) for i in range(30) for k in range(8)]
    left = [(d, k) for d, k, _ in met if d >= 30]
    kept = lambda rows, kind: windows._kept(spark.createDataFrame(rows, kind), "rows")
    parts, folders = [], []
    for p in windows._all_meetings(kept(left, "doc_id bigint, key bigint"), kept(met, "doc_id bigint, key bigint, other bigint"), 5, 16, 2000):
        parts.append([(r.doc_id, r.other, tuple(sorted(r["keys"]))) for r in p.collect()])
        folders.append(p._written_path)
        windows.common.drop(spark, p._written_path)
    every = [x for p in parts for x in p]
    assert sorted(every) == sorted([(d, o, tuple(range(8))) for d in range(30, 70) for o in range(d)] + [(1001 + 2 * i, 1000 + 2 * i, tuple(range(100 + 8 * i, 108 + 8 * i))) for i in range(30)])
    assert len(parts) >= 5 and max(map(len, parts)) * 8 < 3 * 2000


def test_parts_hold_every_pair_once_and_no_part_grows_with_the_square(spark):
    """A group of 60 documents that all meet, and small groups."""
    pairs = [(d, o, list(range(10))) for d in range(60) for o in range(d)] + [(1000 + 3 * k + d, 1000 + 3 * k, [1, 2]) for k in range(50) for d in (1, 2)]
    parts = [[(r.doc_id, r.other, r["keys"]) for r in p.collect()] for p in windows._slices(windows._kept(spark.createDataFrame(pairs, "doc_id bigint, other bigint, keys array<bigint>"), "pairs"), 2000)]
    assert sorted(x for p in parts for x in p) == sorted(pairs)
    assert len(parts) == 9 and max(sum(len(keys) for _, _, keys in p) for p in parts) < 3 * 2000


def test_shuffled_files_go_with_the_table_that_needed_them(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, written = spark.conf.get(setting), [], windows.common.written
    windows.common.written = lambda df, *more: seen.append(spark.conf.get(setting)) or written(df, *more)
    try:
        assert windows._kept(spark.range(100).repartition(4, "id"), "numbers").count() == 100
    finally:
        windows.common.written = written
    assert seen == ["true"] and spark.conf.get(setting) == before


def test_a_copy_is_found_beside_repeats_of_its_ends(docs, words):
    """The source repeats the passage's first words before it and its last words after it."""
    passage = words(50, 71).split()
    source = " ".join([*passage[:12], *words(30, 72).split(), *passage, *words(30, 73).split(), *passage[-12:]])
    got = {r.doc_id: r for r in windows.repeated_passages(docs([source, f"{words(40, 74)} {' '.join(passage)} {words(40, 75)}"])).collect()}
    assert got[1].n_spans == 1


def test_every_supported_alignment_is_tried():
    """Against all pairs of windows, with shingles that occur many times in the other document."""
    rng = np.random.default_rng(12)
    least = 10
    for trial in range(60):
        other = rng.integers(0, 12 if trial % 2 else 40, 80).astype(np.uint64)
        passage = np.r_[rng.integers(100, 200, 5), other[20:40], rng.integers(0, 40, 10)].astype(np.uint64)
        passage[rng.integers(5, 25)] = 999
        order = np.argsort(other, kind="stable")
        spans = windows.similar_spans(passage, (other[order], order.astype(np.int64)), least, 0.8)
        covered = np.zeros(len(passage), bool)
        for _, _, x, y in spans:
            covered[x:y] = True
        for s in range(len(passage) - least + 1):
            own = passage[s : s + least]
            exact = any(np.array_equal(own, other[b : b + least]) for b in range(len(other) - least + 1))
            assert covered[s : s + least].all() or not exact, (trial, s)
