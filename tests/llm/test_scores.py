from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import mixing, quality, topics, toxicity, urls


# --- quality


def test_score_is_the_network_over_every_byte():
    net = quality.ByteNet.new()
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 4, 5, 50, 4097, 9000, 0, 7)]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]

    def one(t):
        room = max(1, -(-len(t) // quality.STRIDE)) * quality.STRIDE
        x = np.zeros(room + quality.WIDTH, np.uint8)
        x[: len(t)] = np.frombuffer(t, np.uint8)
        a = np.array([net.embed[x[i : i + quality.WIDTH]].reshape(-1) @ net.filters + net.bias for i in range(0, room, quality.STRIDE)])
        return quality._head(net, a.max(axis=0)[None], np.maximum(a, 0).mean(axis=0)[None])[0][0]

    want = [one(t) for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert np.allclose(quality.score_slice(net, data, bounds), want, atol=1e-6)
    assert np.allclose(quality.score_slice(net, data, bounds, 4096), want, atol=1e-6)


def test_gradient():
    net = quality.ByteNet.new(k=4, h=3)
    for x in ("embed", "filters", "bias", "hidden", "out"):
        setattr(net, x, getattr(net, x).astype(np.float64))
    quality_embed = net.embed
    data = np.frombuffer(b"The quick brown fox, the lazy dog", np.uint8)
    bounds, label, weight = np.array([0, 20, len(data)]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        net32 = quality.ByteNet(*(p.astype(np.float32) for p in net.parts()))
        p = quality.score_slice(net32, data, bounds)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    net32 = quality.ByteNet(*(p.astype(np.float32) for p in net.parts()))
    grads = quality._gradient(net32, data, bounds, label, weight)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        step = 1e-2
        part[at] += step
        up = loss()
        part[at] -= 2 * step
        down = loss()
        part[at] += step
        assert abs((up - down) / (2 * step) - grad[at]) < 0.15 * abs(grad[at]) + 1e-3
    assert net.embed is quality_embed


def test_held_out_quality(table):
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted").toPandas()
    assert (got.quality == got.predicted).mean() > 0.93
    assert got[got.quality == 1].predicted.mean() > 0.95


def test_quality_edges(docs, table):
    labels = table("labels")
    assert quality.quality_scores(docs([]), labels, epochs=1).count() == 0
    got = quality.quality_scores(docs([None, "", "x" * 400_000, "a"], [None, 1, 2, 2]), labels, epochs=1).toPandas()
    assert len(got) == 4 and got.score.between(0, 1).all() and not got[got.doc_id.isna()].held_out.any()
    bare = quality.quality_scores(docs(["a", "b"]), labels.limit(0)).toPandas()
    assert (bare.predicted == 1).all()


def test_labels_of_held_out_rows_are_not_learned(table):
    docs, labels = table("documents"), table("labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_scores(docs, x, epochs=1).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score)


# --- toxicity


def test_held_out_toxicity(table):
    """Fitted on the labelled documents of even id, judged on the odd ones."""
    docs, labels = table("documents", "sf0.1"), table("labels", "sf0.1")
    got = toxicity.severity(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").selectExpr("doc_id", "toxic AS label"), "doc_id").toPandas()
    assert (got.label == 1).sum() > 200 and (got.label == 0).sum() > 1500
    assert got[got.label == 1].toxic.mean() >= 0.93
    assert got[got.label == 0].toxic.mean() <= 0.01


def test_ordinal_likelihood_against_its_definition():
    """The sum of log(P(grade >= k) - P(grade >= k + 1)), written out; and the gradient by differences."""
    rng = np.random.default_rng(2)
    n, f, levels, ridge = 30, 6, 3, 0.02
    has = rng.random((n, f)) < 0.4
    doc, at = np.nonzero(has)
    grade, weight = rng.integers(0, levels + 1, n), rng.random(n)
    par = rng.normal(size=f + levels) * 0.7
    value, grad = toxicity.likelihood(par, doc, at, grade, weight, f, levels, ridge)
    t = [par[f], par[f] + np.exp(par[f + 1]), par[f] + np.exp(par[f + 1]) + np.exp(par[f + 2])]
    total = 0.0
    for i in range(n):
        x = sum(par[k] for k in range(f) if has[i, k])
        above = [1.0, *(1 / (1 + np.exp(-(x - c))) for c in t), 0.0]
        total -= weight[i] * np.log(above[grade[i]] - above[grade[i] + 1])
    assert value == pytest.approx(total + ridge / 2 * sum(c * c for c in par[:f]))
    for k in range(len(par)):
        step = np.eye(len(par))[k] * 1e-6
        high, low = (toxicity.likelihood(par + s, doc, at, grade, weight, f, levels, ridge)[0] for s in (step, -step))
        assert grad[k] == pytest.approx((high - low) / 2e-6, rel=1e-5, abs=1e-7)


def test_features_are_words_beginnings_and_levels():
    """Each document's features against a plain count."""
    texts = ["abcdefgh abcdefgh abcdefxx", "Abcde abcde abcde abcde é", "", "abcdef"]
    data = [t.encode() for t in texts]
    doc, slot, count = toxicity._present(np.r_[0, np.cumsum([len(t) for t in data])], np.frombuffer(b"".join(data), np.uint8))
    want = []
    for t in texts:
        words = [w.encode() for w in t.lower().split()]
        have = Counter(words) + Counter((k, w[:k]) for w in words for k in toxicity.BEGINNINGS if len(w) > k)
        want.append(sorted(n for n in have.values() for level in toxicity.LEVELS if n >= level))
    assert [sorted(count[doc == i].tolist()) for i in range(4)] == want
    assert all(len(set(slot[doc == i].tolist())) == len(want[i]) for i in range(4))


def test_toxicity_flags_planted_words(docs, spark):
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["sun", "tree", "road", "milk", "stone", "river"], 30)) for _ in range(200)]
    texts = [t + " grubblefink snarzle" * (1 + k % 3) if k % 4 == 0 else t for k, t in enumerate(plain)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)], "doc_id bigint, toxic int")
    got = toxicity.severity(docs(texts), labels).toPandas().sort_values("doc_id")
    assert (got.toxic.to_numpy() == (np.arange(200) % 4 == 0)).all()
    assert got.severity.between(0, 3).all() and np.allclose([sum(p) for p in got.p_grades], 1)
    assert got[got.toxic].severity.min() > got[~got.toxic].severity.max()


def test_thresholds_are_ordered_and_weights_shared(docs, spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "d"], 20)) + " bad" * (k % 5) for k in range(300)]
    data = [t.encode() for t in texts]
    model = toxicity.fit(np.r_[0, np.cumsum([len(t) for t in data])], np.frombuffer(b"".join(data), np.uint8), (np.arange(300) % 5 > 0).astype(int))
    assert (np.diff(model.thresholds) > 0).all() and model.weights.max() > 0


def test_toxicity_edges(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.severity(docs([None, "", "word"], [1, None, 2]), none).toPandas()
    assert len(got) == 3 and not got.toxic.any()
    assert toxicity.severity(docs([]), none).count() == 0


# --- mixing


def _numpy_raked(tokens, goals, rounds=25):
    table = tokens.copy()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            sums = table.sum(axis=tuple(a for a in range(3) if a != axis), keepdims=True)
            table = np.minimum(table * np.array(goal).reshape([-1 if a == axis else 1 for a in range(3)]) / sums, tokens)
    return table


@pytest.mark.parametrize("budget", [2000.0, 9000.0])
def test_raking_meets_the_goals(spark, budget):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(10, 1000))) for i in range(4) for j in range(3) for k in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    want = {"source": [0.1, 0.2, 0.3, 0.4], "lang": [0.5, 0.25, 0.25], "topic": [0.2, 0.2, 0.6]}
    one = spark.createDataFrame([(budget,)], "budget double")
    wanted = {d: {f"{d[0]}{i}": p for i, p in enumerate(w)} for d, w in want.items()}
    targets = {d: mixing.goals(cells, d, wanted[d], 1.0, one) for d in want}
    got = mixing.rake(cells, targets, tolerance=0, most_rounds=25).toPandas()
    tokens = np.array([r[3] for r in rows], float).reshape(4, 3, 3)
    goals = [[r.goal for r in sorted(targets[d].collect(), key=lambda r: r.value)] for d in want]
    assert all(abs(sum(g) - budget) < 1e-6 for g in goals)
    own = got.sort_values(["source", "lang", "topic"]).weight.to_numpy()
    assert any(np.allclose(own, _numpy_raked(tokens, goals, k).reshape(-1), rtol=1e-6) for k in range(1, 26)) and (own <= tokens.reshape(-1)).all()
    for axis, goal in enumerate(goals if budget == 2000 else []):  # the larger budget contradicts some cells
        assert np.allclose(own.reshape(4, 3, 3).sum(axis=tuple(a for a in range(3) if a != axis)), goal, rtol=1e-2)


@pytest.mark.parametrize("budget", [0.5, 20.0, 100.0, 119.0, 120.0, 500.0])
def test_scarce_values_are_kept_whole_and_the_others_make_up_for_them(spark, budget):
    own, share = {"a": 10.0, "b": 60.0, "c": 50.0}, {"a": 0.6, "b": 0.3, "c": 0.1}
    cells = spark.createDataFrame([(v, int(n)) for v, n in own.items()], "source string, tokens bigint")
    got = {r.value: r.goal for r in mixing.goals(cells, "source", share, 1.0, spark.createDataFrame([(budget,)], "budget double")).collect()}
    low, high = 0.0, 1e9  # the level by halving
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(own[v], level * share[v]) for v in own) < budget else (low, level)
    assert all(got[v] == pytest.approx(min(own[v], high * share[v]), rel=1e-6) for v in own)


def test_mixing_keeps_by_probability(docs):
    rng = np.random.default_rng(4)
    n = 3000
    source = [("a", "b", "c")[int(x)] for x in rng.choice(3, n, p=[0.6, 0.3, 0.1])]
    lang = [("en", "de")[int(x)] for x in rng.choice(2, n, p=[0.8, 0.2])]
    df = docs(["w " * 49 + "w"] * n, source=source, lang=lang)
    wanted = {"source": {"a": 1, "b": 1, "c": 1}, "lang": {"en": 1, "de": 1}}
    got = mixing.mixed(df, wanted, share=0.25).toPandas()
    assert len(got) == n and got.probability.between(0, 1).all()
    assert abs((got.probability * got.tokens).sum() / got.tokens.sum() - 0.25) < 0.0025
    kept = got[got.kept]
    for d, k in (("source", 3), ("lang", 2)):
        assert (abs(kept[d].value_counts(normalize=True) - 1 / k) < 0.06).all()
    again = mixing.mixed(df.repartition(7), wanted, share=0.25).toPandas()
    assert set(again[again.kept].doc_id) == set(kept.doc_id)
    few = mixing.mixed(df, tokens=5000).toPandas()
    assert abs((few.probability * few.tokens).sum() - 5000) < 50


def test_a_stray_document_takes_nothing_from_the_others(docs, table):
    real = table("documents", "sf0.01").select("doc_id", "text", "lang", "source")
    stray = docs(["a stray document of words"], [10**9], lang=["xx"], source=["elsewhere"]).select("doc_id", "text", "lang", "source")
    shares = []
    for df in (real, real.unionAll(stray)):
        got = mixing.mixed(df, mixing.TARGETS, share=mixing.KEPT_SHARE).toPandas()
        shares.append((got.probability * got.tokens).sum() / got.tokens.sum())
    assert abs(shares[0] - mixing.KEPT_SHARE) < 0.007 and abs(shares[1] - shares[0]) < 0.01 * shares[0]


def test_mixing_edges(docs):
    assert mixing.mixed(docs([])).count() == 0
    got = mixing.mixed(docs([None, "", "a b", "c"], [1, 2, None, 4], source=["s", None, None, "s"], lang=[None, "x", "x", None])).toPandas()
    assert got.tokens.tolist().count(0) == 2 and not got[got.tokens == 0].kept.any() and "(null)" in set(got.source)
    assert set(got[got.tokens == 0].topic) == {"none"}
    given = mixing.mixed(docs(["a b", "c"]), topic=F.lit("one")).toPandas()
    assert set(given.topic) == {"one"}


def test_topics_part_texts_of_different_words(docs):
    rng = np.random.default_rng(6)
    words = [[f"{k}x{i}" for i in range(200)] for k in "abc"]
    texts = [" ".join(rng.choice(words[i % 3], 80)) for i in range(240)]
    model = topics.train(docs(texts), topics=3)
    got = topics.with_topics(docs(texts).select("doc_id", "text"), model, "doc_id").toPandas()
    assert got.groupby(got.doc_id % 3).topic.nunique().tolist() == [1, 1, 1] and got.topic.nunique() == 3
    again = topics.train(docs(texts).repartition(5), topics=3)
    assert np.array_equal(again.centers, model.centers)
    assert len(topics.train(docs(["one", "one", None]), topics=3).centers) == 1 and len(topics.train(docs([])).centers) == 0


def test_topics_are_learned_from_all_documents(docs):
    many = ["sun sea sand"] * 4500
    few = [f"iron steel coal n{k}" for k in range(40)]
    df = docs(many + few)
    model = topics.train(df, topics=2)
    held = np.zeros(topics.DIMENSIONS)
    for t in many + few:
        d = t.encode()
        held += topics._counts(np.array([0, len(d)]), np.frombuffer(d, np.uint8))[0] > 0
    assert np.allclose(model.idf, np.log((len(many + few) + 1) / (held + 1)) + 1)  # a sample of 4,000 gave other counts
    got = topics.with_topics(df.select("doc_id", "text"), model, "doc_id").toPandas()
    assert got.groupby(got.doc_id < 4500).topic.nunique().tolist() == [1, 1] and got.topic.nunique() == 2


# --- urls

BY_HAND = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("https://www.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("http://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
    ("http://x.example.org/fr/a/b", "x.example.org", "/fr/a/b", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, None),
    ("http://a.net?x=/", "a.net", "", None, None),
    ("http://x.org/FR/", "x.org", "/FR/", None, None),
    ("ftp://u@h.com:80/p://q", "u@h.com:80", "/p://q", None, None),
    ("no scheme", "", "", None, None),
    ("://b.net/", "b.net", "/", "net/", "block"),
    (None, "", "", None, None),
    ("", "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, r[0], "h", "t") for k, r in enumerate(BY_HAND)], "page_id bigint, url string, host string, text string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(BY_HAND):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert got[12].score == got[13].score == 0
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_models_tell_hosts_apart(spark):
    rng = np.random.default_rng(5)
    name = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for k in range(400):
        kind = k % 4
        rows.append((k, [f"http://good{name()}.example.net/en/{k}", f"http://spam{name()}.x.net/zz/{k}", f"http://good{name()}.edu/en/{k}", f"http://spam{name()}.edu/zz/{k}"][kind]))
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).toPandas()
    free = got[got.rule.isna()]
    assert ((free.verdict == "allow") == (free.page_id % 4 == 2)).mean() > 0.97


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"http://abc.net/abcabc", np.uint8)
    rng = np.random.default_rng(0)
    model = urls.CharModel(*(np.zeros((2, urls.ORDERS, urls.SLOTS), np.float32) for _ in range(3)))
    slots, contexts = urls._grams(np.array([0, len(data)]), data)
    for k in range(urls.ORDERS):
        pairs, n = np.unique(np.stack([slots[k], contexts[k]]), axis=1, return_counts=True)
        np.add.at(model.grams[0, k], pairs[0], n)
        np.add.at(model.totals[0, k], pairs[1], n)
        np.add.at(model.kinds[0, k], pairs[1], 1)
    prefix = bytes(rng.choice(data, 3))
    total = 0.0
    for c in range(256):
        text = np.frombuffer(prefix + bytes([c]), np.uint8)
        total += np.exp(model.log_likelihood(*urls._grams(np.array([0, 4]), text), 0)[3])
    assert total == pytest.approx(1, abs=1e-6)


def test_url_scores_are_those_of_exact_counts(spark):
    """More different 5-grams than any fixed table of 2^18 counters holds apart, against counts in a dict."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789-_"))
    rows = [(k, f"http://{'x.net/' if k % 2 else 'a.example.net/en/'}{''.join(rng.choice(letters, 120))}") for k in range(6000)]
    free = [(10_000 + k, f"http://a.edu/{''.join(rng.choice(letters, 60))}") for k in range(20)] + [(10_100, "http://a.edu/en/"), (10_101, "caf\u00e9")]
    table = spark.createDataFrame(rows + free, "page_id bigint, url string").repartition(5)
    got = {r.page_id: r.score for r in urls.judge_urls(table).where("page_id >= 10000").collect()}
    grams, after = [{}, {}], [{}, {}]
    for k, url in rows:
        s = [256] * 4 + list(url.encode())
        for i in range(4, len(s)):
            for o in range(urls.ORDERS):
                g = (*s[i - o : i], s[i])
                grams[1 - k % 2][g] = grams[1 - k % 2].get(g, 0) + 1
    for c in (0, 1):
        for g, n in grams[c].items():
            total, kinds = after[c].get(g[:-1], (0, 0))
            after[c][g[:-1]] = total + n, kinds + 1
    assert max(len(x) for x in grams) > urls.SLOTS
    for k, url in free:
        s, gap = [256] * 4 + list(url.encode()), 0.0
        for i in range(4, len(s)):
            for c in (0, 1):
                p = 1 / 256
                for o in range(urls.ORDERS):
                    total, kinds = after[c].get(tuple(s[i - o : i]), (0, 0))
                    p = (grams[c].get((*s[i - o : i], s[i]), 0) + kinds * p) / (total + kinds) if total else p
                gap += np.log(p) * (1 if c else -1)
        assert got[k] == pytest.approx(gap / len(url.encode()), abs=1e-9)
