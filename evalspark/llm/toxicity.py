"""Severity of toxicity by cumulative-link ordinal regression on sparse word features.

One weight vector serves all grades: P(grade > k) = sigmoid(w.x - t_k) with ordered thresholds t_0 < t_1 < ...
The expected severity is the sum of these probabilities. The features are the words of the document and the beginnings
of its words (inflected and compound forms share them), hashed; each says whether a word or beginning occurs at least
once, twice, or four times. Of them those count whose share differs between toxic and other labelled documents beyond
chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SLOTS = 1 << 21
BEGINNINGS = (5, 6, 7, 8)  # bytes
LEVELS = (1, 2, 4)  # occurrences
Z = 8.0  # standard errors beyond which a feature counts
RIDGES = (3e-4, 1e-3, 3e-3)  # of which a split of the sample chooses


@dataclass
class OrdinalModel:
    """Sorted ``words`` (hash slots) with their ``weights``, and the ``thresholds`` of the grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) of documents with linear scores ``x``."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -40, 40)))


def _present(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature slot, how often) of the different features of each document; a repeated feature is as many as
    the levels its occurrences reach."""
    start, stop, row = common.word_spans(bounds, data)
    spans = common.SpanHash(common.LOWER[data])
    hashes, rows = [spans(start, stop)], [row]
    for k in BEGINNINGS:
        longer = np.flatnonzero(stop - start > k)
        hashes.append(common.mix(spans(start[longer], start[longer] + k) + np.uint64(k)))
        rows.append(row[longer])
    feature = (np.concatenate(hashes) & np.uint64(_SLOTS - 1)).astype(np.int64)
    both, count = np.unique(np.concatenate(rows).astype(np.int64) * _SLOTS + feature, return_counts=True)
    out, how = [], []
    for k, level in enumerate(LEVELS):
        own = count >= level
        slot = (common.mix(both[own].astype(np.uint64) % np.uint64(_SLOTS) + np.uint64(k << 32)) & np.uint64(_SLOTS - 1)).astype(np.int64) if k else both[own] % _SLOTS
        out.append(both[own] // _SLOTS * _SLOTS + slot)
        how.append(count[own])
    both, at = np.unique(np.concatenate(out), return_index=True)
    return both // _SLOTS, both % _SLOTS, np.concatenate(how)[at]


def linear_scores(model: OrdinalModel, bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    doc, word, _ = _present(bounds, data)
    return _linear(model, doc, word, len(bounds) - 1)


def _linear(model: OrdinalModel, doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    if not len(model.words):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(model.words, word), len(model.words) - 1)
    hit = model.words[at] == word
    return np.bincount(doc[hit], model.weights[at[hit]], n)


def telling_words(doc: np.ndarray, word: np.ndarray, toxic: np.ndarray, z: float = Z) -> tuple[np.ndarray, np.ndarray]:
    """Words whose share of documents differs between the classes by ``z`` standard errors, and the signed difference."""
    return _telling(np.bincount(word, toxic[doc], _SLOTS), np.bincount(word, minlength=_SLOTS), len(toxic), int(toxic.sum()), z)


def _telling(with_toxic: np.ndarray, with_any: np.ndarray, n: int, n_toxic: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """The same from the numbers of toxic and of all documents that have each feature."""
    n_toxic = max(1, n_toxic)
    n_clean = max(1, n - n_toxic)
    pooled = with_any / max(n, 1)
    gap = with_toxic / n_toxic - (with_any - with_toxic) / n_clean
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_toxic + 1 / n_clean))
    score = np.where(with_any >= 3, gap / error, 0)
    chosen = np.flatnonzero(np.abs(score) >= z)
    return chosen, score[chosen]


def grades(toxic: np.ndarray, telling: np.ndarray, levels: int) -> np.ndarray:
    """0 for documents that are not toxic; toxic ones 1 to ``levels`` by how many telling words they have, in equal parts."""
    out = np.zeros(len(toxic), np.int64)
    own = np.sort(telling[toxic == 1])
    if len(own):
        cuts = own[(np.arange(1, levels) * len(own)) // levels]
        out[toxic == 1] = 1 + np.searchsorted(np.unique(cuts), telling[toxic == 1], "right")
    return out


def fit(bounds: np.ndarray, data: np.ndarray, toxic: np.ndarray, levels: int = 3, steps: int = 300, ridges: tuple[float, ...] = RIDGES) -> OrdinalModel:
    """Maximum likelihood by Adam with a ridge on the weights; both classes weigh alike.

    Of several ridges the one is taken that does best on every fifth document when fitted on the others: most toxic ones
    flagged, a falsely flagged share counting three times.
    """
    features = _gathered(bounds, data, toxic)
    if len(ridges) > 1 and len(toxic) >= 50:
        aside = np.arange(len(toxic)) % 5 == 0
        right = [_gain(_fit(*_part(features, ~aside), toxic[~aside], levels, steps, r), _part(features, aside), toxic[aside]) for r in ridges]
        ridges = (ridges[int(np.argmax(right))],)
    return _fit(*features, toxic, levels, steps, ridges[0])


def _gathered(bounds: np.ndarray, data: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_present`` of the sample a slice at a time: counted first, then only features kept that come near to telling."""
    with_toxic, with_any = np.zeros(_SLOTS), np.zeros(_SLOTS, np.int64)
    for a, b in common.slices(bounds):
        doc, word, _ = _present(bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]])
        with_toxic += np.bincount(word, toxic[a + doc], _SLOTS)
        with_any += np.bincount(word, minlength=_SLOTS)
    near = np.zeros(_SLOTS, bool)
    near[_telling(with_toxic, with_any, len(toxic), int(toxic.sum()), 0.75 * Z)[0]] = True
    held = [(np.zeros(0, np.int64),) * 3]
    for a, b in common.slices(bounds):
        doc, word, count = _present(bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]])
        held.append((a + doc[near[word]], word[near[word]], count[near[word]]))
    return tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _part(features: tuple, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of the chosen documents, numbered anew."""
    doc, word, count = features
    own = chosen[doc]
    return (np.cumsum(chosen) - 1)[doc[own]], word[own], count[own]


def _gain(model: OrdinalModel, features: tuple, toxic: np.ndarray) -> float:
    flagged = model.exceed(_linear(model, features[0], features[1], len(toxic)))[:, 0] >= 0.5
    return flagged[toxic == 1].mean() - 3 * flagged[toxic == 0].mean() if 0 < toxic.sum() < len(toxic) else 0.0


def likelihood(par: np.ndarray, doc: np.ndarray, at: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, levels: int, ridge: float) -> tuple[float, np.ndarray]:
    """Minus the weighted log likelihood with its ridge, and its gradient.

    ``par``: the weights, the first threshold, and the logarithms of the gaps to the next ones; ``at``: the feature
    that each entry of ``doc`` has.
    """
    w, gaps, n = par[:n_features], np.exp(par[n_features + 1 :]), len(grade)
    t = par[n_features] + np.r_[0, np.cumsum(gaps)]
    x = np.bincount(doc, w[at], n)
    p = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40)))
    above = np.c_[np.ones(n), p, np.zeros(n)]  # P(grade >= 0), ..., P(grade > levels - 1), 0
    slope = np.c_[np.zeros(n), p * (1 - p), np.zeros(n)]
    rows = np.arange(n)
    mass = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
    d_upper, d_lower = -weight / mass * slope[rows, grade], weight / mass * slope[rows, grade + 1]
    d_t = np.zeros((n, levels + 2))
    d_t[rows, grade] -= d_upper
    d_t[rows, grade + 1] -= d_lower
    d_t = d_t[:, 1:-1].sum(axis=0)
    d_w = np.bincount(at, (d_upper + d_lower)[doc], n_features) + ridge * w
    value = float(-(weight * np.log(mass)).sum() + ridge / 2 * (w @ w))
    return value, np.r_[d_w, d_t.sum(), np.cumsum(d_t[::-1])[::-1][1:] * gaps]


def _fit(doc: np.ndarray, word: np.ndarray, count: np.ndarray, toxic: np.ndarray, levels: int, steps: int, ridge: float) -> OrdinalModel:
    never = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), 4.0 + np.arange(levels))
    if not len(toxic) or toxic.min() == toxic.max():
        return never
    chosen, strength = telling_words(doc, word, toxic)
    if not len(chosen):
        return never
    at = np.minimum(np.searchsorted(chosen, word), len(chosen) - 1)
    hit = chosen[at] == word
    doc, at, count = doc[hit], at[hit], count[hit]
    grade = grades(toxic, np.bincount(doc, count * (strength[at] > 0), len(toxic)), levels)
    share = toxic.mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) / len(toxic)
    par = np.zeros(len(chosen) + levels)
    par[: len(chosen)] = 0.1 * strength / np.abs(strength).max()
    first, second = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        _, grad = likelihood(par, doc, at, grade, weight, len(chosen), levels, ridge)
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        par -= 0.1 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    t = par[len(chosen)] + np.r_[0, np.cumsum(np.exp(par[len(chosen) + 1 :]))]
    x = np.bincount(doc, par[: len(chosen)][at], len(toxic))
    return OrdinalModel(chosen, par[: len(chosen)], t + _shift(x - t[0], toxic))


def _shift(x: np.ndarray, toxic: np.ndarray) -> float:
    """What to add to the thresholds so that P(grade > 0) = 1/2 separates the sample best."""
    values = np.unique(x)
    cuts = np.r_[values[0] - 1, (values[1:] + values[:-1]) / 2, values[-1] + 1]
    yes, no = np.sort(x[toxic == 1]), np.sort(x[toxic == 0])
    right = (len(yes) - np.searchsorted(yes, cuts)) / len(yes) + np.searchsorted(no, cuts) / len(no)
    best = cuts[right >= right.max() - 1e-12]
    return float(best[np.argmin(np.abs(best))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_bytes: int = 48 << 20) -> OrdinalModel:
    """Fit on a bounded sample: ``max_rows`` / 2 labelled rows of each label by a hash of the id, whole texts, in one
    task that holds at most ``max_bytes`` of text."""
    learn = labels.select(common.id_column("doc_id").alias("_label_id"), F.col("toxic").cast("int").alias("_label"))
    learn = learn.where(F.col("_label").isin(0, 1)).withColumn("_draw", F.xxhash64("_label_id"))
    chosen = None
    for value in (0, 1):
        part = learn.where(F.col("_label") == value).orderBy("_draw", "_label_id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionAll(part)
    sample = common.texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("_draw", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes, toxic = [], [], []
        room = max_bytes
        for rows, bounds, text in common.text_slices(batches):
            last = int(np.searchsorted(bounds, room, "right")) - 1
            data.append(text[: bounds[last]].copy())
            sizes.append(np.diff(bounds[: last + 1]))
            toxic.append(rows.column("_label").to_numpy()[:last])
            room -= int(bounds[last])
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        model = fit(np.r_[0, np.cumsum(sizes)], np.concatenate([np.zeros(0, np.uint8), *data]), np.concatenate([np.zeros(0, np.int32), *toxic]))
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()]) for x in (model.words, model.weights, model.thresholds)], ["words", "weights", "thresholds"])

    rows = sample.repartition(1).sortWithinPartitions("_draw").mapInArrow(run, "words array<bigint>, weights array<double>, thresholds array<double>").collect()
    if not rows:  # an empty table has no task
        return fit(np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
    (row,) = rows
    return OrdinalModel(np.array(row.words, np.int64), np.array(row.weights), np.array(row.thresholds))


def severity(docs: DataFrame, labels: DataFrame, **training: int) -> DataFrame:
    """One row per document: (doc_id, p_grades, severity, grade, toxic).

    ``p_grades``: probability of each grade from 0; ``severity``: the expected grade; ``grade``: the likeliest;
    ``toxic``: P(grade > 0) >= 1/2. Whole texts are read; null and empty texts have no words. Labels are never
    inputs of a score. Without labelled rows, or with one class only, nothing is toxic. Rows that repeat an id are
    scored by their own text. Further columns are not looked at.
    """
    model = train(docs, labels, **training)
    schema = "doc_id bigint, p_grades array<double>, severity double, grade int, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches):
            above = model.exceed(linear_scores(model, bounds, data))
            p = np.c_[np.ones(len(above)), above] - np.c_[above, np.zeros(len(above))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), lists, pa.array(above.sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                ["doc_id", "p_grades", "severity", "grade", "toxic"],
            )

    return common.texts(docs).mapInArrow(run, schema).withColumn("doc_id", common.real_id("doc_id"))
