"""Quality of documents by a byte-level convolutional network.

Bytes get a small learned vector each; filters of ``WIDTH`` bytes run over the whole document in overlapping
chunks (every ``STRIDE`` bytes); each filter's answer is pooled over the document by its maximum and by its mean
above zero, and a hidden layer combines the pooled values into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, STRIDE = 12, 4


@dataclass
class ByteNet:
    """Weights of the network; ``embed`` (256, E), ``filters`` (WIDTH*E, K), ``hidden`` (2K+1, H), ``out`` (H+1)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    out: np.ndarray

    @classmethod
    def new(cls, seed: int = 7, e: int = 6, k: int = 32, h: int = 16) -> ByteNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 1, (256, e))
        kinds = np.array([*map(_kind, range(256))])
        embed[np.arange(256), kinds % e] += 2.0  # bytes of a kind begin alike
        f = rng.normal(0, (WIDTH * e) ** -0.5, (WIDTH * e, k))
        hidden = rng.normal(0, (2 * k) ** -0.5, (2 * k + 1, h))
        return cls(*(x.astype(np.float32) for x in (embed, f, np.zeros(k), hidden, rng.normal(0, h**-0.5, h + 1))))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.out]


def _kind(c: int) -> int:
    return 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if c in (32, 10, 9) else 3 if 48 <= c <= 57 else 5 if c >= 128 else 4


def _chunks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks begin in the padded bytes, and how many each document has (one at least).

    A document begins at a multiple of ``STRIDE`` and is followed by ``WIDTH`` zero bytes or more, so its last chunks run over its end and no byte is left out.
    """
    count = np.maximum(1, -(-np.diff(bounds) // STRIDE))
    room = count * STRIDE + WIDTH
    return np.repeat(np.cumsum(room) - room, count) + STRIDE * common.ranges(np.zeros(len(count), np.int64), count), count


def _padded(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    begin = at[np.cumsum(count) - count]
    out = np.zeros(int(at[-1]) + STRIDE + 2 * WIDTH, np.uint8)
    out[common.ranges(begin, size)] = data
    return out


def _answers(net: ByteNet, text: np.ndarray) -> np.ndarray:
    """What each filter says to the chunk at every multiple of ``STRIDE``."""
    e = net.embed.shape[1]
    embedded = net.embed[text]
    n = (len(text) - WIDTH) // STRIDE + 1
    chunks = np.lib.stride_tricks.as_strided(embedded, (n, WIDTH * e), (STRIDE * e * 4, 4))
    return chunks @ net.filters + net.bias


def _pooled(net: ByteNet, data: np.ndarray, bounds: np.ndarray, where: bool = False) -> tuple[np.ndarray, ...]:
    """(maximum, mean of the positive part) of each filter and document; with ``where`` also what the gradient needs."""
    at, count = _chunks(bounds)
    text = _padded(data, bounds, at, count)
    edge = np.cumsum(count) - count
    answers = _answers(net, text)[at // STRIDE]
    top = np.maximum.reduceat(answers, edge, axis=0)
    positive = np.maximum(answers, 0)
    mean = np.add.reduceat(positive, edge, axis=0) / count[:, None]
    return (top, mean, answers, text[at[:, None] + np.arange(WIDTH)], count) if where else (top, mean)


def _squash(x: np.ndarray) -> np.ndarray:
    return np.tanh(x)


def score_slice(net: ByteNet, data: np.ndarray, bounds: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Probability of each document; a long document's chunks are pooled piece by piece."""
    n, k = len(bounds) - 1, len(net.bias)
    top, total = np.full((n, k), -np.inf, np.float32), np.zeros((n, k), np.float64)
    for a, b in common.slices(bounds, step):
        if bounds[b] - bounds[a] <= step:
            top[a:b], total[a:b] = _pooled(net, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            continue
        length, begin = int(bounds[b] - bounds[a]), int(bounds[a])
        for at in range(0, length, step):  # a multiple of STRIDE; chunks reach over the cut
            own, stop = min(step, length - at), min(length, at + step + WIDTH - STRIDE)
            text = np.zeros(stop - at + STRIDE + WIDTH, np.uint8)
            text[: stop - at] = data[begin + at : begin + stop]
            answers = _answers(net, text)[: -(-own // STRIDE)]
            top[a] = np.maximum(top[a], answers.max(axis=0))
            total[a] += np.maximum(answers, 0).sum(axis=0)
        total[a] /= -(-length // STRIDE)
    return _head(net, top, total.astype(np.float32))[0]


def _head(net: ByteNet, top: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, ...]:
    pooled = np.concatenate([_squash(top), np.sqrt(mean + 1e-6), np.ones((len(top), 1), np.float32)], axis=1)
    inner = np.maximum(pooled @ net.hidden, 0)
    logit = inner @ net.out[:-1] + net.out[-1]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40))), pooled, inner


def _gradient(net: ByteNet, data: np.ndarray, bounds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    top, mean, answers, view, count = _pooled(net, data, bounds, where=True)
    p, pooled, inner = _head(net, top, mean)
    d_logit = ((p - label) * weight / len(label)).astype(np.float32)
    d_out = np.r_[inner.T @ d_logit, d_logit.sum()]
    d_inner = np.outer(d_logit, net.out[:-1]) * (inner > 0)
    d_hidden = pooled.T @ d_inner
    d_pooled = d_inner @ net.hidden.T
    k = len(net.bias)
    d_top = d_pooled[:, :k] * (1 - pooled[:, :k] ** 2)
    d_mean = d_pooled[:, k : 2 * k] / (2 * pooled[:, k : 2 * k]) / count[:, None]
    doc = np.repeat(np.arange(len(count)), count)
    d_answers = d_mean[doc] * (answers > 0)
    is_top = answers == top[doc]
    d_answers += np.where(is_top, d_top[doc], 0)
    embedded = net.embed[view].reshape(len(view), -1)
    d_filters = embedded.T @ d_answers
    d_embedded = (d_answers @ net.filters.T).reshape(-1, net.embed.shape[1])
    d_embed = np.stack([np.bincount(view.reshape(-1), d_embedded[:, j], 256) for j in range(net.embed.shape[1])], axis=1)
    return [d_embed, d_filters, d_answers.sum(axis=0), d_hidden, d_out]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int, good_share: float | None = None, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy with both classes weighing alike; then the threshold 0.3 is put where it errs least
    if a share of ``good_share`` of all documents is good (by default as many as in the sample)."""
    net = ByteNet.new(seed)
    if len(texts) == 0 or labels.min() == labels.max():
        net.out[:] = 0
        net.out[-1] = 4.0 if len(texts) == 0 or labels[0] == 1 else -4.0
        return net
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.05, 0.95)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first, second = ([np.zeros_like(x, dtype=np.float64) for x in net.parts()] for _ in range(2))
    steps = 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            bounds = np.r_[0, np.cumsum([len(texts[i]) for i in rows])]
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            grads = _gradient(net, data, bounds, labels[rows], weight[rows])
            steps += 1
            speed = rate * (1 - 0.9 * steps / total)
            for x, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= (speed * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    score = score_slice(net, np.frombuffer(b"".join(texts), np.uint8), bounds)
    logit = np.sort(np.log(score / (1 - score)))
    cuts = np.unique((logit[1:] + logit[:-1]) / 2) if len(logit) > 1 else logit
    own = np.log(score / (1 - score))
    good, bad = np.sort(own[labels == 1]), np.sort(own[labels == 0])
    natural = share if good_share is None else good_share
    right = natural * (len(good) - np.searchsorted(good, cuts)) / len(good) + (1 - natural) * np.searchsorted(bad, cuts) / len(bad)
    best = cuts[right >= right.max() - 1e-12]
    net.out[-1] += np.float32(np.log(0.3 / 0.7) - best[len(best) // 2])
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 16 << 20, epochs: int = 6) -> ByteNet:
    """Fit on a bounded sample: of the labelled rows whose crc32(doc_id as text) mod 5 is not 0, ``max_rows`` / 2 of each label.

    The sample is chosen by a hash of the id among ALL labelled rows, its whole texts are read, and the fit runs in
    one task that holds at most ``max_bytes`` of text (documents after that are left out of the sample).
    """
    learn = labels.select(common.id_column("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_label"))
    learn = learn.where(F.col("_label").isin(0, 1) & ~held_out(F.col("_label_id"))).withColumn("_draw", F.xxhash64("_label_id"))
    counts = dict(learn.groupBy("_label").count().collect())
    good_share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for value in (0, 1):  # at most max_rows / 2 rows of ids each: a top-k, not a collection
        part = learn.where(F.col("_label") == value).orderBy("_draw", "_label_id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionAll(part)
    sample = common.texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("_draw", "_label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for rows, bounds, data in common.text_slices(batches):
            for i, label in enumerate(rows.column("_label").to_pylist()):
                if size + bounds[i + 1] - bounds[i] <= max_bytes:
                    texts.append(data[bounds[i] : bounds[i + 1]].tobytes())
                    labels.append(label)
                    size += bounds[i + 1] - bounds[i]
        net = fit(texts, np.array(labels, np.float64), epochs, good_share)
        yield pa.RecordBatch.from_arrays([pa.array([list(map(str, x.shape)) for x in net.parts()]), pa.array([x.astype("<f4").tobytes() for x in net.parts()], pa.binary())], ["shape", "weights"])

    rows = sample.repartition(1).sortWithinPartitions("_draw").mapInArrow(run, "shape array<string>, weights binary").collect()
    if not rows:  # an empty table has no task
        return fit([], np.zeros(0), epochs)
    return ByteNet(*(np.frombuffer(r.weights, "<f4").reshape(tuple(map(int, r.shape))).copy() for r in rows))


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training: int) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Every byte of every text is scored; null and empty texts count as one chunk of zeros. Rows that repeat an id are
    scored by their own text. A null doc_id is held out of nothing (held_out false). Without labelled rows, or with
    one class only, every document gets the same score. Further columns are not looked at.
    """
    net = train(docs, labels, **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score_slice(net, data, bounds))], ["doc_id", "score"])

    scored = common.texts(docs).mapInArrow(run, "doc_id bigint, score double")
    real = common.real_id("doc_id")
    return scored.select(real.alias("doc_id"), F.coalesce(held_out(real), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
