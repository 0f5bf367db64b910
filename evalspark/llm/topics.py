"""Topics learned from the texts themselves: spherical k-means over hashed, weighted word counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOPICS, DIMENSIONS = 8, 1024
_ROWS = 256  # documents whose counts are held at once
_ONE = 1 << 20  # weights and cosines are summed as whole numbers of this unit: sums don't depend on the partitions
_BITS = 6  # directions that part the documents before the first round


def _counts(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(documents, dimensions): logarithms of 1 + the words' counts."""
    words, _, _, row = common.word_hashes(bounds, data)
    n = len(bounds) - 1
    at = row * DIMENSIONS + (words % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.log1p(np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)).astype(np.float32)


def _cosines(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Products of all rows with few centres, without the threads and buffers of a matrix library in every worker."""
    return np.stack([np.einsum("ij,j->i", x, c) for c in centers], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


@dataclass
class Topics:
    """Weights of the dimensions and the topics' directions; a few kilobytes, whatever the corpus."""

    idf: np.ndarray
    centers: np.ndarray

    def assign(self, bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Number of the nearest topic of every text, of equally near ones the first; -1 without words."""
        out = np.full(len(bounds) - 1, -1)
        for a in range(0, len(out), _ROWS):
            b = min(a + _ROWS, len(out))
            x = _counts(bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]]) * self.idf
            out[a:b] = np.where(x.any(axis=1), _cosines(x, self.centers).argmax(axis=1), -1) if len(self.centers) else -1
        return out


@dataclass
class Vectors:
    """Non-zero counts of some documents: dimension, count and document of each, and how many documents."""

    at: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    n: int

    def unit(self, idf: np.ndarray) -> np.ndarray:
        """The weighted counts, each document of length 1, as whole numbers of ``1 / _ONE``."""
        x = np.log1p(self.count) * idf[self.at]
        return np.rint(x / np.sqrt(self.sums(x * x))[self.doc] * _ONE)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, x, self.n)

    def products(self, x: np.ndarray, directions: np.ndarray) -> np.ndarray:
        return np.stack([self.sums(x * d[self.at]) for d in directions], axis=1)


def _written_vectors(docs: DataFrame) -> DataFrame:
    """(at, count): the counts of every document with words, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bounds, data in common.text_slices(batches, common.SLICE_BYTES // 4):
            for a in range(0, len(bounds) - 1, _ROWS):
                edge = bounds[a : a + _ROWS + 1] - bounds[a]
                words, _, _, row = common.word_hashes(edge, data[bounds[a] : bounds[a] + edge[-1]])
                n = np.bincount(row * DIMENSIONS + (words % np.uint64(DIMENSIONS)).astype(np.int64), minlength=(len(edge) - 1) * DIMENSIONS)
                found = np.flatnonzero(n)
                cut = common.runs(found // DIMENSIONS)
                parts = [np.split(x, cut[1:]) if len(x) else [] for x in ((found % DIMENSIONS).astype("<u2"), n[found].astype("<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in part], pa.binary()) for part in parts], ["at", "count"])

    return common.written(common.texts(docs).mapInArrow(run, "at binary, count binary"), "topic-vectors")


def _totals(vectors: DataFrame, size: int, of: Callable[[Vectors], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` (``size`` whole numbers) over all documents; every task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * _ROWS):
                at, count = (np.frombuffer(b"".join(batch.column(c).slice(a, 4 * _ROWS).to_pylist()), t) for c, t in (("at", "<u2"), ("count", "<u4")))
                sizes = np.array([len(x) // 2 for x in batch.column("at").slice(a, 4 * _ROWS).to_pylist()])
                total += of(Vectors(at.astype(np.int64), count, np.repeat(np.arange(len(sizes)), sizes), len(sizes)))
        slot = np.flatnonzero(total)
        for a in range(0, len(slot), 10_000):
            part = slot[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], ["slot", "total"])

    out = np.zeros(size)
    for r in vectors.mapInArrow(run, "slot int, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).collect():  # at most ``size`` rows
        out[r.slot] = r.total
    return out


def _directions(sums: np.ndarray) -> np.ndarray:
    return _unit(sums.astype(np.float64)).astype(np.float32)


def _first_centers(vectors: DataFrame, idf: np.ndarray, topics: int) -> np.ndarray:
    """All documents are parted by the sides of a few directions through their mean on which they lie; the parts' means
    are the choice for the first centres: the largest part, then whichever is large and far from the ones there are."""
    mean = _totals(vectors, DIMENSIONS + 1, lambda v: np.r_[np.bincount(v.at, v.unit(idf), DIMENSIONS), v.n])
    if not mean[-1]:
        return np.zeros((0, DIMENSIONS), np.float32)
    middle = mean[:-1] / mean[-1]
    normals = np.random.default_rng(5).normal(0, 1, (_BITS, DIMENSIONS))
    level = (normals * middle).sum(axis=1)
    parts = 1 << _BITS

    def parted(v: Vectors) -> np.ndarray:
        x = v.unit(idf)
        part = ((v.products(x, normals) > level) << np.arange(_BITS)).sum(axis=1)
        return np.r_[np.bincount(part[v.doc] * DIMENSIONS + v.at, x, parts * DIMENSIONS), np.bincount(part, minlength=parts)]

    found = _totals(vectors, parts * (DIMENSIONS + 1), parted)
    sums, n = found[:-parts].reshape(parts, DIMENSIONS), found[-parts:]
    x = _directions(sums[n > 0])
    n = n[n > 0]
    chosen = [int(n.argmax())]
    while len(chosen) < topics:
        far = 1 - _cosines(x, x[chosen]).max(axis=1)
        best = int((n * far).argmax())
        if far[best] < 1e-5:
            break
        chosen.append(best)
    return x[chosen]


def train(docs: DataFrame, topics: int = TOPICS, rounds: int = 25, least_gain: float = 1e-4) -> Topics:
    """Spherical k-means over every document, whole texts: their counts are written once, each round is one pass over
    them in which the tasks add up their documents by nearest centre. Rounds end when the sum of the cosines rises by
    less than that share. Only sums by topic and dimension come to the driver; they are sums of whole numbers, so the
    topics are the same on any partitioning. Fewer different texts than topics can give fewer topics."""
    vectors = _written_vectors(docs)
    held = _totals(vectors, DIMENSIONS + 1, lambda v: np.r_[np.bincount(v.at, minlength=DIMENSIONS), v.n])
    idf = (np.log((held[-1] + 1) / (held[:-1] + 1)) + 1).astype(np.float32)
    centers = _first_centers(vectors, idf, topics)
    before = 0.0
    for _ in range(rounds if len(centers) else 0):

        def moved(v: Vectors, centers: np.ndarray = centers) -> np.ndarray:
            x = v.unit(idf)
            near = v.products(x, centers)
            own = near.argmax(axis=1)
            return np.r_[np.bincount(own[v.doc] * DIMENSIONS + v.at, x, centers.size), np.rint(near.max(axis=1)).sum()]

        found = _totals(vectors, centers.size + 1, moved)
        sums = found[:-1].reshape(centers.shape)
        centers = np.where(sums.any(axis=1, keepdims=True), _directions(sums), centers)
        if found[-1] <= before * (1 + least_gain):
            break
        before = found[-1]
    common.drop(docs.sparkSession, vectors._written_path)
    return Topics(idf, centers)


def with_topics(texts: DataFrame, model: Topics, *kept: str) -> DataFrame:
    """(``kept`` columns, ``topic``) of a table with ``text`` without nulls; ``none`` for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches, common.SLICE_BYTES // 4):
            names = [f"topic{k}" if k >= 0 else "none" for k in model.assign(bounds, data).tolist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(names, pa.string())], [*kept, "topic"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*kept).schema.fields)
    return texts.mapInArrow(run, f"{fields}, topic string")
