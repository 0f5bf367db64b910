"""Ranked lexical search: the best documents for every query text, by branch and bound over prefix trees of documents.

A document is restricted to the terms that occur in queries and written as its terms in order of falling document
frequency. Documents ordered by these sequences share their beginnings, so they form a tree: a node is the range of
documents below one path. A node knows, for each term, the largest number of occurrences in a document below it, and
the smallest length factor below it. From these follows what no document below the node can exceed for a query. A query
walks down depth first, the most promising branch first, and leaves out every branch that can't reach its best
documents so far. A task carries a query's best documents from tree to tree.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordtable import WordTable, words_of

TOP = 20
LEAF = 32  # documents that are scored together
TREE_DOCUMENTS, TREE_TERMS = 4096, 500_000  # a tree is closed when it has as many
BLOCK_BYTES = 128 << 10  # query texts that one pass over the documents answers; they go to every task

# Fixed values of the score.
_SCALE, _BASE, _SLOPE, _STEP = 1_000_000_000, 75, 25, 12


class Queries:
    """A block of query texts: their different terms, and of every text its terms by number and how often each occurs."""

    def __init__(self, texts: list[str]) -> None:
        counts = [Counter(words_of(t)) for t in texts]
        self.table = WordTable(sorted({t for c in counts for t in c}))
        self.n_terms = len(self.table.words)
        number = {t: i for i, t in enumerate(self.table.words)}
        self.queries = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]


def vectors(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, n, terms, counts) of every document: all its terms counted, those of queries by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = sent.value
        size = max(1, asked.n_terms)
        for rows, bounds, data in common.text_slices(batches):
            start, stop, row = common.word_spans(bounds, data, common.ALPHANUMERIC)
            n = np.bincount(row, minlength=rows.num_rows)
            at, term = asked.table.find(common.LOWER[data], start, stop)
            key, count = np.unique(row[at] * size + term, return_counts=True)
            cut = np.searchsorted(key, np.arange(rows.num_rows + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array((key % size).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(count.astype(np.int32))),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


class Tree:
    """Documents as a prefix tree of their terms, with what bounds the scores below each node.

    ``ids`` and ``factor`` (m) of the documents, their terms ``cut[i]:cut[i + 1]`` as ranks by falling frequency, each
    document's in ascending order, and how often each occurs. Every document has a term.
    """

    def __init__(self, ids: np.ndarray, factor: np.ndarray, cut: np.ndarray, rank: np.ndarray, count: np.ndarray, n_terms: int, leaf: int = LEAF) -> None:
        big = rank.astype(">u4")
        keys = [big[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        size = np.diff(cut)[order]
        entry = common.ranges(cut[:-1][order], size)
        self.ids, self.factor = ids[order], factor[order]
        self.cut = np.r_[0, np.cumsum(size)]
        self.rank, self.count = rank[entry], count[entry].astype(np.int64)
        each = np.repeat(self.factor, size)
        self.gain = _SCALE * self.count // (1000 * self.count + _STEP * each)
        self._build(self._shared(), leaf)
        self._bound(n_terms)

    def _shared(self) -> np.ndarray:
        """Length of the beginning that a document shares with the one before."""
        out = np.zeros(len(self.ids), np.int64)
        cut = self.cut.tolist()
        for i in range(1, len(out)):
            k = min(cut[i] - cut[i - 1], cut[i + 1] - cut[i])
            differ = self.rank[cut[i - 1] : cut[i - 1] + k] != self.rank[cut[i] : cut[i] + k]
            out[i] = int(differ.argmax()) if differ.any() else k
        return out

    def _build(self, shared: np.ndarray, leaf: int) -> None:
        self.first, self.last, self.below = [0], [len(self.ids)], [None]
        open_nodes = [0]
        while open_nodes:
            node = open_nodes.pop()
            a, b = self.first[node], self.last[node]
            if b - a <= leaf:
                continue
            depth = int(shared[a + 1 : b].min())
            if depth == self.cut[b] - self.cut[b - 1]:  # the last document ends here, so all are equal
                continue
            edges = [a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] == depth)).tolist(), b]
            starts = [a]  # small neighbours share a leaf
            for x, y in zip(edges[1:-1], edges[2:], strict=True):
                if y - starts[-1] > leaf:
                    starts.append(x)
            self.below[node] = np.arange(len(self.first), len(self.first) + len(starts))
            for x, y in zip(starts, [*starts[1:], b], strict=True):
                open_nodes.append(len(self.first))
                self.first.append(x)
                self.last.append(y)
                self.below.append(None)

    def _bound(self, n_terms: int) -> None:
        """``most[node, term]``: the gain that no document below the node exceeds."""
        nodes = len(self.first)
        largest = np.zeros((nodes, n_terms), np.int64)
        low, self.least_id = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):  # children have larger numbers
            a, b, below = self.first[node], self.last[node], self.below[node]
            if below is None:
                at = slice(self.cut[a], self.cut[b])
                np.maximum.at(largest[node], self.rank[at], self.count[at])
                low[node], self.least_id[node] = self.factor[a:b].min(), self.ids[a:b].min()
            else:
                largest[node] = largest[below].max(axis=0)
                low[node], self.least_id[node] = low[below].min(), self.least_id[below].min()
        self.most = (_SCALE * largest // (1000 * largest + _STEP * low[:, None])).astype(np.int32)

    def search(self, rank: np.ndarray, weight: np.ndarray, spread: np.ndarray, best: Best) -> None:
        """Add this tree's documents to the best of a query with these terms; ``spread``: zeros for every term, left so."""
        spread[rank] = weight
        bound = int((self.most[0, rank] * weight).sum())
        stack = [(bound, 0)]
        while stack:
            bound, node = stack.pop()
            if not best.reached_by(bound, int(self.least_id[node])):
                continue
            below = self.below[node]
            if below is None:
                self._score(node, spread, best)
                continue
            bounds = (self.most[below[:, None], rank] * weight).sum(axis=1)
            order = np.argsort(bounds, kind="stable")
            stack += [(int(bounds[i]), int(below[i])) for i in order.tolist() if bounds[i] >= best.least]
        spread[rank] = 0

    def _score(self, node: int, spread: np.ndarray, best: Best) -> None:
        a, b = self.first[node], self.last[node]
        at = slice(self.cut[a], self.cut[b])
        best.add(np.add.reduceat(spread[self.rank[at]] * self.gain[at], self.cut[a:b] - self.cut[a]), self.ids[a:b])


class Best:
    """The ``top`` highest scores above 0, equal ones by ascending id."""

    def __init__(self, top: int) -> None:
        self.top, self.least, self.worst_id = top, 1, None
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reached_by(self, bound: int, least_id: int) -> bool:
        return bound > self.least or (bound == self.least and (self.worst_id is None or least_id < self.worst_id))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.least
        if not enough.any():
            return
        scores, ids = np.r_[self.scores, scores[enough]], np.r_[self.ids, ids[enough]]
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least, self.worst_id = int(self.scores[-1]), int(self.ids[-1])


def _searched(table: DataFrame, asked: Queries, n_docs: int, n_terms: int, frequency: dict[int, int], top: int) -> DataFrame:
    """(query, doc_id, score): the best of every task."""
    by_rank = sorted(frequency, key=lambda t: (-frequency[t], t))  # terms in no document are left out
    rank_of = np.full(asked.n_terms, -1, np.int64)
    rank_of[by_rank] = np.arange(len(by_rank))
    weight = np.zeros(asked.n_terms, np.int64)
    for t, df in frequency.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    queries = [(rank_of[t[rank_of[t] >= 0]], (weight[t] * k)[rank_of[t] >= 0]) for t, k in asked.queries]
    sent = table.sparkSession.sparkContext.broadcast((rank_of, queries, len(by_rank)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, asked_for, size = sent.value
        spread = np.zeros(size, np.int64)
        best = [Best(top) for _ in asked_for]
        for ids, n, cut, term, count in _groups(batches):
            row = np.repeat(np.arange(len(ids)), np.diff(cut))
            order = np.lexsort((ranks[term], row))
            factor = _BASE + (_SLOPE * n * n_docs) // n_terms
            tree = Tree(ids, factor, cut, ranks[term][order], count[order], size)
            for (rank, w), own in zip(asked_for, best, strict=True):
                if len(rank):
                    tree.search(rank, w, spread, own)
        for q, own in enumerate(best):
            if len(own.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.ids), q, np.int32)), pa.array(own.ids), pa.array(own.scores)], ["query", "doc_id", "score"])

    return table.where("size(terms) > 0").mapInArrow(run, "query int, doc_id bigint, score bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The documents of one tree at a time: ids, numbers of terms, and the restricted terms (offsets, terms, counts)."""
    held: list[pa.RecordBatch] = []
    n = size = 0

    def joined() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [t.column(c).combine_chunks() for c in ("terms", "counts")]
        sizes = lists[0].value_lengths().to_numpy()
        return (t.column("doc_id").to_numpy(), t.column("n").to_numpy(), np.r_[0, np.cumsum(sizes)].astype(np.int64), *(x.flatten().to_numpy().astype(np.int64) for x in lists))

    for batch in batches:
        sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy())
        a = 0
        while a < batch.num_rows:
            before = int(sizes[a - 1]) if a else 0
            b = max(a + 1, min(a + TREE_DOCUMENTS - n, int(np.searchsorted(sizes, before + TREE_TERMS - size, "right"))))
            held.append(batch.slice(a, b - a))
            n, size, a = n + b - a, size + int(sizes[b - 1]) - before, b
            if n >= TREE_DOCUMENTS or size >= TREE_TERMS or a < batch.num_rows:
                yield joined()
                held, n, size = [], 0, 0
    if held:
        yield joined()


def _blocks(texts: DataFrame, limit: int) -> Iterator[list[str]]:
    """The texts in lists of bounded size: those whose hash leaves one remainder, with as many remainders as it takes."""
    sizes = texts.select("text", F.octet_length("text").alias("size"))
    total, longest = sizes.agg(F.sum("size"), F.max("size")).head()
    if total is None:
        return
    n = max(1, math.ceil(total / limit))
    while n > 1 and (sizes.groupBy(F.pmod(F.xxhash64("text"), F.lit(n))).agg(F.sum("size").alias("s")).agg(F.max("s")).head()[0]) > 2 * limit + longest:
        n *= 2
    for k in range(n):
        yield [r[0] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).select("text").collect()]


def _top(found: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The best of each query, first within shares of its documents: no task gets all that the tasks found for a query."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0, equal scores by doc_id.

    Terms are runs of letters, digits and non-ASCII characters, A-Z as a-z, over whole texts. A term's weight falls
    with the number of documents that hold it; its occurrences in a document count less and less, and less in longer
    documents. Everything behind the logarithm is 64-bit integer, so scores are exact.

    A null or empty text has no terms: such a document is never found, such an item finds nothing. Every row of
    ``docs`` is a document of its own and every row of ``items`` an item of its own, whatever their ids; a null doc_id
    is the smallest. Further columns are not read. Items are answered in blocks of about ``block_bytes`` of different
    texts (or one longer text), each in one pass over the documents: what a task holds of them is bounded.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = []
    for texts in _blocks(asked.select("text").distinct(), block_bytes):
        block = Queries(texts)
        table = common.written(vectors(docs, spark.sparkContext.broadcast(block)), "vectors")
        n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
        frequency = {r[0]: r[1] for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most the block's terms
        found = common.written(_top(_searched(table, block, n_docs, n_terms, frequency, top), top), "found")
        names = spark.createDataFrame(list(enumerate(texts)), "number int, query_text string")
        parts.append(found.join(F.broadcast(names), F.col("query") == F.col("number")).select("query_text", "rank", "doc_id", "score"))
    if not parts:
        empty = "CAST(NULL AS INT) AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS score"
        return asked.limit(0).selectExpr("item_id", *empty.split(", "))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return asked.join(every, F.col("text") == F.col("query_text")).select("item_id", "rank", common.real_id("doc_id").alias("doc_id"), "score")
