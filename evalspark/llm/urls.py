"""URL filter: block and allow rules first, for all other URLs two character language models.

URLs that the rules allow or block are the accepted and rejected examples. A smoothed variable-order Markov
model of the characters is counted over ALL of each, exactly, as a table that grows with them; a URL's score is the difference of its log-likelihoods
under the two, divided by its length, and the cut between verdicts is calibrated on the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The rules (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDERS = 5
#: Numbers that ``_grams`` folds into; the query's own counts are not folded.
SLOTS = 1 << 18
#: Bytes of URLs that are scored together: their contexts are looked up once. Each row counts as some bytes more.
CHUNK_BYTES, _ROW_BYTES = 1 << 20, 16
_SYMBOL = np.int64(9)  # bits: the beginning is 1, byte b is b + 2
BINS, LIMIT = 4000, 4.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the beginning of the path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in reversed(ordered):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, text, host, path, rule, by_rule); ``text`` is the whole URL."""
    urls = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("_url"))
    host, path = split_url(F.col("_url"))
    parts = urls.select("page_id", F.col("_url").alias("text"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": rule, "by_rule": verdict})


@dataclass
class CharModel:
    """Counts of character sequences, ``grams[k]`` of k + 1 characters, for both classes; slots and contexts are places in them."""

    grams: np.ndarray  # (class, order, place)
    totals: np.ndarray  # characters seen after a context, same shape; contexts of k characters at order k
    kinds: np.ndarray  # different characters seen after a context

    def log_likelihood(self, slots: np.ndarray, contexts: np.ndarray, label: int) -> np.ndarray:
        """Of each character: Witten-Bell interpolation from the shortest context up; bytes are uniform below that."""
        p = np.full(slots.shape[1], 1 / 256)
        for k in range(ORDERS):
            n = self.grams[label, k][slots[k]].astype(np.float64)
            total = self.totals[label, k][contexts[k]].astype(np.float64)
            kinds = self.kinds[label, k][contexts[k]].astype(np.float64)
            p = np.where(total > 0, (n + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1)), p)
        return np.log(p)


def _exact(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, contexts), each (ORDERS, characters): the k characters before each character, and with it, as one number.

    Different sequences have different numbers: a 1 before the symbols tells their length. The beginning of a URL counts
    as a character of its own.
    """
    n = len(data)
    first = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.arange(n)
    symbols = data.astype(np.int64) + 2
    grams, contexts = np.zeros((ORDERS, n), np.int64), np.zeros((ORDERS, n), np.int64)
    before = np.zeros(n, np.int64)
    for k in range(ORDERS):
        if k:
            back = at - k
            before |= np.where(back >= first, symbols[np.maximum(back, 0)], 1) << (_SYMBOL * (k - 1))
        contexts[k] = before | np.int64(1) << (_SYMBOL * k)
        grams[k] = contexts[k] << _SYMBOL | symbols
    return grams, contexts


def _grams(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, contexts) of ``_exact`` folded into SLOTS numbers, for a small model that is held in arrays."""
    return tuple((common.mix(x.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64) for x in _exact(bounds, data))


def _in_chunks(judged: DataFrame) -> DataFrame:
    """The rows with the number of their chunk, written: it stays the same however often they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, task = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            bounds, _ = common.flat(batch.column("text"))
            passed = before + bounds[:-1] + _ROW_BYTES * np.arange(len(bounds) - 1)
            before += int(bounds[-1]) + _ROW_BYTES * (len(bounds) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + passed // CHUNK_BYTES, pa.int64())], [*batch.schema.names, "chunk"])

    kind = judged.schema["page_id"].dataType.simpleString()
    rows = judged.select("page_id", "text", "host", "path", "rule", "by_rule")
    return common.written(rows.mapInArrow(run, f"page_id {kind}, text string, host string, path string, rule string, by_rule string, chunk bigint"), "url-rows")


def _counts(rows: DataFrame) -> DataFrame:
    """(context, next: [gram, n0, n1]) over every URL that a rule judges: a task's counts are summed before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for c in (0, 1)}

        def out() -> Iterator[pa.RecordBatch]:
            for c, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n * (c == 0)), pa.array(n * (c == 1))], ["gram", "n0", "n1"])
                held[c] = np.zeros(0, np.int64), np.zeros(0, np.int64)

        for part, bounds, data in common.text_slices(batches, 1 << 18):
            label = np.repeat(part.column("label").to_numpy(), np.diff(bounds))
            grams, _ = _exact(bounds, data)
            for c in (0, 1):
                gram, n = np.unique(grams[:, label == c], return_counts=True)
                joined, where = np.unique(np.r_[held[c][0], gram], return_inverse=True)
                total = np.zeros(len(joined), np.int64)
                np.add.at(total, where, np.r_[held[c][1], n])
                held[c] = joined, total
            if sum(len(n) for _, n in held.values()) > 1_000_000:
                yield from out()
        yield from out()

    learn = rows.where("by_rule is not null").select(F.when(F.col("by_rule") == "allow", 1).otherwise(0).alias("label"), "text")
    grams = learn.mapInArrow(run, "gram bigint, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # A context has at most 256 characters after it.
    return grams.groupBy(F.shiftright("gram", int(_SYMBOL)).alias("context")).agg(F.collect_list(F.struct("gram", "n0", "n1")).alias("next"))


def _asked(rows: DataFrame) -> DataFrame:
    """(chunk, context): the different contexts of a chunk, so a common one is asked for once a chunk and not once a URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), last, np.int64)), pa.array(held)], ["chunk", "context"])

        for part, bounds, data in common.text_slices(batches, 1 << 18):
            chunk = np.repeat(part.column("chunk").to_numpy(), np.diff(bounds))
            _, contexts = _exact(bounds, data)
            for c in np.unique(chunk).tolist():
                if last is not None and c != last:
                    yield out()
                    held = np.zeros(0, np.int64)
                last, held = c, np.union1d(held, contexts[:, chunk == c])
        if last is not None:
            yield out()

    return rows.select("chunk", "text").mapInArrow(run, "chunk bigint, context bigint")


def _model(answers: pa.Table) -> tuple[CharModel, np.ndarray, np.ndarray]:
    """(model, its grams, its contexts), both sorted; the place after the last one stands for what was not seen."""
    found = answers.column("next").combine_chunks().flatten() if answers.num_rows else None
    gram, n0, n1 = (np.zeros(0, np.int64) if found is None else found.field(f).to_numpy(zero_copy_only=False) for f in ("gram", "n0", "n1"))
    gram, once = np.unique(gram, return_index=True)  # a chunk that two tasks read may have asked twice
    context, of = np.unique(gram >> _SYMBOL, return_inverse=True)
    counts = np.stack([np.r_[n[once], 0] for n in (n0, n1)])
    tables = counts, *(np.stack([np.r_[np.bincount(of, x, len(context)), 0] for x in xs]) for xs in (counts[:, :-1], counts[:, :-1] > 0))
    return CharModel(*(np.broadcast_to(t[:, None], (2, ORDERS, t.shape[1])) for t in tables)), gram, context


def _places(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, wanted)
    return np.where(np.r_[known, -1][at] == wanted, at, len(known))


def _scored(rows: DataFrame) -> DataFrame:
    names = ["page_id", "host", "path", "rule", "by_rule"]

    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        model, known, seen = _model(answers)
        scores = [np.zeros(0)]
        part = part.combine_chunks()
        for _, bounds, data in common.text_slices(iter(part.to_batches()), 1 << 18):
            size = np.diff(bounds)
            grams, contexts = _exact(bounds, data)
            slots, contexts = _places(known, grams), _places(seen, contexts)
            gap = model.log_likelihood(slots, contexts, 1) - model.log_likelihood(slots, contexts, 0)
            scores.append(np.bincount(np.repeat(np.arange(len(size)), size), gap, len(size)) / np.maximum(size, 1))
        return part.select(names).append_column("score", pa.array(np.concatenate(scores)))

    answers = _asked(rows).join(_counts(rows).hint("merge"), "context").select("chunk", "next")
    kind = rows.schema["page_id"].dataType.simpleString()
    both = rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(run, f"page_id {kind}, host string, path string, rule string, by_rule string, score double")


def calibrated_cut(bins: list[tuple[int, int, int]]) -> float:
    """From (bin, accepted, rejected): the score from which accepting errs least, both kinds of error weighing alike: the middle of the gap."""
    if not bins:
        return 0.0
    at, good, bad = (np.array(x, float) for x in zip(*sorted(bins), strict=True))
    if not good.sum() or not bad.sum():
        return 0.0
    wrong = np.r_[0, np.cumsum(good)] / good.sum() + (bad.sum() - np.r_[0, np.cumsum(bad)]) / bad.sum()
    width = 2 * LIMIT / BINS
    low, high = np.r_[-LIMIT, (at + 1) * width - LIMIT], np.r_[at * width - LIMIT, LIMIT]  # no example lies in between
    best = np.argmin(wrong + 1e-9 * (low - high))  # of equal ones the widest gap
    return float((low[best] + high[best]) / 2)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, score).

    The host ends before the first ``/``, ``?`` or ``#`` after ``://``; the path before ``?`` or ``#``. A null URL, or one
    without ``://``, has an empty host and path, and fits no rule. The longest fitting rule decides; where none fits, a
    URL is allowed if its score is at least the calibrated cut. An empty URL scores 0. Without examples of both kinds the
    models say nothing and scores near 0 are allowed. Repeated page ids are judged row by row; further columns
    are not looked at.
    """
    scored = common.written(_scored(_in_chunks(judged_by_rules(pages, rules))), "url-scores")
    step = F.least(F.greatest(F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = scored.where("by_rule is not null").groupBy(step.alias("bin")).agg(F.sum(F.when(F.col("by_rule") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("by_rule") == "block", 1).otherwise(0)).alias("bad")).collect()
    cut = calibrated_cut([(b.bin, b.good, b.bad) for b in bins])
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
