"""Licence scans: which passages of a text come from licence templates.

All templates and base phrases form one generalised suffix automaton over words. A text streams through it word by word;
at every word the automaton's state and length say how long the longest passage is that ends there and stands in a
template (the matching statistics). Where such a passage can't be made longer it is an anchor: a place in the text and
its places in templates. Anchors of one template that follow each other in both, with bounded gaps, are chained; a
chain is a span of the text that covers a share of the template.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES
from .wordtable import WordTable, words_of

# Fixed values of the contract: phrase and label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
LEAST_MATCH = 3  # words of an anchor
GAP = 24  # words that may lie between two anchors of a chain, in the text and in the template
LEAST_SHARE, ENOUGH = 0.8, 40  # a chain names its licence if it covers that share of the template, or as many words


class SuffixAutomaton:
    """Of several word sequences; ``ends[state]`` are the (sequence, index after its last word) where its passages end."""

    def __init__(self, sequences: list[list[int]], n_words: int) -> None:
        self.n_words = max(1, n_words)
        follow: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]

        def state(depth: int, after: dict[int, int], link: int) -> int:
            follow.append(after)
            self.depth.append(depth)
            self.link.append(link)
            ends.append(set())
            return len(follow) - 1

        def split(p: int, word: int, q: int) -> int:
            """A state for the passages of ``q`` that go through ``p``."""
            if self.depth[q] == self.depth[p] + 1:
                return q
            copy = state(self.depth[p] + 1, dict(follow[q]), self.link[q])
            while p >= 0 and follow[p].get(word) == q:
                follow[p][word] = copy
                p = self.link[p]
            self.link[q] = copy
            return copy

        for number, words in enumerate(sequences):
            last = 0
            for i, word in enumerate(words):
                known = follow[last].get(word)
                if known is not None:
                    last = split(last, word, known)
                else:
                    p, last = last, state(self.depth[last] + 1, {}, 0)
                    while p >= 0 and word not in follow[p]:
                        follow[p][word] = last
                        p = self.link[p]
                    if p >= 0:
                        self.link[last] = split(p, word, follow[p][word])
                ends[last].add((number, i + 1))
        for s in sorted(range(1, len(follow)), key=lambda s: -self.depth[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(x) for x in ends]
        self.go = {s * self.n_words + word: to for s, after in enumerate(follow) for word, to in after.items()}

    def walk(self, words: list[int], fresh: list[bool]) -> tuple[list[int], list[int]]:
        """State and length after every word; all words occur in a sequence, and at ``fresh`` ones the text begins anew."""
        go, link, depth, n = self.go, self.link, self.depth, self.n_words
        state = length = 0
        states, lengths = [], []
        for word, new in zip(words, fresh, strict=True):
            if new:
                state = length = 0
            to = go.get(state * n + word)
            if to is None:
                while to is None:
                    state = link[state]
                    to = go.get(state * n + word)
                length = depth[state]
            state = to
            length += 1
            states.append(state)
            lengths.append(length)
        return states, lengths

    def suffixes(self, state: int) -> Iterator[int]:
        """The state and the states of its passages' shorter endings."""
        while state > 0:
            yield state
            state = self.link[state]

    def reach(self, words: list[int]) -> int:
        state = 0
        for word in words:
            state = self.go[state * self.n_words + word]
        return state


class Scanner:
    """The automaton of templates (label, text) and phrases (phrase, label), and what a state says about phrases."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> None:
        self.labels = [label for label, _ in templates]
        spelled = [words_of(text) for _, text in templates]
        base = [words_of(text) for text, _ in phrases]
        if not all(base):
            raise ValueError("a phrase without words")
        self.table = WordTable(sorted({w for words in spelled + base for w in words}))
        number = {w: i for i, w in enumerate(self.table.words)}
        self.size = [len(words) for words in spelled]
        sequences = [[number[w] for w in words] for words in spelled + base]
        self.automaton = SuffixAutomaton(sequences, len(number))
        self.phrases = [(label, len(words)) for (_, label), words in zip(phrases, base, strict=True)]
        own = defaultdict(list)
        for p, words in enumerate(sequences[len(templates) :]):
            own[self.automaton.reach(words)].append(p)
        #: phrases that may end where a state is reached, and whether one of them does at any length of the state
        self.ending = {s: found for s in range(len(self.automaton.link)) if (found := [(p, s == u) for u in self.automaton.suffixes(s) for p in own.get(u, ())])}
        self.has_phrase = np.zeros(len(self.automaton.link), bool)
        self.has_phrase[list(self.ending)] = True

    def scan(self, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, dict[int, list], dict[int, list]]:
        """Words of every text; of some texts the phrases (start, phrase) and the anchors (start, words, state)."""
        low = common.LOWER[data]
        start, stop, row = common.word_spans(bounds, data, common.ALPHANUMERIC)
        n_words = np.bincount(row, minlength=len(bounds) - 1)
        first = np.cumsum(n_words) - n_words
        at, word = self.table.find(low, start, stop)
        alone = np.ones(len(at), bool)  # known words that don't follow another one
        if len(at):
            alone[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            single = alone & np.r_[alone[1:], True]  # and aren't followed by one: too short for anything
            at, word, alone = at[~single], word[~single], alone[~single]
        state, length = (np.array(x, np.int64) for x in self.automaton.walk(word.tolist(), alone.tolist()))
        phrases, anchors = defaultdict(list), defaultdict(list)
        for i in np.flatnonzero(self.has_phrase[state]).tolist():
            for p, needs_length in self.ending[int(state[i])]:
                if not needs_length or length[i] >= self.phrases[p][1]:
                    r = int(row[at[i]])
                    phrases[r].append((int(at[i] - first[r]) - self.phrases[p][1] + 1, p))
        longest = length >= LEAST_MATCH
        longest[:-1] &= alone[1:] | (length[1:] <= length[:-1])
        for i in np.flatnonzero(longest).tolist():
            r, n = int(row[at[i]]), int(length[i])
            anchors[r].append((int(at[i] - first[r]) - n + 1, n, int(state[i])))
        return n_words, phrases, anchors

    def spans(self, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Chains of one text that name a licence: (label, first word, last word, covered words, share of the template)."""
        by_template = defaultdict(list)
        for start, n, state in anchors:
            for template, end in self.automaton.ends[state]:
                if template < len(self.labels):
                    by_template[template].append((start + n, end, n))
        out = []
        for template, places in by_template.items():
            size = self.size[template]
            for first, last, covered in chains(sorted(places), GAP):
                if covered >= min(LEAST_SHARE * size, ENOUGH):
                    out.append((self.labels[template], first, last, covered, min(1.0, covered / size)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def chains(places: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, last word, covered words) of the best chains of one template that don't overlap in the text.

    ``places`` are (end in the text, end in the template, words), sorted. What two neighbours of a chain share counts once.
    """
    score = [n for _, _, n in places]
    before = [-1] * len(places)
    begin = 0
    reach = max((n for _, _, n in places), default=0)
    for i, (end, place, n) in enumerate(places):
        while places[begin][0] < end - reach - gap:
            begin += 1
        for j in range(begin, i):
            step, along = end - places[j][0], place - places[j][1]
            if step <= 0 or along <= 0 or step - n > gap or along - n > gap:
                continue
            total = score[j] + min(n, step, along)
            if total > score[i]:
                score[i], before[i] = total, j
    taken: list[tuple[int, int]] = []  # disjoint, in order
    out = []
    for i in sorted(range(len(places)), key=lambda i: (-score[i], i)):
        last, first, j = places[i][0] - 1, 0, i
        while j >= 0:
            first = places[j][0] - places[j][2]
            j = before[j]
        at = bisect(taken, (first, last))
        if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
            taken.insert(at, (first, last))
            out.append((first, last, score[i]))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, spans).

    Words are runs of letters, digits and non-ASCII characters of the whole text, A-Z as a-z, counted from 0. ``n_base``
    counts all places of ``phrases`` (overlapping ones too), ``first_word`` and ``last_word`` are the smallest and the
    largest word where one starts (null without any), ``base_labels`` their labels, distinct, sorted, joined by commas.
    ``spans`` are arrays of (label, first_word, last_word, covered, share): passages that cover enough of a template,
    in the order of the text; a passage counts for the templates that hold its longest matches.

    A null or empty text has no words, no phrases and no spans. Every row is scanned by itself, whatever its id; a null
    doc_id stays null; further columns are not read. A task holds one slice of texts, or one longer text.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)  # as large as the templates given by the caller
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scanner = sent.value
        names = ("label", "first_word", "last_word", "covered", "share")
        for rows, bounds, data in common.text_slices(batches):
            n_words, found, anchors = s.scan(bounds, data)
            n = rows.num_rows
            base = [found.get(i, ()) for i in range(n)]
            spans = [[dict(zip(names, x, strict=True)) for x in s.spans(anchors[i])] if i in anchors else [] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(n_words.astype(np.int64)),
                    pa.array([len(x) for x in base], pa.int64()),
                    pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                    pa.array([",".join(sorted({s.phrases[p][0] for _, p in x})) for x in base], pa.string()),
                    pa.array(spans, pa.list_(span)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"],
            )

    inner = "array<struct<label: string, first_word: bigint, last_word: bigint, covered: bigint, share: double>>"
    out = common.texts(docs).mapInArrow(run, f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, spans {inner}")
    return out.withColumn("doc_id", common.real_id("doc_id"))


def summary(scanned: DataFrame) -> DataFrame:
    """The scan with the labels of phrases and spans together, and a score: the largest share of a template or phrase
    that the text covers, so 1 where a phrase stands and 0 where nothing was found."""
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.transform("spans", lambda x: x["label"]))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
