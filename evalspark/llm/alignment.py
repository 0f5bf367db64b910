"""Alignment of two tokenizers over the same texts, and how often their tokens are linked in the corpus.

Both tokenizers cut ``" " + text`` into tokens of bytes. Byte offsets where tokens of both end cut the tokens into
groups. A byte range of a document gives a fragment: the tokens that end in the range, as an open prefix (up to the
first common end), closed groups, and an open suffix (after the last one). Two neighbouring fragments compose: the
suffix of the one and the prefix of the other become a group, or, where a fragment has no common end, a longer open
part. This is associative, with the empty fragment as identity, so the fragments of a very long document, made in many
tasks, are composed as a tree over several shuffles.

A fragment holds the ids of both sides and, for each side, the sizes of its parts in order: prefix, groups, suffix. Then
composing is writing one behind the other and adding the last size of the first to the first size of the second.

Most ranges are words: before a space that follows another character both tokenizers always begin a token. What a word's
range gives is kept in the worker, within a bound, and composed again wherever the word recurs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Where the public vocabularies lie; parameters everywhere.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
LONG_BYTES = 64 << 10  # a longer text is cut into parts that are tokenised in several tasks
PART_BYTES, RANGE_BYTES = 32 << 10, 8 << 10  # of a part, and the most of the byte range of one fragment
FAN = 8  # fragments that one step of the tree composes
KNOWN_WORDS, KNOWN_TOKENS = 300_000, 3_000_000  # what a worker keeps of words
CHUNK_CELLS = 500_000  # (document, pair) cells that ask the corpus-wide counts together
WIDE = 4096  # groups with more links are counted by different ids instead of link by link
_MARK = "▁"  # fixed value: the piece format's mark for a space
#: Fixed value: the pattern by which byte-level vocabularies cut texts before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose kind (letter, number, space) is the same in every version of Unicode: ASCII and Latin letters.
_latin = re.compile(r"[\x00-\x7f\xc0-\u024f]*").fullmatch
#: Ranges that begin with a space that follows another character than white space, and go on up to the next such space.
#: White space at the end belongs to the last one.
_words = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*(?:\s+\Z)?|\s+").findall


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others
    from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Spelled:
    """The bytes of every token of a vocabulary, one behind the other."""

    start: np.ndarray
    size: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelled:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.cumsum(size) - size, size, np.frombuffer(b"".join(tokens), np.uint8))

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[common.ranges(self.start[ids], self.size[ids])]


class Tokenizers:
    """A byte-level BPE (A) and a SentencePiece model (B) from the contents of their files."""

    _loaded: dict[tuple, Tokenizers] = {}

    def __init__(self, byte_level: bytes, pieces: bytes, by_rank: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of, special = _byte_level(), self.a.get_added_tokens_decoder()
        tokens = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            if i not in special:
                tokens[i] = bytes(byte_of[c] for c in token)
        self.spelled_a = Spelled.of(tokens)
        self.ranks = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens) if x}, special_tokens={}) if by_rank else None
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        other = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(len(names))]
        self.spelled_b = Spelled.of([b"" if o else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, (p, o) in enumerate(zip(names, other, strict=True))])
        self.n_a, self.n_b = len(tokens), len(names)
        #: whether no piece goes over the boundary before a space that follows another character
        self.splits_at_spaces = not any(_MARK in p.lstrip(_MARK) for p in names)
        self.known = Words(self)
        self.written = [b"%d," % i for i in range(self.n_a)] + [b"%d|" % i for i in range(self.n_a)] + [b"%d," % i for i in range(self.n_b)] + [b"%d;" % i for i in range(self.n_b)]

    @classmethod
    def load(cls, files: tuple[bytes, bytes, bool]) -> Tokenizers:
        """Once in a worker process."""
        key = (hashlib.sha256(files[0]).digest(), hashlib.sha256(files[1]).digest(), *files[2:])
        if key not in cls._loaded:
            cls._loaded[key] = cls(*files)
        return cls._loaded[key]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's ids of ``" " + text`` and B's of the text, before which B sets the space."""
        spaced = [" " + t for t in texts]
        latin = [self.ranks is not None and _latin(t) is not None for t in spaced]
        rest = iter(self.a.encode_batch([t for t, x in zip(spaced, latin, strict=True) if not x], add_special_tokens=False))
        return [self.ranks.encode_ordinary(t) if x else next(rest).ids for t, x in zip(spaced, latin, strict=True)], self.b.encode(texts, num_threads=1)

    def words(self, text: str) -> list[str]:
        """The ranges of ``" " + text``, each with the space it begins with."""
        return _words(" " + text) if self.splits_at_spaces else [" " + text]


def merges_by_rank(byte_level: bytes) -> bool:
    """Whether merging any neighbours whose bytes are a token, lowest id first, is what the file's list of merges says.

    So if every token's own bytes, merged by rank up to two parts, end in just the pair that the list has for it: two
    neighbours that make a token come about in a text as they do in that token alone.
    """
    model = json.loads(byte_level)["model"]
    rank, pairs = {}, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    for k, (x, y) in enumerate(pairs):
        rank[x + y] = k
    if len(rank) < len(pairs) or any(model["vocab"].get(z) != model["vocab"][pairs[0][0] + pairs[0][1]] + k for z, k in rank.items()):
        return False
    for x, y in pairs:
        parts = list(x + y)
        while len(parts) > 2:
            low, at = min((rank.get(u + v, len(rank)), i) for i, (u, v) in enumerate(pairwise(parts)))
            if low == len(rank):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [x, y]:
            return False
    return True


def _sent(spark: SparkSession, byte_level: str, pieces: str, most_bytes: int = 64 << 20):
    """The vocabulary files for all tasks; their size is checked, as they go to every executor."""
    files = []
    for path in (byte_level, pieces):
        with open(path, "rb") as f:
            files.append(f.read(most_bytes + 1))
        if len(files[-1]) > most_bytes:
            raise ValueError(f"{path} is larger than {most_bytes} bytes")
    return spark.sparkContext.broadcast((*files, merges_by_rank(files[0])))


@dataclass
class Fragments:
    """Fragments of several texts one behind the other: ids and part sizes of both sides, and the parts of each text."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    parts: np.ndarray  # of each fragment: 1 + its common ends

    @staticmethod
    def empty(n: int = 1) -> Fragments:
        none, zero = np.zeros(0, np.int64), np.zeros(n, np.int64)
        return Fragments(none, none, zero, zero, np.ones(n, np.int64))

    def pack(self) -> tuple[bytes, ...]:
        return tuple(x.astype("<i4").tobytes() for x in (self.a, self.b, self.in_a, self.in_b))

    @staticmethod
    def unpack(a: bytes, b: bytes, in_a: bytes, in_b: bytes) -> Fragments:
        """One fragment."""
        x = [np.frombuffer(y, "<i4").astype(np.int64) for y in (a, b, in_a, in_b)]
        return Fragments(*x, np.array([len(x[2])]))


def fragment(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, cut: np.ndarray) -> Fragments:
    """Fragments of neighbouring byte ranges ``cut[i] < end <= cut[i + 1]``: tokens and their (ascending) ends."""
    span = int(cut[-1] - cut[0]) + 1
    has_a, has_b = np.zeros(span, bool), np.zeros(span, bool)
    has_a[end_a - cut[0]], has_b[end_b - cut[0]] = True, True
    both = np.flatnonzero(has_a & has_b) + cut[0]
    # where parts end: at common ends, and at the ends of ranges (there an open suffix, empty or not)
    stop = np.r_[both, cut[1:]]
    order = np.lexsort((np.r_[np.zeros(len(both)), np.ones(len(cut) - 1)], stop))
    stop = stop[order]
    parts = np.bincount(np.searchsorted(cut, both, "left") - 1, minlength=len(cut) - 1) + 1
    return Fragments(a, b, *(np.diff(np.r_[0, np.searchsorted(e, stop, "right")]) for e in (end_a, end_b)), parts)


def compose(f: Fragments, groups: np.ndarray | None = None) -> Fragments:
    """Neighbouring fragments as one, or those of each run of ``groups`` (ascending numbers, one for each fragment)."""
    groups = np.zeros(len(f.parts), np.int64) if groups is None else groups
    if not len(groups):
        return Fragments.empty()
    first = np.cumsum(f.parts) - f.parts
    joins = np.ones(len(f.in_a), bool)
    joins[first[1:][groups[1:] == groups[:-1]]] = False  # an opening part that continues the one before
    start = np.flatnonzero(joins)
    group_start = first[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])]
    parts = np.diff(np.r_[np.searchsorted(start, group_start), len(start)])
    return Fragments(f.a, f.b, np.add.reduceat(f.in_a, start), np.add.reduceat(f.in_b, start), parts)


def tokenised(t: Tokenizers, texts: list[str]) -> tuple[np.ndarray, Fragments]:
    """Which texts' tokens spell ``" " + text`` on both sides, and these texts' fragments, one each: those of byte
    ranges of at most ``RANGE_BYTES``, composed."""
    raw = [b" " + x.encode() for x in texts]
    size = np.array([len(x) for x in raw], np.int64)
    lists = t.encode(texts)
    ids, counts, totals = [], [], []
    for own, spelled in zip(lists, (t.spelled_a, t.spelled_b), strict=True):
        flat = np.fromiter(chain.from_iterable(own), np.int64, sum(map(len, own)))
        count = np.array([len(x) for x in own], np.int64)
        ids.append(flat)
        counts.append(count)
        totals.append(np.bincount(np.repeat(np.arange(len(texts)), count), spelled.size[flat], len(texts)))
    fits = (totals[0] == size) & (totals[1] == size)
    for k, spelled in enumerate((t.spelled_a, t.spelled_b)):
        kept = ids[k][np.repeat(fits, counts[k])]
        wrong = spelled.spell(kept) != np.frombuffer(b"".join(x for x, f in zip(raw, fits.tolist(), strict=True) if f), np.uint8)
        if wrong.any():
            where = np.flatnonzero(fits)
            fits[where[np.unique(np.searchsorted(np.cumsum(size[where]), np.flatnonzero(wrong), "right"))]] = False
    a, b = (ids[k][np.repeat(fits, counts[k])] for k in (0, 1))
    return fits, _by_ranges(t, a, b, np.r_[0, np.cumsum(size[fits])]) if fits.any() else Fragments.empty(0)


def _by_ranges(t: Tokenizers, a: np.ndarray, b: np.ndarray, edge: np.ndarray) -> Fragments:
    """Fragments of the ranges between ``edge``, made by shorter ranges where one is longer than ``RANGE_BYTES``."""
    long = np.flatnonzero(np.diff(edge) > RANGE_BYTES)
    inner = [np.arange(x + RANGE_BYTES, y, RANGE_BYTES) for x, y in zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True)]
    cut = np.unique(np.concatenate([edge, *inner]))
    found = fragment(a, np.cumsum(t.spelled_a.size[a]), b, np.cumsum(t.spelled_b.size[b]), cut)
    return compose(found, np.searchsorted(edge, cut[:-1], "right") - 1) if inner else found


def _behind(f: Fragments, g: Fragments) -> Fragments:
    """The fragments of both, not composed."""
    return Fragments(*(np.r_[getattr(f, c), getattr(g, c)] for c in ("a", "b", "in_a", "in_b", "parts")))


def _cells(t: Tokenizers, f: Fragments) -> tuple[np.ndarray, ...]:
    """Of every text: its tokens of both sides, groups and links, and its groups written out, with a mark after the last;
    and its cells (text, pair, links)."""
    n = len(f.parts)
    last = np.cumsum(f.parts) - 1
    closed = np.ones(len(f.in_a), bool)
    closed[last] = False  # a whole text ends at a common end: its open suffix is empty
    doc = np.repeat(np.arange(n), f.parts)[closed]
    in_a, in_b = f.in_a[closed], f.in_b[closed]
    n_a, n_b, n_links = (np.zeros(n, np.int64) for _ in range(3))
    np.add.at(n_a, doc, in_a)
    np.add.at(n_b, doc, in_b)
    np.add.at(n_links, doc, in_a * in_b)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    # links one by one, but of a very wide group its different ids with their counts
    links = in_a * in_b
    narrow = np.flatnonzero(links <= WIDE)
    group = np.repeat(narrow, links[narrow])
    k = common.ranges(np.zeros(len(narrow), np.int64), links[narrow])
    pair = f.a[first_a[group] + k // in_b[group]] * t.n_b + f.b[first_b[group] + k % in_b[group]]
    owner, weight = doc[group], np.ones(len(pair), np.int64)
    for g in np.flatnonzero(links > WIDE).tolist():
        (x, nx), (y, ny) = (np.unique(i[s : s + c], return_counts=True) for i, s, c in ((f.a, first_a[g], in_a[g]), (f.b, first_b[g], in_b[g])))
        pair = np.r_[pair, (x[:, None] * t.n_b + y).ravel()]
        weight = np.r_[weight, (nx[:, None] * ny).ravel()]
        owner = np.r_[owner, np.full(len(x) * len(y), doc[g])]
    order = np.lexsort((pair, owner))
    pair, owner, weight = pair[order], owner[order], weight[order]
    new = common.runs(owner, pair)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    # the groups written out: every token by its number and what follows it
    at_a, at_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
    token = np.empty(len(f.a) + len(f.b), np.int64)
    ends_a, ends_b = np.zeros(len(f.a), np.int64), np.zeros(len(f.b), np.int64)
    ends_a[first_a + in_a - 1], ends_b[first_b + in_b - 1] = 1, 1
    token[np.arange(len(f.a)) + first_b[at_a]] = f.a + ends_a * t.n_a
    token[np.arange(len(f.b)) + (first_a + in_a)[at_b]] = f.b + (ends_b * t.n_b + 2 * t.n_a)
    cut = np.r_[0, np.cumsum(n_a + n_b)].tolist()
    name = t.written.__getitem__
    spelled = [b"".join(map(name, token[x:y].tolist())) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return n_a, n_b, np.bincount(doc, minlength=n), n_links, spelled, owner[new], pair[new], weight


class Words:
    """What a worker knows of words: their fragments, numbers, groups written out, and cells."""

    def __init__(self, t: Tokenizers) -> None:
        self.t = t
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.number: dict[str, int] = {}
        self.fits = np.zeros(0, bool)
        self.numbers = np.zeros((4, 0), np.int64)  # tokens of both sides, groups, links
        self.spelled: list[bytes] = []
        self.pair, self.weight, self.first, self.size = none, none, none, none
        self.fragments, self.of = Fragments.empty(0), none

    def learn(self, words: set[str]) -> None:
        if len(self.number) > KNOWN_WORDS or len(self.fragments.a) > KNOWN_TOKENS:
            self._forget()
        new = list(words - self.number.keys())
        if not new:
            return
        fits, f = tokenised(self.t, [w[1:] for w in new])
        n_a, n_b, n_groups, n_links, spelled, owner, pair, weight = _cells(self.t, f)
        where = np.flatnonzero(fits)
        numbers, size, first = np.zeros((4, len(new)), np.int64), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        numbers[:, where] = n_a, n_b, n_groups, n_links
        size[where] = np.bincount(owner, minlength=len(where))
        first[where] = np.cumsum(size[where]) - size[where] + len(self.pair)
        of = np.full(len(new), -1)
        of[where] = np.arange(len(where)) + len(self.fragments.parts)
        names = iter(spelled)
        self.spelled += [next(names) if x else b"" for x in fits.tolist()]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.fits, self.numbers = np.r_[self.fits, fits], np.concatenate([self.numbers, numbers], axis=1)
        self.pair, self.weight, self.first, self.size, self.of = (np.r_[x, y] for x, y in ((self.pair, pair), (self.weight, weight), (self.first, first), (self.size, size), (self.of, of)))
        self.fragments = _behind(self.fragments, f)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers of all texts, how many each text has, and which texts have tokens."""
        split = [self.t.words(x) if x else [] for x in texts]
        count = np.array([len(x) for x in split], np.int64)
        self.learn(set(chain.from_iterable(split)))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        return word, count, (count > 0) & (_totals(~self.fits[word], count) == 0)

    def summed(self, texts: list[str]) -> tuple[np.ndarray, tuple]:
        """Which texts have tokens; and what ``_cells`` gives of these texts' composed fragments, from that of words."""
        word, count, fits = self.read(texts)
        word, count = word[np.repeat(fits, count)], count[fits]
        n_a, n_b, n_groups, n_links = (_totals(x[word], count) for x in self.numbers)
        cut = np.r_[0, np.cumsum(count)].tolist()
        name, listed = self.spelled.__getitem__, word.tolist()
        spelled = [b"".join(map(name, listed[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        doc = np.repeat(np.arange(len(count)), count)
        at = common.ranges(self.first[word], self.size[word])
        space = self.t.n_a * self.t.n_b
        key = np.repeat(doc, self.size[word]) * space + self.pair[at]
        weight = self.weight[at]
        if (weight == 1).all():
            key, weight = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = common.runs(key)
            key, weight = key[new], np.add.reduceat(weight[order], new)
        return fits, (n_a, n_b, n_groups, n_links, spelled, key // space, key % space, weight)

    def fragment(self, texts: list[str]) -> tuple[np.ndarray, Fragments]:
        """Which texts have tokens, and these texts' fragments, composed of those of their words."""
        word, count, fits = self.read(texts)
        if not fits.any():
            return fits, Fragments.empty(0)
        own = self.of[word[np.repeat(fits, count)]]
        f = self.fragments
        n_a, n_b = _totals(f.in_a, f.parts), _totals(f.in_b, f.parts)
        a, b, part = (common.ranges((np.cumsum(x) - x)[own], x[own]) for x in (n_a, n_b, f.parts))
        return fits, compose(Fragments(f.a[a], f.b[b], f.in_a[part], f.in_b[part], f.parts[own]), np.repeat(np.arange(int(fits.sum())), count[fits]))


_CHUNK = "chunk string, doc_id array<bigint>, numbers binary, sha array<string>, pairs array<bigint>, held array<bigint>, size array<int>, cells binary"


class _Chunks:
    """Gathers the cells of documents; gives out a chunk: its documents, its different pairs and in how many of its
    documents each is linked, and the cells by pair number."""

    def __init__(self) -> None:
        self.held, self.n = [], 0

    def add(self, ids: list[int], fits: np.ndarray, found: tuple) -> Iterator[pa.RecordBatch]:
        where = np.flatnonzero(fits)
        n_a, n_b, n_groups, n_links, spelled, owner, pair, weight = found
        numbers = np.zeros((4, len(ids)), np.int64)
        numbers[:, where] = n_a, n_b, n_groups, n_links
        names = [""] * len(ids)
        for i, x in zip(where.tolist(), spelled, strict=True):
            names[i] = hashlib.sha256(x[:-1]).hexdigest()
        self.held.append((ids, numbers, names, np.bincount(where[owner], minlength=len(ids)), pair, weight))
        self.n += len(pair)
        if self.n >= CHUNK_CELLS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids, numbers, names, size, pair, weight = zip(*self.held, strict=True)
        self.held, self.n = [], 0
        pairs, at, held = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
        cells = common.planes(at.astype(np.uint64), 4) + common.planes(np.concatenate(weight).astype(np.uint64), 8)
        row = [uuid.uuid4().hex, [i for x in ids for i in x], np.concatenate(numbers, axis=1).tobytes(), [s for x in names for s in x], pairs, held, np.concatenate(size).astype(np.int32), cells]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])


def _parts(long: DataFrame, t: Tokenizers) -> DataFrame:
    """Long texts in parts: (key, doc_id, part, text); parts begin where a space follows a letter and a letter the
    space, where both tokenizers always begin a token, and lack that space, which tokenizing puts before a text."""
    whole = not t.splits_at_spaces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches):
            low = data | 32
            letter = (low >= 97) & (low <= 122)
            space = np.zeros(len(data), bool)
            space[1:-1] = (data[1:-1] == 32) & letter[:-2] & letter[2:]
            for i in range(rows.num_rows):
                a, b = int(bounds[i]), int(bounds[i + 1])
                safe = np.flatnonzero(space[a:b])
                safe = safe[(safe > 0) & (safe < b - a - 1)]
                near = np.searchsorted(safe, np.arange(PART_BYTES, b - a, PART_BYTES))
                cuts = [] if whole else np.unique(safe[near[near < len(safe)]]).tolist()
                texts = [data[a + x : a + y].tobytes().decode() for x, y in zip([0, *(c + 1 for c in cuts)], [*cuts, b - a], strict=True)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column(c)[i].as_py()] * n, pa.int64()) for c in ("key", "doc_id")]
                    + [pa.array(range(n), pa.int32()), pa.array(texts)],
                    ["key", "doc_id", "part", "text"],
                )

    return long.mapInArrow(run, "key bigint, doc_id bigint, part int, text string")


_FRAGMENT = "key bigint, doc_id bigint, part int, fits boolean, a binary, b binary, in_a binary, in_b binary"


def _rows(keys: list, ids: list, parts: list, fits: list, blobs: list) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(fits, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.binary()) for x in zip(*blobs, strict=True)], [c.split()[0] for c in _FRAGMENT.split(", ")])


def _long_fragments(long: DataFrame, sent, t: Tokenizers) -> DataFrame:
    """One row per long text, its fragments composed in rounds: those of ``FAN`` neighbours in one task."""
    n = common.partitions(long.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.load(sent.value)
        for rows, _, _ in common.text_slices(batches):
            keys, ids, parts = (rows.column(c).to_pylist() for c in ("key", "doc_id", "part"))
            fits, f = both.known.fragment(rows.column("text").to_pylist())
            cut_a, cut_b, cut = (np.r_[0, np.cumsum(x)] for x in (_totals(f.in_a, f.parts), _totals(f.in_b, f.parts), f.parts))
            blobs, k = [], 0
            for ok in fits.tolist():
                own = Fragments(f.a[cut_a[k] : cut_a[k + 1]], f.b[cut_b[k] : cut_b[k + 1]], f.in_a[cut[k] : cut[k + 1]], f.in_b[cut[k] : cut[k + 1]], f.parts[k : k + 1]) if ok else Fragments.empty()
                blobs.append(own.pack())
                k += ok
            yield _rows(keys, ids, parts, fits.tolist(), blobs)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for key, doc, part, fits, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != (key, doc, part // FAN):
                    yield _joined(held)
                    held = []
                held.append((key, doc, part // FAN, fits, blobs))
        if held:
            yield _joined(held)

    parts = common.written(_parts(long, t), "parts")
    now = common.written(parts.repartition(n, "key", "part").mapInArrow(make, _FRAGMENT), "fragments")
    while (now.agg(F.max("part")).head()[0] or 0) > 0:
        dealt = now.repartition(n, "key", F.expr(f"part div {FAN}")).sortWithinPartitions("key", "part")
        now = common.written(dealt.mapInArrow(join, _FRAGMENT), "fragments", instead_of=now)
    return now


def _joined(held: list) -> pa.RecordBatch:
    """One step of the tree: neighbours in order as one fragment; a text one part of which does not fit has none."""
    key, doc, part, *_ = held[0]
    fits = all(x[3] for x in held)
    each = [Fragments.unpack(*x[4]) for x in held] if fits else [Fragments.empty()]
    one = compose(Fragments(*(np.concatenate([getattr(x, c) for x in each]) for c in ("a", "b", "in_a", "in_b", "parts"))))
    return _rows([key], [doc], [part], [fits], [one.pack()])


def _totals(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    edge = np.r_[0, np.cumsum(values)]
    stop = np.cumsum(counts)
    return edge[stop] - edge[stop - counts]


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """(one row per document, the linked pairs of the corpus).

    Documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). Every pair of an A and a B token
    in one group is a link; ``count_sum`` adds up, over the links, in how many documents of the corpus their ids are
    linked, and ``n_best`` counts the links whose number is the highest that their A id has with any B id.
    ``groups_sha256`` is the digest of the groups written as ``a1,a2|b1;a3|b2,b3`` in decimal ids.
    Pairs: (a, b, n_docs, is_best).

    Special tokens' strings are plain text. A null or empty text, and one whose tokens don't spell ``" " + text`` on both
    sides, has no tokens: zeros and an empty digest. Every row is a document of its own, whatever its id; a null
    doc_id stays null; further columns are not read.

    Texts over ``LONG_BYTES`` are cut into parts, tokenised in several tasks and composed as a tree; its last step, like
    the given row itself, holds a whole document. The counts of pairs are a table that grows with the corpus: chunks of
    documents ask it once for each of their different pairs.
    """
    spark = docs.sparkSession
    sent = _sent(spark, byte_level, pieces)
    t = Tokenizers.load(sent.value)
    every = common.texts(docs)
    size = F.octet_length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.load(sent.value)
        chunks = _Chunks()
        for rows, _, _ in common.text_slices(batches):
            yield from chunks.add(rows.column("doc_id").to_pylist(), *both.known.summed(rows.column("text").to_pylist()))
        yield from chunks.flush()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunks = Tokenizers.load(sent.value), _Chunks()
        for batch in batches:
            for _, doc, _, fits, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from chunks.add([doc], np.array([fits]), _cells(both, Fragments.unpack(*blobs) if fits else Fragments.empty(0)))
        yield from chunks.flush()

    long = every.where(size > LONG_BYTES).withColumn("key", F.monotonically_increasing_id())
    both = every.where(size <= LONG_BYTES).mapInArrow(short, _CHUNK).unionAll(_long_fragments(long, sent, t).mapInArrow(whole, _CHUNK))
    table = common.written(both, "chunks")
    counts = table.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n_docs"))
    counts = counts.withColumn("a", F.expr(f"pair div {t.n_b}L"))
    counts = common.written(counts.withColumn("is_best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a"))), "counts")
    asked = table.select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("pos", "of_pair")).join(counts.hint("merge"), F.col("of_pair") == F.col("pair"))
    answers = asked.select("of_chunk", "pos", "n_docs", "is_best").groupBy("of_chunk")
    rows = table.select("chunk", "doc_id", "numbers", "sha", "size", "cells").groupBy("chunk")
    found = rows.cogroup(answers).applyInArrow(_summed, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    pairs = counts.select("a", F.expr(f"pair % {t.n_b}L").alias("b"), "n_docs", "is_best")
    return found.withColumn("doc_id", common.real_id("doc_id")), pairs


def _summed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of their pairs."""
    row = chunk.to_pylist()[0]
    n_docs, is_best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    pos = answers.column("pos").to_numpy()
    n_docs[pos] = answers.column("n_docs").to_numpy()
    is_best[pos] = answers.column("is_best").to_numpy().astype(np.int64)
    size = np.array(row["size"], np.int64)
    cells = int(size.sum())
    at = common.unplanes(row["cells"], cells, 4).astype(np.int64)
    weight = common.unplanes(row["cells"], cells, 8, 4 * cells).view(np.int64)
    numbers = np.frombuffer(row["numbers"], np.int64).reshape(4, -1)
    sums = [_totals(weight * x[at], size) if cells else np.zeros(len(size), np.int64) for x in (is_best, n_docs)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([pa.array(row["doc_id"], pa.int64()), *(pa.array(x.astype(np.int64)) for x in (*numbers, *sums)), pa.array(row["sha"], pa.string())], names)
