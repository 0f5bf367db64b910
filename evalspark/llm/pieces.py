"""Encoding texts into the ids of a SentencePiece vocabulary, and decoding them, by a streaming Viterbi search.

The search keeps one back pointer for each boundary between characters, but only for the boundaries a piece can
still reach back to: a window of the longest piece. As soon as the paths of all boundaries in the window run through
one earlier boundary, everything before it is certain; its ids are given out and forgotten.

For a unigram vocabulary the best path is the one with the largest sum of scores. For a BPE vocabulary (scores are
merge ranks, a sum means nothing) a step is allowed where merging would keep the two pieces side by side; then
exactly one path survives at each boundary, and it is the one that merging by rank gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Where the public vocabulary lies; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"  # fixed value: the format's mark for a space
_letter = re.compile(r"[^\W_]").match


class _Remembered(dict):
    """Ids (as 32-bit numbers) of stretches between boundaries that no piece spans; long stretches are not kept."""

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000, length: int = 64) -> None:
        self.vocabulary, self.most, self.length = vocabulary, most, length

    def __missing__(self, stretch: str) -> bytes:
        search = StreamingViterbi(self.vocabulary)
        found = array("i", search.push(stretch.replace(" ", _SPACE)) + search.finish()).tobytes()
        if len(stretch) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[stretch] = found
        return found

    def learn(self, stretches: Iterable[str]) -> None:
        """Encode the ones not known yet, in order, so that each goes on where it departs from the one before."""
        short = {s for s in stretches if len(s) <= self.length}
        new = short - self.keys()
        if len(self) + len(new) > self.most:
            self.clear()
            new = short
        search = SharedBeginnings(self.vocabulary)
        for s in sorted(new):
            self[s] = search.ids(s.replace(" ", _SPACE)).tobytes()


class Vocabulary:
    """Pieces with ids and scores; ``bpe``: scores are merge ranks. Characters without a piece become byte pieces, or
    ``unknown`` where the vocabulary has none."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool, unknown: int = 0) -> None:
        self.pieces, self.scores, self.bpe, self.unknown = pieces, scores, bpe, unknown
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min(self.score.values(), default=0.0) - 10.0
        inner = {a + b for p in self.ids for a, b in pairwise(p)}
        known = set("".join(self.ids))
        # Boundaries that no piece spans: before the first space of a run, between letters or digits and other
        # characters (or only where letters end), and around white space without a piece; each only if the vocabulary is so.
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in known)
        stretch = [f"[{alone}]"] if alone else []
        if any(x[1] == _SPACE != x[0] for x in inner):
            stretch.append(f"[^{alone}]+" if alone else r"[\s\S]+")
        else:
            pairs = [x for x in inner if _SPACE not in x]
            odd = {c for x in pairs if bool(_letter(x[0])) != bool(_letter(x[1])) for c in x if _letter(c)}
            letters = {c for x in pairs for c in x if _letter(c)} - odd
            if len(odd) > 16 or any((x[0] in letters) != (x[1] in letters) for x in pairs):
                stretch += [f" *[^ {alone}]+", " +"]
            else:  # a few characters count with the other side
                apart = "".join(map(re.escape, sorted(odd)))
                other = rf"(?:[^\w {alone}]|[_{apart}])+"
                stretch += [rf" *[^\W_{apart}]+", rf" *{other}", " +"]
        self.split = re.compile("|".join(stretch)).findall
        self.apart: dict[int, bool] = {}
        #: Pieces that a path may use (of a BPE vocabulary those that merging arrives at), and as -1 their beginnings.
        self.usable: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)}
        self.usable |= {p: i for p, i in self.ids.items() if not bpe or self.merged(p) == [p]}
        self.known = _Remembered(self)
        plain = {i: p.replace(_SPACE, " ").encode() for p, i in self.ids.items()}
        self.spelled = [plain.get(i, bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if i == unknown else b"") for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
        scores = [model.get_score(i) for i in ids]
        own = [s for s, k in zip(scores, kinds, strict=True) if k == "normal"]
        return cls([model.id_to_piece(i) for i in ids], scores, kinds, all(float(s).is_integer() for s in own), model.unk_id())

    def keeps_apart(self, first: int, second: int) -> bool:
        """Whether merging by rank leaves two pieces side by side."""
        key = first << 32 | second
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            a, b = self.pieces[first], self.pieces[second]
            found = self.apart[key] = self.merged(a + b) == [a, b]
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"split": None, "known": None, "_pattern": self.split.__self__}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.split, self.known = self._pattern.findall, _Remembered(self)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best pair first; of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i, (x, y) in enumerate(pairwise(parts)):
                s = self.score.get(x + y)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spell_out(self, char: str) -> tuple[int, ...]:
        raw = char.encode()
        return tuple(self.bytes[b] for b in raw) if all(b in self.bytes for b in raw) else (self.unknown,)


class StreamingViterbi:
    """Takes characters (spaces already marked), gives out ids as soon as they are certain. What it holds is bounded
    by the window and by how long two readings can stay open."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text = ""  # not yet committed
        self.score: list[float | None] = [0.0]  # of each boundary of ``text``; None: no path
        self.back: list[int] = [0]
        self.last: list[int] = [-1]  # the piece that ends there; -1: none, or a character without a piece
        self.done = 0  # boundaries whose steps forward are known

    def push(self, chars: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.v.longest
        for a in range(0, len(chars), step):
            self._take(chars[a : a + step])
            self._advance(len(self.text) - self.v.longest)
            if self.done >= step:
                out += self._commit(self._meeting())
        return out

    def finish(self) -> list[int]:
        self._advance(len(self.text))
        return self._commit(len(self.text))

    def _take(self, chars: str) -> None:
        n = len(chars)
        self.text += chars
        self.score += [None] * n
        self.back += [0] * n
        self.last += [-1] * n

    def _advance(self, stop: int) -> None:
        """Steps forward from all boundaries before ``stop``; what they can reach is there already."""
        v, text, n = self.v, self.text, len(self.text)
        score, back, last, usable, apart, by_rank = self.score, self.back, self.last, v.usable, v.apart, v.bpe
        for j in range(self.done, stop):
            own = score[j]
            if own is None:
                continue
            before, k = last[j], j + 1
            piece = usable.get(text[j:k])
            if piece is None or piece < 0:
                if text[j] not in v.ids and (score[k] is None or (not by_rank and own + v.unknown_score > score[k])):
                    score[k], back[k], last[k] = own + v.unknown_score, j, -1
            while piece is not None:
                if piece >= 0:
                    if by_rank:
                        if score[k] is None and (before < 0 or (apart[x] if (x := before << 32 | piece) in apart else v.keeps_apart(before, piece))):
                            score[k], back[k], last[k] = 0.0, j, piece
                    elif score[k] is None or own + v.scores[piece] > score[k]:
                        score[k], back[k], last[k] = own + v.scores[piece], j, piece
                k += 1
                if k > n:
                    break
                piece = usable.get(text[j:k])
        self.done = max(self.done, stop)

    def _meeting(self) -> int:
        """The last boundary that the paths of all boundaries within reach run through."""
        at = {j for j in range(self.done, min(self.done + self.v.longest, len(self.text) + 1)) if self.score[j] is not None}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(self.back[far])
        return at.pop()

    def _commit(self, stop: int) -> list[int]:
        out: list[int] = []
        at = stop
        while at:
            own = self.last[at]
            out += (own,) if own >= 0 else self.v.spell_out(self.text[at - 1])[::-1]
            at = self.back[at]
        out.reverse()
        if stop:
            base = self.score[stop] or 0.0
            self.text = self.text[stop:]
            self.score = [None if s is None else s - base for s in self.score[stop:]]
            self.back = [max(0, b - stop) for b in self.back[stop:]]
            self.last = self.last[stop:]
            self.done = max(0, self.done - stop)
        return out


class SharedBeginnings:
    """The same search over many short texts, one after the other: what it knows of the boundaries inside the beginning
    that a text shares with the one before is kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.text = ""
        self.score: list[float | None] = [0.0]
        self.back: list[int] = [0]
        self.last: list[int] = [-1]

    def ids(self, text: str) -> array:
        v, before, n = self.v, self.text, len(text)
        same, most = 0, min(n, len(before))
        while same < most and text[same] == before[same]:
            same += 1
        score, back, last, usable, apart, by_rank = self.score, self.back, self.last, v.usable, v.apart, v.bpe
        score[same + 1 :], back[same + 1 :], last[same + 1 :] = [None] * (n - same), [0] * (n - same), [-1] * (n - same)
        self.text = text
        for j in range(max(0, same - v.longest + 1), n):
            own = score[j]
            if own is None:
                continue
            before_piece, k = last[j], j + 1
            if j < same:  # only pieces that end behind the shared beginning are new
                if same == n or text[j:same] not in usable:
                    continue
                k = same + 1
            piece = usable.get(text[j:k])
            if k == j + 1 and (piece is None or piece < 0) and text[j] not in v.ids and (score[k] is None or (not by_rank and own + v.unknown_score > score[k])):
                score[k], back[k], last[k] = own + v.unknown_score, j, -1
            while piece is not None:
                if piece >= 0:
                    if by_rank:
                        if score[k] is None and (before_piece < 0 or (apart[x] if (x := before_piece << 32 | piece) in apart else v.keeps_apart(before_piece, piece))):
                            score[k], back[k], last[k] = 0.0, j, piece
                    elif score[k] is None or own + v.scores[piece] > score[k]:
                        score[k], back[k], last[k] = own + v.scores[piece], j, piece
                k += 1
                if k > n:
                    break
                piece = usable.get(text[j:k])
        out: list[int] = []
        at = n
        while at:
            piece = last[at]
            out += (piece,) if piece >= 0 else v.spell_out(text[at - 1])[::-1]
            at = back[at]
        out.reverse()
        return array("i", out)


def encode_all(vocabulary: Vocabulary, texts: list[str]) -> list[array]:
    """``encode`` of many texts: their new stretches are searched together."""
    split = [vocabulary.split(" " + t) if t else [] for t in texts]
    known = vocabulary.known
    known.learn(chain.from_iterable(split))
    out = []
    for stretches in split:
        out.append(array("i"))
        out[-1].frombytes(b"".join(map(known.__getitem__, stretches)))
    return out


def encode(vocabulary: Vocabulary, text: str) -> array:
    """Ids of a text, with the format's space before it; none for an empty text.

    Between boundaries that no piece spans the search starts afresh, so what it gave for such a stretch (a word)
    is remembered, within a bound.
    """
    out = array("i")
    if text:
        out.frombytes(b"".join(map(vocabulary.known.__getitem__, vocabulary.split(" " + text))))
    return out


def decode(vocabulary: Vocabulary, ids: array | list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    text = b"".join(map(vocabulary.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _sent(spark: SparkSession, model: str, most_bytes: int = 64 << 20):
    """The vocabulary for all tasks; its size is checked, as it goes to every executor."""
    vocabulary = Vocabulary.read(model)
    if sum(map(len, vocabulary.pieces)) > most_bytes:
        raise ValueError(f"the vocabulary is larger than {most_bytes} bytes")
    return spark.sparkContext.broadcast(vocabulary)


def encode_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: (doc_id, ids, n_ids, round_trip).

    ``ids`` encode the whole text and ``round_trip`` says whether decoding them gives it back; it fails only for
    texts that hold the mark for spaces itself. Null and empty texts have no ids. Each row is encoded by itself,
    whatever its id; further columns are not looked at.
    """
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for rows, _, _ in common.text_slices(batches):
            texts = rows.column("text").to_pylist()
            found = encode_all(v, texts)
            same = [decode(v, ids) == t for ids, t in zip(found, texts, strict=True)]
            size = np.array([len(x) for x in found], np.int32)
            flat = np.frombuffer(b"".join(map(memoryview, found)), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, pa.array(size), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    encoded = common.texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>, n_ids int, round_trip boolean")
    return encoded.withColumn("doc_id", common.real_id("doc_id"))


def decode_table(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids); null ids give an empty text, ids out of range are an error."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(v, ids) for ids in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
