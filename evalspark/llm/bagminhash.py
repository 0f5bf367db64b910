"""Near-duplicate documents by weighted minhashes of their bags of word shingles.

A shingle that occurs w times covers [0, w) of a weight axis cut into [0, 1), [1, 2), [2, 4), [4, 8), ... Each of these
intervals has its own Poisson process of points in time, with a rate as long as the interval, a place in it and one
of the signature's components; the points depend on the shingle alone. A component of a document's signature is its
earliest point at a covered place, so two documents agree in a component with the probability of their weighted
Jaccard similarity. Only points up to a time by which a document's signature is full are generated.

Documents that agree in a band of components are compared by their whole bags. Compared are first all members of a
band's bucket with its first document, which ties nearly all copies together; and then, in buckets where that left
several classes, whatever is not yet in one class. There members are compared inside the task that holds them, and only
links that tie two classes come out of it, so rows grow with the members and not with their pairs.

Documents of equal bags are one; such a bag has a number of its own, whatever ids its documents have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COMPONENTS, BANDS = 96, 24  # four components a band: a pair at 0.8 is missed with probability 3e-6
FINE = 1024  # components that decide which pairs of large open buckets are worth comparing
SHINGLE = 5
_ONE = np.uint64(1)


def bags(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count): the different runs of ``SHINGLE`` words of each document and how often they occur.

    A document of fewer words has one shingle of all its words; one without words has none.
    """
    words, _, _, row = common.word_hashes(bounds, data)
    shingles, at = common.shingle_hashes(words, row, SHINGLE)
    count = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    first = np.cumsum(count) - count
    whole = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        more = count[short] > k
        whole[more] = common.mix(whole[more] * np.uint64(5) + words[first[short[more]] + k] + _ONE)
    row, shingles = np.r_[row[at], short], np.r_[shingles, whole]
    order = np.lexsort((shingles, row))
    row, shingles = row[order], shingles[order]
    new = common.runs(row, shingles)
    return row[new], shingles[new], np.diff(np.r_[new, len(row)])


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m) weighted minhashes as 32-bit numbers; 0 for documents without shingles."""
    earliest = np.full(n * m, np.inf)
    total = np.bincount(row, weight, n)
    open_row = total > 0
    stop = np.zeros(n)
    stop[open_row] = m * (np.log(m) + 1.5) / total[open_row]
    who, seed, low, size, cover = [], [], [], [], []
    level = 0
    while True:  # the intervals that a shingle's weight reaches into
        begin = 0 if level == 0 else 1 << (level - 1)
        own = np.flatnonzero(weight > begin)
        if not len(own):
            break
        who.append(row[own])
        seed.append(common.mix(shingle[own] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))))
        low.append(np.full(len(own), begin, np.float64))
        size.append(np.full(len(own), max(1, begin), np.float64))
        cover.append(weight[own].astype(np.float64))
        level += 1
    if not who:
        return np.zeros((n, m), np.int32)
    who, seed, low, size, cover = (np.concatenate(x) for x in (who, seed, low, size, cover))
    time = np.zeros(len(who))
    time, step = _next(time, seed, np.zeros(len(who), np.uint64), size)
    while len(who):
        waiting: list[tuple] = []
        while len(who):
            due = time <= stop[who]
            if not due.all():
                waiting.append(tuple(x[~due] for x in (who, seed, low, size, cover, time, step)))
                who, seed, low, size, cover, time, step = (x[due] for x in (who, seed, low, size, cover, time, step))
                if not len(who):
                    break
            draw = common.mix(seed ^ (step * np.uint64(0xD1342543DE82EF95)))
            component = ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            place = low + (draw >> np.uint64(32)).astype(np.float64) / 2.0**32 * size
            inside = np.floor(place) < cover
            np.minimum.at(earliest, who[inside] * m + component[inside], time[inside])
            time, step = _next(time, seed, step, size)
        last = earliest.reshape(n, m).max(axis=1)
        unfinished = open_row & ~(last <= stop)
        stop[unfinished] *= 2
        if waiting:
            who, seed, low, size, cover, time, step = (np.concatenate(x) for x in zip(*waiting, strict=True))
            keep = unfinished[who]
            who, seed, low, size, cover, time, step = (x[keep] for x in (who, seed, low, size, cover, time, step))
    found = common.mix(earliest.view(np.uint64))
    out = (found >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(n, m)
    out[~open_row] = 0
    return out


def _next(time: np.ndarray, seed: np.ndarray, step: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The processes' next points."""
    step = step + _ONE
    draw = common.mix(seed + step * np.uint64(0x9E3779B97F4A7C15))
    return time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate, step


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    common_part = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common_part / (total - common_part)


def bag_names(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    """16 bytes that stand for each bag; null for an empty one."""
    both = common.mix(shingle + weight.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    first, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(first, row, both)
    np.add.at(second, row, common.mix(both + _ONE))
    size = np.bincount(row, minlength=n)
    names = np.stack([first, second], axis=1).tobytes()
    return [names[16 * i : 16 * i + 16] if size[i] else None for i in range(n)]


def _signed(docs: DataFrame, bands: int, m: int) -> DataFrame:
    """(doc_id, bag, bands); ``bag`` names equal bags; it is null for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches, common.SLICE_BYTES // 2):
            n = rows.num_rows
            row, shingle, weight = bags(bounds, data)
            bag = pa.array(bag_names(row, shingle, weight, n), pa.binary())
            sign = signatures(row, shingle, weight, n, m)
            part = sign.view(np.uint32).astype(np.uint64).reshape(n, bands, -1)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)) * np.uint64(0x9E3779B97F4A7C15)
            for k in range(part.shape[2]):
                key = common.mix(key ^ part[:, :, k]) * np.uint64(3)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), bag, lists], ["doc_id", "bag", "bands"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, bag binary, bands array<bigint>")


def _pack(shingle: np.ndarray, weight: np.ndarray) -> bytes:
    """A bag as bytes: its size, the shingles, and the counts that are not 1."""
    more = np.flatnonzero(weight > 1)
    return b"".join([np.int64(len(shingle)).tobytes(), shingle.tobytes(), more.astype(np.int64).tobytes(), weight[more].astype(np.int64).tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    rest = np.frombuffer(blob, np.int64, offset=8 + 8 * n).reshape(2, -1)
    weight = np.ones(n, np.int64)
    weight[rest[0]] = rest[1]
    return np.frombuffer(blob, np.uint64, n, 8), weight


def _fine_signatures(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(of_key, sign, held): one byte of each of ``FINE`` minhashes, and the whole bag, of the bags in ``wanted`` (key, rep, bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches, common.SLICE_BYTES // 4):
            row, shingle, weight = bags(bounds, data)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            sign = signatures(row, shingle, weight, rows.num_rows, FINE).astype(np.uint8)
            names = bag_names(row, shingle, weight, rows.num_rows)
            own = [i for i, (x, y) in enumerate(zip(names, rows.column("bag").to_pylist(), strict=True)) if x == y]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("key").take(pa.array(own, pa.int64())),
                    pa.array([sign[i].tobytes() for i in own], pa.binary()),
                    pa.array([_pack(shingle[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]) for i in own], pa.binary()),
                ],
                ["of_key", "sign", "held"],
            )

    chosen = common.texts(docs).join(wanted.hint("shuffle_merge"), F.col("doc_id") == F.col("rep")).select("key", "bag", "text")
    found = chosen.mapInArrow(run, "of_key bigint, sign binary, held binary")
    return found.groupBy("of_key").agg(F.min(F.struct("sign", "held")).alias("x")).select("of_key", "x.*")  # rows repeated with their id


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, similarity: float, group: int) -> DataFrame:
    """(a, b) of the pairs (a, b) of numbers in ``reps`` (key, rep, bag) whose whole bags are that similar.

    The documents ``b`` get copies of their text, one for each ``group`` partners, and meet a share of the partners each;
    so one document with very many partners is spread over many tasks, and a task holds one bag and a row.
    """
    spark = docs.sparkSession
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    member = pairs.join(salts.hint("merge"), "b").select(F.col("a").alias("who"), F.col("b").alias("to"), F.pmod(F.hash("a"), "salts").alias("salt"), F.lit(1).alias("second"))
    center = salts.select(F.col("b").alias("who"), F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("second"))
    asked = member.unionAll(center).join(reps.select("key", "rep", "bag").hint("merge"), F.col("who") == F.col("key"))
    texts = common.texts(docs).join(asked.hint("merge"), F.col("doc_id") == F.col("rep")).select("to", "salt", "second", "who", "bag", "text")
    dealt = texts.repartition(common.partitions(spark), "to", "salt").sortWithinPartitions("to", "salt", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center_key, center = None, None
        for rows, bounds, data in common.text_slices(batches):
            row, shingle, weight = bags(bounds, data)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            names = bag_names(row, shingle, weight, rows.num_rows)
            out: list[tuple] = []
            for i, (to, salt, second, who, bag) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("to", "salt", "second", "who", "bag")), strict=True)):
                if names[i] != bag:  # another text of the same id
                    continue
                own = shingle[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]
                if not second:
                    center_key, center = (to, salt), own
                elif center_key == (to, salt):
                    if overlap(own, center) >= similarity:
                        out.append((who, to))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, m: int = COMPONENTS, bands: int = BANDS, group: int = 256) -> DataFrame:
    """One row per document: (doc_id, component_id, group_size, kept).

    Two documents are linked if the weighted Jaccard similarity of their bags of five-word shingles (words: runs of
    letters, digits, ``_`` and non-ASCII characters, A-Z as a-z) is at least ``similarity``; ``component_id`` is the
    smallest doc_id that links lead to, and that document is ``kept``. Candidates share one of ``bands`` bands of the ``m`` minhashes;
    every candidate pair of different bags that is not in one class already is verified on whole texts, unless so few
    of ``FINE`` minhashes agree that the wanted similarity has a probability below 4e-6 (4.5 standard errors).

    Documents with equal bags are compared once. A text of one to four words is one shingle; a null or empty text, or
    one without words, links with nothing. A null doc_id is the smallest; every row is a document of its own, also
    where rows share an id (then all rows with the smallest id of a class are ``kept``). Further columns are not read.
    """
    signed = common.written(_signed(docs, bands, m), "signatures")
    named = signed.where("bag is not null")
    reps = named.groupBy("bag").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("copies"))
    reps = common.written(reps.withColumn("key", F.monotonically_increasing_id()), "bags")
    keys = reps.select("key", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    shared = common.written(keys.join(buckets.hint("merge"), "band").select("band", "key", "first"), "buckets")
    star = common.written(shared.where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    links = common.written(_verified(docs, reps, star, similarity, group), "near")
    more = common.written(_open_links(docs, reps, shared, components(links), similarity), "links")
    parts = components(links.unionAll(more))
    known = reps.join(parts.hint("merge"), F.col("key") == F.col("node"), "left").select("bag", "rep", "copies", F.coalesce("component", "key").alias("part"))
    sizes = known.groupBy("part").agg(F.min("rep").alias("component"), F.sum("copies").alias("n"))
    known = known.select(F.col("bag").alias("of_bag"), F.col("part").alias("of_part")).join(sizes, F.col("of_part") == F.col("part")).select("of_bag", "component", "n")
    joined = signed.select("doc_id", "bag").join(known.hint("merge"), F.col("bag") == F.col("of_bag"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        common.real_id("doc_id").alias("doc_id"),
        common.real_id(component).alias("component_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("doc_id") == component).alias("kept"),
    )


def _open_links(docs: DataFrame, reps: DataFrame, shared: DataFrame, parts: DataFrame, similarity: float, chunk: int = 512) -> DataFrame:
    """(a, b): links that tie classes in buckets where the stars left several.

    In such a bucket only the members outside its first document's class meet the others: members are dealt into chunks
    and held with their bags, the outsiders go by each chunk. A pair of different classes whose fine signatures agree
    enough is verified on the whole bags, unless links found in the chunk tie its classes already.
    """
    class_of = parts.select(F.col("node"), "component")
    placed = shared.join(class_of.hint("merge"), F.col("key") == F.col("node"), "left").select("band", "key", "first", F.coalesce("component", "key").alias("part"))
    heads = class_of.select(F.col("node").alias("head"), F.col("component").alias("head_part"))
    placed = placed.join(heads.hint("merge"), F.col("first") == F.col("head"), "left").select("band", "key", "first", "part", F.coalesce("head_part", "first").alias("head_part"))
    placed = common.written(placed, "placed")
    several = placed.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    several = several.where("lo <> hi").select(F.col("band").alias("of_band"), "chunks")
    rows = common.written(placed.join(several.hint("merge"), F.col("band") == F.col("of_band")).drop("of_band"), "open")
    wanted = reps.select("key", "rep", "bag").join(rows.select(F.col("key").alias("open_key")).distinct().hint("merge"), F.col("key") == F.col("open_key")).drop("open_key")
    sign = common.written(_fine_signatures(docs, wanted), "fine")
    rows = rows.join(sign.hint("merge"), F.col("key") == F.col("of_key"))
    member = rows.where("key <> first").select("band", F.pmod(F.hash("key"), "chunks").alias("chunk"), F.lit(0).alias("outside"), "key", "part", "sign", "held")
    outside = rows.where("part <> head_part").select("band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("outside"), "key", "part", "sign", "held")
    dealt = member.unionAll(outside).repartition(common.partitions(docs.sparkSession), "band", "chunk").sortWithinPartitions("band", "chunk", "outside")
    least = int(np.ceil((similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / FINE)) * FINE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, here = None, _Chunk(least, similarity)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, number, second, key, part, blob, held in zip(*(batch.column(c).to_pylist() for c in ("band", "chunk", "outside", "key", "part", "sign", "held")), strict=True):
                if group != (band, number):
                    group, here = (band, number), _Chunk(least, similarity)
                if second:
                    out += here.links(key, part, blob, held)
                else:
                    here.hold(key, part, blob, held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


class _Chunk:
    """Some members of a bucket, and which classes the links found so far tie together."""

    def __init__(self, least: int, similarity: float) -> None:
        self.least, self.similarity = least, similarity
        self.keys: list[int] = []
        self.parts: list[int] = []
        self.blobs: list[bytes] = []
        self.held: list = []
        self.table: np.ndarray | None = None
        self.root: dict[int, int] = {}

    def hold(self, key: int, part: int, sign: bytes, held: bytes) -> None:
        for x, y in ((self.keys, key), (self.parts, part), (self.blobs, sign), (self.held, held)):
            x.append(y)

    def find(self, part: int) -> int:
        root = part
        while (up := self.root.get(root, root)) != root:
            root = up
        while (up := self.root.get(part, part)) != root:
            self.root[part] = root
            part = up
        return root

    def links(self, key: int, part: int, sign: bytes, held: bytes) -> list[tuple[int, int]]:
        """Links of one outsider, each of which ties its class to another one."""
        if not self.keys:
            return []
        if self.table is None:
            self.table = np.frombuffer(b"".join(self.blobs), np.uint8).reshape(-1, FINE)
            self.blobs = []
        agree = np.count_nonzero(self.table == np.frombuffer(sign, np.uint8), axis=1)
        near = np.flatnonzero(agree >= self.least)
        out, own = [], None
        for i in near[np.argsort(-agree[near], kind="stable")].tolist():
            a, b = self.find(part), self.find(self.parts[i])
            if a == b:
                continue
            if own is None:
                own = _unpack(held)
            if isinstance(self.held[i], bytes):
                self.held[i] = _unpack(self.held[i])
            if overlap(own, self.held[i]) >= self.similarity:
                self.root[max(a, b)] = min(a, b)
                out.append((max(key, self.keys[i]), min(key, self.keys[i])))
        return out
