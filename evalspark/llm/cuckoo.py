"""Exact deduplication with an index of cuckoo filters over buckets of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_INDEX = "digest binary, keep_id bigint, group_size bigint"
_BATCH = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class CuckooIndex:
    """Live digests of one bucket: a cuckoo filter in front of the stored keys.

    A slot of the filter holds a 16-bit fingerprint and the place of the stored key, so that a hit
    is verified against the whole digest. A key sits in one of two buckets of four slots; the second
    follows from the first and the fingerprint alone. When an insertion finds no slot after
    ``MAX_KICKS`` moves, the table is doubled and filled again from the stored keys.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, capacity: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.keep: list[int] = []
        self.size: list[int] = []
        self.free: list[int] = []
        self.resizes = 0
        self._allocate(max(2, 1 << (max(1, int(capacity / self.SLOTS / 0.9)) - 1).bit_length()))

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.place = [0] * (buckets * self.SLOTS)

    def _spot(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[-2:], "little") | 1  # 0 marks an empty slot
        first = int.from_bytes(digest[-10:-2], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The slot of a live digest, or -1."""
        mark, first, second = self._spot(digest)
        for bucket in (first, second):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[slot] == mark and self.keys[self.place[slot]] == digest:
                    return slot
        return -1

    def __contains__(self, digest: bytes) -> bool:
        return self.find(digest) >= 0

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def insert(self, digest: bytes, keep_id: int, size: int = 1) -> bool:
        """Add documents of a digest; true if it was not live before. The largest id stays."""
        slot = self.find(digest)
        if slot >= 0:
            at = self.place[slot]
            self.keep[at] = max(self.keep[at], keep_id)
            self.size[at] += size
            return False
        if self.free:
            at = self.free.pop()
            self.keys[at], self.keep[at], self.size[at] = digest, keep_id, size
        else:
            at = len(self.keys)
            self.keys.append(digest)
            self.keep.append(keep_id)
            self.size.append(size)
        if not self._settle(digest, at):
            self._grow()
        return True

    def delete(self, digest: bytes) -> bool:
        """Take a digest out with all its documents; false if it is not live."""
        slot = self.find(digest)
        if slot < 0:
            return False
        at = self.place[slot]
        self.prints[slot] = 0
        self.keys[at] = None
        self.free.append(at)
        return True

    def _settle(self, digest: bytes, at: int) -> bool:
        mark, first, second = self._spot(digest)
        for bucket in (first, second):
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.place[slot] = mark, at
                    return True
        bucket = first
        for kick in range(self.MAX_KICKS):
            slot = bucket * self.SLOTS + (kick + mark) % self.SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.place[slot], at = at, self.place[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.place[slot] = mark, at
                    return True
        return False

    def _grow(self) -> None:
        while True:
            self.resizes += 1
            self._allocate((self.mask + 1) * 2)
            if all(self._settle(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def rows(self) -> list[tuple[bytes, int, int]]:
        return [(k, self.keep[i], self.size[i]) for i, k in enumerate(self.keys) if k is not None]


def _batches(rows: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 50_000], strict=True), _BATCH.types, strict=True)], schema=_BATCH)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the whole text in UTF-8 with A-Z lower-cased; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, data in common.text_slices(batches):
            lower = data.tobytes().translate(_LOWER)
            cuts = bounds.tolist()
            found = [hashlib.sha256(lower[a:b]).digest() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return common.texts(docs).mapInArrow(run, "doc_id bigint, digest binary")


def _merged(live: DataFrame, limit: int | None = None) -> DataFrame:
    """One index per task over rows of (digest, keep_id, group_size); a negative size deletes the digest.

    With ``limit`` the index is given out and begun anew at that many digests (pre-aggregation).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, keep, size in zip(*(batch.column(n).to_pylist() for n in ("digest", "keep_id", "group_size")), strict=True):
                if size < 0:
                    index.delete(digest)
                else:
                    index.insert(digest, keep, size)
            if limit and len(index) >= limit:
                yield from _batches(index.rows())
                index = CuckooIndex()
        yield from _batches(index.rows())

    return live.mapInArrow(run, _INDEX)


def build_index(keyed: DataFrame, local_digests: int = 500_000) -> DataFrame:
    """The index of live digests of a table (doc_id, digest): (digest, keep_id, group_size).

    Every task first collapses its own copies in an index of at most ``local_digests``; a text that a
    third of all rows share then crosses the network once per task.
    """
    rows = keyed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    return _merged(_merged(rows, local_digests).repartition(common.partitions(keyed.sparkSession), "digest"))


def update_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """A written index with digests taken out and documents put in.

    ``deleted`` has a column ``digest`` (whole groups go); ``inserted`` is (doc_id, digest). Deletions
    come first. Buckets are rebuilt from the stored keys, each in its task.
    """
    order = "step"
    parts = [index.select("digest", "keep_id", "group_size", F.lit(0).alias(order))]
    if deleted is not None:
        parts.append(deleted.select("digest", F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"), F.lit(1)))
    if inserted is not None:
        parts.append(build_index(inserted).select("digest", "keep_id", "group_size", F.lit(2)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    dealt = rows.repartition(common.partitions(index.sparkSession), "digest").sortWithinPartitions(order)
    return _merged(dealt.select("digest", "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; a null text is empty; of equal texts the
    largest doc_id stays. A null doc_id is the smallest; rows that repeat an id and its text count in
    the group and are kept or dropped together. Further columns of ``docs`` are not looked at; an empty table
    gives none. The join that brings the group to its rows is on the digest, with nothing above it, so Spark
    splits a group that is too large for a task.
    """
    keyed = common.written(digests(docs), "digests")
    index = build_index(keyed)
    return keyed.join(index.hint("merge"), "digest").select(
        common.real_id("doc_id").alias("doc_id"),
        common.real_id("keep_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text stays, with all their columns; rows that share an id stay if one of them does."""
    return common.with_ids(docs, exact_duplicates(docs).where("kept"))
