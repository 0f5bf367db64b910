"""Helpers the operators share: flat byte views of text columns, hashing, packed keys, intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: smaller than every id; turned back into null in results.
NULL_ID = -(2**63)
#: Bytes of text that a task looks at together; its temporary arrays are about 100 times as large.
SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """Tasks after a shuffle; a cluster's own setting, which has to follow the data."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that all executors see: in ``spark.checkpoint.dir``, or in the warehouse where that
    is unset, as in tests; on a cluster a warehouse on the machine's own disk is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: the warehouse {warehouse} is local to a machine")
        folder = f"{warehouse}/_evalspark"
    return f"{folder.rstrip('/')}/evalspark/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor loses nothing of it.

    ``instead_of``: a table written before that nothing reads any more once ``df`` is written; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if instead_of is not None:
        drop(spark, instead_of._written_path)
    return out


def kept(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``written``; what was shuffled for the table is deleted once it is written, not when the driver happens to collect its garbage."""
    conf, setting = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        return written(df, name, instead_of)
    finally:
        conf.set(setting, before)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NULL_ID))


def real_id(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NULL_ID, c)


def texts(docs: DataFrame, *more: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text, nulls replaced: what the operators read of a table."""
    return docs.select(id_column(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def with_ids(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is in ``chosen``."""
    ids = chosen.select(id_column("doc_id").alias("_chosen_id")).distinct()
    return docs.join(ids, id_column("doc_id") == F.col("_chosen_id"), "left_semi")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return bounds - bounds[0], data[bounds[0] : bounds[-1]]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row comes alone."""
    start, n = 0, len(bounds) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bounds, bytes) of the column ``text``, a slice at a time."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds, data = flat(batch.column("text"))
        for a, b in slices(bounds, limit):
            yield batch.slice(a, b - a), bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one pass of prefix sums."""

    BASE, STEP = np.uint64(0x9E3779B97F4A7C15), 1 << 16
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    _powers: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, base: np.uint64, n: int) -> np.ndarray:
        have = cls._powers.get(int(base))
        if have is None or len(have) < n:
            size = max(n, 1 << 20)
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
            cls._powers[int(base)] = have
        return have[:n]

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * self.powers(self.BASE, len(data)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        inverse = self.powers(self.INVERSE, len(self.sums))
        return mix((self.sums[stop] - self.sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of words without ``_``: letters, digits and all non-ASCII characters.
ALPHANUMERIC = _WORD.copy()
ALPHANUMERIC[95] = False
LOWER = _LOWER


def word_spans(bounds: np.ndarray, data: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of the words: runs of letters, digits, ``_`` and all non-ASCII characters, or of ``letters``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = letters[data]
    change = np.diff(inside)
    begins, ends = change[:-1] == 1, change[1:] == -1
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    joined = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # words of two rows that touch
    begins[joined], ends[joined - 1] = True, True
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(bounds, start, "right") - 1


def word_hashes(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop, row) of every word, A-Z counting as a-z."""
    start, stop, row = word_spans(bounds, data)
    return SpanHash(_LOWER[data])(start, stop), start, stop, row


def shingle_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and the indices of the words where that many are left in the row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(3)) + words[k : len(words) - n + 1 + k]
    at = np.flatnonzero(row[: len(out)] == row[n - 1 :])
    return mix(out[at]), at


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned numbers, all first bytes first: equal bytes meet and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class PackedKeys:
    """Gathers (key, further columns, doc) in a task and gives them out as one blob for each bucket of keys.

    A key's bucket is its remainder; the blob holds ``widths`` bytes of the quotient and of each further
    column, the keys and the documents as differences. A full buffer is given out early, so memory is bounded.
    """

    SCHEMA = "bucket int, blob binary"

    def __init__(self, buckets: int, widths: tuple[int, ...], limit: int = 2_000_000) -> None:
        self.buckets, self.widths, self.limit, self.parts, self.n = buckets, widths, limit, [], 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``columns``: one for each width after the first, then the documents."""
        if len(key):
            self.parts.append((key, *columns))
            self.n += len(key)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, *more = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, columns, docs = bucket[order], [(key // np.uint64(self.buckets))[order], *(x[order] for x in more[:-1])], more[-1][order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        ids, blobs = [], []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            steps = np.diff(docs[a:b], prepend=np.int64(0))
            steps = ((steps << 1) ^ (steps >> 63)).view(np.uint64)  # small, whatever the sign
            own = [np.diff(columns[0][a:b], prepend=np.uint64(0)), *(c[a:b] for c in columns[1:])]
            ids.append(int(bucket[a]))
            blobs.append(b"".join([np.int64(b - a).tobytes(), *(planes(c, w) for c, w in zip(own, self.widths, strict=True)), planes(steps, 8)]))
            if len(ids) >= 4096 or b == edge[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
                ids, blobs = [], []

    @staticmethod
    def read(bucket: int, blob: bytes, buckets: int, widths: tuple[int, ...]) -> list[np.ndarray]:
        """The key, the further columns and the documents of a blob."""
        n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for w in widths:
            out.append(unplanes(blob, n, w, at))
            at += n * w
        out[0] = (np.cumsum(out[0], dtype=np.uint64) & np.uint64((1 << 8 * widths[0]) - 1)) * np.uint64(buckets) + np.uint64(bucket)
        steps = unplanes(blob, n, 8, at)
        return [*out, np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64))]


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value of the (together sorted) columns begins."""
    first = np.ones(len(sorted_columns[0]), bool)
    if len(first):
        first[1:] = False
        for c in sorted_columns:
            first[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(first)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) - np.repeat(ends - size, size) + np.repeat(start, size)
