"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are ordered by the cells of a grid on their leading principal dimensions. The order is cut into leaves of
few vectors, and some leaves in a row are a group. A directory of the leaves' boxes says which leaves are within epsilon
of each other (an equality join on the first dimension's cells finds them); all others are skipped and don't travel. What
two groups have to compare is a tile: a leaf goes to a tile once, however many leaves it meets there, and two leaves are
joined by halving them until the parts are provably distant or small. Tiles are compared in rounds, so that what travels at a
time is bounded by the vectors and not by their pairs. Projections shorten distances, so nothing within
epsilon is skipped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, local_forest

_LEAF = 64  # intervals up to this size are compared at once
LEAF, LEAVES = 256, 16  # vectors of a leaf, and leaves of a group at least
GROUPS = 32  # more leaves a group rather than more groups, up to
GROUP_BYTES = 8 << 20  # of a group's vectors; with longer vectors it has fewer leaves
ROUND_BYTES = 256 << 20


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dims, vector): ``key`` names equal vectors; null for those that link with nothing. ``vector`` has their
    numbers, in four bytes each where these hold them exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = column.values.to_numpy(zero_copy_only=False)  # a null within a vector becomes NaN
            start = column.offsets.to_numpy()
            size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(start))
            keys, packed, dims = np.full(len(size), None, object), np.full(len(size), None, object), np.zeros(len(size), np.int32)
            for d in np.unique(size[size > 0]).tolist():
                places = np.flatnonzero(size == d)
                for at in np.array_split(places, -(-len(places) * d // (1 << 20))):
                    x = values[start[at][:, None] + np.arange(d)] + 0.0
                    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    at, x = at[good], x[good]
                    with np.errstate(over="ignore"):
                        narrow = x.astype(np.float32)
                    short = (narrow == x).all(axis=1)
                    dims[at] = d
                    for i, v, w, fits in zip(at.tolist(), x, narrow, short.tolist(), strict=True):
                        keys[i], packed[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), (w if fits else v).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims), pa.array(packed, pa.binary())], ["vec_id", "key", "dims", "vector"])

    rows = vectors.select(common.id_column("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id bigint, key binary, dims int, vector binary")


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows at unit length, in double precision."""
    x = x / np.abs(x).max(axis=1, initial=0).astype(np.float64)[:, None]  # no overflow in the square
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    bounds, data = common.flat(column)
    size = np.diff(bounds)
    out = np.empty((len(size), dims))
    for kind, width in ((np.float32, 4), (np.float64, 8)):
        own = size == width * dims
        if own.any():
            out[own] = np.frombuffer(data[np.repeat(own, size)].tobytes(), kind).reshape(-1, dims)
    return _unit(out)


def principal_axes(different: DataFrame, lead: int) -> dict[int, np.ndarray]:
    """For each length of vectors the ``lead`` directions along which they vary most, from ALL of them.

    A task sends one sum of products per pair of coordinates; the sums meet in a small table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d in set(batch.column("dims").to_pylist()):
                own = batch.filter(pa.array(batch.column("dims").to_numpy() == d))
                x = np.c_[np.ones(own.num_rows), _matrix(own.column("vector"), d)]
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(i.reshape(-1).astype(np.int32)), pa.array(j.reshape(-1).astype(np.int32)), pa.array(s.reshape(-1))], ["dims", "i", "j", "s"])

    total = different.select("dims", "vector").mapInArrow(run, "dims int, i int, j int, s double").groupBy("dims", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for d in {r.dims for r in total}:
        s = np.zeros((d + 1, d + 1))
        for r in total:
            if r.dims == d:
                s[r.i, r.j] = r.s
        mean = s[0, 1:] / s[0, 0]
        spread = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        out[d] = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1][:, :lead]
    return out


def _leaves(different: DataFrame, axes: dict[int, np.ndarray], epsilon: float, lead: int, size: int, most: int = LEAVES) -> DataFrame:
    """(leaf, block, dims, ids, copies, low, high, vectors): runs of the grid order, and the group (block) of each, of ``most`` leaves."""
    cells = [f"c{k}" for k in range(lead)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cell = np.zeros((batch.num_rows, lead), np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = _matrix(batch.column("vector").take(pa.array(own)), d) @ axes[d]
                cell[own, : x.shape[1]] = np.floor(x / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, k]) for k in range(lead))], [*batch.schema.names, *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block: list[int] = [0, 0, 0]  # its first vector, its leaves so far, their dimensions

        def out() -> pa.RecordBatch:
            ids, copies, dims, units = zip(*held, strict=True)
            d = dims[0]
            if not block[1] or block[1] >= min(most, max(1, GROUP_BYTES // (8 * d * size))) or block[2] != d:
                block[:] = ids[0], 0, d
            block[1] += 1
            unit = _matrix(pa.array(units, pa.binary()), d)
            if any(len(v) != 4 * d for v in units):  # one width in a leaf
                units = [v if len(v) == 8 * d else np.frombuffer(v, np.float32).astype(np.float64).tobytes() for v in units]
            x = unit @ axes[d]
            low, high = x.min(axis=0) - 1e-9, x.max(axis=0) + 1e-9
            row = [[int(ids[0])], [block[0]], [d], [np.array(ids, np.int64).tobytes()], [np.array(copies, np.int64).tobytes()], [low.tolist()], [high.tolist()], [b"".join(units)]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["leaf", "block", "dims", "ids", "copies", "low", "high", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("number", "copies", "dims", "vector")), strict=True):
                if held and (len(held) >= size or held[0][2] != row[2]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    kinds = ", ".join(f"{c} int" for c in cells)
    placed = different.select("number", "copies", "dims", "vector").mapInArrow(project, f"number bigint, copies bigint, dims int, vector binary, {kinds}")
    ordered = placed.repartitionByRange(common.partitions(different.sparkSession), "dims", *cells, "number").sortWithinPartitions("dims", *cells, "number")
    schema = "leaf bigint, block bigint, dims int, ids binary, copies binary, low array<double>, high array<double>, vectors binary"
    return ordered.select("number", "copies", "dims", "vector").mapInArrow(cut, schema)


def _near_leaves(leaves: DataFrame, epsilon: float, part: int = 0, parts: int = 1) -> DataFrame:
    """(left, right, block_l, block_r): leaves, each with itself too, whose boxes are within epsilon; from the boxes alone.
    No leaf meets one whose cells are not adjacent. A tile is named by its groups in ascending order; ``part``: of the tiles,
    those whose first group is dealt to that one of ``parts``."""
    boxes = leaves.select("leaf", "block", "dims", "low", "high")
    cell = lambda c: F.floor(c / epsilon)
    own = boxes.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == part)
    a = own.select(F.col("leaf").alias("left"), F.col("block").alias("block_l"), F.col("dims").alias("d"), F.col("low").alias("l"), F.col("high").alias("h"), F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    b = boxes.select(F.col("leaf").alias("right"), F.col("block").alias("block_r"), "dims", "low", "high", F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("near"))
    gaps = F.zip_with(F.zip_with("l", "high", lambda x, y: x - y), F.zip_with("low", "h", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    once = (F.col("block_l") < F.col("block_r")) | ((F.col("block_l") == F.col("block_r")) & (F.col("left") <= F.col("right")))
    near = a.join(b, (F.col("cell") == F.col("near")) & (F.col("d") == F.col("dims")) & once & (apart <= epsilon * epsilon))
    return near.select("left", "right", "block_l", "block_r").distinct()


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of unit vectors have a cosine of at least ``threshold``; cases within rounding of it are summed exactly."""
    cosine = x @ y.T
    found = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
        u, v = x[i], y[j]
        found[i, j] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v)) >= threshold
    return found


def join_intervals(a: tuple, b: tuple, axes: np.ndarray, epsilon: float, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Joins two intervals (vectors, projections, places) of the order: halves them unless their boxes are apart or both are small.

    Gives (left places, right places, matrix of links).
    """
    (x, px, ix), (y, py, iy) = a, b
    gap = np.maximum(0, np.maximum(px.min(axis=0) - py.max(axis=0), py.min(axis=0) - px.max(axis=0)))
    if gap @ gap > epsilon * epsilon:
        return
    if max(len(x), len(y)) <= _LEAF:
        found = linked(x, y, threshold)
        if same:
            found = np.triu(found, 1)
        if found.any():
            yield ix, iy, found
        return
    halves = lambda v: ((v[0][: len(v[0]) // 2], v[1][: len(v[0]) // 2], v[2][: len(v[0]) // 2]), (v[0][len(v[0]) // 2 :], v[1][len(v[0]) // 2 :], v[2][len(v[0]) // 2 :]))
    if same:
        first, second = halves(a)
        parts = [(first, first, True), (first, second, False), (second, second, True)]
    elif len(x) >= len(y):
        parts = [(h, b, False) for h in halves(a)]
    else:
        parts = [(a, h, False) for h in halves(b)]
    for left, right, own in parts:
        yield from join_intervals(left, right, axes, epsilon, threshold, own)


def _links(leaves: DataFrame, near: DataFrame, axes: dict[int, np.ndarray], epsilon: float, threshold: float) -> DataFrame:
    """(a, b, links): with ``b`` null, links of vector ``a`` found in a tile; else ``b`` is a smaller vector of a's part of the graph."""

    def tile(pairs: pa.Table, sides: pa.Table) -> pa.Table:
        held = {}
        for leaf, d, ids, copies, vectors in zip(*(sides.column(n).to_pylist() for n in ("of_leaf", "dims", "ids", "copies", "vectors")), strict=True):
            x = _unit(np.frombuffer(vectors, np.float32 if len(vectors) * 2 == len(ids) * d else np.float64).reshape(-1, d))
            held[leaf] = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.zeros(len(x), np.int64), (x, x @ axes[d], np.arange(len(x))), d
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        for left, right in zip(pairs.column("left").to_pylist(), pairs.column("right").to_pylist(), strict=True):
            (own, n, of_own, x, d), (other, m, of_other, y, _) = held[left], held[right]
            for i, j, found in join_intervals(x, y, axes[d], epsilon, threshold, left == right):
                of_own[i] += found @ m[j]
                of_other[j] += n[i] @ found
                p, q = np.nonzero(found)
                forest.append(local_forest(own[i[p]], other[j[q]]))
        none = np.zeros(0, np.int64)
        a, b = local_forest(*(np.concatenate(c) for c in zip(*forest, strict=True))) if forest else (none, none)
        who, how = (np.concatenate([none, *(x[k] for x in held.values())]) for k in (0, 2))
        who, how = who[how > 0], how[how > 0]
        second = pa.chunked_array([pa.nulls(len(who), pa.int64()), pa.array(b, pa.int64())])
        return pa.table([pa.array(np.r_[who, a]), second, pa.array(np.r_[how, np.zeros(len(a), np.int64)])], ["a", "b", "links"])

    sides = near.select("block_l", "block_r", F.explode(F.array("left", "right")).alias("to")).distinct().join(leaves.select(F.col("leaf").alias("of_leaf"), "dims", "ids", "copies", "vectors"), F.col("to") == F.col("of_leaf")).drop("to")
    sides = sides.select(F.col("block_l").alias("bl"), F.col("block_r").alias("br"), "of_leaf", "dims", "ids", "copies", "vectors")
    return near.groupBy("block_l", "block_r").cogroup(sides.groupBy("bl", "br")).applyInArrow(tile, "a bigint, b bigint, links bigint")


def _all_links(leaves: DataFrame, axes: dict[int, np.ndarray], epsilon: float, threshold: float, round_bytes: int) -> DataFrame:
    """``_links`` of all tiles. Each leaf travels to as many tiles as there are groups, which together grows with the square of the
    vectors: the tiles are compared in rounds in which about ``round_bytes`` travel, or twice the leaves themselves if that is more."""
    groups, size = leaves.agg(F.count_distinct("block"), F.sum(F.length("vectors") + F.length("ids") + F.length("copies"))).head()
    rounds = max(1, min(groups, math.ceil(groups * (size or 0) / max(round_bytes, 2 * (size or 0), 1))))
    found: list[DataFrame] = []
    for k in range(rounds):
        near = common.kept(_near_leaves(leaves, epsilon, k, rounds), "directory")
        found.append(common.kept(_links(leaves, near, axes, epsilon, threshold), "found", instead_of=near))
        if len(found) == 16 and k + 1 < rounds:
            found = [_together(found)]
    return found[0] if len(found) == 1 else _together(found)


def _together(found: list[DataFrame]) -> DataFrame:
    """What several rounds found, the links of a vector added up."""
    out = common.kept(reduce(DataFrame.unionAll, found).groupBy("a", "b").agg(F.sum("links").alias("links")), "found")
    for x in found:
        common.drop(x.sparkSession, x._written_path)
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95, lead: int = 8, leaf: int = LEAF, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Two vectors are linked if their cosine, in double precision, is at least ``threshold`` (which must be positive).
    ``n_links``: other vectors linked directly; ``component_id``: the smallest vec_id that links lead to, itself included;
    ``kept``: it is that one. Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as do
    vectors of different lengths. Equal vectors are joined once, with their number; a null vec_id is the smallest
    id; each row counts as a vector even if its id repeats. Other columns are not read. ``lead``: dimensions of the grid;
    ``leaf``: vectors that travel together; ``round_bytes``: of vectors that travel at a time, which bounds the disk.
    """
    epsilon = math.sqrt(2 - 2 * threshold) * (1 + 1e-9)
    whole = common.kept(_prepared(vectors), "vectors")
    different = whole.where("key is not null").groupBy("key", "dims").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    different = common.kept(different.withColumn("number", F.monotonically_increasing_id()), "different")
    rows = common.kept(whole.select("vec_id", "key"), "keys", instead_of=whole)
    axes = principal_axes(different, lead)
    leaves = common.kept(_leaves(different, axes, epsilon, lead, leaf, max(LEAVES, different.count() // (GROUPS * leaf))), "leaves")
    different = common.kept(different.select("key", "number", "rep", "copies"), "numbers", instead_of=different)
    found = _all_links(leaves, axes, epsilon, threshold, round_bytes)
    common.drop(vectors.sparkSession, leaves._written_path)
    parts = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    known = different.select("key", "number", "rep", "copies").join(counts, F.col("number") == F.col("a"), "left").join(parts, F.col("number") == F.col("node"), "left")
    known = known.select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "number").alias("part"))
    least = known.groupBy(F.col("part").alias("of_part")).agg(F.min("rep").alias("component"))
    known = known.join(least, F.col("part") == F.col("of_part")).select(F.col("key").alias("of_key"), "links", "component")
    joined = rows.select("vec_id", "key").join(known.hint("merge"), F.col("key") == F.col("of_key"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        common.real_id("vec_id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        common.real_id(component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
