"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits recursively along random directions at the median of a bounded
sample, with spill: vectors near a split go to both sides, the more of them the
denser a node is beside the distance of linked vectors. A node that such a split
hardly makes smaller is a mass of near vectors and stays one leaf of any size.
Below the sample's reach, other leaves that are still large are split on along
directions that hang on the leaf's name, through the centre of the fitted leaf's
sample: as often as the sample lets expect at once, then, where rows are counted
to be still too many, level by level. Leaves are compared in short floats with
room for their rounding; what is near there, as classes of a leaf, is compared
again in double precision, large classes and masses in blocks. A class that
several leaves hold alike is compared once; found pairs are united.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.llm.common import Run, components, map_arrow, mix, saved, small_batches, trim

#: Vectors that fit the trees' splits; all vectors are indexed. This bounds what the driver gathers and what is sent to tasks.
SAMPLE_ROWS = 8192
LAST_LEVEL = 40
#: A split may part this share of the pairs at the threshold. After twelve splits a pair is kept by a tree with probability 0.6, and missed by 16 trees with about 1e-6.
LOST = 0.04
#: A split that sends a larger share than this to one side saves no comparisons: twice its square is 1.
HARDLY = 0.7
#: Directions of unfitted splits, and how many of them the splits expected from the sample may take; the others are left to the levels after.
POOL = 256
EXPECTED_LEVELS = 64
#: Splits are expected down to this share of the limit, as sizes vary about what the sample says.
ROOM = 0.7
#: A leaf of so many times the limit is compared whole, in single floats, in less time than the copies made by another split take.
WHOLE = 4
#: Components of vectors that a task takes at a time, as it makes many copies of each.
HELD = 1 << 18
_AT = np.arange(0, 8, 1 / 64)
_TAIL = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in _AT])


def _above(x: np.ndarray) -> np.ndarray:
    """The probability that a standard normal value exceeds x."""
    return np.interp(x, _AT, _TAIL)


class Forest:
    """The fitted part: per tree arrays of directions, offsets, spills and children (a child below zero is leaf -child - 1).

    A pair at the threshold differs along a random direction by about
    ``sigma``. A node's spill is the smallest, ``spill`` at least, with which
    its split parts a share of at most LOST of such pairs placed at its members.
    Where that sends more than HARDLY of them to one side, the node is a mass of
    near vectors and stays one leaf.
    """

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, spill: float, least: float, seed: int = 11, rows: int = 0, limit: int = 0):
        self.seed, self.trees = seed, []
        self.sigma = float(np.sqrt(max(2 - 2 * least, 0) / max(sample.shape[-1], 1)))
        #: Unfitted splits see no sample: with this spill they part few pairs at the threshold wherever they fall.
        self.wide = max(spill, 0.75 * self.sigma)
        spills = [spill, *[k * self.sigma for k in np.arange(0.2, 1.55, 0.1) if k * self.sigma > spill]]
        # by fitted leaf: its name, the centre of its sample, and whether it is a mass
        tops, centres, masses = [], [], []
        for t in range(trees):
            rng = np.random.default_rng((seed, t))
            directions, offsets, widths, children = [], [], [], []
            self.leaves = 0

            def end(rows: np.ndarray, mass: bool) -> int:
                self.leaves += 1
                tops.append(int(self._names(np.array([self.leaves]), t)[0]))
                centres.append(sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[-1]))
                masses.append(mass)
                return -self.leaves

            def grow(rows: np.ndarray) -> int:
                if len(rows) <= leaf:
                    return end(rows, False)
                d = rng.standard_normal(sample.shape[1])
                d /= np.sqrt(d @ d)
                x = sample[rows] @ d
                cut = float(np.median(x))
                left, right = rows[x <= cut], rows[x > cut]
                if not len(left) or not len(right):
                    return end(rows, False)
                far = np.abs(x - cut)
                for width in spills:
                    if not self.sigma or np.where(far > width, _above((far + width) / self.sigma), 0).mean() <= LOST:
                        break
                if max((x <= cut + width).sum(), (x > cut - width).sum()) > HARDLY * len(rows):
                    return end(rows, True)
                at = len(offsets)
                directions.append(d)
                offsets.append(cut)
                widths.append(width)
                children.append(None)
                children[at] = (grow(left), grow(right))
                return at

            root = grow(np.arange(len(sample)))
            shape = (len(offsets), sample.shape[1] if len(sample) else 0)
            self.trees.append((np.array(directions).reshape(shape), np.array(offsets), np.array(widths), np.array(children, np.int64).reshape(-1, 2), root))
        order = np.argsort(np.array(tops, np.uint64))
        self.tops, self.centres, self.masses = np.array(tops, np.uint64)[order], np.array(centres)[order], np.array(masses)[order]
        pool = np.random.default_rng((seed, trees)).standard_normal((POOL, sample.shape[-1]))
        self.pool = pool / np.sqrt(np.einsum("ij,ij->i", pool, pool))[:, None]
        self.levels = self._levels(sample, rows / max(len(sample), 1), ROOM * limit) if limit else np.zeros(len(tops), np.int64)

    def _levels(self, sample: np.ndarray, each: float, most: float) -> np.ndarray:
        """By fitted leaf: the unfitted splits after which ``most`` rows are expected, as each row of the sample stands for ``each`` rows.

        None for masses and where splits hardly make the sample of a leaf smaller.
        """
        names, rows = self.leaves_of(sample)
        at = np.searchsorted(self.tops, names)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(self.tops) + 1))
        levels = np.zeros(len(self.tops), np.int64)
        for k in np.flatnonzero(~self.masses & (np.diff(ends) * each > most)):
            far = (sample[rows[order[ends[k] : ends[k + 1]]]] - self.centres[k]) @ self.pool[:: POOL // 32].T
            share = float(np.maximum((far <= self.wide).mean(axis=0), (far > -self.wide).mean(axis=0)).mean())
            if share <= HARDLY:
                levels[k] = min(math.ceil(math.log(most / (len(far) * each)) / math.log(share)), EXPECTED_LEVELS)
        return levels

    @staticmethod
    def _names(leaf: np.ndarray, t: int) -> np.ndarray:
        return mix(leaf.astype(np.uint64) + np.uint64((t + 1) << 40))

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf name, row) of unit vectors in all trees; a row may lie in several leaves of a tree."""
        names, rows = [], []
        for t, (directions, offsets, widths, children, root) in enumerate(self.trees):
            row, node = np.arange(len(x)), np.full(len(x), root)
            while len(row):
                done = node < 0
                names.append(self._names(-node[done], t))
                rows.append(row[done])
                row, node = row[~done], node[~done]
                far = np.einsum("ij,ij->i", x[row], directions[node]) - offsets[node] if len(row) else np.empty(0)
                left, right = far <= widths[node], far > -widths[node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([children[node[left], 0], children[node[right], 1]])
        return np.concatenate(names), np.concatenate(rows)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf name, row, fitted leaf) after the splits that the sample lets expect."""
        names, row = self.leaves_of(x)
        top = np.searchsorted(self.tops, names)
        out, level = [], 0
        while len(row):
            done = self.levels[top] <= level
            out.append((names[done], row[done], top[done]))
            names, row, top = names[~done], row[~done], top[~done]
            names, took = self.deeper(names, top, x, row, level)
            row, top = row[took], top[took]
            level += 1
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (names, row, top)

    def deeper(self, names: np.ndarray, tops: np.ndarray, x: np.ndarray, row: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """One more split of unfitted leaves, through the centres of the fitted ones (``tops``) they come from: (name, place in ``row``).

        No direction comes twice below a fitted leaf, as long as there are fewer levels than directions.
        """
        far, step = np.empty(len(row)), max(HELD // max(x.shape[1], 1), 1)
        for at in range(0, len(row), step):
            top = tops[at : at + step]
            d = self.pool[((self.tops[top] >> np.uint64(20)) + np.uint64(level)) % np.uint64(POOL)]
            far[at : at + step] = np.einsum("ij,ij->i", x[row[at : at + step]], d) - np.einsum("ij,ij->i", self.centres[top], d)
        sides = [np.flatnonzero(far <= self.wide), np.flatnonzero(far > -self.wide)]
        return np.concatenate([mix(names[some] + np.uint64(side + 1)) for side, some in enumerate(sides)]), np.concatenate(sides)


def unit_of(data: bytes) -> np.ndarray:
    """The unit vector in doubles of stored components; they are stored as single floats where those hold them exactly."""
    v = np.frombuffer(data[1:], np.float32 if data[:1] == b"f" else np.float64).astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _stored(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of values of one length as a matrix of ``kind``."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1).view(kind)


def _matrix(column: pa.Array) -> np.ndarray:
    """The unit vectors, as :func:`unit_of` gives them one by one."""
    if not len(column):
        return np.empty((0, 0))
    data = _stored(column, np.uint8)
    if (data[:, 0] != data[0, 0]).any():
        return np.array([unit_of(d) for d in column.to_pylist()])
    v = np.ascontiguousarray(data[:, 1:]).view(np.float32 if data[0, 0] == ord("f") else np.float64).astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the stored components, null where there is no direction: null, empty, zero, or with a null or non-finite component."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        values = lists.flatten().fill_null(math.nan).to_numpy()
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        starts = np.cumsum(sizes) - sizes
        out = np.full(len(sizes), None, object)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            v = values[starts[rows][:, None] + np.arange(size)]
            ok = np.isfinite(v).all(axis=1) & v.any(axis=1)
            rows, v = rows[ok], v[ok]
            with np.errstate(over="ignore"):
                single = v.astype(np.float32)
            exact = (single == v).all(axis=1)
            out[rows[exact]] = [b"f" + x.tobytes() for x in single[exact]]
            out[rows[~exact]] = [b"d" + x.tobytes() for x in v[~exact]]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return map_arrow(rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), run, "vec_id long, v binary")


def in_groups(fn: Callable[[pa.RecordBatch], list[np.ndarray] | None], by: int, names: list[str]):
    """For partitions sorted by their first ``by`` columns: the columns that ``fn`` gives for each group, in batches."""

    def whole(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch | None:
        out = [o for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 and (o := fn(batch.slice(a, b - a))) is not None]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=names) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in range(by):
                x = batch.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
                new[0] |= not held or held[-1].column(k)[-1].as_py() != x[0]
            starts = np.flatnonzero(new)
            if len(starts) and starts[-1]:
                rest = batch.slice(starts[-1])
                batch, starts = batch.slice(0, starts[-1]), starts[:-1]
            elif len(starts):
                rest, batch, starts = batch, batch.slice(0, 0), starts[:-1]
            else:
                held.append(batch)
                continue
            before = sum(h.num_rows for h in held)
            out = whole(pa.concat_batches([*held, batch]), np.unique([0, *(starts + before), before + batch.num_rows]))
            held = [rest]
            if out is not None:
                yield out
        if held and (out := whole(batch := pa.concat_batches(held), np.array([0, batch.num_rows]))) is not None:
            yield out
        trim()

    return run


def spread(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the n items that each is linked to by (a, b): minima spread along links until none moves."""
    name = np.arange(n)
    while True:
        low = name.copy()
        np.minimum.at(low, a, name[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == name).all():
            return name
        name = low


def classes_of(rows: pa.RecordBatch, least: float) -> list[pa.Array] | None:
    """One leaf (node, key, u: unit vector in half floats): (name, key) for the members of each class of near vectors.

    The name is one of the set of members. Rounding is allowed for, so that all links are within classes.
    """
    x, keys = _stored(rows.column(2), np.float16).astype(np.float32), rows.column(1).to_numpy()
    n = x.shape[1]
    # two unit vectors off by 2**-11 of their components, or 2**-25 of them where those are tiny; then products and sums in single floats
    enough = np.float32(least - 2.0**-10 * 1.01 - math.sqrt(n) * 2.0**-23 - (n + 8) * 2.0**-23)
    a, b = [], []
    for at in range(0, len(x), 512):
        near = x[at : at + 512] @ x[at:].T >= enough
        near[:, : len(near)] = np.triu(near[:, : len(near)], 1)
        if near.any():
            i, j = np.nonzero(near)
            a.append(i + at)
            b.append(j + at)
    if not a:
        return None
    a, b = np.concatenate(a), np.concatenate(b)
    some = np.unique(np.concatenate([a, b]))
    name = spread(np.searchsorted(some, a), np.searchsorted(some, b), len(some))
    order = np.argsort(name, kind="stable")
    starts = np.flatnonzero(np.diff(name[order], prepend=-1))
    sizes = np.diff(starts, append=len(order))
    of = mix(np.add.reduceat(mix(keys[some][order].view(np.uint64)), starts) + sizes.astype(np.uint64))
    return [pa.array(np.repeat(of, sizes).view(np.int64)), pa.array(keys[some][order])]


def first_here(near: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray, names: np.ndarray) -> None:
    """Takes out of ``near`` the pairs whose members share a name; ``owner`` lists the vector of each name."""
    if not len(names) or not near.any():
        return
    _, number, times = np.unique(names, return_inverse=True, return_counts=True)
    at_left, at_right = np.full((2, int(max(left.max(), right.max())) + 1), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))

    def drop(some: np.ndarray) -> None:
        near[np.ix_(at_left[some][at_left[some] >= 0], at_right[some][at_right[some] >= 0])] = False

    # names that many hold first: mostly little is left then
    order = np.lexsort((number, -times[number]))[: times[times > 1].sum()]
    owner, number = owner[order], number[order]
    cuts = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
    for some in (owner[a:b] for a, b in zip(cuts[:8], cuts[1:9], strict=False)):
        drop(some)
    cuts = cuts[8:]
    pairs, n_names = int(near.sum()), len(cuts) - 1
    if not pairs or n_names < 1:
        return
    owner, number, cuts = owner[cuts[0] :], number[cuts[0] :], cuts - cuts[0]
    if pairs <= 32 * n_names:
        codes = np.unique(owner * (len(times) + 1) + number)
        own, n = codes // (len(times) + 1), int(max(left.max(), right.max())) + 1
        ends = np.searchsorted(own, np.arange(n + 1))
        i, j = np.nonzero(near)
        for at in range(0, len(i), 10_000):
            p, q = i[at : at + 10_000], j[at : at + 10_000]
            many = (ends[1:] - ends[:-1])[left[p]]
            nth = np.repeat(np.arange(len(p)), many)
            step = np.arange(len(nth)) - np.repeat(np.cumsum(many) - many, many)
            code = codes[ends[left[p]][nth] + step] - left[p][nth] * (len(times) + 1) + right[q][nth] * (len(times) + 1)
            found = nth[codes[np.searchsorted(codes, code).clip(max=len(codes) - 1)] == code]
            near[p[found], q[found]] = False
        return
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        drop(owner[a:b])


def compared(table: pa.RecordBatch, least: float) -> list[pa.Array] | None:
    """One class, or two blocks of one: a row (a, null, n) per vector with n links first found here, and spanning links (a, b, null).

    ``groups`` lists all classes of a vector; two vectors that share several
    are counted in the one with the smallest name.
    """
    x, keys, copies = _matrix(table["v"]), table["key"].to_numpy(), table["copies"].to_numpy()
    side, here = table["side"].to_numpy(), table["node"][0].as_py()
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    near = x[left] @ x[right].T >= least
    near &= keys[left][:, None] != keys[right][None, :]
    groups = table["groups"]
    names, owner = groups.flatten().to_numpy(), np.repeat(np.arange(len(keys)), np.diff(groups.offsets.to_numpy()))
    first_here(near, left, right, owner[names < here], names[names < here])
    n = np.zeros(len(keys), np.int64)
    n[left] += near @ copies[right]
    n[right[side[right] == 2]] += (copies[left] @ near)[side[right] == 2]
    # one link to the smallest member for each class that the block makes
    i, j = np.nonzero(near)
    if not len(i):
        return None
    name = spread(left[i], right[j], len(keys))
    some, moved = np.flatnonzero(n), np.flatnonzero(name != np.arange(len(keys)))
    none = np.arange(len(some) + len(moved)) < len(some)
    a, b = np.concatenate([keys[some], keys[moved]]), np.concatenate([keys[some], keys[name[moved]]])
    return [pa.array(a), pa.array(b, mask=none), pa.array(np.concatenate([n[some], n[moved]]), mask=~none)]


def similar(rows: DataFrame, *, least: float = 0.95, trees: int = 16, leaf: int = 24, spill: float = 0.01, limit: int = 1000) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors with cosine of at least ``least`` are linked where a leaf of some
    tree holds both. Equal vectors are one point of the search and each other's
    links. Vectors that are null, empty, zero or hold null or non-finite
    components have no links and are kept. A null vec_id counts as a vector but
    is never the smallest. Vectors of different length never meet. Other
    columns are not read. Links are counted where they are found, not listed.
    """
    spark = rows.sparkSession
    small_batches(spark, 4000)
    with Run(spark) as run:
        out, least_id = _linked(rows, least, trees, leaf, spill, limit)
        run.keep(out, least_id)
    out = out.join(least_id, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(rows: DataFrame, least: float, trees: int, leaf: int, spill: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """Saved rows (vec_id, n, root) and the smallest vec_id of each root."""
    spark = rows.sparkSession
    points = saved(vectors_of(rows).withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "points")
    unique = saved(points.where("v is not null").groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("copies")), "unique")
    widths = [r[0] for r in unique.select(F.length("v").alias("w")).distinct().limit(1001).collect()]
    if len(widths) > 1000:
        raise ValueError("more than 1000 different vector lengths")
    found = spark.createDataFrame([], "a long, b long, n long")
    for width in widths:
        found = found.unionByName(_links(unique.where(F.length("v") == width), least, trees, leaf, spill, limit))
    found = saved(found, "links")
    roots = components(found.where("n is null").select("a", "b")).select(F.col("v").alias("key"), "root")
    near = found.where("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("near"))
    known = unique.select("key", "copies").join(near, "key", "left").join(roots, "key", "left")
    known = saved(known.select("key", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("root", "key").alias("root")), "known")
    out = saved(points.select("vec_id", "key").join(known, "key", "left"), "joined")
    return out, saved(out.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "least")


def _sample(unique: DataFrame, rows: int) -> np.ndarray:
    """The vectors with the smallest hashes; a bound on hashes keeps what tasks sort and send small."""
    most = min((2 * SAMPLE_ROWS << 64) // rows - (1 << 63), (1 << 63) - 1)
    sample = unique.withColumn("hash", F.xxhash64("key")).where(F.col("hash") <= most).orderBy("hash").select("v").limit(SAMPLE_ROWS).collect()
    return np.array([unit_of(bytes(r[0])) for r in sample])


def _links(unique: DataFrame, least: float, trees: int, leaf: int, spill: float, limit: int, block: int = 1000) -> DataFrame:
    n = unique.count()
    forest = Forest(_sample(unique, n), trees, leaf, spill, least, rows=n, limit=WHOLE * limit)
    sent = unique.sparkSession.sparkContext.broadcast(forest)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, row, top = sent.value.placed(_matrix(batch.column(1)))
        # a mass counts as one that a split did not make smaller
        was = pa.array(np.zeros(len(top), np.int64), mask=~sent.value.masses[top])
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), batch.column(0).take(pa.array(row)), was, pa.array(top.astype(np.int32))], names=["node", "key", "was", "top"])

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            step = max(HELD // max(x.shape[1], 1), 1)
            for at in range(0, len(x), step):
                names, row, _ = sent.value.placed(x[at : at + step])
                some = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), batch.column(0).slice(at, step).take(some), halves(x[at : at + step]).take(some)], names=["node", "key", "u"])
        trim()

    def halves(x: np.ndarray) -> pa.Array:
        width = 2 * x.shape[1]
        ends = pa.py_buffer(np.arange(0, width * len(x) + 1, width, dtype=np.int32))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.astype(np.float16))])

    def half(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), halves(_matrix(batch.column(2)))], names=["node", "key", "u"])

    def split(level: int):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, row = sent.value.deeper(batch.column(0).to_numpy().view(np.uint64), batch.column(4).to_numpy(), _matrix(batch.column(2)), np.arange(batch.num_rows), EXPECTED_LEVELS + level)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *[batch.column(i).take(take) for i in (1, 3, 4)]], names=["node", "key", "was", "top"])

        return run

    vectors = unique.select("key", "v")
    leaves, masses = vectors.mapInArrow(place_all, "node long, key long, u binary"), None
    nodes = map_arrow(vectors, place, "node long, key long, was long, top int")
    for level in range(LAST_LEVEL + 1):
        nodes = saved(nodes, "leaves")
        large = saved(nodes.groupBy("node").agg(F.count("*").alias("size"), F.max("was").alias("before")).where(F.col("size") > WHOLE * limit), "sizes")
        # the leaves that are compared as they are; those of the first level are placed again, with their vectors
        if level:
            leaves = leaves.union(map_arrow(nodes.join(large, "node", "left_anti").join(vectors, "key").select("node", "key", "v"), half, "node long, key long, u binary"))
        else:
            leaves = leaves.join(large, "node", "left_anti").select("node", "key", "u")
        # a leaf that a split hardly makes smaller is a mass of near copies: no use in splitting it further
        more = ~F.coalesce(F.col("size") > 0.8 * F.col("before"), F.lit(False)) & F.lit(level < LAST_LEVEL)
        whole = nodes.join(large.where(~more).select("node"), "node").select(F.col("node").alias("name"), "key")
        masses = whole if masses is None else masses.union(whole)
        large = large.where(more).select("node", "size")
        if large.isEmpty():
            break
        rest = nodes.select("node", "key", "top").join(large, "node").join(vectors, "key")
        nodes = map_arrow(rest.select("node", "key", "v", F.col("size").alias("was"), "top"), split(level), "node long, key long, was long, top int")
    found = in_groups(lambda rows: classes_of(rows, least), 1, ["name", "key"])
    near = leaves.repartition("node").sortWithinPartitions("node").mapInArrow(found, "name long, key long")
    classes = saved(near.union(masses).distinct(), "classes")
    sizes = classes.groupBy("name").agg(F.count("*").alias("size"))
    groups = classes.join(sizes, "name").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("at"))
    rows = unique.join(groups, "key").select("key", "v", "copies", F.col("at.name").alias("groups"), F.explode("at").alias("x"))
    blocks = F.ceil(F.col("x.size") / block)
    rows = rows.withColumns({"node": F.col("x.name"), "nth": F.pmod(F.xxhash64("key"), blocks), "meets": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    side = F.when(F.col("nth") == F.col("meets"), 0).when(F.col("nth") < F.col("meets"), 1).otherwise(2)
    rows = rows.select("node", F.least("nth", "meets").alias("i"), F.greatest("nth", "meets").alias("j"), side.alias("side"), "key", "v", "copies", "groups")
    pairs = in_groups(lambda rows: compared(rows, least), 3, ["a", "b", "n"])
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "key").mapInArrow(pairs, "a long, b long, n long")
