"""The most similar vectors of every vector: NN-descent from a random graph, by joins of neighbours of neighbours.

Vectors are encoded once: equal directions share one code and become one node. Nodes are placed in
cells around centres fitted in a random projection, so that the codes of vectors that may be similar
lie together; a node near a border lies in both cells. The codes of a cell come together once. There
the first graph links every node to a few random others; each round joins the links of either direction
at every node and takes what is better from the pairs of its neighbours, until the lists stop changing.
The products of all pairs of a cell come from one multiplication of matrices, which costs less than to
gather the vectors of the pairs of a single round; a check reads from it what the joins missed. Rounds
between cells follow, without codes: where neighbours of one node share no cell they are judged by their
projections, and the codes of pairs that can still matter travel. ``greedy_search`` answers queries by
walking the graph.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidemark.session import cut, drop_stored, store

#: Cells hold about so many nodes; one of more than four times as many is split by hyperplanes.
CELL = 1024
#: Cells of fewer nodes join the next: lists start inside a cell.
LEAST = 32
#: A node lies in its second cell too when that centre is at most so many times as far.
BORDER = 1.05
#: Centres are fitted on at most so many projected vectors, brought to the driver (128 bytes each).
SAMPLE = 20_000
CENTRES = 2_048
SKETCH = 128
#: Neighbours kept a node while the graph is built.
LIST = 12
#: Bytes that the products of all pairs of a cell may take; those of a larger cell are made block by block.
TABLE = 80_000_000
#: Both cells of a node as one number: the first 31 bits up, the second (the first again where there is none) below.
_SHIFT, _LOW = 31, 2**31 - 1


def projection(dims: int) -> np.ndarray:
    return (np.random.default_rng(7).standard_normal((dims, SKETCH)) / np.sqrt(SKETCH)).astype(np.float32)


def encode(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(codes, projections as int8) of usable rows of a float32 matrix.

    A row that is a multiple of small integers, but for the rounding of single precision, is coded by them,
    a byte each, without loss but for its length; any other row by 16 bits an element, relative to its largest.
    """
    size = np.abs(x)
    unit = np.where(size > 0, size, np.inf).min(axis=1)
    ratio = x / unit[:, None]
    whole = np.rint(ratio)
    exact = (np.abs(ratio - whole) <= 5e-7 * np.maximum(size / unit[:, None], 1)).all(axis=1) & (np.abs(whole).max(axis=1) <= 127)
    rest = ~exact
    wide = iter(np.rint(x[rest].astype(np.float64) / size[rest].max(axis=1)[:, None] * 32767).astype(np.int16))
    narrow = iter(whole[exact].astype(np.int8))
    codes = [next(narrow if e else wide).tobytes() for e in exact]
    unit_length = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)
    return codes, np.clip(np.rint(unit_length @ projection(x.shape[1]) * 254), -127, 127).astype(np.int8)


def read_codes(codes: list[bytes], dims: int, kind=np.float32) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.int8 if len(c) == dims else np.int16) for c in codes]).astype(kind)


def exact_cosine(a: list[bytes], b: list[bytes], dims: int) -> np.ndarray:
    """Cosines row by row; the sums are sums of whole numbers, so equal pairs give equal results anywhere."""
    x, y = read_codes(a, dims, np.float64), read_codes(b, dims, np.float64)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def encode_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, hash, sketch, code) of every usable vector: ``dims`` elements, none null, NaN or infinite, not all zero."""
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dims)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = flat = x = None
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat = part.column(1).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(part.num_rows, dims)
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                if not ok.any():
                    continue
                codes, sketches = encode(x[ok])
                yield pa.RecordBatch.from_arrays([
                    pa.array(part.column(0).to_numpy(zero_copy_only=False)[ok], pa.int64()),
                    pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in codes], pa.binary()),
                    pa.array([s.tobytes() for s in sketches], pa.binary()), pa.array(codes, pa.binary()),
                ], ["id", "hash", "sketch", "code"])
            del batch, part, flat, x
            give_back()

    return rows.mapInArrow(run, "id long, hash binary, sketch binary, code binary")


def give_back() -> None:
    """Returns freed memory to the system: a worker that has read large batches waits for the next task as small as before."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system
        pass


def fit_centres(sketches: np.ndarray, count: int, seed: int, rounds: int = 6) -> np.ndarray:
    """k-means centres in the projected space; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    x = sketches.astype(np.float32)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres).astype(np.float32)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i:i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _placer(centres: np.ndarray, border: float):
    """A UDF from sketch to one or two centres, each 32 bits up."""

    def place(sketches: pd.Series) -> pd.Series:
        cells: list[list[int]] = []
        half = (centres**2).sum(axis=1)
        for at in range(0, len(sketches), 1024):
            x = np.stack([np.frombuffer(s, np.int8) for s in sketches[at:at + 1024]]).astype(np.float32)
            far, row, two, d = half - 2 * (x @ centres.T), np.arange(len(x)), [], []
            for _ in range(min(2, len(centres))):
                two.append(far.argmin(axis=1))
                d.append(np.sqrt(np.maximum(far[row, two[-1]] + (x**2).sum(axis=1), 0)))
                far[row, two[-1]] = np.inf
            first = two[0].astype(np.int64) << 32
            both = (d[1] <= border * d[0]) if len(two) > 1 and border > 0 else np.zeros(len(x), bool)
            second = (two[-1].astype(np.int64) << 32).tolist()
            cells += [[a, b] if two_ else [a] for a, b, two_ in zip(first.tolist(), second, both.tolist())]
        return pd.Series(cells, dtype=object)

    return F.pandas_udf(place, ArrayType(LongType()))


def _splitter(centres: np.ndarray, bits: np.ndarray):
    """A UDF from sketch and centres to cells: a centre and as many hyperplane signs as it needs below."""

    def split(sketches: pd.Series, cells: pd.Series) -> pd.Series:
        if not len(sketches):
            return pd.Series([], dtype=object)
        planes = np.random.default_rng(100).standard_normal((SKETCH, 30)).astype(np.float32)
        x = np.stack([np.frombuffer(s, np.int8) for s in sketches]).astype(np.float32)
        count = np.array([len(c) for c in cells])
        at, c = np.repeat(np.arange(len(x)), count), np.concatenate([np.asarray(c, np.int64) for c in cells]) >> 32
        above = (x @ planes)[at] > (centres @ planes)[c]
        signs = (above & (np.arange(30) < bits[c][:, None])) @ (1 << np.arange(30, dtype=np.int64))
        return pd.Series([v.tolist() for v in np.split((c << 32) | signs, np.cumsum(count)[:-1])], dtype=object)

    return F.pandas_udf(split, ArrayType(LongType()))


def _numberer(number: dict[int, int], others: dict[int, int]):
    """A UDF from cells to their numbers 0, 1, ..., each once; those of too few nodes have the number of another one of their centre."""
    find = lambda c: number.get(int(c), number[others[int(c) >> 32]])
    return F.pandas_udf(lambda cells: pd.Series([list(dict.fromkeys(find(c) for c in picked)) for picked in cells], dtype=object), ArrayType(LongType()))


class _Cell:
    """The nodes of one cell as arrays: ids, codes as numbers, squares of lengths, projections, both cells of each."""

    def __init__(self, nodes: pa.Table, dims: int):
        # the same whatever order rows come in; a row delivered twice counts once
        nodes = nodes.take(pa.array(np.unique(nodes["id"].to_numpy(), return_index=True)[1]))
        self.dims, self.ids, self.home = dims, nodes["id"].to_numpy(), nodes["home"].to_numpy()
        self.codes = nodes["code"].to_pylist()
        x = read_codes(self.codes, dims)
        self.squares = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        # whole numbers whose sums stay under 2^24 are exact in single precision, in any order; others need double
        self.x = x if (self.squares < 2**24).all() else read_codes(self.codes, dims, np.float64)
        self.sketches = nodes["sketch"].to_pylist()
        self.sketch = _directions(self.sketches)

        self.lengths = (1 / np.sqrt(self.squares)).astype(np.float32)
        self.table = self.x @ self.x.T if len(x) ** 2 * self.x.itemsize <= TABLE else None

    def best(self, keep: int, pool: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, cosine) of positions: for each a the ``keep`` best of those that its row of ``pool`` allows, or of
        all, ties to the smaller id; in order."""
        n, found = len(self.ids), []
        for lo in range(0, n, 512):
            dots = self.x[lo:lo + 512] @ self.x.T if self.table is None else self.table[lo:lo + 512]
            row = np.arange(len(dots))
            asked = np.ones(dots.shape, bool) if pool is None else pool[lo:lo + 512]
            asked[row, row + lo] = False
            if keep < n and np.count_nonzero(asked) > 4 * keep * len(dots):
                # within a row the order does not depend on its own length; what may be equal in single precision is kept
                score = np.multiply(dots, self.lengths, dtype=np.float32, casting="same_kind")
                score[~asked] = -np.inf
                least = np.partition(score, n - keep, axis=1)[:, n - keep, None]
                asked = (score >= least - 1e-6 * np.abs(np.where(np.isinf(least), 0, least))) & asked
            i, j = np.nonzero(asked)
            c = dots[i, j].astype(np.float64) / np.sqrt(self.squares[i + lo] * self.squares[j])
            order = np.lexsort((j, -c, i))
            order = order[_ranks(i[order]) < keep]
            found.append((i[order] + lo, j[order], c[order]))
        return tuple(np.concatenate(v) for v in zip(*found))


def _directions(sketches: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(sketches), np.int8).reshape(-1, SKETCH).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


_OUT = pa.schema([
    ("a", pa.int64()), ("own", pa.int64()), ("b", pa.list_(pa.int64())), ("sim", pa.list_(pa.float64())), ("fresh", pa.list_(pa.bool_())),
    ("home", pa.list_(pa.int64())), ("sketch", pa.binary()),
])
_OUT_DDL = "a long, own long, b array<long>, sim array<double>, fresh array<boolean>, home array<long>, sketch binary"


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def _ranks(a: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    first = _firsts(a)
    return np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))


def _lists(a: np.ndarray, b: np.ndarray, sim: np.ndarray, fresh: np.ndarray, home: np.ndarray, keep: int, names: np.ndarray, sketches: list[bytes]) -> pa.Table:
    """One row a node: of the pairs (a, b) of positions, each once and old rather than new, the ``keep`` best, ties to the smaller id."""
    order = np.lexsort((fresh, names[b], -sim, a))
    first = order[_firsts(a[order], b[order])]
    first = first[_ranks(a[first]) < keep]
    a, b = a[first], b[first]
    edge = _firsts(a)
    offsets = pa.array(np.append(edge, len(a)), pa.int32())
    column = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
    return pa.table([
        pa.array(names[a[edge]], pa.int64()), pa.array(home[a[edge]], pa.int64()), column(names[b], pa.int64()), column(sim[first], pa.float64()),
        column(fresh[first], pa.bool_()), column(home[b], pa.int64()),
        pa.array([sketches[i] if i < len(sketches) else None for i in a[edge]], pa.binary()),
    ], schema=_OUT)


def _settle_cell(dims: int, k: int, keep: int, least: float, rounds: int | None, check: bool):
    """The graph of one cell: every node linked to random others, then joins of the links of either direction at every
    node until they change fewer than ``least`` of the entries of the k-lists, then the check."""

    def run(nodes: pa.Table) -> pa.Table:
        if nodes.num_rows < 2:
            return _OUT.empty_table()
        cell = _Cell(nodes, dims)
        n = len(cell.ids)
        if n < 2:
            return _OUT.empty_table()
        if cell.table is None and check and rounds is None:  # too large for its table: all pairs, block by block
            a, b, sim = cell.best(keep)
        else:
            rng = np.random.default_rng(int(nodes["cell"][0].as_py()) & 0xFFFFFFFF)
            # numbers under n - 1 that step over the node itself; one drawn twice counts once
            drawn = rng.integers(0, n - 1, (n, keep + 2)) if n > 2 * keep else np.tile(np.arange(n - 1), (n, 1))
            a = np.repeat(np.arange(n), drawn.shape[1])
            pool = np.zeros((n, n), bool)
            pool[a, drawn.ravel() + (drawn.ravel() >= a)] = True
            a, b, sim = cell.best(keep, pool)
            done = 0
            while rounds is None or done < rounds:
                done += 1
                pool[:] = False
                pool[a, b] = pool[b, a] = True
                centre, member, _ = cell.best(2 * keep, pool)
                around = np.repeat(np.arange(n)[:, None], 2 * keep, axis=1)
                around[centre, _ranks(centre)] = member
                pool[b, a] = False
                pool[a, b] = True
                for lo in range(0, n, 512):
                    pool[around[lo:lo + 512, :, None], around[lo:lo + 512, None, :]] = True
                was = (a * n + b)[_ranks(a) < k]
                a, b, sim = cell.best(keep, pool)
                if (~np.isin((a * n + b)[_ranks(a) < k], was)).sum() < max(1, least * k * n):
                    break
            if check:
                a, b, sim = cell.best(keep)
            del pool
        out = _lists(a, b, sim, np.ones(len(a), bool), cell.home, keep, cell.ids, cell.sketches)
        del cell, nodes
        give_back()
        return out

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("other", pa.int64()), ("place", pa.int64()), ("home", pa.int64()), ("other_home", pa.int64())])


def _apart_cell(k: int, keep: int, margin: float):
    """Joins at the nodes of one cell: pairs of neighbours, one of them new, that share no cell, but whose projections
    say that they may belong into a k-list.

    Rows are the lists of the cell's nodes and of those that link here."""

    def run(lists: pa.Table) -> pa.Table:
        here = int(lists["cell"][0].as_py())
        lists = lists.combine_chunks()
        flat = lambda c: lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        count = lists["b"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        ids, sims, fresh = lists["a"].to_numpy(), flat("sim"), flat("fresh").astype(bool)
        owner, target = np.repeat(ids, count), flat("b")
        names, at = np.unique(np.concatenate([ids, target]), return_index=True)
        home = np.concatenate([lists["own"].to_numpy(), flat("home")])[at]
        one, two = home >> _SHIFT, home & _LOW
        inside = (one == here) | (two == here)
        src, dst = np.searchsorted(names, owner), np.searchsorted(names, target)
        centre, member = np.concatenate([src, dst]), np.concatenate([dst, src])
        sim, new = np.concatenate([sims, sims]), np.concatenate([fresh, fresh])
        # only a node of the cell with a neighbour outside it has neighbours that share no cell
        mixed = np.zeros(len(names), bool)
        mixed[centre[~inside[member]]] = True
        mine = (mixed & inside)[centre]
        centre, member, sim, new = centre[mine], member[mine], sim[mine], new[mine]
        if not len(centre):
            return _PAIRS.empty_table()
        ends = np.full(len(names), -2.0)  # what the k-lists end with
        last = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) == k - 1
        ends[src[last]] = sims[last]
        listed = np.searchsorted(names, ids)
        sketch = np.zeros((len(names), SKETCH), np.float32)
        sketch[listed] = _directions(lists["sketch"].to_pylist())
        known = np.zeros(len(names), bool)
        known[listed] = True

        # neighbours of either direction, the 2 x keep best of each
        order = np.lexsort((member, -sim, centre))
        centre, member, new = centre[order], member[order], new[order]
        first = _firsts(centre, member)
        new = np.logical_or.reduceat(new, first)
        centre, member = centre[first], member[first]
        rank = _ranks(centre)
        near = rank < 2 * keep
        centre, member, new, rank = centre[near], member[near], new[near], rank[near]
        busy, centre = np.unique(centre, return_inverse=True)
        spots = np.full((len(busy), 2 * keep), -1, np.int64)
        fresh_ = np.zeros((len(busy), 2 * keep), bool)
        spots[centre, rank], fresh_[centre, rank] = member, new
        upper, far = np.triu(np.ones((2 * keep, 2 * keep), bool), 1)[None], []
        for lo in range(0, len(busy), 512):
            at, is_new = spots[lo:lo + 512], fresh_[lo:lo + 512]
            there = (at >= 0) & known[at]
            r, i, j = np.nonzero((is_new[:, :, None] | is_new[:, None, :]) & upper & there[:, :, None] & there[:, None, :])
            a, b = at[r, i], at[r, j]
            apart = (one[a] != one[b]) & (one[a] != two[b]) & (two[a] != one[b]) & (two[a] != two[b])
            a, b = a[apart], b[apart]
            pair = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
            a, b = pair // len(names), pair % len(names)
            likely = np.einsum("ij,ij->i", sketch[a], sketch[b]) >= np.minimum(ends[a], ends[b]) - margin
            far.append(pair[likely])
        pair = np.unique(np.concatenate(far))
        a, b = pair // len(names), pair % len(names)
        return pa.table([pa.array(names[a]), pa.array(names[b]), pa.array(one[a]), pa.array(home[a]), pa.array(home[b])], schema=_PAIRS)

    return run


def _score_apart(dims: int, keep: int):
    """Compares pairs that share no cell: the lists that come of them."""

    def run(pairs: pa.Table, codes: pa.Table) -> pa.Table:
        if not pairs.num_rows or not codes.num_rows:
            return _OUT.empty_table()
        names, at = np.unique(codes["id"].to_numpy(), return_index=True)
        home, code = codes["home"].to_numpy()[at], codes["code"].take(pa.array(at)).to_pylist()
        i, j = np.searchsorted(names, pairs["a"].to_numpy()), np.searchsorted(names, pairs["other"].to_numpy())
        c = np.concatenate([exact_cosine([code[v] for v in i[lo:lo + 1000]], [code[v] for v in j[lo:lo + 1000]], dims) for lo in range(0, len(i), 1000)])
        return _lists(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([c, c]), np.ones(2 * len(c), bool), home, keep, names, [])

    return run


class Graph:
    """near(a, own, b, sim, fresh, home), light(node, hash, sketch, cells), groups(node, hash, ids, copies), members(id, hash),
    nodes(id, hash, sketch, code: every vector, copies too) and how it was built:
    rounds holds (pairs compared, entries of k-lists changed) of each round across cells."""

    def __init__(self, near, light, groups, members, nodes, dims: int, rounds: list[tuple[int, int]]):
        self.near, self.light, self.groups, self.members, self.nodes, self.dims, self.rounds = near, light, groups, members, nodes, dims, rounds

    def codes(self) -> DataFrame:
        """(id, code) of every node once."""
        return self.nodes.join(self.light.select(F.col("node").alias("id"), "hash"), ["id", "hash"]).select("id", "code").dropDuplicates(["id"])

    def links(self) -> DataFrame:
        """(a, b, sim): one row a link, best first within a node."""
        return self.near.select("a", F.explode(F.arrays_zip("b", "sim")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.sim").alias("sim"))


def build_graph(
    vectors: DataFrame, id_col: str, vector_col: str, dims: int, k: int = 5, cell: int = CELL, border: float = BORDER,
    margin: float = 0.1, least: float = 0.002, rounds: int | None = None, keep: int = LIST, check: bool = True, broadcast_limit: int = 200_000,
) -> Graph:
    """The neighbour graph of all usable vectors.

    Rounds in a cell, and those across cells, end once one changes fewer than ``least`` of the entries of
    all k-lists (lists only ever get better, so this comes); ``rounds`` ends either earlier and without
    ``check`` the last comparison is left out, for measurements. An empty input gives empty tables.
    """
    encoded = store(encode_vectors(vectors, id_col, vector_col, dims))
    members = encoded.select("id", "hash")
    part = F.pmod(F.xxhash64("id"), F.lit(32))
    some = encoded.groupBy("hash", part.alias("part")).agg(
        F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.count_distinct("id").alias("copies"), F.first("sketch").alias("sketch")
    )
    groups = some.groupBy("hash").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.sum("copies").alias("copies"), F.first("sketch").alias("sketch")
    )
    groups = store(groups.select(F.col("ids")[0].alias("node"), "hash", "ids", "copies", "sketch"))
    total = groups.count()
    count = max(1, min(CENTRES, total // cell))
    sample = groups.select("sketch")
    if total > SAMPLE:
        sample = sample.sample(min(1.0, 1.2 * SAMPLE / total), seed=11).limit(SAMPLE)
    sketches = np.array([np.frombuffer(r["sketch"], np.int8) for r in sample.collect()]).reshape(-1, SKETCH)
    centres = fit_centres(sketches if len(sketches) else np.zeros((1, SKETCH), np.int8), count, 0)

    def counted(udf, *columns: str, of: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        """``of`` with its cells, stored, and the nodes of each: one row a centre, later for every few thousand nodes."""
        placed = store(of.select("node", "hash", "sketch", udf(*columns).alias("cells")))
        if of is not groups:
            drop_stored(of)
        return placed, {r["cell"]: r["count"] for r in placed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}

    placed, sizes = counted(_placer(centres, border), "sketch", of=groups)
    if len(centres) > 1 and any(sizes.get(c << 32, 0) < LEAST for c in range(len(centres))):
        centres = centres[[c for c in range(len(centres)) if sizes.get(c << 32, 0) >= LEAST] or [0]]
        drop_stored(placed)
        placed, sizes = counted(_placer(centres, border), "sketch", of=groups)
    bits = np.zeros(len(centres), np.int64)
    for at, n in sizes.items():
        if n > 4 * cell:
            bits[at >> 32] = int(np.ceil(np.log2(n / (4 * cell))))
    if bits.any():
        placed, sizes = counted(_splitter(centres, bits), "sketch", "cells", of=placed)
    largest: dict[int, int] = {}
    for at in sorted(sizes):
        if sizes[at] > sizes.get(largest.get(at >> 32, -1), 0):
            largest[at >> 32] = at
    kept = {at: i for i, at in enumerate(at for at in sorted(sizes) if sizes[at] >= LEAST or largest[at >> 32] == at)}
    numbered = _numberer(kept, largest)
    light = store(placed.select("node", "hash", "sketch", numbered("cells").alias("cells")))
    drop_stored(placed)
    # one row a node and cell, brought together once: no round moves the codes of a cell again
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 20_000))
    many = groups.where("copies > 1").select("hash", "node")
    if total > broadcast_limit >= many.count():
        # too many nodes to lend, but few with copies: each row finds its cells itself, and no shuffle brings it to them first
        cells = _placer(centres, border)("sketch")
        cells = numbered(_splitter(centres, bits)("sketch", cells) if bits.any() else cells)
        own = encoded.join(F.broadcast(many), "hash", "left").where("node is null or id = node")
        nodes = _by_cell(own.withColumn("cells", cells))
    else:
        nodes = node_rows(encoded, light, total, broadcast_limit)
    nodes = nodes.repartition(parts, "cell")

    near = _merged(nodes.groupBy("cell").applyInArrow(_settle_cell(dims, k, keep, least, rounds, check), _OUT_DDL), keep)
    log: list[tuple[int, int]] = []
    while len(kept) > 1 and (rounds is None or len(log) < rounds):
        pairs = store(_lists_by_cell(near).groupBy("cell").applyInArrow(_apart_cell(k, keep, margin), "a long, other long, place long, home long, other_home long").distinct())
        sent = pairs.count()
        if not sent:
            drop_stored(pairs)
            break
        ends = F.array(F.struct(F.col("a").alias("id"), "home"), F.struct(F.col("other").alias("id"), F.col("other_home").alias("home")))
        wanted = pairs.select(F.col("place").alias("to"), F.explode(ends).alias("s")).select("to", "s.id", "s.home").distinct()
        codes = _sent_codes(encoded, light, wanted, sent, broadcast_limit)
        found = pairs.groupBy("place").cogroup(codes.groupBy("to")).applyInArrow(_score_apart(dims, keep), _OUT_DDL)
        aged = near.withColumn("fresh", F.transform("b", lambda _: F.lit(False)))
        last, near = near, _merged(aged.unionByName(found), keep)
        drop_stored(last), drop_stored(pairs)
        log.append((sent, _news(near, k)))
        if log[-1][1] < max(1, least * k * total):
            break
    return Graph(near, light, groups, members, encoded, dims, log)


def _first_cell(home):
    return F.shiftright(home, _SHIFT)


def _cells(home):
    """The one or two cells of a node."""
    return F.array_distinct(F.array(_first_cell(home), home.bitwiseAND(F.lit(_LOW))))


def _lend(df: DataFrame, count: int, limit: int) -> DataFrame:
    """``df`` for broadcast while it has at most ``limit`` narrow rows, as it is beyond that."""
    return F.broadcast(df) if count <= limit else df


def _merged(worked: DataFrame, keep: int) -> DataFrame:
    """One row a node of what the cells return: each neighbour once, old rather than new, the ``keep`` best, ties to the smaller id."""
    entries = F.transform(F.arrays_zip("b", "sim", "fresh", "home"), lambda s: F.struct((-s["sim"]).alias("far"), s["b"].alias("b"), s["fresh"].alias("fresh"), s["home"].alias("home")))
    whole = worked.groupBy("a").agg(F.first("own").alias("own"), F.array_sort(F.flatten(F.collect_list(entries))).alias("s"), F.max("sketch").alias("sketch"))
    best = F.slice(F.filter("s", lambda s, i: (i == 0) | (F.get("s", i - 1)["b"] != s["b"])), 1, keep)
    rows = whole.withColumn("s", best)
    return store(rows.select(
        "a", "own", F.col("s.b").alias("b"), F.transform("s.far", lambda v: -v).alias("sim"), F.col("s.fresh").alias("fresh"), F.col("s.home").alias("home"), "sketch"
    ))


def _news(near: DataFrame, k: int) -> int:
    """New entries of the k-lists."""
    return near.select(F.sum(F.size(F.filter(F.slice("fresh", 1, k), lambda f: f)))).first()[0] or 0


def node_rows(encoded: DataFrame, light: DataFrame, count: int, broadcast_limit: int = 200_000) -> DataFrame:
    """(cell, id, code, sketch, home): the code of each node once a cell, so copies never reach one; rows delivered
    twice still come twice. ``light`` is broadcast while there are at most ``broadcast_limit`` nodes, and joined beyond that."""
    once = light.select(F.col("node").alias("id"), "hash", "cells")
    return _by_cell(encoded.join(_lend(once, count, broadcast_limit), ["id", "hash"]))


def _by_cell(rows: DataFrame) -> DataFrame:
    pair = F.shiftleft(F.col("cells")[0], _SHIFT) + F.element_at("cells", -1)
    return rows.select(F.explode("cells").alias("cell"), "id", "code", "sketch", pair.alias("home"))


def _lists_by_cell(near: DataFrame) -> DataFrame:
    """The lists in the cells of their node and in the first cell of every neighbour."""
    targets = F.array_distinct(F.concat(_cells(F.col("own")), F.transform("home", _first_cell)))
    return near.select(F.explode(targets).alias("cell"), "a", "own", "b", "sim", "fresh", "home", "sketch")


def _sent_codes(encoded: DataFrame, light: DataFrame, wanted: DataFrame, sent: int, broadcast_limit: int) -> DataFrame:
    """(to, id, code, home) of the nodes ``wanted`` (to, id, home) of ``sent`` pairs; they are broadcast while there are few enough."""
    named = light.select(F.col("node").alias("id"), "hash").join(_lend(wanted, sent, broadcast_limit), "id")
    return encoded.select("id", "hash", "code").join(_lend(named, sent, broadcast_limit), ["id", "hash"]).select("to", "id", "code", "home")


def nearest_ids(graph: Graph, k: int = 5, broadcast_limit: int = 100_000) -> DataFrame:
    """(id, other, sim, place): the k nearest ids of every id; ties go to the smaller id, itself is left out.

    Copies of one vector are each other's nearest. A node carries its k + 1 smallest ids only, so a
    vector with very many copies costs one row a copy.
    """
    many = cut(graph.groups.where("copies > 1").select("node", "hash", "ids"))
    small = many.count() <= broadcast_limit
    lend = F.broadcast if small else (lambda df: df)
    far = graph.links().select("a", "b", (-F.col("sim")).alias("far"))
    spelled = far.join(lend(many.select(F.col("node").alias("b"), F.col("ids").alias("b_ids"))), "b", "left").select(
        "a", "far", F.explode(F.coalesce("b_ids", F.array("b"))).alias("other")
    )
    lists = spelled.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k).alias("lists"))
    none = F.array().cast("array<struct<far:double,other:bigint>>")
    full = lists.join(lend(many.select(F.col("node").alias("a"), "hash", "ids")), "a", "full").select(
        F.col("a").alias("node"), "hash",
        F.concat(F.coalesce(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("other"))), none), F.coalesce("lists", none)).alias("all"),
    )
    alone = full.where("hash is null").select(F.col("node").alias("id"), "all")
    copies = graph.members.select("id", "hash").distinct().join(lend(full.where("hash is not null").select("hash", "all")), "hash").select("id", "all")
    mine = alone.unionByName(copies).select("id", F.slice(F.filter("all", lambda s: s["other"] != F.col("id")), 1, k).alias("best"))
    return mine.select("id", F.posexplode("best").alias("place", "s")).select(
        "id", F.col("s.other").alias("other"), (-F.col("s.far")).alias("sim"), (F.col("place") + 1).alias("place")
    )


def greedy_search(graph: Graph, queries: DataFrame, k: int = 5, beam: int = 12, starts: int = 8) -> DataFrame:
    """(q, node, sim, place): the k nearest nodes of every query (q BIGINT, code BINARY, sketch BINARY, cells ARRAY<BIGINT>), by walking the graph.

    Groups of similar vectors need not be linked to each other, so a walk starts at the ``starts`` nodes of
    the query's own cells that look nearest in the projection. Each step looks at the neighbours, either
    way, of the ``beam`` best nodes seen so far and keeps the best; it ends when a step brings no query
    anything new. A query whose cells hold no node finds nothing. Of the links to a node from others it
    walks the best, as many as a list is long; the others are walked from their own end.
    """
    dims = graph.dims

    def enter(nodes: pa.Table, asks: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("node", pa.int64())])
        if not nodes.num_rows or not asks.num_rows:
            return schema.empty_table()
        read = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, SKETCH).astype(np.float32)
        x, ids, asked = read(nodes["sketch"]), nodes["node"].to_numpy(), asks["q"].to_numpy()
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        take, q, n = min(starts, len(x)), [], []
        y = read(asks["asked_sketch"])
        for at in range(0, len(y), 1024):
            best = np.argpartition(-(y[at:at + 1024] @ x.T), take - 1, axis=1)[:, :take]
            q.append(np.repeat(asked[at:at + 1024], take))
            n.append(ids[best.ravel()])
        return pa.table([pa.array(np.concatenate(q)), pa.array(np.concatenate(n))], schema=schema)

    places = graph.light.select("node", "sketch", F.explode("cells").alias("cell"))
    asks = queries.select("q", F.col("sketch").alias("asked_sketch"), F.explode("cells").alias("asked_cell"))
    fresh = cut(places.groupBy("cell").cogroup(asks.groupBy("asked_cell")).applyInArrow(enter, "q long, node long").distinct())
    links = graph.links()
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a"))
    back = links.withColumn("r", best).where(F.col("r") <= LIST).select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = cut(links.select("a", "b").unionByName(back).groupBy("a").agg(F.collect_set("b").alias("near")))
    seen = None
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    while not fresh.isEmpty():
        scored = _score_queries(fresh, queries, graph.codes(), dims).withColumn("walked", F.lit(False))
        seen = cut(scored if seen is None else seen.unionByName(scored))
        best = seen.withColumn("r", rank)
        frontier = best.where((F.col("r") <= beam) & ~F.col("walked")).select("q", "node")
        step = frontier.join(around, F.col("node") == F.col("a")).select("q", F.explode("near").alias("node")).distinct()
        fresh = cut(step.join(seen.select("q", "node"), ["q", "node"], "left_anti"))
        seen = best.withColumn("walked", F.col("walked") | (F.col("r") <= beam)).drop("r")
    if seen is None:
        return fresh.select("q", "node", F.lit(0.0).alias("sim"), F.lit(0).alias("place"))
    return seen.withColumn("place", rank).where(F.col("place") <= k).select("q", "node", "sim", "place")


def _score_queries(pairs: DataFrame, queries: DataFrame, codes: DataFrame, dims: int, broadcast_limit: int = 200_000) -> DataFrame:
    """(q, node, sim) of (q, node) pairs; each code goes once to each of the places that score it, of about 20,000 pairs each."""
    count = pairs.count()
    place = F.pmod(F.xxhash64("q"), F.lit(max(16, count // 20_000)))
    placed = pairs.withColumn("place", place)
    wanted = placed.select("place", F.col("node").alias("id")).distinct()
    nodes = codes.join(_lend(wanted, count, broadcast_limit), "id").select(F.col("place").alias("spot"), F.lit(False).alias("asks"), "id", "code")
    asks = queries.select(place.alias("spot"), F.lit(True).alias("asks"), F.col("q").alias("id"), "code")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("node", pa.int64()), ("sim", pa.float64())])
        codes = dict(zip(zip(right["asks"].to_pylist(), right["id"].to_pylist()), right["code"].to_pylist()))
        q, node = left["q"].to_pylist(), left["node"].to_pylist()
        sims = [exact_cosine([codes[True, i] for i in q[at:at + 1000]], [codes[False, i] for i in node[at:at + 1000]], dims) for at in range(0, len(q), 1000)]
        return pa.table([pa.array(q, pa.int64()), pa.array(node, pa.int64()), pa.array(np.concatenate(sims) if sims else np.zeros(0))], schema=schema)

    return placed.groupBy("place").cogroup(nodes.unionByName(asks).groupBy("spot")).applyInArrow(score, "q long, node long, sim double")
