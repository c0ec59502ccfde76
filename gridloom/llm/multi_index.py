"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut in halves, each half has a codebook, and the two nearest words
are a vector's cell in the product grid. A vector visits cells in multi-sequence
order, the nearest first by the squared distances of its halves to the words'
borders, until the target recall is reached; every vector met there is verified
in double precision. A target of 1 is reached where the distance exceeds the
radius, for no neighbour can lie behind it. A lower target is reached at the
distance that holds this part of the links of a sample of vectors to all others.

Cells are dealt to tasks in blocks of neighbouring cells of a label. A vector is
sent once to a block in which it visits any cell, and visits the cells there, so
the shuffle grows with the blocks of a label and not with the visits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.components import connected, forest
from gridloom.llm.tables import stash

THRESHOLD = 0.98
#: Vectors the codebooks are fitted on at most; all vectors are indexed.
FIT_ON = 20_000
#: Links that are to be found. At 1 the stop follows from the radius alone and none is lost, whatever the data.
TARGET = 1.0
#: Below a target of 1: vectors whose links to all others are measured, the links this takes (with fewer the stop is that
#: of target 1), and the distances told apart.
PROBES = 512
LEAST_LINKS = 1_000
STEPS = 200
#: Vectors of a cell that are compared at once.
CELL = 4_096
#: Components of the vectors that live in a block, from the least to the most: 32 to 128 MB in double precision. Of the
#: components of the whole table a block has a part in ``SHARE`` between these; one with more than that has more blocks.
#: The last cell of a block may exceed it, by as much again at most; a cell above it is dealt over several blocks.
HELD = (1 << 22, 1 << 24)
SHARE = 64
#: Rows of a block below which they are one cell.
FEW = 64
#: Edges held in a task before they are written.
EDGES = 1 << 20
#: Words of a codebook, the fewest and the most: as many as leave some 500 vectors to a cell of the grid.
WORDS = (4, 1_024)
#: Border distances, and visits at most, held at once while cells are visited (for ``FEWEST`` rows it may be more).
BLOCK = 1 << 21
FEWEST = 64


class Codebooks:
    """Two codebooks for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, words: int):
        self._cut = sample.shape[1] // 2
        self.books = [_lloyd(half, words) for half in self._halves(sample)]

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self._cut], x[:, self._cut:]]

    @cached_property
    def _apart(self) -> list[np.ndarray]:
        """Distances between the words of each half."""
        return [np.stack([np.sqrt(((book - word) ** 2).sum(axis=1)) for word in book]) for book in self.books]

    def borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the nearest word of every row and the squared distances to the borders of all words."""
        out = []
        for half, book, apart in zip(self._halves(x), self.books, self._apart):
            far = _squares(half, book)
            own = far.argmin(axis=1)
            between = apart[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = (far - far[np.arange(len(far)), own][:, None]) / (2 * between)
            out.append((own, np.where(between > 0, np.maximum(border, 0), 0.0) ** 2))
        return out

    def cell(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * len(self.books[1]) + second

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of every unit vector."""
        out = [np.zeros(0, dtype=np.int64)]
        some = max(1, BLOCK // max(map(len, self.books)))
        for at in range(0, len(x), some):
            first, second = (_squares(half, book).argmin(axis=1) for half, book in zip(self._halves(x[at:at + some]), self.books))
            out.append(self.cell(first, second))
        return np.concatenate(out)

    def visits(self, x: np.ndarray, stop: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) of the cells that unit vectors visit up to the distance ``stop``, their own included, some rows at a time."""
        some = max(FEWEST, BLOCK // (len(self.books[0]) * len(self.books[1])))
        for at in range(0, len(x), some):
            (_, near1), (_, near2) = self.borders(x[at:at + some])
            met = [(row + at, self.cell(first, second)) for row, first, second in _multi_sequence(near1, near2, stop ** 2 + 1e-9)]
            if met:
                rows, cells = zip(*met)
                yield np.concatenate(rows), np.concatenate(cells)


class OneCell:
    """Stands in for codebooks where vectors are too few, or of a dimension that is not in the sample."""

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x), dtype=np.int64)

    def visits(self, x: np.ndarray, stop: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(x)), np.zeros(len(x), dtype=np.int64)


class Ranges:
    """The blocks of a label: cells from ``first`` to ``last`` live in the blocks from ``low`` to ``high``, several only for one large cell."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self._first, self._last, self._low, self._high = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))

    def home(self, cell: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The block a vector lives in."""
        at = np.searchsorted(self._first, cell, side="right") - 1
        return self._low[at] + (node ^ node >> 33) % (self._high[at] - self._low[at] + 1)

    def visited(self, row: np.ndarray, cell: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block), each once, of the other blocks that rows are sent to. Of two blocks that would send rows to each other one does."""
        at = np.searchsorted(self._first, cell, side="right") - 1
        there = (at >= 0) & (cell <= self._last[at])
        pairs = np.unique(row[there] * len(self._first) + at[there])
        row, at = pairs // len(self._first), pairs % len(self._first)
        times = self._high[at] - self._low[at] + 1
        row, block = np.repeat(row, times), np.repeat(self._low[at], times) + _places(times)
        pairs = np.unique(np.stack([row, block], axis=1), axis=0)
        row, block = pairs[:, 0], pairs[:, 1]
        own = home[row]
        sent = (block != own) & ((block > own) == ((block + own) % 2 == 0))
        return row[sent], block[sent]


def _places(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs of the given lengths."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _multi_sequence(near1: np.ndarray, near2: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of words (row, first, second) by growing sum of the two distances, up to ``limit``; a step gives each row its next pair.

    ``taken`` has, for each rank of the first half, how many ranks of the second have gone with it. The next pair is the
    nearest of those whose predecessors in both halves have been given.
    """
    order1, order2 = np.argsort(near1, axis=1, kind="stable"), np.argsort(near2, axis=1, kind="stable")
    near1, near2 = np.take_along_axis(near1, order1, axis=1), np.take_along_axis(near2, order2, axis=1)
    # Words that are too far by themselves are never given, so their ranks are left out.
    wide1, wide2 = (max(1, int((near <= limit).sum(axis=1).max())) for near in (near1, near2))
    near1, near2 = near1[:, :wide1], np.pad(near2[:, :wide2], ((0, 0), (0, 1)), constant_values=np.inf)
    active = np.arange(len(near1))
    taken = np.zeros(near1.shape, dtype=np.int64)
    while len(active):
        cost = near1 + np.take_along_axis(near2, taken, axis=1)
        cost[:, 1:][taken[:, 1:] >= taken[:, :-1]] = np.inf
        first = cost.argmin(axis=1)
        here = np.arange(len(active))
        go = cost[here, first] <= limit
        if not go.all():
            active, near1, near2, taken, first = active[go], near1[go], near2[go], taken[go], first[go]
            here = here[:len(active)]
        second = taken[here, first]
        yield active, order1[active, first], order2[active, second]
        taken[here, first] += 1


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(axis=1)[:, None] - 2 * a @ b.T + (b ** 2).sum(axis=1)[None], 0)


def _lloyd(points: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    book = np.unique(points[np.linspace(0, len(points) - 1, min(words, len(points))).astype(int)], axis=0)
    for _ in range(rounds):
        own = _squares(points, book).argmin(axis=1)
        count = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, points)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    top = float(np.finfo(np.float64).max)
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= top, F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label); no rows give none, other columns play no part.

    ``target`` is the part of the links that is to be found; 1 finds all of them.

    Rows link if labels are equal and the cosine is ``threshold`` or more. Null
    labels, unusable vectors and vectors of different lengths link with nothing;
    they are their own component. Equal vectors of a label are one point with a
    count, so a frequent vector costs one row. component_id is the smallest
    vec_id of the component, nulls passed over; kept is vec_id = component_id.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("vector"))
    linking = F.col("label").isNotNull() & usable(F.col("vector"))
    # Of the two zeros one, as in grouping, so that equal vectors have equal keys.
    fine = rows.where(linking).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast(kind[6:-1])))
    points = fine.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    points = points.select(F.monotonically_increasing_id().alias("node"), "label", "vector", "first_id", "n", _key().alias("key"))
    points = stash(points, "vector-points")

    told = points.select(F.col("label").cast("long").alias("label"), F.size("vector").alias("dim"), "node", "n", "vector")
    codebooks = _fit(points)
    stop = _stop(points, codebooks, threshold, target)
    ranges = _blocks(told, codebooks)
    met = told.mapInArrow(lambda b: _place(b, codebooks, ranges, stop), f"label long, dim int, block int, visitor boolean, node long, n long, vector {kind}")
    block = ["label", "dim", "block"]
    met = met.repartition(*block).sortWithinPartitions(*block, "visitor")
    found = stash(met.mapInArrow(lambda b: _verify(b, codebooks, stop, threshold), "a long, b long, n long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected(found.where("b is not null").select("a", "b"))
    placed = points.select("node", "key", "first_id", "n").join(roots, "node", "left").join(links, "node", "left")
    placed = placed.select("key", "first_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(first, "root").select("key", "n_links", "component_id")
    # Vectors stay behind here: a row finds its point by the digest of label and vector.
    out = fine.select("vec_id", _key().alias("key")).join(placed, "key").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where(~linking).select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def _key() -> Column:
    """SHA-256 of label and vector; a float's text names that float only."""
    return F.unhex(F.sha2(F.concat(F.col("label").cast("string"), F.col("vector").cast("string")), 256))


def _sample(points: DataFrame, order: Column, rows: int, count: int) -> DataFrame:
    """The ``rows`` points of smallest hash. Only hashes below a bound that lets some more through are sorted."""
    bound = int(min(1.0, (1.2 * rows + 100) / max(count, 1)) * 2 ** 64) - 2 ** 63 - 1
    return points.where(order <= F.lit(bound)).orderBy(order, "node").limit(rows)


def _fit(points: DataFrame) -> dict[int, Codebooks]:
    """Codebooks for each dimension of a sample; a dimension that is not in it has one cell."""
    count = points.count()
    sample = [r[0] for r in _sample(points, F.xxhash64("node"), FIT_ON, count).select("vector").collect()]
    words = int(np.clip(np.sqrt(count / 500), *WORDS))
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    return {d: Codebooks(_unit(np.array(vs)), words) for d, vs in by_size.items() if d > 1}


def _stop(points: DataFrame, codebooks: dict[int, Codebooks], threshold: float, target: float) -> float:
    """The distance up to which cells are visited: that within which ``target`` of the links of sampled vectors to all others lie."""
    radius = float(np.sqrt(2 - 2 * threshold))
    if target >= 1:
        return radius
    probed = _sample(points, F.xxhash64("node", F.lit("probe")), PROBES, points.count())
    probes: dict[tuple[int, int], list] = defaultdict(list)
    for label, node, vector in probed.select("label", "node", "vector").collect():
        probes[label, len(vector)].append((node, vector))
    measured = points.select("label", "vector", "node", "n").mapInArrow(lambda b: _needed(b, codebooks, dict(probes), threshold, radius), "step int, links long")
    links = np.zeros(STEPS + 1)
    for step, count in measured.groupBy("step").agg(F.sum("links")).collect():
        links[step] = count
    if links.sum() < LEAST_LINKS:
        return radius
    return radius * int(np.searchsorted(np.cumsum(links), target * links.sum())) / STEPS


def _needed(batches: Iterator[pa.RecordBatch], codebooks: dict[int, Codebooks], probes: dict, threshold: float, radius: float) -> Iterator[pa.RecordBatch]:
    """Links between a batch and the probes, counted by the distance, in steps, up to which each side has to visit the other."""
    for batch in batches:
        sizes, labels = np.array(batch["vector"].value_lengths()), batch["label"].to_numpy(zero_copy_only=False)
        node, n = batch["node"].to_numpy(), batch["n"].to_numpy()
        flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        links = np.zeros(STEPS + 1, dtype=np.int64)
        for (label, size), held in probes.items():
            rows = np.flatnonzero((sizes == size) & (labels == label))
            if not len(rows) or size not in codebooks:
                continue
            x = _unit(flat[(ends[rows] - size)[:, None] + np.arange(size)])
            p = _unit(np.array([vector for _, vector in held]))
            i, j = np.nonzero((x @ p.T >= threshold) & (node[rows][:, None] != np.array([each for each, _ in held])[None]))
            book = codebooks[size]
            (own1, near1), (own2, near2) = book.borders(x[i])
            (to1, back1), (to2, back2) = book.borders(p[j])
            at = np.arange(len(i))
            ahead, back = near1[at, to1] + near2[at, to2], back1[at, own1] + back2[at, own2]
            own, to = book.cell(own1, own2), book.cell(to1, to2)
            distance = np.sqrt(np.where(own == to, 0.0, np.maximum(ahead, back)))
            step = np.minimum(np.ceil(distance / radius * STEPS), STEPS).astype(np.int64)
            np.add.at(links, step, n[rows][i])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"step": pa.array(some, pa.int32()), "links": pa.array(links[some], pa.int64())})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _blocks(told: DataFrame, codebooks: dict[int, Codebooks]) -> dict[tuple[int, int], Ranges]:
    """The blocks of each label and dimension that has more than one; two entries a block at most reach the driver."""
    sizes = told.groupBy("label", "dim").agg((F.count(F.lit(1)) * F.col("dim")).alias("held"))
    held = float(np.clip((sizes.agg(F.sum("held")).first()[0] or 0) / SHARE, *HELD))
    large = {(label, dim) for label, dim in sizes.where(F.col("held") > held).select("label", "dim").collect()}
    if not large:
        return {}
    homes = told.select("label", "dim", "vector").mapInArrow(lambda b: _homes(b, codebooks, large), "label long, dim int, cell long")
    cells = homes.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.ceil(F.lit(held) / F.col("dim"))
    cells = cells.withColumn("before", before).withColumn("low", F.floor(F.col("before") / most))
    cells = cells.withColumn("high", F.when(F.col("n") > most, F.floor((F.col("before") + F.col("n") - 1) / most)).otherwise(F.col("low")))
    rows = cells.groupBy("label", "dim", "low", "high").agg(F.min("cell").alias("first"), F.max("cell").alias("last"))
    out: dict[tuple[int, int], list] = defaultdict(list)
    for r in rows.collect():
        out[r["label"], r["dim"]].append((r["first"], r["last"], r["low"], r["high"]))
    return {k: Ranges(v) for k, v in out.items()}


def _vectors(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    """Unit vectors of rows that have ``dim`` components."""
    column = batch["vector"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _homes(batches: Iterator[pa.RecordBatch], codebooks: dict[int, Codebooks], large: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, dims = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "dim"))
        for label, dim in large:
            rows = np.flatnonzero((labels == label) & (dims == dim))
            if len(rows):
                cells = codebooks.get(dim, OneCell()).homes(_vectors(batch.take(pa.array(rows)), dim))
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(np.full(len(rows), label), pa.int64()), "dim": pa.array(np.full(len(rows), dim), pa.int32()), "cell": pa.array(cells)})


def _place(batches: Iterator[pa.RecordBatch], codebooks: dict[int, Codebooks], ranges: dict[tuple[int, int], Ranges], stop: float) -> Iterator[pa.RecordBatch]:
    """Each vector in the block it lives in and, as a visitor, in the blocks it is sent to."""
    for batch in batches:
        labels, dims = (batch[c].to_numpy(zero_copy_only=False) for c in ("label", "dim"))
        node = batch["node"].to_numpy()
        home, rows, blocks = np.zeros(batch.num_rows, dtype=np.int64), [], []
        for (label, dim), of_label in ranges.items():
            own = np.flatnonzero((labels == label) & (dims == dim))
            if not len(own):
                continue
            book, x = codebooks.get(dim, OneCell()), _vectors(batch.take(pa.array(own)), dim)
            home[own] = of_label.home(book.homes(x), node[own])
            for row, cell in book.visits(x, stop):
                row, block = of_label.visited(row, cell, home[own])
                rows.append(own[row])
                blocks.append(block)
        yield _sent(batch, np.arange(batch.num_rows), home, False)
        if rows:
            rows, blocks = np.concatenate(rows), np.concatenate(blocks)
            for at in range(0, len(rows), 20_000):
                yield _sent(batch, rows[at:at + 20_000], blocks[at:at + 20_000], True)


def _sent(batch: pa.RecordBatch, rows: np.ndarray, blocks: np.ndarray, visitor: bool) -> pa.RecordBatch:
    out = batch.take(pa.array(rows))
    return pa.RecordBatch.from_pydict({
        "label": out["label"], "dim": out["dim"], "block": pa.array(blocks, pa.int32()), "visitor": pa.array(np.full(len(rows), visitor)),
        "node": out["node"], "n": out["n"], "vector": out["vector"]})


class _Block:
    """The vectors that live in a block, sorted by their cells, to be compared with those that visit these cells."""

    def __init__(self, homes: pa.Table, dim: int, book: Codebooks | OneCell, stop: float, threshold: float):
        self._dim, self._stop, self._threshold = dim, stop, threshold
        self._book = book if homes.num_rows > FEW else OneCell()
        x = _vectors(homes, dim)
        cell = self._book.homes(x)
        order = np.argsort(cell, kind="stable")
        self._x, self._cell = x[order], cell[order]
        self._node, self._n = homes["node"].to_numpy()[order], homes["n"].to_numpy()[order]
        self._cells, starts = np.unique(self._cell, return_index=True)
        self._starts = np.append(starts, len(order))
        self._links = np.zeros(len(order), dtype=np.int64)
        self._edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._n_edges = 0

    def among(self) -> Iterator[pa.RecordBatch]:
        """Compares the block's own vectors; of two cells the lower one visits."""
        for lo, hi in zip(self._starts, self._starts[1:]):
            own = np.arange(lo, hi)
            for at in range(lo, hi, CELL):
                yield from self._compare(self._x, self._node, self._n, self._links, own[:at + CELL - lo], at, min(at + CELL, hi), True)
        for row, cell in self._book.visits(self._x, self._stop):
            later = cell > self._cell[row]
            yield from self._meet(self._x, self._node, self._n, self._links, row[later], cell[later])

    def visit(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Compares vectors that live elsewhere with those here."""
        x, node, n = _vectors(batch, self._dim), batch["node"].to_numpy(), batch["n"].to_numpy()
        links = np.zeros(len(node), dtype=np.int64)
        for row, cell in self._book.visits(x, self._stop):
            yield from self._meet(x, node, n, links, row, cell)
        yield _counted(node, links)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield _counted(self._node, self._links)
        yield from self._write(0)

    def _meet(self, x: np.ndarray, node: np.ndarray, n: np.ndarray, links: np.ndarray, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.searchsorted(self._cells, cell)
        here = at < len(self._cells)
        here[here] = self._cells[at[here]] == cell[here]
        row, at = row[here], at[here]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                for start in range(self._starts[at[lo]], self._starts[at[lo] + 1], CELL):
                    yield from self._compare(x, node, n, links, row[lo:hi], start, min(start + CELL, self._starts[at[lo] + 1]), False)

    def _compare(self, x: np.ndarray, node: np.ndarray, n: np.ndarray, links: np.ndarray, rows: np.ndarray, lo: int, hi: int, within: bool) -> Iterator[pa.RecordBatch]:
        """Links of ``rows`` with the block's vectors from ``lo`` to ``hi``; ``within``: both are of this block, and earlier rows meet later ones only."""
        there = self._x[lo:hi].T
        for at in range(0, len(rows), 512):
            some = rows[at:at + 512]
            near = x[some] @ there >= self._threshold
            if within:
                near &= some[:, None] < np.arange(lo, hi)[None]
            if not near.any():
                continue
            i, j = np.nonzero(near)
            a, b = some[i], lo + j
            np.add.at(links, a, self._n[b])
            np.add.at(self._links, b, n[a])
            self._edges.append(forest(node[a], self._node[b]))
            self._n_edges += len(self._edges[-1][0])
            if self._n_edges > EDGES:
                yield from self._write(EDGES // 2)

    def _write(self, most: int) -> Iterator[pa.RecordBatch]:
        """Edges that connect what those held connect; they are held on if they are no more than ``most``."""
        if self._edges:
            a, b = forest(*(np.concatenate(p) for p in zip(*self._edges)))
            self._edges, self._n_edges = [(a, b)], len(a)
            if len(a) > most:
                self._edges, self._n_edges = [], 0
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "n": pa.nulls(len(a), pa.int64())})


def _counted(node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    linked = links > 0
    return pa.RecordBatch.from_pydict({"a": pa.array(node[linked]), "b": pa.nulls(int(linked.sum()), pa.int64()), "n": pa.array(links[linked])})


def _verify(batches: Iterator[pa.RecordBatch], codebooks: dict[int, Codebooks], stop: float, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links counted for each point, and edges that connect what is linked; pairs themselves stay in the task.

    A block's own rows come first and are held; its visitors pass in batches.
    """
    at: tuple[int, int, int] | None = None
    homes: list[pa.RecordBatch] = []
    block: _Block | None = None

    def opened() -> _Block:
        return _Block(pa.Table.from_batches(homes), at[1], codebooks.get(at[1], OneCell()), stop, threshold)

    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "block", "visitor")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            *now, visitor = keys[:, lo].tolist()
            if tuple(now) != at:
                if homes:
                    block = opened()
                    yield from block.among()
                if block:
                    yield from block.close()
                at, homes, block = tuple(now), [], None
            if not visitor:
                homes.append(batch.slice(lo, hi - lo))
                continue
            if homes:
                block, homes = opened(), []
                yield from block.among()
            if block:
                yield from block.visit(batch.slice(lo, hi - lo))
    if homes:
        block = opened()
        yield from block.among()
    if block:
        yield from block.close()
