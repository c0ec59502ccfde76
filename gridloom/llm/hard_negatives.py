"""Hard negatives by an R-tree packed by sort-tile-recursive.

Vectors are sorted into slabs by label, slabs into slabs by one coordinate after
the other, down to pages. A page's box is the least and greatest label and value
of every coordinate, so a query's inner product with any member lies in an
interval that the box alone gives. The boxes of the upper pages decide which
pages a query is sent to; in a page, a tree of boxes is searched best first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import row_count_parts, stash
from gridloom.llm.top_k import usable

SCALE = 256
#: Rows of a page, and queries that meet it in one group.
PAGE = 8_192
ASKING = 65_536
#: Pages told apart by cuts, and coordinates of all their boxes together: this bounds what reaches the driver and every task.
PAGES = 4_096
BOXED = 1 << 18
#: Coordinates of the rows the cuts are taken from. The sample decides how well pages are balanced, not what is found.
SAMPLED = 1 << 21
#: Rows of a leaf, and children of a node.
LEAF = 64
FAN = 16
#: Queries sent on at once.
SENT = 4_096

_KEYS = ["dim", "page", "part", "block"]
_ASKS = "row long, vec_id long, label long, vector array<double>, wanted array<long>"
_FOUND = "row long, place int, vec_id long, score long"


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, embedding, label).

    Components x count as floor(256 x); a score is an integer inner product.
    Anchors are the rows for which ``is_anchor`` holds. Their positives are the
    first ``positives`` rows of the same label and another id, their negatives, for
    each positive, the first ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's. Higher scores come first, then
    smaller ids. An anchor without a positive, or a positive without a negative,
    gives no row.

    Labels are whole numbers. Null ids and labels, and vectors that are null or
    hold null or non-finite components, take no part; vectors of different lengths
    do not meet. A repeated row is one more row: one more candidate, and as an
    anchor it gives its rows again. Scores are exact up to 2^53; beyond, they are
    summed in whole numbers of any size and held to the range of a long. Other
    columns are not read. No rows give no rows.
    """
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"), is_anchor.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    rows = stash(rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vector")}), "negatives-rows")
    index = Index.of(rows)
    asks = rows.where("asks").select("row", "vec_id", "label", "vector")
    asked = asks.count()

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = index.search(asks.withColumn("wanted", F.lit(None).cast("array<long>")), asked, Same(positives))
    near = stash(best(near, positives), "negatives-positives")
    wanted = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("told"))
    wanted = wanted.select("row", F.col("told.score").alias("wanted"))
    far = best(index.search(asks.join(wanted, "row"), asked, Other(negatives, low, high)), negatives)
    far = far.select("row", (F.col("place") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.select("row", F.col("rank").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = far.join(named, ["row", "of"]).join(asks.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# --- what is asked --------------------------------------------------------------


@dataclass(frozen=True)
class Same:
    """The ``k`` best of the query's own label, whatever their score."""

    k: int

    def admits(self, label, least, greatest):
        return (least <= label) & (label <= greatest)

    def windows(self, wanted) -> list[tuple]:
        return [(-np.inf, np.inf)]


@dataclass(frozen=True)
class Other:
    """The ``k`` best of other labels within each of the windows that the positives' scores set."""

    k: int
    low: int
    high: int

    def admits(self, label, least, greatest):
        return (least != label) | (greatest != label)

    def windows(self, wanted) -> list[tuple]:
        return [(-(-self.low * s // 100), self.high * s // 100) for s in wanted]


# --- pages ----------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """Cuts of one coordinate (-1: the label); what lies between two of them goes to the next cut, or is a page."""

    at: int
    values: np.ndarray
    below: tuple


def cut_pages(labels: np.ndarray, values: np.ndarray, pages: int, first: int = 0) -> tuple[Cut | int, int]:
    """Cuts that deal rows like the given ones over about ``pages`` pages, and the number of the next page."""
    names, counts = np.unique(labels, return_counts=True)
    share = counts / max(1, len(labels)) * pages
    # A label of a page or more is a slab of its own; smaller ones share slabs.
    slab, filled, runs = 0, 0.0, []
    for size in share:
        if runs and filled + size > 1:
            slab, filled = slab + 1, 0.0
        runs.append(slab)
        filled += size
    runs = np.array(runs, dtype=np.int64)
    spread = np.argsort(-values.var(axis=0), kind="stable") if len(values) else np.arange(0)

    def deal(rows: np.ndarray, want: float, dims: np.ndarray) -> Cut | int:
        nonlocal first
        if want <= 1 or len(dims) == 0 or len(rows) < 2:
            first += 1
            return first - 1
        slices = max(2, int(np.ceil(want ** (1 / len(dims)))))
        ordered = np.sort(values[rows, dims[0]])
        cuts = np.unique(ordered[np.arange(1, slices) * len(rows) // slices])
        side = np.searchsorted(cuts, values[rows, dims[0]], side="right")
        return Cut(int(dims[0]), cuts, tuple(deal(rows[side == i], want / slices, dims[1:]) for i in range(len(cuts) + 1)))

    borders = np.flatnonzero(np.diff(runs)) + 1 if len(runs) else np.arange(0)
    place = np.searchsorted(names[borders], labels, side="right")
    below = tuple(deal(np.flatnonzero(place == i), share[runs == i].sum(), spread) for i in range(len(borders) + 1))
    return Cut(-1, names[borders], below), first


def pages_of(cut: Cut | int, labels: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(labels), dtype=np.int32)

    def deal(cut: Cut | int, rows: np.ndarray) -> None:
        if isinstance(cut, int):
            out[rows] = cut
            return
        side = np.searchsorted(cut.values, labels[rows] if cut.at < 0 else values[rows, cut.at], side="right")
        for i, below in enumerate(cut.below):
            deal(below, rows[side == i])

    deal(cut, np.arange(len(labels)))
    return out


@dataclass(frozen=True)
class Boxes:
    """Boxes of pages, or of the nodes of one level of a tree."""

    least: np.ndarray
    greatest: np.ndarray
    label_least: np.ndarray
    label_greatest: np.ndarray

    def scores(self, up: np.ndarray, down: np.ndarray, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product of a query, given as its positive and negative components, with members of each box."""
        least, greatest = self.least[part], self.greatest[part]
        return least @ up + greatest @ down, greatest @ up + least @ down


def whole(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(vectors), dim)


def exact(*parts: np.ndarray) -> bool:
    """Whether doubles hold every inner product of such rows."""
    peak = max((float(np.abs(p).max(initial=0)) for p in parts), default=0.0)
    return peak * peak * max(1, parts[0].shape[-1]) < 2.0 ** 53


@dataclass(frozen=True)
class Index:
    rows: DataFrame
    boxes: dict[int, tuple[Boxes, np.ndarray, np.ndarray]]  # by length of vectors: boxes, pages, rows in each

    @staticmethod
    def of(rows: DataFrame) -> Index:
        """Rows (row, dim, vec_id, label, vector) with their page and part. A page of more than ``PAGE`` rows has several parts."""
        lengths = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(lengths.values())
        cuts: dict[int, Cut | int] = {}
        for dim, n in lengths.items():
            of_one = rows.where(F.col("dim") == dim)
            part = min(1.0, SAMPLED / max(1, dim) / total)
            some = of_one.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(part * (1 << 30))).select("label", "vector").toArrow()
            pages = max(1, min(-(-n // PAGE), PAGES * n // total, BOXED // max(1, dim) * n // total))
            values = pc.list_flatten(some["vector"]).to_numpy().reshape(some.num_rows, dim)
            cuts[dim], _ = cut_pages(some["label"].to_numpy(), values, pages)
        keep = "row long, dim int, vec_id long, label long, vector array<double>"
        dealt = stash(rows.select("row", "dim", "vec_id", "label", "vector").mapInArrow(lambda b: _deal(b, cuts), f"{keep}, page int"), "negatives-pages")
        bounds = dealt.mapInArrow(_bounds, "dim int, page int, n long, at int, least double, greatest double")
        bounds = bounds.groupBy("dim", "page", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        told = bounds.orderBy("dim", "page", "at").toArrow()
        column = {c: told[c].to_numpy() for c in ("dim", "page", "n", "at", "least", "greatest")}
        boxes = {}
        for dim in lengths:
            of_dim = column["dim"] == dim
            least, greatest, pages, n = (column[c][of_dim].reshape(-1, dim + 1) for c in ("least", "greatest", "page", "n"))
            boxes[dim] = Boxes(least[:, 1:], greatest[:, 1:], least[:, 0], greatest[:, 0]), pages[:, 0], n[:, 0]
        parts = [(dim, int(p), int(-(-n // PAGE))) for dim, (_, pages, counts) in boxes.items() for p, n in zip(pages, counts)]
        # One row for each page, so it is bounded as the boxes are.
        parts = rows.sparkSession.createDataFrame(parts, "dim int, page int, parts int")
        dealt = dealt.join(F.broadcast(parts), ["dim", "page"]).withColumn("part", F.pmod("row", "parts").cast("int")).drop("parts")
        return Index(dealt, boxes)

    def search(self, asks: DataFrame, asked: int, what: Same | Other) -> DataFrame:
        """(row, place, vec_id, score): what each page has of the best for each of a query's windows."""
        boxes = self.boxes
        blocks = row_count_parts(asks.sparkSession, asked, ASKING)
        sent = asks.select("row", "vec_id", "label", "vector", "wanted").mapInArrow(lambda b: _send(b, boxes, what), f"{_ASKS}, dim int, page int, part int")
        sent = sent.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "kind": F.lit(1)})
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        members = self.rows.select("row", "vec_id", "label", "vector", F.lit(None).cast("array<long>").alias("wanted"), "dim", "page", "part", every, F.lit(0).alias("kind"))
        met = members.unionByName(sent).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "kind")
        return met.mapInArrow(lambda b: _search(b, what), _FOUND)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, batch if len(at) == len(sizes) else batch.take(pa.array(at))


def _deal(batches: Iterator[pa.RecordBatch], cuts: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_length(batch):
            values = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
            pages = pages_of(cuts[dim], part["label"].to_numpy(), values)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pages, pa.int32())], names=[*part.schema.names, "page"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of what each page has in this task, a row for the label (at 0) and one for each coordinate."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for dim, part in _by_length(batch):
            values = np.column_stack([part["label"].to_numpy().astype(np.float64), whole(part["vector"], dim)])
            pages = part["page"].to_numpy()
            order = np.argsort(pages, kind="stable")
            found, starts, counts = np.unique(pages[order], return_index=True, return_counts=True)
            least, greatest = np.minimum.reduceat(values[order], starts), np.maximum.reduceat(values[order], starts)
            for page, n, a, b in zip(found.tolist(), counts.tolist(), least, greatest):
                now = held.get((dim, page))
                held[dim, page] = [n, a, b] if now is None else [now[0] + n, np.minimum(now[1], a), np.maximum(now[2], b)]
    for (dim, page), (n, least, greatest) in held.items():
        rows = dim + 1
        columns = [np.full(rows, dim, np.int32), np.full(rows, page, np.int32), np.full(rows, n), np.arange(rows, dtype=np.int32), least, greatest]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "page", "n", "at", "least", "greatest"])


def _send(batches: Iterator[pa.RecordBatch], boxes: dict, what: Same | Other) -> Iterator[pa.RecordBatch]:
    """Each query once for every part of every page that may hold one of its rows."""
    for batch in batches:
        for dim, asks in _by_length(batch):
            box, pages, sizes = boxes[dim]
            # Parts of all pages, one after the other.
            parts = -(-sizes // PAGE)
            page_of, start = np.repeat(np.arange(len(pages)), parts), np.cumsum(parts) - parts
            queries = whole(asks["vector"], dim)
            bounded = exact(queries, box.least, box.greatest)
            held: list[np.ndarray] = []
            for i, label in enumerate(asks["label"].to_pylist()):
                on = what.admits(label, box.label_least, box.label_greatest)
                if bounded:
                    lowest, highest = box.scores(np.maximum(queries[i], 0), np.minimum(queries[i], 0))
                    windows = what.windows(asks["wanted"][i].as_py())
                    if isinstance(what, Same):
                        windows = [(sure_floor(lowest, sizes, on & (box.label_least == box.label_greatest), what.k), np.inf)]
                    on = on & np.any([(highest >= a) & (lowest <= b) for a, b in windows], axis=0)
                to = np.flatnonzero(on[page_of])
                held.append(np.stack([np.full(len(to), i), page_of[to], to - start[page_of[to]]]))
                if i == asks.num_rows - 1 or sum(x.shape[1] for x in held) > SENT:
                    row, page, part = np.concatenate(held, axis=1)
                    more = [pa.array(x.astype(np.int32)) for x in (np.full(len(row), dim), pages[page], part)]
                    one = asks.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*one.columns, *more], names=[*one.schema.names, "dim", "page", "part"])
                    held = []


def sure_floor(lowest: np.ndarray, sizes: np.ndarray, on: np.ndarray, k: int) -> float:
    """A score that ``k`` rows besides the query reach for certain: pages by their lowest score, best first, until they hold k + 1 rows."""
    order = np.flatnonzero(on)[np.argsort(-lowest[on], kind="stable")]
    enough = np.flatnonzero(np.cumsum(sizes[order]) > k)
    return float(lowest[order[enough[0]]]) if len(enough) else -np.inf


# --- the tree of a page ----------------------------------------------------------


def tiled(values: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which every ``leaf`` of them lie close: slabs by one coordinate after the other, widest first."""
    out, dims = [], np.argsort(-values.var(axis=0), kind="stable") if len(values) else np.arange(0)

    def deal(rows: np.ndarray, depth: int) -> None:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == len(dims):
            out.append(rows)
            return
        rows = rows[np.argsort(values[rows, dims[depth]], kind="stable")]
        slices = max(2, int(np.ceil(leaves ** (1 / (len(dims) - depth)))))
        each = -(-leaves // slices) * leaf
        for at in range(0, len(rows), each):
            deal(rows[at:at + each], depth + 1)

    deal(np.arange(len(values)), 0)
    return np.concatenate(out)


class Tree:
    """Boxes over boxes over leaves of ``LEAF`` rows, packed full."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = tiled(np.column_stack([labels.astype(np.float64), values]), LEAF)
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.levels = []
        box, width = Boxes(self.values, self.values, self.labels, self.labels), LEAF
        while not self.levels or len(self.levels[-1].least) > 1:
            heads = np.arange(0, len(box.least), width)
            box = Boxes(np.minimum.reduceat(box.least, heads), np.maximum.reduceat(box.greatest, heads),
                        np.minimum.reduceat(box.label_least, heads), np.maximum.reduceat(box.label_greatest, heads))
            self.levels.append(box)
            width = FAN

    def search(self, query: np.ndarray, vec_id: int, label: int, windows: list[tuple], what: Same | Other) -> list[Best]:
        best = [Best(what.k, *window) for window in windows]
        if not exact(query, self.values):
            return self._search_large(query, vec_id, label, best, what)
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        queue = []

        def enter(level: int, part: slice) -> None:
            box = self.levels[level]
            lowest, highest = box.scores(up, down, part)
            on = what.admits(label, box.label_least[part], box.label_greatest[part])
            on = on & np.any([(highest >= b.floor) & (lowest <= b.high) for b in best], axis=0)
            for i in np.flatnonzero(on).tolist():
                heapq.heappush(queue, (-highest[i], level, part.start + i))

        enter(len(self.levels) - 1, slice(0, len(self.levels[-1].least)))
        while queue:
            highest, level, node = heapq.heappop(queue)
            # What is left is strictly below the k-th best of every window.
            if all(-highest < b.floor for b in best):
                break
            if level:
                enter(level - 1, slice(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1].least))))
                continue
            part = slice(node * LEAF, (node + 1) * LEAF)
            scores = self.values[part] @ query
            on = (self.ids[part] != vec_id) & what.admits(label, self.labels[part], self.labels[part])
            on &= (scores >= min(b.floor for b in best)) & (scores <= max(b.high for b in best))
            if on.any():
                for b in best:
                    b.offer(scores[on], self.ids[part][on])
        return best

    def _search_large(self, query, vec_id, label, best, what):
        """Scores that doubles do not hold, in whole numbers of any size; boxes are not asked."""
        top = (1 << 63) - 1
        on = np.flatnonzero((self.ids != vec_id) & what.admits(label, self.labels, self.labels))
        asked = [int(x) for x in query]
        scores = [max(-top, min(top, sum(a * int(b) for a, b in zip(asked, self.values[i])))) for i in on]
        for b in best:
            within = sorted((-s, int(self.ids[i])) for s, i in zip(scores, on) if b.low <= s <= b.high)[: what.k]
            b.scores, b.ids = [-s for s, _ in within], [i for _, i in within]
        return best


class Best:
    """The best rows so far of one window."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high, self.floor = k, low, high, low
        self.scores, self.ids = np.zeros(0), np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        on = (scores >= self.floor) & (scores <= self.high)
        if on.any():
            scores, ids = np.concatenate([self.scores, scores[on]]), np.concatenate([self.ids, ids[on]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]
            if len(first) == self.k:
                self.floor = self.scores[-1]


def _search(batches: Iterator[pa.RecordBatch], what: Same | Other) -> Iterator[pa.RecordBatch]:
    """Groups come sorted: a page's rows, then its queries. A page is held, its queries pass by."""
    group, members, tree = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in (*_KEYS, "kind")])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        found: list[tuple] = []
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            key, kind, dim = tuple(keys[:4, lo]), keys[4, lo], int(keys[0, lo])
            if key != group:
                group, members, tree = key, [], None
            part = batch.slice(lo, hi - lo)
            rows = part["vec_id"].to_numpy(), part["label"].to_numpy(), whole(part["vector"], dim)
            if kind == 0:
                members.append(rows)
                continue
            if tree is None:
                if not members:
                    continue
                tree, members = Tree(*(np.concatenate(x) for x in zip(*members))), []
            for row, vec_id, label, query, wanted in zip(part["row"].to_pylist(), *(x.tolist() for x in rows[:2]), rows[2], part["wanted"].to_pylist()):
                for place, best in enumerate(tree.search(query, vec_id, label, what.windows(wanted), what)):
                    found += [(row, place, int(i), int(s)) for i, s in zip(best.ids, best.scores)]
        if found:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["row", "place", "vec_id", "score"])


#: What the query over ``embeddings`` returns.
SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.e, c.e)::bigint as score
      from v a join v c on a.vec_id <> c.vec_id and len(a.e) = len(c.e) where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
