"""Best-fit-decreasing packing of indivisible groups into shards.

Packing looks at sizes alone. Groups are counted by size in Spark, so what
reaches the driver is one row for each different size: K different sizes need
K^2/2 bytes of data, hence at most 14 million rows at 100 TB. Sizes are placed
from large to small, each into the tightest shard that still has room, found in
a balanced tree of remaining capacities; groups then look up their place by
their rank among groups of their size.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import row_count_parts, stash, utf8_size

#: Bytes a row takes besides its text.
OVERHEAD = 16
#: Ranks among equal sizes are counted in so many parts, so that a frequent size is no single task.
SPREAD = 64
#: Rows of a shard that are numbered in one task.
RUN = 20_000


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key, rank):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class Rooms:
    """Shards by (remaining capacity, shard): a treap, balanced by random ranks."""

    def __init__(self):
        self._root, self._random = None, random.Random(0)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, _Node(key, self._random.random())), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest key with room for ``size``."""
        node, best = self._root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        if best is None:
            return None
        low, rest = self._split(self._root, best)
        _, high = self._split(rest, (best[0], best[1] + 1))
        self._root = self._join(low, high)
        return best

    def _split(self, node, key):
        """Nodes below ``key``, and the rest."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._join(a.right, b)
            return a
        b.left = self._join(a, b.left)
        return b


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Places (size, shard, count) for (size, count) pairs given from large to small; shards are opened as needed.

    A shard that took a group is the tightest still, so equal sizes go in as a
    run. A group above the capacity has a shard to itself. None if more than
    ``most`` shards would be needed.
    """
    rooms, opened, places = Rooms(), 0, []
    for size, count in sizes:
        while count:
            room = rooms.take_tightest(size)
            if room is None:
                room, opened = (max(capacity, size), opened), opened + 1
                if most is not None and opened > most:
                    return None
            n = min(count, room[0] // size)
            places.append((size, room[1], n))
            count -= n
            if size <= capacity and room[0] - n * size:
                rooms.add((room[0] - n * size, room[1]))
    return places


def level_fit(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Places in ``shards`` shards, of the smallest capacity found for which best fit needs no more of them.

    Groups above an equal share have shards to themselves, and the others share
    the rest. The capacity is found to a thousandth of a shard.
    """
    left, total, own = shards, sum(s * n for s, n in sizes), 0
    while own < len(sizes) and left > 1 and sizes[own][0] * left > total and sizes[own][1] <= left - 1:
        left, total, own = left - sizes[own][1], total - sizes[own][0] * sizes[own][1], own + 1
    rest = sizes[own:]
    alone = [(size, n) for size, n in sizes[:own]]
    least = max(-(-total // left), rest[0][0] if rest else 0)
    step, found = max(1, least // 20_000), None
    low, high = least, least
    while (found := best_fit(rest, high, left)) is None:
        low, high, step = high, high + step, step * 2
    while high - low > max(1, least // 1000):
        middle = (low + high) // 2
        if (better := best_fit(rest, middle, left)) is None:
            low = middle
        else:
            high, found = middle, better
    first = sum(n for _, n in alone)
    places, shard = [], 0
    for size, n in alone:
        for _ in range(n):
            places.append((size, shard, 1))
            shard += 1
    return places + [(size, first + s, n) for size, s, n in found]


def pack(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of ``docs`` (doc_id, text): ``shards`` of near equal bytes, or as few as ``capacity`` allows.

    Equal texts are one group and stay together; null is a text of its own, of
    16 bytes and null text_crc32. A group above the capacity fills a shard of
    its own whole. Slots count the rows of a shard from 0 by parts of the rows'
    hashes; which of several rows with equal id and text comes first is open.
    No rows in, no rows out.
    """
    text = F.col("text")
    digest = F.coalesce(F.sha2(text, 256), F.lit("null"))
    size = utf8_size(text) + OVERHEAD
    rows = stash(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("digest")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = stash(groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(SPREAD))), "shard-groups")

    cells = groups.groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = cells.groupBy("bytes").agg(F.sum("n").alias("n")).toArrow()
    sizes = sorted(zip(histogram["bytes"].to_pylist(), histogram["n"].to_pylist()), reverse=True)
    places = (level_fit(sizes, shards) if capacity is None else best_fit(sizes, capacity)) if sizes else []
    table = pa.table({
        "bytes": pa.array([p[0] for p in places], pa.int64()), "at": pa.array(range(len(places)), pa.int64()),
        "shard": pa.array([p[1] for p in places], pa.int32()), "n": pa.array([p[2] for p in places], pa.int64()),
    })
    runs = stash(docs.sparkSession.createDataFrame(table), "shard-runs")
    ends = runs.withColumn("end", F.sum("n").over(Window.partitionBy("bytes").orderBy("at")))
    ends = ends.groupBy("bytes").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))

    before = F.sum("n").over(Window.partitionBy("bytes").orderBy("part")) - F.col("n")
    starts = cells.select("bytes", "part", before.alias("start")).join(ends, "bytes")
    rank = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest")) - 1
    ranked = groups.withColumn("rank", rank).join(starts, ["bytes", "part"])
    place = F.element_at(F.filter("ends", lambda e: e["end"] > F.col("start") + F.col("rank")), 1)
    placed = ranked.select("digest", place["shard"].alias("shard"))

    runs_each = row_count_parts(docs.sparkSession, rows.count(), RUN)
    part = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(runs_each)).alias("part")
    dealt = stash(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard", part, "digest"), "shard-dealt")
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "digest")) - 1
    numbered = dealt.withColumn("slot", slot.cast("long")).join(starts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("start")).alias("slot"))
