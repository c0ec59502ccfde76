"""SimHash fingerprints and their near-duplicate components by a self-join of binary tries.

A pair that differs in two bits at most agrees wholly on one of three parts of
the 64 bits. Fingerprints meet by such a part; inside each meeting a binary trie
over the remaining bits is joined with itself: node pairs are followed together,
differing bits add up, and a pair of nodes is dropped once the budget is spent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.llm.components import connected, forest
from gridloom.llm.tables import keep_rows, row_hash, stash

SEED = 42
BUDGET = 2
#: Keys with more fingerprints than this are split by further bits.
GROUP = 2_000
#: After this many splits 2^20 different fingerprints share a key at most, which bounds a group.
LEVELS = 3
#: Bytes of text whose words are held at once.
PIECE = 4 << 20
#: Fingerprints joined at once in a task, beyond the group that ends there.
CHUNK = 100_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256
#: The bytes that part words.
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 where there is no word."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for words in _word_runs((text or "").encode("utf-8").lower(), width):
        shingles = map(b" ".join, zip(*[words[i:] for i in range(min(width, len(words)))]))
        hashes = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        lanes = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + _LANES
        counts += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
        total += len(lanes)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def _word_runs(data: bytes, width: int) -> Iterator[list[bytes]]:
    """Words in runs of bounded size; each run after the first starts with the last ``width - 1`` words before it."""
    at, held, begun = 0, [], False
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        held += data[at:end].split()
        at = end
        if len(held) >= width:
            yield held
            begun, held = True, held[len(held) - width + 1:]
    if held and not begun:
        yield held


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(x) for x in texts], dtype="int64")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_hash, fp) of ``docs`` (doc_id, text), and (fp, root, component_id) of every fingerprint.

    Null and empty texts, and texts of white space, have fingerprint 0 and link
    like any other. Repeated rows, copies and equal ids are one fingerprint each
    and cost one row in the join. component_id is the smallest doc_id of the
    component; null ids are passed over, and null comes out only where a
    component has no other. Other columns play no part but for ``row_hash``.
    """
    rows = stash(docs.select("doc_id", row_hash(docs).alias("row_hash"), fingerprint("text").alias("fp")), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-ids")
    roots = connected(link(distinct, budget))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, placed.join(first, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``docs`` with the row of the smallest doc_id of each component; ties go to the smallest row hash, null ids last."""
    rows, components = near_duplicates(docs, budget)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    chosen = rows.join(components, "fp").groupBy("root").agg(F.min(order).alias("first"))
    return keep_rows(docs, chosen.select("first.doc_id", "first.row_hash"))


def link(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (a, b) that connect the different fingerprints ``fp`` exactly as all pairs within ``budget`` bits would."""
    parts = budget + 1
    masks = [0]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    edges = None
    for level in range(LEVELS):
        below = {m: _split(m, parts) for m in masks}
        masks = [x for xs in below.values() for x in xs]
        pairs = [(_long(m), F.array(*map(_long, xs))) for m, xs in below.items()]
        choices = F.create_map(*[x for pair in pairs for x in pair])
        rows = rows.select("fp", F.explode(choices[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        keys = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        keys = stash(keys, "fingerprint-keys")
        crowded = F.col("n") > GROUP if level < LEVELS - 1 else F.lit(False)
        hot = keys.where(crowded).drop("n")
        calm = rows.join(keys.where(~crowded).drop("n"), ["mask", "part"], "left_semi")
        found = calm.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").select("mask", "fp")
        found = found.mapInArrow(lambda batches: _join_groups(batches, budget), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if hot.isEmpty():
            break
        rows = stash(rows.join(hot, ["mask", "part"], "left_semi").select("fp", "mask"), "fingerprint-hot")
    return edges


def _split(mask: int, parts: int) -> list[int]:
    """``mask`` with, in turn, each of ``parts`` runs of its free bits added."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _join_groups(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Groups come sorted by key, over as many batches as they like; whole groups are joined as they complete."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = trie_pairs(mask, fp, budget)
        a, b = forest(a, b) if len(a) else (a, b)
        return pa.RecordBatch.from_pydict({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size < CHUNK:
            continue
        mask, fp = (np.concatenate(x) for x in zip(*held))
        last = _starts(mask, fp)[-1]
        if last:
            yield joined(mask[:last], fp[:last])
        held, size = [(mask[last:], fp[last:])], len(fp) - last
    if size:
        yield joined(*(np.concatenate(x) for x in zip(*held)))


def _starts(mask: np.ndarray, fp: np.ndarray) -> np.ndarray:
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (mask[1:] != mask[:-1]) | ((fp[1:] & mask[1:]) != (fp[:-1] & mask[:-1]))
    return np.flatnonzero(new)


def trie_pairs(mask: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group that differ in ``budget`` bits at most.

    A trie node is a range of the sorted fingerprints that share all bits above
    the current one. Pairs of nodes are kept as four range ends and the bits in
    which they differ so far, and followed down to single fingerprints.
    """
    # Bits a group agrees on cannot tell its members apart: a sort by the bit pattern orders each group.
    bits = fp.astype(np.int64).view(np.uint64)
    start = _starts(mask, fp)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(fp))))
    order = np.lexsort((bits, group))
    bits, fp = bits[order], fp[order]
    end = np.append(start[1:], len(fp))
    whole = end - start > 1
    lo, hi = start[whole], end[whole]
    pairs = np.stack([lo, hi, lo, hi, np.zeros_like(lo)])
    out_a, out_b = [], []
    for bit in range(63, -2, -1):
        same = pairs[0] == pairs[2]
        sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        leaf = (sizes <= 1) & ~same if bit >= 0 else np.ones(len(same), dtype=bool)
        a, b = _leaf_pairs(pairs[:, leaf])
        near = np.bitwise_count(bits[a] ^ bits[b]) <= budget
        out_a.append(fp[a[near]])
        out_b.append(fp[b[near]])
        pairs, same = pairs[:, ~leaf], same[~leaf]
        if not pairs.shape[1]:
            break
        ones = np.concatenate([[0], np.cumsum((bits >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        al, ah, bl, bh, d = pairs
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        other = ~same
        pairs = np.concatenate([
            np.stack([al, am, bl, bm, d]), np.stack([am, ah, bm, bh, d]), np.stack([al, am, bm, bh, d + 1]),
            np.stack([am, ah, bl, bm, d + 1])[:, other],
        ], axis=1)
        pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= budget)]
        pairs = pairs[:, (pairs[0] != pairs[2]) | (pairs[1] - pairs[0] > 1)]
    return np.concatenate(out_a), np.concatenate(out_b)


def _leaf_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all members of the left node with all of the right; each unordered pair once where both are one node."""
    al, ah, bl, bh, _ = pairs
    wide = bh - bl
    count = (ah - al) * wide
    which = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a, b = al[which] + place // wide[which], bl[which] + place % wide[which]
    keep = (al[which] != bl[which]) | (a < b)
    return a[keep], b[keep]


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
