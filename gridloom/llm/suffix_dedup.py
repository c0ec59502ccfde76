"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

A corpus has too many suffixes to sort as one. Equal windows of W bytes have
the same anchor, the K-byte string of smallest hash among those they hold, so
windows are compared where their anchors meet:

1. Every text gives its anchors (about one in 35 bytes), each with a hash of its
   context, the bytes that windows holding the anchor can reach.
2. Anchors are dealt by hash. Of equal contexts all but the earliest repeat it
   wholly; contexts of which an anchor has only one are unique.
3. What is left, different contexts of one anchor, is cut from the texts, and
   their suffixes are sorted in a task: those smaller than their successor
   directly, the others induced by a scan of the buckets. Common prefixes of
   neighbours show which windows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import stash

W = 100
K = 32
#: Bytes on either side of an anchor that its windows can reach.
REACH = W - K
#: Window starts of a text hashed at once.
SEGMENT = 1 << 20
#: Bytes hashed at once, but for the segment that ends there.
BYTES = 1 << 20

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x | 1) for x in _RANDOM.integers(1 << 62, 1 << 63, 6).tolist()]
_MIX = [np.uint64(x | 1) for x in _RANDOM.integers(1 << 62, 1 << 63, 5).tolist()]
_TIE = 31

_ANCHORS = "known boolean, h long, c long, id long, at long"
_MARKS = "h long, id long, at long, probe boolean"


def keyed(docs: DataFrame) -> DataFrame:
    """(id, tie, text): a total order of texts. Null ids come last, by a hash of the text; equal ids by another."""
    text = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(text)
    high = 1 << 62
    own = F.lit(high).bitwiseOR(hashed.bitwiseAND(F.lit(high - 1)))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), own).alias("id"), F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1)).alias("tie"), text.alias("text"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i + width] for every i that has as much."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return op(out[:len(out) - rest], out[rest:]) if rest else out


def anchors_of(segments: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, hash, hash of context) of the anchors of (text, first start, last start + 1) segments.

    Between texts lie zeros; a context is hashed with how far its text reaches,
    so that they are not taken for bytes of it.
    """
    parts, first, at = [], [], 0
    for data, a, b in segments:
        lo, hi = a - REACH, b - 1 + W + REACH
        piece = b"\0" * max(0, -lo) + data[max(0, lo):min(len(data), hi)] + b"\0" * max(0, hi - len(data))
        parts.append(piece)
        first.append(at + REACH)
        at += len(piece)
    x = np.frombuffer(b"".join(parts), dtype=np.uint8)
    first = np.array(first)
    starts = np.array([b - a for _, a, b in segments])
    h, width = _BYTE[x], 1
    for step in _STEP:
        h = h[:-width] * step + h[width:]
        width *= 2
        if width == K:
            gram = _mixed(h)
    context = h
    least = _sliding(gram, REACH + 1, np.minimum)
    open_ = np.zeros(len(least) + 1, dtype=np.int8)
    np.add.at(open_, first, 1)
    np.add.at(open_, first + starts, -1)
    least = np.where(np.cumsum(open_[:-1]) > 0, least, np.uint64(0))
    held = np.concatenate([np.zeros(REACH, dtype=np.uint64), least, np.zeros(REACH, dtype=np.uint64)])
    best = _sliding(held, REACH + 1, np.maximum)[:len(gram)]
    p = np.flatnonzero((best == gram[:len(best)]) & (best > 0))
    segment = np.searchsorted(first, p + REACH, side="right") - 1
    segment = np.where(p < first[segment], segment - 1, segment)
    offset = np.array([a for _, a, _ in segments])
    size = np.array([len(d) for d, _, _ in segments])
    place = p - first[segment] + offset[segment]
    left, right = np.minimum(REACH, place), np.minimum(REACH, size[segment] - place - K)
    clip = (left * (REACH + 1) + right).astype(np.uint64)
    c = _mixed(context[p - REACH] * _MIX[2] + context[p - REACH + 64] * _MIX[3] + context[p + K + REACH - 64] * _MIX[4] + clip)
    return segment, place, gram[p], c


def _segments(size: int) -> list[tuple[int, int]]:
    starts = size - W + 1
    return [(a, min(a + SEGMENT, starts)) for a in range(0, starts, SEGMENT)]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def settle(segments, ids, ties):
        segment, place, h, c = anchors_of(segments)
        ids, at = np.array(ids, dtype=np.int64)[segment], (np.array(ties, dtype=np.int64)[segment] << _TIE) | place
        order = np.lexsort((at, ids, c, h))
        h, c, ids, at = h[order], c[order], ids[order], at[order]
        known = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        once = ~np.concatenate([[False], known[1:] & (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])])
        # What repeats a context of the same bytes is settled; it travels by a key of its own.
        h = np.where(known, _mixed(h ^ (ids * 31 + at).view(np.uint64)), h)
        return pa.RecordBatch.from_pydict({
            "known": pa.array(known[once]), "h": pa.array(h[once].view(np.int64)), "c": pa.array(c[once].view(np.int64)),
            "id": pa.array(ids[once]), "at": pa.array(at[once])})

    segments, ids, ties, size = [], [], [], 0
    for batch in batches:
        for i, tie, text in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            for a, b in _segments(len(text)):
                segments.append((text, a, b))
                ids.append(i)
                ties.append(tie)
                size += b - a + W
                if size >= BYTES:
                    yield settle(segments, ids, ties)
                    segments, ids, ties, size = [], [], [], 0
    if segments:
        yield settle(segments, ids, ties)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by h, c, id and at: all but the first of each context, and the first ones where an anchor has several. Known ones pass."""
    last = None  # (h, c, id, at) of the row before, how many contexts its anchor has so far, and the first one's row
    count, only = 0, None
    for batch in batches:
        known = batch.filter(batch["known"])
        if known.num_rows:
            yield pa.RecordBatch.from_pydict({**{n: known[n] for n in ("h", "id", "at")}, "probe": pa.array(np.zeros(known.num_rows, dtype=bool))})
        batch = batch.filter(pc.invert(batch["known"]))
        cols = np.stack([batch[n].to_numpy(zero_copy_only=False) for n in ("h", "c", "id", "at")])
        if not cols.shape[1]:
            continue
        before = np.concatenate([np.array(last if last is not None else ~cols[:, 0])[:, None], cols[:, :-1]], axis=1)
        differs = cols != before
        again = ~differs.any(axis=0)
        new_h = differs[0]
        new_c = new_h | differs[1]
        last = cols[:, -1]
        group = np.cumsum(new_h)
        contexts = np.bincount(group, weights=new_c, minlength=group[-1] + 1).astype(np.int64)
        contexts[0] += count
        first = np.flatnonzero(new_c)
        several = contexts[group[first]] > 1
        probe = cols[:, first[several]]
        if only is not None and contexts[0] > 1 and count == 1:
            probe = np.concatenate([only[:, None], probe], axis=1)
        if group[-1] > 0 or count == 0:
            mine = first[group[first] == group[-1]]
            only = cols[:, mine[0]] if len(mine) else None
        count = contexts[group[-1]]
        repeat = cols[:, ~new_c & ~again]
        out = np.concatenate([repeat, probe], axis=1)
        flag = np.arange(out.shape[1]) >= repeat.shape[1]
        yield pa.RecordBatch.from_pydict({"h": pa.array(out[0]), "id": pa.array(out[2]), "at": pa.array(out[3]), "probe": pa.array(flag)})


def marks(docs: DataFrame) -> DataFrame:
    found = docs.select("id", "tie", "text").mapInArrow(_anchors, _ANCHORS)
    met = found.repartition("h").sortWithinPartitions("known", "h", "c", "id", "at")
    return stash(met.mapInArrow(_pick, _MARKS), "suffix-marks")


#: Contexts of an anchor that are sorted in one task; more are narrowed down over all tasks, see ``_narrow``.
GROUP = 20_000
#: Suffixes sorted at once, but for the anchor that ends there.
SUFFIXES = 60_000
#: A window of W bytes shares this much left or right of its anchor.
HALF = REACH // 2

_CONTEXTS = "h long, hot boolean, id long, at long, left int, data binary"
_FOUND = "h long, id long, lo long, hi long, left int, data binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context of every probe, with where it starts."""
    for batch in batches:
        out = {n: [] for n in ("h", "hot", "id", "at", "left", "data")}
        size = 0
        for i, tie, text, probes in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["probes"]):
            fields = probes.values
            for h, at, hot in zip(fields.field("h").to_pylist(), fields.field("at").to_pylist(), fields.field("hot").to_pylist()):
                place = at & ((1 << _TIE) - 1)
                start = max(0, place - REACH)
                data = text[start:place + K + REACH]
                for name, value in zip(out, (h, hot, i, tie << _TIE | start, place - start, data)):
                    out[name].append(value)
                size += len(data)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_SCHEMA)
                out, size = {n: [] for n in out}, 0
        if size:
            yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_SCHEMA)


_CONTEXT_SCHEMA = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("id", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("data", pa.binary())])


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of window starts that repeat an earlier window of the same anchor; contexts of hot anchors pass."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(table: pa.Table) -> pa.RecordBatch:
        h, ids, at = (table[n].to_numpy() for n in ("h", "id", "at"))
        return _ranges(*repeats(h, ids, at, table["left"].to_numpy(), table["data"].to_pylist()))

    for batch in batches:
        hot = batch["hot"].to_numpy(zero_copy_only=False)
        if hot.any():
            passed = batch.filter(batch["hot"])
            yield pa.RecordBatch.from_pydict({
                "h": passed["h"], "id": passed["id"], "lo": passed["at"], "hi": pa.nulls(passed.num_rows, pa.int64()), "left": passed["left"], "data": passed["data"]})
            batch = batch.filter(pa.array(~hot))
        if not batch.num_rows:
            continue
        h = batch["h"].to_numpy()
        cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and size >= SUFFIXES and held[-1]["h"][0].as_py() != h[lo]:
                yield settle(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(lo, hi - lo))
            size += (hi - lo) * (REACH + 1)
    if held:
        yield settle(pa.Table.from_batches(held))


def repeats(h: np.ndarray, ids: np.ndarray, at: np.ndarray, left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(id, at) of windows in the contexts that equal an earlier one; ``at`` orders places within an id."""
    lefts, rights, seen = [], [], {}
    for i, (anchor, l, text) in enumerate(zip(h.tolist(), left.tolist(), data)):
        sides = ((anchor, text[l - HALF:l]) if l >= HALF else None, (anchor, text[l + K:l + K + HALF], 1) if len(text) >= l + K + HALF else None)
        lefts.append(sides[0])
        rights.append(sides[1])
        for side in sides:
            if side is not None:
                seen[side] = seen.get(side, 0) + 1
    parts, places, owner, starts, size = [], [], [], [], 0
    for i, (a, b, l, text) in enumerate(zip(lefts, rights, left.tolist(), data)):
        lo, hi = 0, len(text) - W
        if a is None or seen[a] < 2:
            lo = max(lo, l - HALF)
        if b is None or seen[b] < 2:
            hi = min(hi, l - HALF)
        if lo > hi:
            continue
        parts.append(text[lo:hi + W])
        starts.append(size)
        places.append(at[i] + lo)
        owner.append((ids[i], hi - lo + 1))
        size += hi - lo + W
    if not parts:
        return ids[:0], at[:0]
    text = np.frombuffer(b"".join(parts) + bytes(W + 1), dtype=np.uint8)
    count = np.array([n for _, n in owner])
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(places, count) + within
    ident = np.repeat(np.array([i for i, _ in owner]), count)
    wanted = np.repeat(starts, count) + within
    order = two_stage_order(text, wanted)
    number = np.full(len(text), -1)
    number[wanted] = np.arange(len(wanted))
    order = number[order]
    order = order[order >= 0]
    windows = np.lib.stride_tricks.sliding_window_view(text, W)
    same = common_prefix(windows, wanted[order]) >= W
    run = np.flatnonzero(np.concatenate([[True], ~same]))
    rank = np.empty(len(place), dtype=np.int64)
    by_place = np.lexsort((place, ident))
    fresh = np.concatenate([[True], (np.diff(place[by_place]) != 0) | (np.diff(ident[by_place]) != 0)])
    rank[by_place] = np.cumsum(fresh)
    ranks = rank[order]
    first = np.repeat(np.minimum.reduceat(ranks, run), np.diff(np.append(run, len(ranks))))
    later = order[ranks > first]
    return ident[later], place[later]


def two_stage_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The suffixes at ``wanted``, and those they follow from, sorted by their first W bytes.

    Suffixes smaller than their successor are sorted directly. Every other
    suffix is a byte before a suffix that sorts no later, so a scan of the
    buckets of first bytes, from the smallest, meets its successor first and
    puts it at the next place of its own bucket.
    """
    step = np.diff(text.astype(np.int16))
    place = np.arange(len(step))
    turn = np.minimum.accumulate(np.where(step != 0, place, len(step) - 1)[::-1])[::-1]
    smaller = np.append(step[turn] > 0, True)
    # The next suffix that is sorted directly, from every place on.
    direct = np.minimum.accumulate(np.where(smaller, np.arange(len(text)), len(text) - 1)[::-1])[::-1]
    reach = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(reach, wanted, 1)
    np.add.at(reach, direct[wanted] + 1, -1)
    needed = np.cumsum(reach[:-1]) > 0

    padded = np.concatenate([text, np.zeros(W, dtype=np.uint8)])
    sorted_ = np.flatnonzero(needed & smaller)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, W)[sorted_]).view(f"S{W}").ravel()
    sorted_ = sorted_[np.argsort(keys, kind="stable")]
    induced = needed & ~smaller
    ends = np.searchsorted(text[sorted_], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        bucket = list(waiting[byte])
        level = np.concatenate(bucket) if bucket else sorted_[:0]
        while len(level):
            before = level[level > 0] - 1
            level = before[induced[before] & (text[before] == byte)]
            bucket.append(level)
        bucket.append(sorted_[ends[byte]:ends[byte + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (text[before] > byte)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefix(windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, up to W."""
    out = []
    for at in range(0, len(order) - 1, 20_000):
        a, b = windows[order[at:at + 20_000][:len(order) - 1 - at]], windows[order[at + 1:at + 20_001]]
        differ = a != b
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1), W))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _ranges(ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    cut = np.flatnonzero((np.diff(ids) != 0) | (np.diff(at) > 1)) + 1
    lo, hi = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(ids)]]).astype(int) - 1
    if not len(ids):
        lo = hi = np.zeros(0, dtype=int)
    return pa.RecordBatch.from_pydict({
        "h": pa.nulls(len(lo), pa.int64()), "id": pa.array(ids[lo]), "lo": pa.array(at[lo]), "hi": pa.array(at[hi]),
        "left": pa.nulls(len(lo), pa.int32()), "data": pa.nulls(len(lo), pa.binary())})


def _narrow(contexts: DataFrame) -> DataFrame:
    """(id, at) of windows of ``contexts`` (h, id, at, left, data) that equal an earlier window of the same anchor.

    Window starts are counted from the anchor. All windows of a range of starts
    hold the bytes from its last start to the end of its first; ranges are
    halved, and a context stays in a range while another one has the same bytes
    there. When ranges are down to one start these bytes are the window.
    """
    items = contexts.select("h", "id", "at", "left", "data", F.lit(-REACH).alias("lo"), F.lit(0).alias("hi"))
    width = REACH + 1
    while width > 1:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi"))
        items = items.select("h", "id", "at", "left", "data", F.inline(F.when(F.col("lo") < F.col("hi"), halves).otherwise(F.array(F.struct("lo", "hi")))))
        held = F.greatest("lo", -F.col("left")) <= F.least("hi", F.octet_length("data") - F.col("left") - W)
        core = F.md5(F.substring(F.col("data"), F.col("left") + F.col("hi") + 1, F.col("lo") - F.col("hi") + W))
        items = items.where(held).withColumn("core", core)
        shared = items.groupBy("h", "lo", "hi", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        items = stash(items.join(shared, ["h", "lo", "hi", "core"]), "suffix-narrowed")
        width = -(-width // 2)
    windows = items.select("h", "lo", "core", "id", (F.col("at") + F.col("left") + F.col("lo")).alias("at"))
    first = windows.groupBy("h", "lo", "core").agg(F.min(F.struct("id", "at")).alias("first"))
    return windows.join(first, ["h", "lo", "core"]).where(F.struct("id", "at") != F.col("first")).select("id", "at")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes its spans cover."""
    import hashlib

    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["spans"]):
            removed, runs, done, kept = 0, 0, 0, hashlib.sha256()
            if spans.is_valid:
                values = spans.values
                lo, hi = values.field("lo").to_numpy(), values.field("hi").to_numpy()
                anchor = hi < 0
                ends = np.where(anchor, np.minimum(lo + K + REACH, len(text)), hi + W)
                begins = np.where(anchor, np.maximum(lo - REACH, 0), lo)
                order = np.argsort(begins, kind="stable")
                begins, ends = begins[order], np.maximum.accumulate(ends[order])
                cut = np.flatnonzero(begins[1:] > ends[:-1]) + 1
                for a, b in zip(begins[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist()):
                    kept.update(text[done:a])
                    removed, runs, done = removed + b - a, runs + 1, b
            kept.update(text[done:])
            rows.append((doc_id, len(text), removed, runs, kept.hexdigest()))
        doc_id, *numbers, sha = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_id, pa.int64()), *[pa.array(n, pa.int64()) for n in numbers], pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(docs: DataFrame) -> DataFrame:
    """(id, tie, lo, hi) of what repeats earlier text of ``keyed`` documents: window starts lo to hi, or, where hi is -1, the context of the anchor at lo."""
    found = marks(docs)
    place, tie = F.col("at").bitwiseAND(F.lit((1 << _TIE) - 1)), F.shiftrightunsigned("at", _TIE)
    probes = found.where("probe")
    hot = stash(probes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("hot")), "suffix-hot")
    probes = probes.join(hot, "h", "left").select("id", tie.alias("tie"), F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("probe"))
    by_text = probes.groupBy("id", "tie").agg(F.collect_list("probe").alias("probes"))
    texts = docs.select("id", "tie", "text")
    cut = texts.join(by_text, ["id", "tie"]).select("id", "tie", "text", "probes").mapInArrow(_cut, _CONTEXTS)
    # Contexts of a hot anchor only pass here, so they may go anywhere.
    spread = F.when(F.col("hot"), F.xxhash64("id", "at")).otherwise(F.lit(0))
    sorted_ = stash(cut.repartition("h", spread).sortWithinPartitions("h").mapInArrow(_sort, _FOUND), "suffix-found")
    ranges = sorted_.where("h is null").select("id", F.col("lo").alias("at"), "hi")
    if not hot.isEmpty():
        repeated = _narrow(sorted_.where("h is not null").select("h", "id", F.col("lo").alias("at"), "left", "data"))
        ranges = ranges.union(repeated.select("id", "at", F.col("at").alias("hi")))
    ranges = ranges.select("id", tie.alias("tie"), place.alias("lo"), F.col("hi").bitwiseAND(F.lit((1 << _TIE) - 1)).alias("hi"))
    return ranges.union(found.where("not probe").select("id", tie, place, F.lit(-1).cast("long")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each of ``docs`` (doc_id, text).

    A byte goes if a 100-byte string that covers it also starts earlier: in a
    text of smaller doc_id, or before in the same text. Null is an empty text;
    texts under 100 bytes stay whole. Null ids count as larger than all others;
    texts of equal ids, and of null ones, are ordered by hashes of the text, and
    rows equal in id and text are one text.
    """
    texts = keyed(docs)
    by_text = spans(texts).groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(by_text, ["id", "tie"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_strip, _RESULT)
