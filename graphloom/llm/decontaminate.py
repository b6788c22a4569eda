"""Benchmark decontamination by SimHash over item-sized windows.

1. Fingerprints: every window of a text as long as a benchmark item (within GRID of it, never longer)
   gets the 64-bit SimHash of its FEATURE-word grams; windows of more than FINE words start at every
   second word. All windows of a chunk are hashed at once with bit-sliced counters: counts of 1, 2, 4,
   ... neighbours are added as bit planes of 64-bit words, so a window costs tens of word operations and
   not 64 counters.
2. Multi-index Hamming search: a fingerprint within RADIUS = 15 of an item's has one of four 16-bit
   blocks within 3 bits of the item's block. A table for each block holds, for each of its 65,536
   values, the set of near items; the union of four look-ups holds every item within RADIUS.
3. Verification: within the candidate's surroundings the item-long window with the largest weighted
   Jaccard similarity of five-word shingles (weight: count) is found; at 0.8 or more it is a hit.

4. A text shorter than an item has no window of the item's length. Its shingles are counted against those
   of every such item, and where enough are common, step 3 follows with the whole text as the window.

The item set is read in blocks of ITEMS_A_PASS; each block goes to all executors and scans all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import map_arrow

SHINGLE, SIMILARITY, FEATURE, RADIUS = 5, 0.8, 3, 15
ITEMS_A_PASS = 4096
#: Bytes of look-up tables that a worker keeps; others are made again.
KEPT_BYTES = 40 << 20
#: Windows longer than this step in length by GRID, and start at every second word.
FINE, GRID = 24, 0.03
_STRIP = 8192
_NEAR = np.array([sum(1 << b for b in c) for k in range(RADIUS // 4 + 1) for c in combinations(range(16), k)], np.uint32)


def window_size(words: int) -> int:
    """The window length for items of so many words: exact up to FINE, then on a grid."""
    size = FINE
    while size < words:
        step = max(2, int(size * GRID) // 2 * 2)
        if size + step > words:
            break
        size += step
    return min(size, words)


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two stacks of bit planes."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            half = x ^ b[i]
            if carry is None:
                out.append(half)
                carry = x & b[i]
            else:
                out.append(half ^ carry)
                carry = (x & b[i]) | (half & carry)
        else:
            out.append(x ^ carry)
            carry = x & carry
    return [*out, carry]


def _over_half(planes: list[np.ndarray], n: int) -> np.ndarray:
    """Bits whose count exceeds half of n, by the carry out of adding 2^p - (n // 2 + 1)."""
    rest = (1 << len(planes)) - (n // 2 + 1)
    carry = np.zeros_like(planes[0])
    for i, x in enumerate(planes):
        carry = (x | carry) if rest >> i & 1 else (x & carry)
    return carry


def fingerprints(features: np.ndarray, sizes: list[int], stride: dict[int, int]) -> dict[int, np.ndarray]:
    """By window size in words, SimHashes of the windows from every stride-th position of features on."""
    most = max(sizes) - FEATURE + 1
    n = len(features)
    padded = np.concatenate((features, np.zeros(2 * most + 2, np.uint64)))
    out: dict[int, list[np.ndarray]] = {s: [] for s in sizes}
    for at in range(0, n, _STRIP):
        stop = min(n, at + _STRIP)
        power = [[padded[at : stop + 2 * most]]]
        while 2 << (len(power) - 1) <= most:
            last, step = power[-1], 1 << (len(power) - 1)
            power.append(_add([p[:-step] for p in last], [p[step:] for p in last]))
        for size in sizes:
            count, step, width = size - FEATURE + 1, stride[size], stop - at
            total, done = None, 0
            for k in reversed(range(len(power))):
                if count >> k & 1:
                    part = [p[done : done + width : step] for p in power[k]]
                    total = part if total is None else _add(total, part)
                    done += 1 << k
            out[size].append(_over_half(total, count))
    return {s: np.concatenate(x) if x else np.empty(0, np.uint64) for s, x in out.items()}


class Items:
    """A block of benchmark items: words, fingerprints and look-up tables by window size."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        at = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t in rows]))).astype(np.int64)
        raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
        w = textkit.words(at, raw)
        grams, parts = w.shingles(SHINGLE), w.shingles(FEATURE)
        self.ids, self.size, self.shingles, prints = [], [], [], []
        for i, (item, _) in enumerate(rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= SHINGLE and item is not None:
                self.ids.append(item)
                self.size.append(b - a)
                self.shingles.append(grams[a : b - SHINGLE + 1])
                prints.append(fingerprints(parts[a : b - FEATURE + 1], [b - a], {b - a: 1})[b - a][0])
        self.prints = np.array(prints, np.uint64)
        by: dict[int, list[int]] = {}
        for k, size in enumerate(self.size):
            by.setdefault(window_size(size), []).append(k)
        self.groups = [(size, np.array(members[i : i + 32])) for size, members in sorted(by.items()) for i in range(0, len(members), 32)]
        self.sizes = sorted(by)
        # shingles of all items in order, with their item
        parts = [np.unique(x) for x in self.shingles]
        flat, of = np.concatenate([np.empty(0, np.uint64), *parts]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        order = np.argsort(flat, kind="stable")
        self.flat, self.of = flat[order], of[order]
        self.stride = {s: 1 if s <= FINE else 2 for s in self.sizes}

    def tables(self, members: np.ndarray) -> np.ndarray:
        """For each 16-bit block and value, a bit for each member whose block lies within 3 bits of it."""
        kind = np.uint8 if len(members) <= 8 else np.uint16 if len(members) <= 16 else np.uint32
        out = np.zeros((4, 1 << 16), kind)
        for bit, k in enumerate(members):
            for block in range(4):
                out[block, _NEAR ^ np.uint32(int(self.prints[k]) >> 16 * block & 0xFFFF)] |= kind(1 << bit)
        return out

    def within(self, prints: np.ndarray, members: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, member) of all prints within RADIUS of an item."""
        views = prints.view(np.uint16).reshape(-1, 4)
        near = reduce(np.bitwise_or, (tables[block].take(views[:, block]) for block in range(4)))
        found = []
        for bit, k in enumerate(members):
            at = np.flatnonzero(near & near.dtype.type(1 << bit))
            at = at[np.bitwise_count(prints[at] ^ self.prints[k]) <= RADIUS]
            found.append((at, np.full(len(at), k)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shorter_texts(items: Items, grams: np.ndarray, words: int) -> list[int]:
    """The items longer than a text of so many words and these shingles whose similarity to it is SIMILARITY
    or more if each of its shingles that they have counts."""
    if not len(grams) or words >= max(items.size):
        return []
    low, high = (np.searchsorted(items.flat, grams, side) for side in ("left", "right"))
    n = high - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    both = np.bincount(items.of[at], minlength=len(items.size))  # no less than the weighted overlap
    size = np.array(items.size)
    return np.flatnonzero((size > words) & (both > 0) & (both * (1 + SIMILARITY) >= SIMILARITY * (size - SHINGLE + 1 + len(grams)) - 1e-9)).tolist()


def best_window(region: np.ndarray, item: np.ndarray) -> tuple[float, int]:
    """The largest weighted Jaccard similarity of item and a run of region of its length, and where."""
    want, n = Counter(item.tolist()), len(item)
    have: Counter = Counter()
    both, best, where = 0, -1, 0
    values = region.tolist()
    size = min(n, len(values))
    for i, x in enumerate(values):
        have[x] += 1
        both += have[x] <= want[x]
        if i >= size:
            y = values[i - size]
            both -= have[y] <= want[y]
            have[y] -= 1
        if i >= size - 1 and both > best:
            best, where = both, i - size + 1
    return max(best, 0) / (n + size - max(best, 0)), where


def passages(region: np.ndarray, item: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, similarity) of windows of region of SIMILARITY or more, none overlapping: the best one, then
    likewise on either side of it."""
    out, open_ = [], [(0, len(region))]
    while open_:
        a, b = open_.pop()
        if (b - a) * (1 + SIMILARITY) < SIMILARITY * (len(item) + b - a):
            continue
        similarity, where = best_window(region[a:b], item)
        if similarity >= SIMILARITY:
            first, end = a + where, a + where + min(len(item), b - a)
            out.append((first, end, similarity))
            open_ += [(a, first), (end, b)]
    return sorted(out)


def _search(items: Items):
    """(doc_id, item_id, first word, end word, similarity) of each hit in a batch of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        sets = [np.unique(x) for x in items.shingles]
        for batch in batches:
            rows: list[tuple[int, int, int, int, float]] = []
            for i, j, at, raw in textkit.chunks(batch.column(1)) if items.ids else ():
                w = textkit.words(at, raw)
                # texts start at even places, so that every second start includes their first
                count = np.diff(w.first)
                place = np.concatenate(([0], np.cumsum(count + (count & 1)))).astype(np.int64)
                word = np.zeros(place[-1], np.uint64)
                doc = np.repeat(np.arange(j - i), count)
                word[np.arange(len(w.hashes)) - w.first[doc] + place[doc]] = w.hashes
                if len(word) < FEATURE:
                    continue
                spread = textkit.Words(word, w.start, w.end, place, w.data, w.text_at, w.total)
                features, grams = spread.shingles(FEATURE), spread.shingles(SHINGLE)
                owner = np.repeat(np.arange(j - i), np.diff(place))[: len(features)]
                left = (place[owner] + count[owner] - np.arange(len(features))).astype(np.int32)  # words from here to the text's end
                prints = fingerprints(features, items.sizes, items.stride)
                found: dict[tuple[int, int], list[int]] = {}
                for g, (size, members) in enumerate(items.groups):
                    tables = kept.get(g)
                    if tables is None:
                        tables = items.tables(members)
                        if sum(t.nbytes for t in kept.values()) < KEPT_BYTES:
                            kept[g] = tables
                    step = items.stride[size]
                    own = np.ascontiguousarray(prints[size])
                    starts, who = items.within(own, members, tables)
                    starts = starts * step
                    good = left[starts] >= size
                    for s, k in zip(starts[good].tolist(), who[good].tolist(), strict=True):
                        found.setdefault((int(owner[s]), k), []).append(s)
                for d in np.flatnonzero(count < max(items.size)).tolist():
                    first = int(place[d])
                    for k in shorter_texts(items, grams[first : first + max(0, int(count[d]) - SHINGLE + 1)], int(count[d])):
                        found.setdefault((d, k), []).append(first)
                for (d, k), starts in found.items():
                    end = int(place[d] + count[d]) - SHINGLE + 1
                    n, low = len(items.shingles[k]), int(place[d])
                    starts.sort()
                    runs: list[list[int]] = []
                    for s in starts:
                        if runs and s <= runs[-1][1] + n:
                            runs[-1][1] = s
                        else:
                            runs.append([s, s])
                    for a, b in runs:
                        a, b = max(low, a - 6), min(end, b + n + 8)
                        region = grams[a:b]
                        if np.isin(region, sets[k]).sum() * (1 + SIMILARITY) < SIMILARITY * n:
                            continue
                        rows += [(i + d, k, a - low + x, a - low + y + SHINGLE - 1, s) for x, y, s in passages(region, items.shingles[k])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([items.ids[r[1]] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.int32()) for c in (2, 3)], pa.array([r[4] for r in rows], pa.float64())], ["doc_id", "item_id", "first_word", "end_word", "similarity"])

    return run


def _passes(benchmark: DataFrame, most: int) -> Iterator[Items]:
    rows: list[tuple[int, str | None]] = []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").dropDuplicates().orderBy("item_id").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == most:
            yield Items(rows)
            rows = []
    if rows:
        yield Items(rows)


def hits(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, similarity), a row for each passage of docs (doc_id, text)
    that repeats an item of benchmark (item_id, text).

    Items and texts of fewer than five words have no shingle and match nothing, nor do null and empty
    ones; items with a null id are left out. Rows that repeat, and null ids of documents, are searched
    like others. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word int, end_word int, similarity double"
    found = [map_arrow(base, _search(items), schema) for items in _passes(benchmark, most)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, most: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of docs, all columns as they are, whose text repeats no benchmark item. No shuffle."""
    place = docs.columns.index("text")

    def clean(items: Items):
        search = _search(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], ["doc_id", "text"])
                keep = np.ones(batch.num_rows, bool)
                for out in search(iter([rows])):
                    keep[out.column(0).to_numpy(zero_copy_only=False)] = False
                yield batch.filter(pa.array(keep))

        return run

    for items in _passes(benchmark, most):
        docs = map_arrow(docs, clean(items), docs.schema)
    return docs
