"""N-gram Jaccard self join by a size-aware split into light and heavy sets.

Sets of words' shingles with Jaccard similarity of at least `threshold` are linked. Equal sets form
one class, which the join sees once. For sets x, y of a <= b shingles the overlap must reach
c(a, b) = ceil(t (a + b) / (1 + t)):

* light sets (up to `boundary`) list their fixed-size subsets, those of c(a, b) shingles for every
  partner size that can link; two sets with that overlap share one of them.
* heavy sets go to inverted lists. A list belongs to a block of shingles rather than to one: shingle
  hashes deal a set over k blocks, with k above the largest symmetric difference d that a linked pair
  may have, so more than k - d blocks agree whole. A set enters the lists of its d + 1 largest blocks
  (all ties too). The agreeing block with the larger claim is large enough for both, so no link is
  lost, and a passage that thousands of texts share makes no list of its own.

Postings travel packed, by ranges of keys. Before that each batch links its own members of a list and
sends only the smallest of them on, so a list that a third of all sets are in is short where it is read.

Sets still apart in a list of more than SHORT_LIST are compared in tiles of bounded size, which give only
the links that join two components: their number grows with the list and not with its square. Such lists
with the same smallest set share their tiles.

The boundary is where the count of subsets first exceeds the cost of the lists. Lists first link
every member to the smallest one; only what is still in different components of one list is compared
afterwards. All candidates are verified on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.components import components
from graphloom.llm.durable import cut, map_arrow, one, spent

WORDS, PERCENT = 3, 90
#: A probe of a list costs about this many subset keys: lists hold more sets that turn out not to link.
PROBE = 4
#: Bytes of packed postings in one range of keys, and the most ids that are sent to all executors.
RANGE_BYTES, BROADCAST_IDS = 48 << 20, 2_000_000
#: Lists up to this length give pairs; of longer ones, tiles hold about this many shingles.
SHORT_LIST, TILE_SHINGLES = 32, 1_500_000
#: Keys that are linked and packed at a time, and the most bytes of a tile's bit rows.
LOT, GRID_BYTES = 1_000_000, 32 << 20
_LINK = "key long, rep long, head long"


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of a and b shingles: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def difference(n: int, percent: int) -> int:
    """The largest symmetric difference of a set of n shingles and a set linked to it."""
    return max(n + b - 2 * overlap(n, b, percent) for b in (partners(n, percent)[0], partners(n, percent)[-1], n))


def blocks(top: int, percent: int) -> int:
    """Blocks for sets of fewer than top shingles and their larger partners."""
    return difference(top, percent) + 2 + max(4, top // 50)


@lru_cache(64)
def subset_sizes(n: int, boundary: int, percent: int) -> tuple[int, ...]:
    return tuple(sorted({overlap(n, b, percent) for b in partners(n, percent) if b <= boundary and overlap(n, b, percent) <= min(n, b)}))


@lru_cache(64)
def boundary_by_cost(percent: int) -> int:
    """The largest size whose subsets cost no more than its lists."""
    n = 1
    while sum(comb(n + 1, c) for c in subset_sizes(n + 1, n + 1, percent)) <= PROBE * blocks(max(32, 1 << (n + 1).bit_length()), percent):
        n += 1
    return n


def _light(s: np.ndarray, boundary: int, percent: int) -> list[np.ndarray]:
    out = []
    mixed = textkit.mix(s + np.uint64(0x51ED270B))
    total = mixed.sum(dtype=np.uint64)
    for c in subset_sizes(len(s), boundary, percent):
        drop = np.array(list(combinations(range(len(s)), len(s) - c)), dtype=np.int64)
        left = total - mixed[drop].sum(axis=1, dtype=np.uint64) if drop.size else np.array([total])
        out.append(textkit.mix(left * np.uint64(2 * c + 1)))
    return out


def _heavy(s: np.ndarray, percent: int) -> list[np.ndarray]:
    out, n = [], len(s)
    top = max(32, 1 << n.bit_length())  # n < top
    need = difference(n, percent)
    mixed = textkit.mix(s + np.uint64(0xA5A5A5A5))
    tops = [top]
    if top > 32 and n <= 100 * (top // 2) // percent:
        tops.append(top // 2)  # as the larger partner of a set below top / 2
    for t in tops:
        k = blocks(t, percent)
        deal = ((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(deal, minlength=k)
        least = np.sort(size)[::-1][min(need, k - 1)]
        used = np.flatnonzero(size >= max(1, least))
        bounds = np.concatenate(([0], np.cumsum(size)))  # s is sorted, so a block is a run
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
        keys = sums[bounds[used + 1]] - sums[bounds[used]]
        out.append(textkit.mix(keys + textkit.mix(np.uint64(t) * np.uint64(1 << 20) + used.astype(np.uint64) * np.uint64(2654435761))))
    return out


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which linked, unequal sets have one in common."""
    boundary, n = boundary_by_cost(percent), len(s)
    keys = _light(s, boundary, percent) if n <= boundary else []
    if partners(n, percent)[-1] > boundary:
        keys += _heavy(s, percent)
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _profile(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, raw in textkit.chunks(batch.column(1)):
                w = textkit.words(at, raw)
                grams = w.shingles(words)
                n, low, high, keys = [], [], [], []
                for d in range(j - i):
                    s = textkit.set_of(w, d, words, grams)
                    n.append(len(s))
                    low.append(textkit.mix(s).sum(dtype=np.uint64))
                    high.append(textkit.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                    keys.append(signatures(s, percent) if len(s) else s)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), _longs(np.array(low, np.uint64)), _longs(np.array(high, np.uint64)), lists], ["doc_id", "n_shingles", "low", "high", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, raw in textkit.chunks(batch.column(1)):
                w = textkit.words(at, raw)
                grams = w.shingles(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([textkit.set_of(w, d, words, grams).tobytes() for d in range(j - i)], pa.binary())], ["doc_id", "elements"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
                both = int((q[at] == p).sum()) if len(q) else 0
                good.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _groups(keys: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings by key, the smallest set of each list, its place in them, and which lists have several."""
    order = np.lexsort((reps, keys))
    keys, reps = keys[order], reps[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    return keys, reps, first, size


def _links(keys: np.ndarray, reps: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    many = np.repeat(size > 1, size)
    return [_longs(keys[many]), pa.array(reps[many]), pa.array(np.repeat(reps[first], size)[many])]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their sets, of about LOT keys at a time."""
    keys, reps, n = [], [], 0
    for batch in batches:
        lists = batch.column(1)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        keys.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        reps.append(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size))
        n += len(reps[-1])
        if n >= LOT:
            yield np.concatenate(keys), np.concatenate(reps)
            keys, reps, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(reps)


def _pack(parts: int):
    """Of each lot: a packed row for each range of keys, and one, of a part behind them, of the lot's own links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, reps in _lots(batches):
            keys, reps, first, size = _groups(keys, reps)
            own = _links(keys, reps, first, size)
            keys, reps = keys[first], reps[first]
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            at = np.concatenate((np.searchsorted(part, np.arange(parts)), [len(part)]))
            rows = [(p, np.concatenate((keys[a:b], reps[a:b].view(np.uint64))).tobytes()) for p, a, b in zip(range(parts), at[:-1], at[1:], strict=True) if a < b]
            if len(own[0]):
                rows.append((parts + int(reps[0]) % parts, b"".join(x.to_numpy().tobytes() for x in own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["part", "packed"])

    return run


def _unpack(parts: int):
    """The links of a range of keys; or, of a part behind the ranges, those that lots have made."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("packed")]
        if table.column("part")[0].as_py() >= parts:
            return pa.table([_longs(np.concatenate([x.reshape(3, -1)[k] for x in rows])) for k in range(3)], names=["key", "rep", "head"])
        keys = np.concatenate([x[: len(x) // 2] for x in rows])
        reps = np.concatenate([x[len(x) // 2 :] for x in rows]).view(np.int64)
        return pa.table(_links(*_groups(keys, reps)), names=["key", "rep", "head"])

    return run


def joining_links(component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Of all linked pairs of sets, enough to join their components: at most one for each two of them."""
    size = np.array([len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    number = np.cumsum(count > 1) - 1
    owner, element = np.repeat(np.arange(len(sets)), size)[shared], number[place[shared]]
    m, v = len(sets), int((count > 1).sum())
    wide = v // 64 + 1
    dense = m * m * wide < 2 * int((count.astype(np.int64) ** 2)[count > 1].sum()) + 1 and m * wide * 8 <= GRID_BYTES
    if dense:
        rows = np.zeros(m * wide, np.uint64)
        np.bitwise_or.at(rows, owner * wide + (element >> 6), np.uint64(1) << (element & 63).astype(np.uint64))
        rows = rows.reshape(m, wide)
    else:
        by = np.argsort(element, kind="stable")
        lists, at = owner[by], np.concatenate(([0], np.cumsum(count[count > 1])))
        first = np.searchsorted(owner, np.arange(m + 1))
    label, out = component.copy(), []
    for x in range(m - 1):
        if dense:
            both = np.bitwise_count(rows[x + 1 :] & rows[x]).sum(axis=1, dtype=np.int64)
        else:
            mine = element[first[x] : first[x + 1]]
            both = np.bincount(np.concatenate([lists[at[e] : at[e + 1]] for e in mine]) if len(mine) else np.empty(0, np.int64), minlength=m)[x + 1 :]
        near = np.flatnonzero((100 * both >= percent * (size[x] + size[x + 1 :] - both)) & (both > 0)) + x + 1
        for y in near[np.unique(label[near], return_index=True)[1]].tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, component = (table.column(c).to_numpy() for c in ("rep", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements")]
        found = joining_links(component, sets, percent) if len(set(component.tolist())) > 1 else []
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[y]) for _, y in found], pa.int64())})

    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included; class_size counts the rows
    with an equal set. Null, empty and blank texts have 0 shingles, link with nothing and keep their own
    id (class_size 1). Rows that share a doc_id count as one document, whose links are those of all its
    rows. A null doc_id gives a row with a null component and no links. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(map_arrow(base, _profile(words, percent), "doc_id long, n_shingles long, low long, high long, keys array<long>"))
    real = seen.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "low", "high"]
    classes = cut(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")))
    total = one(classes.agg(F.sum("n_shingles")))[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * 16 // 5 // RANGE_BYTES + 1)  # under a fifth of the shingles become postings
    own = real.filter(F.size("keys") > 0).join(classes.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"]).dropDuplicates([*same, "doc_id"])
    packed = map_arrow(own.select("doc_id", "keys"), _pack(parts), "part int, packed binary")
    shared = cut(packed.groupBy("part").applyInArrow(_unpack(parts), _LINK))

    asked: list[DataFrame] = []

    def sets_of(ids: DataFrame) -> DataFrame:
        """(doc_id, elements) of the documents of ids (doc_id)."""
        ids = cut(ids.distinct())
        asked.append(ids)
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return map_arrow(base.join(ids, "doc_id", "left_semi"), _sets(words), "doc_id long, elements binary")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) whose sets link."""
        sets = sets_of(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
        x = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y"))
        return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), _verify(percent), "a long, b long").distinct()

    stars = cut(shared.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct())
    # rows of one document in different classes join those classes
    placed = real.join(classes, same).select("doc_id", "rep").distinct()
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).filter("b < top").drop("top")
    twice = placed.join(several, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    first = cut(linked(stars).unionByName(twice))
    joined = components(first)
    part = cut(joined)
    of = shared.select("key", "rep").distinct().join(part.select(F.col("id").alias("rep"), F.col("component")), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = classes.groupBy("rep").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    open_ = of.join(sizes, "rep").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.sum("most").alias("shingles")).filter("lo < hi")
    rest = cut(of.join(open_.select("key", "members", "shingles"), "key").join(sizes, "rep"))
    spent(shared, part)
    short = rest.filter(F.col("members") <= SHORT_LIST)
    x = short.select("key", F.col("rep").alias("a"), F.col("least").alias("la"), F.col("most").alias("ma"), F.col("component").alias("ca"))
    y = short.select("key", F.col("rep").alias("b"), F.col("least").alias("lb"), F.col("most").alias("mb"), F.col("component").alias("cb"))
    more = x.join(y, "key").filter("ca < cb").filter((F.col("ma") * 100 >= F.col("lb") * percent) & (F.col("mb") * 100 >= F.col("la") * percent))
    unseen = cut(_unseen(more, stars))
    second = cut(linked(unseen))
    spent(unseen, stars)
    # lists of the same smallest set mostly hold the same sets: these are compared together and sent once
    big = rest.filter(F.col("members") > SHORT_LIST)
    headed = cut(big.join(big.groupBy("key").agg(F.min("rep").alias("head")), "key").select("head", "rep", "component", "most").distinct())
    spent(rest)
    bundle = headed.join(headed.groupBy("head").agg(F.sum("most").alias("shingles")), "head")
    pieces = F.ceil(F.col("shingles") / F.lit(TILE_SHINGLES)).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: (k != F.col("chunk")) | (F.col("pieces") == 1))
    long_ = bundle.select("head", "rep", "component", pieces.alias("pieces")).withColumn("chunk", chunk).withColumn("other", F.explode(others))
    long_ = cut(long_.select("head", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "component"))
    tiles = long_.join(sets_of(long_.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), "elements"), "rep")
    second = second.unionByName(cut(tiles.groupBy("head", "i", "j").applyInArrow(_tile(percent), "a long, b long").distinct()))
    spent(headed, long_, *asked)
    ends = components(first.unionByName(second))
    named = classes.join(ends, F.col("rep") == F.col("id"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"), "class_size")
    rows = seen.drop("keys").join(named, same, "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_size", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("class_size"))


def _unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs, smaller id second, that seen does not have."""
    order = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return order(pairs).join(order(seen), ["a", "b"], "left_anti")
