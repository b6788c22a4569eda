"""Near-duplicate passages by compact windows.

A text is a sequence of five-word shingles. For each of HASHES min-hash functions, the Cartesian tree of
the hashed sequence groups its subsequences: node c stands for all subsequences within [l, r] that
contain c, which share the min-hash at c. Nodes with r - l + 1 >= SPAN, about 2 n / SPAN of them, are the
compact windows; they cover every subsequence of SPAN shingles or more.

1. Windows of the same function and min-hash meet in a list, wherever they are, each with a sign (a byte) of
   every shingle that lies less than SPAN from c. Equal ones are a class: its first, that with the smallest id,
   stands for it and the others are linked to it; a task does so before it sends on what it has of a list. In a
   list no class is left out. Up to COMPARED classes are compared pair by pair. In longer lists those that agree
   over SPAN, but for what one changed, added or removed word or two added ones take, are found by equal hashes
   of the two runs before and after it, for each place and division; all that have the two runs are linked to the
   first of them, so that there is a link to a representative and not one a pair.
2. Links of two texts on about one diagonal are intervals, which are joined to candidates where they overlap.
3. Candidates are verified on their shingles: windows of SPAN of which enough occur in the other passage
   are merged, trimmed, and kept where the Jaccard similarity of the two passages reaches SIMILARITY;
   where the merged run does not reach it, the parts that do are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textkit
from graphloom.llm.durable import cut, map_arrow

WORDS, SIMILARITY = 5, 0.8
LEAST_WORDS = 50
SPAN = LEAST_WORDS - WORDS + 1
HASHES = 3
SLIDE = 4  # two links lie on one diagonal if a run of such steps joins their shifts
MARGIN = 16
RANGE_BYTES, BROADCAST_ROWS = 8 << 20, 400_000
FLUSH = 150_000  # windows that a task gathers before it joins copies and packs them
COMPARED = 128  # posts of a list up to which each pair is compared
TILE = 50_000  # pairs that are compared at a time
_PACKED = "part int, packed binary"
_MEET = np.dtype([("doc", "<i8"), ("other", "<i8"), ("shift", "<i4"), ("l", "<i4"), ("r", "<i4")])


def _post_kind(span: int) -> np.dtype:
    """signs: a byte, not 0, of each shingle of the window that lies less than span from c, which is in the middle."""
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("c", "<i4"), ("signs", "u1", (-(-(2 * span - 1) // 8) * 8,))])


def _sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    """Least of each span values in a row (van Herk and Gil-Werman)."""
    n = len(v) - span + 1
    if n <= 0:
        return np.empty(0, v.dtype)
    full = -(-len(v) // span) * span
    padded = np.full(full, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def compact_windows(hashed: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of width >= span of the Cartesian trees of the sequences
    hashed[first[i]:first[i + 1]]; of equal values the left one is the smaller. Places are absolute."""
    bits = max(20, int(len(hashed)).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)
    least = _sliding_min(packed, span)
    if not len(least):
        return (np.empty(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(least))
    good = first[1:][owner[start]] - start >= span
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])
    begin = np.flatnonzero(fresh & good)
    group = np.cumsum(fresh)
    last = np.searchsorted(group, group[begin], "right") - 1
    last = np.minimum(last, first[1:][owner[begin]] - span)
    node = least[begin]
    c = (node & low).astype(np.int64)
    own = owner[begin]
    l, r = begin.copy(), last + span - 1
    far_left, far_right = begin == c - span + 1, last == c
    # where nothing within reach is smaller, the next smaller one is a node itself
    lo, hi = first[own], first[own + 1]
    stack: list[int] = []
    values, owners, places = node.tolist(), own.tolist(), c.tolist()
    left, right = lo.tolist(), (hi - 1).tolist()
    for i, x in enumerate(values):
        while stack and (owners[stack[-1]] != owners[i] or values[stack[-1]] > x):
            j = stack.pop()
            if owners[j] == owners[i]:
                right[j] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    l[far_left] = np.array(left, np.int64)[far_left]
    r[far_right] = np.array(right, np.int64)[far_right]
    return l, c, r


def _spread(w: textkit.Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in a row, without those that leave their text, and where each text begins."""
    grams = w.shingles(words)
    count = np.maximum(np.diff(w.first) - words + 1, 0)
    first = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    return grams[at], first


def _blobs(part: np.ndarray, parts: int, rows: np.ndarray) -> pa.RecordBatch:
    """Records packed by part."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    at = np.concatenate((np.searchsorted(part, np.arange(parts)), [len(part)]))
    out = [(p, rows[a:b].tobytes()) for p, a, b in zip(range(parts), at[:-1], at[1:], strict=True) if a < b]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "packed"])


def _unblob(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("packed")])


def _near_enough(span: int, similarity: float) -> int:
    """Of how many shingles of span two passages have to agree."""
    return int(np.ceil(2 * similarity / (1 + similarity) * span - 1e-9))


def _links(a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Links of posts to others of their lists, to the smaller id, over what both windows hold."""
    a, b = np.where(a["doc"] > b["doc"], a, b), np.where(a["doc"] > b["doc"], b, a)
    a, b = (x[a["doc"] != b["doc"]] for x in (a, b))
    reach = span - 1
    low = [(x["signs"][:, :reach] != 0).sum(axis=1, dtype=np.int32) for x in (a, b)]
    high = [(x["signs"][:, reach + 1 :] != 0).sum(axis=1, dtype=np.int32) for x in (a, b)]
    out = np.zeros(len(a), _MEET)
    out["doc"], out["other"], out["shift"] = a["doc"], b["doc"], b["c"] - a["c"]
    out["l"], out["r"] = a["c"] - np.minimum(*low), a["c"] + np.minimum(*high)
    return out


def _classes(posts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first post of each class, that is of those of a list with equal windows, and links of the others to it."""
    signs = np.ascontiguousarray(posts["signs"]).view("<u8")
    kind = np.zeros(len(posts), np.uint64)
    for k in range(signs.shape[1]):
        kind = textkit.mix((kind ^ signs[:, k]) + np.uint64(k + 1))
    order = np.lexsort((posts["c"], posts["doc"], kind, posts["key"]))
    posts, kind = posts[order], kind[order]
    fresh = np.ones(len(posts), bool)
    fresh[1:] = (posts["key"][1:] != posts["key"][:-1]) | (kind[1:] != kind[:-1])
    rest = np.flatnonzero(~fresh)
    return posts[fresh], _links(posts[rest], posts[np.flatnonzero(fresh)[np.cumsum(fresh)[rest] - 1]], span)


def _agreeing(found: np.ndarray, span: int) -> np.ndarray:
    """The most places found of any span in a row, row by row."""
    total = np.zeros((len(found), found.shape[1] + 1), np.int16)
    np.cumsum(found, axis=1, out=total[:, 1:])
    return (total[:, span:] - total[:, :-span]).max(axis=1)


def _alike_pairs(x: np.ndarray, y: np.ndarray, span: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether signs x and y, row by row, agree in need of some span shingles, moved by up to two words or not, and
    whether in more than need where they are."""
    found = (x == y) & (x != 0)
    surely = _agreeing(found, span) > need
    other = found.copy()
    for k in (1, 2):
        for a, b in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
            same = (x[:, a] == y[:, b]) & (x[:, a] != 0)
            found[:, a] |= same
            other[:, b] |= same
    return np.maximum(_agreeing(found, span), _agreeing(other, span)) >= need, surely


def _short(posts: np.ndarray, first: np.ndarray, d: int, span: int, need: int) -> np.ndarray:
    """Links of the alike pairs of lists of d posts that begin at first, each pair compared. Of posts surely alike to
    the same earlier one a pair is not linked again."""
    i, j = np.triu_indices(d, 1)
    earlier = np.tri(d, k=-1, dtype=bool)
    out = []
    step = max(1, TILE // len(i))
    for k in range(0, len(first), step):
        at = first[k : k + step, None]
        a, b = (at + i).reshape(-1), (at + j).reshape(-1)
        other = posts["doc"][a] != posts["doc"][b]
        alike, sure = np.zeros((2, len(at), d, d), bool)
        alike[:, j, i], sure[:, j, i] = ((v & other).reshape(len(at), -1) for v in _alike_pairs(posts["signs"][a], posts["signs"][b], span, need))
        sure |= sure.transpose(0, 2, 1)
        least = (sure & earlier).argmax(axis=2)[:, :, None]
        known = np.take_along_axis(sure, least, axis=1) & np.take_along_axis(sure, least, axis=2)
        m, b, a = np.nonzero(alike & ~known)
        out.append(_links(posts[at[m, 0] + b], posts[at[m, 0] + a], span))
    return np.concatenate(out)


def _long(posts: np.ndarray, span: int, need: int) -> np.ndarray:
    """Links of the posts of lists of any length to the first of each group of alike ones, without comparing pairs:
    alike windows agree in two runs, need shingles together, with what a changed word takes in between. For each
    place and each division of the runs those that agree are a group, of which any two are alike."""
    n, wide, wipe = len(posts), 2 * span - 1, span - need
    power = np.ones(wide + 1, np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(power)
    back = np.array([pow(int(x), -1, 1 << 64) for x in power], np.uint64)
    signs = posts["signs"][:, :wide]
    run, some = np.zeros((wide + 1, n), np.uint64), np.zeros((wide + 1, n), np.int16)
    for k in range(wide):
        run[k + 1] = run[k] + textkit.mix(signs[:, k].astype(np.uint64) + np.uint64(1)) * power[k]
        some[k + 1] = some[k] + (signs[:, k] != 0)
    lists = textkit.mix(posts["key"])
    met: list[np.ndarray] = []

    def group(parts: list[tuple[int, int, int, int]]) -> None:
        """Links posts that agree in the runs [a, b) and [c, d) of any of the parts, each run from its begin on; those
        of the last part, which has most in between, only to those of the first, which has least."""
        hashes, at, part = [], [], []
        for k, (a, b, c, d) in enumerate(parts):
            whole = np.flatnonzero(some[b] - some[a] + some[d] - some[c] == need)
            hashes.append(lists[whole] + (run[b][whole] - run[a][whole]) * back[a] + textkit.mix((run[d][whole] - run[c][whole]) * back[c]))
            at.append(whole)
            part.append(np.full(len(whole), k))
        h, at, part = np.concatenate(hashes), np.concatenate(at), np.concatenate(part)
        if not len(h):
            return
        order = np.argsort(h)
        h, at, part = h[order], at[order], part[order]
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(begins, len(h)))
        least, narrow = (np.repeat(np.minimum.reduceat(np.where(part <= k, at, n), begins), size) for k in (1, 0))
        least = np.where(part == 2, narrow, least)
        found = np.flatnonzero((least != at) & (least < n))
        fresh = found[last[at[found]] != least[found]]
        last[at[fresh]] = least[fresh]
        met.append(at[fresh] * n + least[fresh])

    last = np.full(n, -1, np.int64)
    middle, between = span - 1, (wipe - 1, wipe, wipe + 1)
    for one in range(need + 1):
        for start in range(span):
            # the place is in the first run, which lies where it does in all, or in the second
            if start <= middle < start + one:
                group([(start, start + one, min(wide, start + one + w), min(wide, start + need + w)) for w in between])
            end = start + span
            if end - (need - one) <= middle < end:
                group([(max(0, end - need - w), max(0, end - need - w + one), end - (need - one), end) for w in between])
        if sum(map(len, met)) > 4 * n:
            met = [np.unique(np.concatenate(met))]
    pairs = np.unique(np.concatenate(met)) if met else np.empty(0, np.int64)
    return _links(posts[pairs // n], posts[pairs % n], span)


def _linked(posts: np.ndarray, span: int, need: int, compared: int = COMPARED) -> np.ndarray:
    """Links of all alike posts of each list: copies to the first of their class, and classes to each other."""
    posts, links = _classes(posts, span)
    posts = posts[np.lexsort((posts["c"], posts["doc"], posts["key"]))]
    begins = np.flatnonzero(np.concatenate(([True], posts["key"][1:] != posts["key"][:-1])))
    size = np.diff(np.append(begins, len(posts)))
    out = [links]
    for d in np.unique(size[(size > 1) & (size <= compared)]).tolist():
        out.append(_short(posts, begins[size == d], d, span, need))
    long = np.repeat(size > compared, size)
    if long.any():
        out.append(_long(posts[long], span, need))
    return np.concatenate(out)


def _share(hashed: np.ndarray, parts: int) -> np.ndarray:
    return ((textkit.mix(hashed) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _keyed(hashed: np.ndarray, code: int) -> np.ndarray:
    """Hashes whose remainder is the code of their lists."""
    low = hashed // np.uint64(HASHES) * np.uint64(HASHES)
    return np.where(low > np.uint64(2**64 - 1 - HASHES), np.uint64(0), low) + np.uint64(code)


def _posts(w: textkit.Words, ids: np.ndarray, words: int, span: int) -> Iterator[np.ndarray]:
    """Posts of the texts of a chunk, by function."""
    grams, first = _spread(w, words)
    reach = span - 1
    sign = np.zeros(len(grams) + 2 * reach, np.uint8)
    sign[reach : len(grams) + reach] = textkit.mix(grams + np.uint64(HASHES)) % np.uint64(255) + np.uint64(1)
    around = np.arange(2 * reach + 1)
    for f in range(HASHES):
        hashed = textkit.mix(grams * np.uint64(0x9E3779B97F4A7C15 * (2 * f + 1) & (2**64 - 1)) + np.uint64(f))
        l, c, r = compact_windows(hashed, first, span)
        own = np.searchsorted(first, c, "right") - 1
        posts = np.zeros(len(c), _post_kind(span))
        posts["key"], posts["doc"], posts["c"] = _keyed(hashed[c], f), ids[own], c - first[own]
        place = c[:, None] + around - reach
        posts["signs"][:, : len(around)] = np.where((place >= l[:, None]) & (place <= r[:, None]), sign[place + reach], 0)
        yield posts


def _post(parts: int, words: int, span: int):
    """Of each lot of windows: a post for each class by range of keys (parts 0 on), and the links of copies within the
    lot by range of texts (parts `parts` on)."""

    def lot(posts: np.ndarray) -> pa.RecordBatch:
        heads, links = _classes(posts, span)
        rows = [_blobs(_share(heads["key"], parts), parts, heads), _blobs(_share(links["doc"].view(np.uint64), parts), parts, links)]
        part = pa.concat_arrays([rows[0].column(0), pa.array(rows[1].column(0).to_numpy() + np.int32(parts), pa.int32())])
        return pa.RecordBatch.from_arrays([part, pa.concat_arrays([x.column(1) for x in rows])], ["part", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, at, raw in textkit.chunks(batch.column(1)):
                kept += _posts(textkit.words(at, raw), ids[i:j], words, span)
                if sum(map(len, kept)) > FLUSH:
                    yield lot(np.concatenate(kept))
                    kept = []
        if kept:
            yield lot(np.concatenate(kept))

    return run


def _meet(parts: int, span: int, need: int):
    """Of each range of keys: the links of its posts, by range of texts; links made before as they are."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= parts:
            return pa.table([pa.array([part - parts] * len(table), pa.int32()), table.column("packed")], names=["part", "packed"])
        links = _linked(_unblob(table, _post_kind(span)), span, need)
        return pa.Table.from_batches([_blobs(_share(links["doc"].view(np.uint64), parts), parts, links)])

    return run


def overlaps(l: list[int], r: list[int], f: list[int], enough: int, span: int) -> list[tuple[int, int]]:
    """Places [s, e] of at least span on which intervals of at least `enough` kinds lie, by one sweep."""
    events = sorted([(a, 0, k) for a, b, k in zip(l, r, f, strict=True) if b >= a] + [(b + 1, 1, k) for a, b, k in zip(l, r, f, strict=True) if b >= a])
    depth: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    since = None
    i = 0
    while i < len(events):
        at = events[i][0]
        while i < len(events) and events[i][0] == at:
            _, closing, k = events[i]
            depth[k] = depth.get(k, 0) + (-1 if closing else 1)
            i += 1
        deep = sum(1 for v in depth.values() if v > 0) >= enough
        if deep and since is None:
            since = at
        elif not deep and since is not None:
            if at - since >= span:
                out.append((since, at - 1))
            since = None
    return out


def _sweep(least: int):
    """Candidates of a range of texts: links of two texts on about one diagonal, joined where they overlap, of least
    shingles or more."""
    names = ["doc", "other", "shift", "s", "e"]

    def run(table: pa.Table) -> pa.Table:
        links = _unblob(table, _MEET)
        links = links[np.lexsort((links["shift"], links["other"], links["doc"]))]
        cut_at = np.ones(len(links), bool)
        cut_at[1:] = (links["doc"][1:] != links["doc"][:-1]) | (links["other"][1:] != links["other"][:-1]) | (links["shift"][1:] - links["shift"][:-1] > SLIDE)
        at = np.append(np.flatnonzero(cut_at), len(links))
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = links[a:b]
            shift = int(own["shift"][(b - a) // 2])
            found = overlaps(own["l"].tolist(), own["r"].tolist(), [0] * (b - a), 1, least)
            rows += [(int(own["doc"][0]), int(own["other"][0]), shift, s, e) for s, e in found]
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    return run


def passages(x: np.ndarray, y: np.ndarray, span: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(first, end, other first, other end, similarity) of runs of x of at least span shingles that y has
    nearly as they are."""
    if len(x) < span or len(y) < span:
        return []
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
    found = y[order][at] == x
    total = np.concatenate(([0], np.cumsum(found)))
    need = _near_enough(span, similarity)
    dense = np.flatnonzero(total[span:] - total[:-span] >= need)
    if not len(dense):
        return []

    def fit(a: int, b: int) -> tuple[int, int, int, int, float] | None:
        """x[a:b] less what y has not at its ends, and where it is in y, if alike."""
        hits = np.flatnonzero(found[a:b]) + a
        a, b = int(hits[0]), int(hits[-1]) + 1
        place = order[at[hits]]
        oa, ob = max(0, _middle(place - (hits - a))), min(len(y), _middle(place + (b - 1 - hits)) + 1)
        if b - a < span * similarity:
            return None
        if ob - oa == b - a and (x[a:b] == y[oa:ob]).all():
            return a, b, oa, ob, 1.0
        p, q = set(x[a:b].tolist()), set(y[oa:ob].tolist())
        both = len(p & q)
        alike = both / max(1, len(p) + len(q) - both)
        return (a, b, oa, ob, alike) if alike >= similarity else None

    out = []
    ends = np.append(np.flatnonzero(np.diff(dense) > span) + 1, len(dense)).tolist()
    for first, end in zip([0, *ends], ends):
        whole = fit(int(dense[first]), int(dense[end - 1]) + span)
        out += [whole] if whole else _parts(dense[first:end].tolist(), span, fit)
    return out


def _middle(v: np.ndarray) -> int:
    """The median, towards zero."""
    v = np.sort(v)
    return int((int(v[(len(v) - 1) // 2]) + int(v[len(v) // 2])) / 2)


def _parts(starts: list[int], span: int, fit) -> list[tuple[int, int, int, int, float]]:
    """Passages, each grown as far as doubling and halving of its length keep it alike, that together cover
    every alike window of span shingles at one of starts."""
    out, i, end, top = [], 0, -1, starts[-1] + span
    while i < len(starts):
        # the last alike window that begins in the passage before or just after it, else the next one
        near = bisect_right(starts, end)
        for k in [*range(near - 1, i - 1, -1), *range(max(near, i), len(starts))]:
            if starts[k] + span > end and (best := fit(starts[k], starts[k] + span)):
                break
        else:
            break
        a, low, high = starts[k], starts[k] + span, starts[k] + 2 * span
        while high <= top and (more := fit(a, high)):
            best, low, high = more, high, a + 2 * (high - a)
        high = min(high, top + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if more := fit(a, middle):
                best, low = more, middle
            else:
                high = middle
        out.append(best)
        end, i = best[1], k + 1
    return out


def _slices(words: int):
    """For each place [s, e] of each row's text: the shingles of [s - MARGIN, e + MARGIN] as bytes, and where
    they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, ids = batch.column(2), batch.column(0).to_pylist()
            for i, j, at, raw in textkit.chunks(batch.column(1)):
                grams, first = _spread(textkit.words(at, raw), words)
                rows = []
                for d in range(j - i):
                    own = grams[first[d] : first[d + 1]]
                    for spot in spots[i + d].as_py():
                        low = max(0, spot["s"] - MARGIN)
                        rows.append((ids[i + d], spot["s"], spot["e"], low, own[low : spot["e"] + MARGIN + 1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 4 else pa.int64()) for k in range(5)], ["id", "s", "e", "low", "grams"])

    return run


def _verify(words: int, span: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, other, low, olow, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, their = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # what one has added may leave too little of its own span, but not of the other's
                found = passages(own, their, span, similarity) or [(c, d, a, b, alike) for a, b, c, d, alike in passages(their, own, span, similarity)]
                for a, b, oa, ob, alike in found:
                    rows.append((doc, low + a, low + b + words - 1, other, olow + oa, olow + ob + words - 1, alike))
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], pa.array([r[6] for r in rows], pa.float64())], ["doc_id", "first_word", "end_word", "other_id", "other_first", "other_end", "similarity"])

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, first_word, end_word, other_id, other_first, other_end, similarity): passages of
    least_words words or more of docs (doc_id, text) that another document, with a smaller id, has too.

    Copies of a passage are each linked to the first of their class and not to all, and of classes that are alike
    to the same earlier one not each pair is linked; each passage that is alike to another is linked to it or, in
    such steps, by others that are. Repeats within one document are not searched.
    Null ids, null texts and texts of fewer words have none. Rows that repeat an id are one document: a
    passage of any of its rows counts, and is listed once. Other columns are not read.
    """
    span = least_words - WORDS + 1
    need = _near_enough(span, similarity)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    posts = size / 6 * 2 / span * HASHES * _post_kind(span).itemsize
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(posts / RANGE_BYTES) + 1)
    packed = map_arrow(base, _post(parts, WORDS, span), _PACKED)
    links = packed.groupBy("part").applyInArrow(_meet(parts, span, need), _PACKED)
    found = cut(links.groupBy("part").applyInArrow(_sweep(need), "doc long, other long, shift long, s long, e long"))
    return _alike(base, found, span, similarity)


def _alike(base: DataFrame, found: DataFrame, span: int, similarity: float) -> DataFrame:
    """The passages at the candidates found (doc, other, shift, s, e)."""
    few = found.count() <= BROADCAST_ROWS

    def grams(spots: DataFrame) -> DataFrame:
        """(id, s, e, low, grams) of distinct spots (id, s, e): each text is read once for all of its own."""
        own = spots.distinct().groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("s", "e")).alias("spots"))
        own = F.broadcast(own) if few else own
        return map_arrow(base.join(own, "doc_id").select("doc_id", "text", "spots"), _slices(WORDS), "id long, s long, e long, low long, grams binary")

    mine = grams(found.select(F.col("doc").alias("id"), "s", "e")).select(F.col("id").alias("doc"), "s", "e", F.col("low").alias("low1"), F.col("grams").alias("grams1"))
    shifted = found.select("doc", "other", "s", "e", (F.col("s") + F.col("shift")).alias("s2"), (F.col("e") + F.col("shift")).alias("e2"))
    theirs = grams(shifted.select(F.col("other").alias("id"), F.col("s2").alias("s"), F.col("e2").alias("e"))).select(F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"), "low", "grams")
    both = shifted.join(mine, ["doc", "s", "e"]).join(theirs, ["other", "s2", "e2"]).select("doc", "other", "low1", "low", "grams1", "grams")
    return map_arrow(both, _verify(WORDS, span, similarity), "doc_id long, first_word long, end_word long, other_id long, other_first long, other_end long, similarity double").distinct()
