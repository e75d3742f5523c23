"""Periodic runs of words, found as maximal pairs in the tree of LCP intervals."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ranks import common_prefixes, rank_levels
from .sentencepiece import Places, _slices

#: Counters (a power of two) of the sieve that looks for repeated grams; more only let fewer single ones through.
BUCKETS = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def least_pair(min_length: int, times: int) -> int:
    """The shortest match that a run can have: one of period q matches itself at distance q in max(min_length - q, (times - 1) q) words or more."""
    return min(max(min_length - q, (times - 1) * q) for q in range(1, max(min_length, 2)))


def zones(ids: np.ndarray, doc: np.ndarray, k: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [begin, end) of words, disjoint and each inside one text, that together hold every run whole.

    In a run of period q, over (times - 1) q - k + 1 grams of k words in a row come again after q words. So a gram that
    doesn't come again soon enough for the row of coming-again grams it stands in is in no run; what is left is widened by the
    longest period there.
    """
    none = np.zeros(0, np.int64)
    n = len(ids) - k + 1
    if n < 2:
        return none, none
    gram = doc[:n].astype(np.uint64) * _ODD
    gram ^= gram >> np.uint64(29)
    for j in range(k):
        gram = (gram + ids[j : n + j].astype(np.uint64)) * _ODD
        gram ^= gram >> np.uint64(29)
    bucket = (gram & np.uint64(BUCKETS - 1)).astype(np.int64)
    at = np.flatnonzero((np.bincount(bucket, minlength=BUCKETS)[bucket] > 1) & (doc[:n] == doc[k - 1 :]))
    at = at[np.argsort(gram[at], kind="stable")]
    same = gram[at[1:]] == gram[at[:-1]]
    again = np.zeros(n, np.int64)
    again[at[:-1][same]] = (at[1:] - at[:-1])[same]
    while True:
        live = again > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], live.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        most = (end - begin + k - 1) // (times - 1)
        bound = np.zeros(n, np.int64)
        bound[np.flatnonzero(live)] = np.repeat(most, end - begin)
        late = live & (again > bound)
        if not late.any():
            break
        again[late] = 0
    if not len(begin):
        return none, none
    stop = np.minimum(end + k - 1 + most, np.searchsorted(doc, doc[begin], side="right"))
    reach = np.maximum.accumulate(stop)
    first = np.concatenate(([True], begin[1:] >= reach[:-1]))
    return begin[first], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(begin) - 1]))]


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], k: int, min_length: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs (i, j, length of the match), i < j, that are runs: (times - 1)(j - i) <= length, min_length in all.

    Suffixes in sorted `order` come with the LCP of each and the next one. Intervals close from the bottom up; each holds
    its suffixes in the order of their places, next to which `left` names the class of the word in front. Where two
    children meet, the pairs of different classes are left- and right-maximal. Of those, only ones next to each other in
    place can be at the least period, so that only neighbours are looked at: n log n in all.
    """
    stack: list[tuple[int, list[int]]] = []
    for at, deep in zip(order, lcp):
        node = [at]
        while stack and stack[-1][0] >= deep:
            d, big = stack.pop()
            small = node
            if len(small) > len(big):
                small, big = big, small
            limit = d // (times - 1)
            for x in small:
                p = bisect(big, x)
                if p and x - (y := big[p - 1]) <= limit and left[x] != left[y] and d + x - y >= min_length:
                    yield y, x, d
                if p < len(big) and (y := big[p]) - x <= limit and left[x] != left[y] and d + y - x >= min_length:
                    yield x, y, d
            if len(small) == 1:
                big.insert(p, small[0])
            else:
                big.extend(small)
                big.sort()
            node = big
        if deep >= k:
            stack.append((deep, node))


def find(ids: np.ndarray, doc: np.ndarray, min_length: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in the words `ids` of the texts `doc` (ascending), by start, then period."""
    k = least_pair(min_length, times)
    begin, end = zones(ids, doc, k, times)
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    size = end - begin
    base = np.cumsum(size + 1) - size - 1
    place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    codes, real, left = (np.full(base[-1] + size[-1] + 1, -1, np.int64) for _ in range(3))
    inside = np.ones(len(codes), bool)
    inside[base + size] = False
    codes[inside], real[inside] = ids[place], place
    codes[~inside] = ids.max() + 1 + np.arange(len(base))
    before = np.maximum(place - 1, 0)
    left[inside] = np.where((place > 0) & (doc[before] == doc[place]), ids[before], -1)
    levels = rank_levels(codes)
    order = np.empty(len(codes), np.int64)
    order[levels[-1]] = np.arange(len(codes))
    lcp = common_prefixes(levels, order[:-1], order[1:])
    held = np.concatenate(([False], lcp >= k)) | np.concatenate((lcp >= k, [False]))
    lcp = np.concatenate((lcp, [0]))
    pairs = list(maximal_pairs(order[held].tolist(), lcp[held].tolist(), left.tolist(), k, min_length, times))
    if not pairs:
        return np.zeros((0, 3), np.int64)
    i, j, d = np.array(pairs, np.int64).T
    out = np.stack((real[i], j - i + d, j - i), 1)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]  # of a stretch's periods the least
    out = out[np.concatenate(([True], (out[1:, :2] != out[:-1, :2]).any(1)))]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def find_runs(df: DataFrame, text: str = "text", min_length: int = 6, times: int = 4) -> DataFrame:
    """All rows and columns of `df` with `n_words`, `runs` (start, length and period in words, by start, then period) and
    `collapsed`: the words that no run holds after its first period, joined by one space.

    A run is a stretch of at least max(min_length, times * q) words whose smallest period is q and that neither neighbour
    extends. Words are split at ASCII white space. Repeated grams are looked for first; the words of the stretches around them
    are sorted as suffixes, and of the tree of LCP intervals, from the bottom up, those maximal pairs are taken whose
    distance fits their length: they are the runs, ends included.

    A null or empty text has no words, no runs and an empty `collapsed`. Rows are independent: repeated ones give equal
    results, an empty table gives an empty table. Columns of the three output names are replaced. A text is held in one task
    as a whole, whatever its length; nothing else is gathered.
    """
    if times < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    names = {f.name for f in fields}
    keep = [k for k, f in enumerate(df.schema.fields) if f.name not in names]
    kept = [df.schema.fields[k] for k in keep]
    spot = df.columns.index(text)
    out = [f.name for f in [*kept, *fields]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(spot).cast(pa.binary()).fill_null(b"")
            for a, n in _slices([len(x.as_buffer()) for x in col]):
                parts = [x.as_py().split() for x in col.slice(a, n - a)]
                count = np.fromiter(map(len, parts), np.int64, len(parts))
                ids = np.fromiter(map(Places([]).__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
                first = np.cumsum(count) - count
                doc = np.repeat(np.arange(len(parts)), count)
                runs = find(ids, doc, min_length, times)
                row = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                stays = np.cumsum(gone[:-1]) == 0
                whole = np.ones(len(parts), bool)
                whole[row] = False
                texts = [b" ".join(p if w else compress(p, stays[f : f + len(p)].tolist())).decode() for p, w, f in zip(parts, whole.tolist(), first.tolist())]
                struct = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
                edge = np.searchsorted(row, np.arange(len(parts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, n - a) for k in keep), pa.array(count), pa.ListArray.from_arrays(pa.array(edge), struct), pa.array(texts, pa.string())], names=out)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(each, T.StructType([*kept, *fields]))
