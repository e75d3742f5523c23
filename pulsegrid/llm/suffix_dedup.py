"""Removal of long repeated strings with a sampled, range-partitioned suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, row_key

#: Leading bytes of a suffix that choose it (a multiple of 8), bytes after them by which ranges are split, starts of
#: strings that one task scans at a time, and suffixes that one range of the sorted order holds.
LEAD, MORE, SCAN, RANGE = 104, 16, 1 << 19, 20_000
_M64 = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes, mod 2**64 over random byte values, of all substrings of one length."""

    def __init__(self, n: int):
        base, rng = 0xD6E8FEB86659FD93, np.random.default_rng(20240)
        self.byte = rng.integers(1, 1 << 63, 256, np.uint64)
        self.power, self.back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        self.power[1:], self.back[1:] = base, pow(base, -1, 1 << 64)
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.back, out=self.back)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        n = data.shape[-1]
        out = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], axis=-1, out=out[..., 1:])
        return out

    def grams(self, data: np.ndarray, k: int) -> np.ndarray:
        p = self.prefixes(data)
        return _mix((p[k:] - p[:-k]) * self.back[: len(p) - k])


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """For strings of `length` bytes inside the segments [begins, ends): runs of starts that share an anchor.

    A string's anchor is the place in it whose next LEAD bytes hash least, the rightmost of equals, so that equal
    strings have their anchors at the same offset. Returns (hash, anchor, first start, last start) of each run.
    """
    n, w = len(data), length - LEAD + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    mask = np.uint64((1 << 24) - 1)
    gram = hasher.grams(data, LEAD)
    low = (gram & ~mask) | (mask - np.arange(len(gram), dtype=np.uint64))
    reach = 1
    while 2 * reach <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: n - length + 1], low[w - reach :][: n - length + 1])
    at = (mask - (low & mask)).astype(np.int64)
    valid = np.zeros(n - length + 2, np.int32)
    ok = ends - begins >= length
    np.add.at(valid, begins[ok], 1)
    np.add.at(valid, ends[ok] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
    new[begins[ok]] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.concatenate((new[1:] | ~valid[1:], [True])) & valid)
    return gram[at[first]], at[first], first, stop


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to arrays of about SCAN bytes; a longer text goes in overlapping slices. (data, row, begin, end, base)"""
    held: list[bytes] = []
    rows: list[int] = []
    base: list[int] = []
    size = 0

    def out() -> tuple:
        ends = np.cumsum([len(x) for x in held])
        return np.frombuffer(b"".join(held), np.uint8), np.array(rows), np.concatenate(([0], ends[:-1])), ends, np.array(base)

    for r, t in enumerate(texts):
        for s in range(0, max(len(t) - length + 1, 0), SCAN):
            part = t[s : s + SCAN + length - 1]
            held.append(part)
            rows.append(r)
            base.append(s)
            size += len(part)
            if size >= SCAN:
                yield out()
                held, rows, base, size = [], [], [], 0
    if held:
        yield out()


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """`(gram, r1, r2, at, first, last)`: the runs of every text, positions in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * SCAN + 2 * length)
        for b in batches:
            r1, r2 = (np.asarray(b.column(i)) for i in (0, 1))
            for data, row, begin, end, base in _pieces([x.as_py() for x in b.column(2)], length):
                gram, at, first, last = anchors(data, begin, end, length, hasher)
                seg = np.searchsorted(begin, first, side="right") - 1
                move = base[seg] - begin[seg]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(r1[row[seg]]), pa.array(r2[row[seg]]), *(pa.array((x + move).astype(np.int32)) for x in (at, first, last))],
                    names=["gram", "r1", "r2", "at", "first", "last"],
                )

    return docs.select("r1", "r2", "bytes").mapInArrow(run, "gram long, r1 long, r2 long, at int, first int, last int")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as they travel to a shuffle: compressed, for they make up most of what is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield b.set_column(b.schema.get_field_index("bytes"), "bytes", pa.array([press(x.as_py()) for x in b.column("bytes")], pa.binary()))

    return docs.mapInArrow(run, docs.schema)


def _suffixes(held: DataFrame, length: int) -> DataFrame:
    """`(suffix, before, r1, r2, at, first, last)`: the bytes from the anchor on and, reversed, those before it, as
    far as the run's strings reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                data, (r1, r2) = unpack(b.column(2)[i].as_py()), (b.column(k)[i].as_py() for k in (0, 1))
                runs = [b.column(k)[i].values for k in (3, 4, 5)]
                at, first, last = (x.to_pylist() for x in runs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([data[a : e + length] for a, e in zip(at, last)], pa.binary()),
                        pa.array([data[s:a][::-1] for a, s in zip(at, first)], pa.binary()),
                        pa.array([r1] * len(at), pa.int64()), pa.array([r2] * len(at), pa.int64()), *runs,
                    ],
                    names=["suffix", "before", "r1", "r2", "at", "first", "last"],
                )

    return held.select("r1", "r2", "bytes", "at", "first", "last").mapInArrow(run, "suffix binary, before binary, r1 long, r2 long, at int, first int, last int")


def multikey_order(words: np.ndarray, kind: str = "stable") -> np.ndarray:
    """The order of the rows of `words` (unsigned 64-bit characters), by multikey quicksort: sort by one character,
    then only what is still equal by the next. Equal rows keep their order if `kind` is stable."""
    order = np.argsort(words[:, 0], kind=kind)
    lead = words[order, 0]
    group = np.cumsum(np.concatenate(([0], (lead[1:] != lead[:-1]).astype(np.int64))))
    for j in range(1, words.shape[1]):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub = np.lexsort((words[order[tied], j], group[tied]))
        order[tied] = order[tied[sub]]
        char = words[order, j]
        step = group[1:] != group[:-1]
        both = np.zeros(len(group), bool)
        both[tied] = True
        step |= both[1:] & both[:-1] & (char[1:] != char[:-1])
        group = np.cumsum(np.concatenate(([0], step.astype(np.int64))))
    return order


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Binary values as rows of `width` bytes, padded with zeros."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    out = np.zeros((len(col), width), np.uint8)
    length = np.diff(offsets)
    rows = np.repeat(np.arange(len(col)), length)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)] = data[offsets[0] : offsets[-1]]
    return out


def _lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _same_bytes(full: np.ndarray, length: int, a: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Are the strings of `length` bytes at column `col` of rows a and b of `full` equal, byte by byte?"""
    key, back = np.unique(a.astype(np.int64) * len(full) + b, return_inverse=True)
    out, by = np.zeros(len(a), bool), np.argsort(back, kind="stable")
    ends = np.searchsorted(back[by], np.arange(0, len(key) + 2000, 2000))
    for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        i, j = np.divmod(key[2000 * k : 2000 * (k + 1)], len(full))
        wrong = np.zeros((len(i), full.shape[1] + 1), np.int16)
        np.cumsum(full[i] != full[j], axis=1, out=wrong[:, 1:])
        rows = by[s:e]
        out[rows] = (wrong[:, length:] == wrong[:, :-length])[back[rows] - 2000 * k, col[rows]]
    return out


def _repeats(suffixes: DataFrame, length: int, ranges: int) -> DataFrame:
    """`(r1, r2, start, end, bucket, edge)`: repeated stretches, and what must be compared across ranges.

    Sampled splitters deal the suffixes to ranges by their leading bytes: the first eight, a hash of the first LEAD, the
    MORE after them, then by row, so that a passage with very many copies fills several ranges; a splitter is 40 bytes.
    A range is sorted by multikey quicksort; suffixes that share LEAD bytes then stand together, and two strings can
    only be equal in there and at the same offset. Equal ones are found by digests and compared byte by byte.
    Strings of the range's outermost groups may have equals in another range: 128 bits of their SHA-256 are sent on, in
    one packed row for each bucket. A string whose part after the anchor is longer than what its suffix shares with the
    range's outermost one can't have an equal beyond, and stays.
    """
    lead = F.xxhash64(F.substring("suffix", 1, LEAD))
    dealt = suffixes.repartitionByRange(ranges, F.substring("suffix", 1, 8), lead, F.substring("suffix", LEAD + 1, MORE), F.xxhash64("before", "r1", "r2", "at"))
    left, width = length - LEAD, length - LEAD + length
    refs = np.dtype([("digest", "S16"), ("r1", "<i8"), ("r2", "<i8"), ("start", "<i4"), ("dup", "<i4")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        table = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        hasher, n = Hasher(width + 1), table.num_rows
        suffix, before = (_matrix(table.column(k).chunk(0), w) for k, w in ((0, length), (1, left)))
        order = multikey_order(np.hstack((suffix, before)).view(">u8").astype(np.uint64))
        suffix = suffix[order]
        full = np.hstack((before[order, ::-1], suffix))
        r1, r2, at, first, last = (np.asarray(table.column(k))[order] for k in range(2, 7))
        del table, before
        same = (suffix[1:, :LEAD] == suffix[:-1, :LEAD]).all(axis=1)
        group = np.cumsum(np.concatenate(([0], ~same)))
        more = suffix[:, LEAD : LEAD + MORE]
        begins = np.flatnonzero(np.concatenate(([True], ~same)))
        reach = np.zeros(n, np.int64)
        for end, pick in ((begins[0], min), (begins[-1], max)):  # the range's outermost groups, as the splitters have it
            tied = begins[(suffix[begins, :8] == suffix[end, :8]).all(axis=1)]
            g = group[pick(tied.tolist(), key=lambda i: (d := xxhash.xxh64_intdigest(suffix[i, :LEAD].tobytes(), 42)) - (d >> 63 << 64))]
            rows = np.flatnonzero(group == g)
            shared = _lcp(more[rows], more[[pick(rows.tolist(), key=lambda i: more[i].tobytes())]])
            reach[rows] = np.maximum(reach[rows], np.where(shared < MORE, LEAD + shared, length))
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], ~same))), [n]))
        low = 0
        while low < n:
            high = int(cuts[min(np.searchsorted(cuts, low + 2000), len(cuts) - 1)])
            high = max(high, int(cuts[np.searchsorted(cuts, low, side="right")]))
            digests, rows, cols = [], [], []
            for s in range(low, high, 1000):
                e = min(s + 1000, high)
                p = hasher.prefixes(full[s:e])
                head = _mix(p[:, left + LEAD] - p[:, left])
                col = np.arange(left + 1)
                hashed = _mix((p[:, length:] - p[:, :-length]) + head[:, None] * np.uint64(_ODD) + col.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                ok = (col >= (left - (at - first)[s:e])[:, None]) & (col <= (left - (at - last)[s:e])[:, None])
                i, c = np.nonzero(ok)
                digests.append(hashed[i, c])
                rows.append((i + s).astype(np.int32))
                cols.append(c.astype(np.int16))
            digest, row, col = map(np.concatenate, (digests, rows, cols))
            by = np.argsort(digest, kind="stable")
            eq = np.flatnonzero(digest[by][1:] == digest[by][:-1])
            a, z = by[eq], by[eq + 1]
            true = (col[a] == col[z]) & _same_bytes(full, length, row[a], row[z], col[a].astype(np.int64))
            dup, later = np.zeros(len(digest), bool), np.zeros(len(digest), bool)
            dup[a[true]] = dup[z[true]] = later[z[true]] = True
            for d in np.unique(digest[a[~true]]).tolist():  # different strings with one digest: told apart by their bytes
                seen: dict[bytes, int] = {}
                dup[digest == d] = later[digest == d] = False
                for i in np.flatnonzero(digest == d).tolist():
                    mate = seen.setdefault(full[row[i], col[i] : col[i] + length].tobytes(), i)
                    if mate != i:
                        dup[mate] = dup[i] = later[i] = True
            start = at[row].astype(np.int64) - left + col
            d = np.flatnonzero(dup)
            if len(d):
                step = (np.diff(row[d]) != 0) | (np.diff(start[d]) != 1)
                a, z = d[np.concatenate(([True], step))], d[np.concatenate((step, [True]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r1[row[a]]), pa.array(r2[row[a]]), pa.array(start[a].astype(np.int32)), pa.array((start[z] + length).astype(np.int32)), pa.array(np.full(len(a), -1, np.int32)), pa.nulls(len(a), pa.binary())],
                    names=["r1", "r2", "start", "end", "bucket", "edge"],
                )
            far = np.flatnonzero(~later & (col + length - left <= reach[row]))
            if len(far):
                packed = np.zeros(len(far), refs)
                named = [hashlib.sha256(full[i, c : c + length]).digest()[:16] for i, c in zip(row[far].tolist(), col[far].tolist())]
                for k, v in (("digest", named), ("r1", r1[row[far]]), ("r2", r2[row[far]]), ("start", start[far]), ("dup", dup[far])):
                    packed[k] = v
                bucket = (np.frombuffer(b"".join(x[:8] for x in named), np.uint64) % np.uint64(ranges)).astype(np.int32)
                packed, bucket = packed[o := np.argsort(bucket, kind="stable")], bucket[o]
                edges = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(bucket)]))
                m = len(edges) - 1
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.array(bucket[edges[:-1]]), pa.array([packed[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])], pa.binary())],
                    names=["r1", "r2", "start", "end", "bucket", "edge"],
                )
            low = high

    found = cut(dealt.mapInArrow(run, "r1 long, r2 long, start int, end int, bucket int, edge binary"))

    def across(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("edge").to_pylist()), refs)
        x = x[np.argsort(x["digest"], kind="stable")]
        eq = np.concatenate(([False], x["digest"][1:] == x["digest"][:-1], [False]))
        x = x[(eq[1:] | eq[:-1]) & (x["dup"] == 0)]
        return pa.table({"r1": x["r1"], "r2": x["r2"], "start": x["start"], "end": x["start"] + np.int32(length)})

    beyond = found.filter("bucket >= 0").select("bucket", "edge").groupBy("bucket").applyInArrow(across, "r1 long, r2 long, start int, end int")
    return found.filter("bucket < 0").select("r1", "r2", "start", "end").union(beyond)


class Passages:
    """Runs of `gram` words that stand for every passage of over `words` words: in each such passage one is chosen, the one
    whose hash is the least, so that two texts that share the passage choose the same."""

    def __init__(self, words: int, gram: int):
        self.gram, self.window = gram, words + 2 - gram
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.hasher, self.turns = Hasher(4 * SCAN), Hasher(1 << 16)

    def words(self, text: bytes) -> np.ndarray:
        """The hash of every word."""
        out, at = [], 0
        while at < len(text):
            part = text[at : at + SCAN]
            if at + SCAN < len(text) and (cut := max(part.rfind(c) for c in (b" ", b"\n", b"\t"))) > 0:
                part = part[:cut]
            elif at + SCAN < len(text):  # a word that is longer than a slice
                end = next((i for i in range(at + SCAN, len(text)) if self.space[text[i]]), len(text))
                part = text[at:end]
            at += len(part)
            if len(part) > 4 * SCAN:
                out += [np.frombuffer(hashlib.sha256(w).digest()[:8], np.uint64) for w in part.split()]
                continue
            data = np.frombuffer(part, np.uint8)
            gap = np.concatenate(([True], self.space[data], [True]))
            begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
            p = self.hasher.prefixes(data)
            out.append(_mix((p[end] - p[begin]) * self.hasher.back[begin]))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def chosen(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the runs chosen in each text, by text."""
        row, all_words = np.repeat(np.arange(len(words)), [len(w) for w in words]), np.concatenate(words)
        n, k, w = len(all_words), self.gram, self.window
        if n < k + w - 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n + 1 > len(self.turns.power):
            self.turns = Hasher(2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(all_words * self.turns.power[:n], out=total[1:])
        low = _mix((total[k:] - total[:-k]) * self.turns.back[: n + 1 - k])
        reach = 1
        while 2 * reach <= w:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < w:
            low = np.minimum(low[: reach - w], low[w - reach :])
        row = np.where(row[: len(low)] == row[k + w - 2 :], row[: len(low)], -1)  # a window lies in one text
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (row[1:] != row[:-1]))) & (row >= 0)
        return row[new], low[new]


def shared_passages(docs: DataFrame, words: int, gram: int) -> DataFrame:
    """`(r1, n_passages)` for `docs` (r1, bytes): how many of its chosen runs of `gram` words other rows have, too. A text
    that shares over `words` words in a row has at least one. Rows are dealt by the run and sorted; one that many have is
    run through, not gathered."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(words, gram)
        for b in batches:
            r1, held, rows, size = np.asarray(b.column(0)), [], [], 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or size >= SCAN:
                    if held:
                        row, run = passages.chosen(held)
                        yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(r1[np.array(rows)[row]])], names=["run", "r1"])
                    held, rows, size = [], [], 0
                if i < b.num_rows:
                    text = b.column(1)[i].as_py()
                    held.append(passages.words(text))
                    rows.append(i)
                    size += len(text)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, last, many = None, 0, 0, True  # the run that a batch before ended in
        for b in batches:
            runs, r1 = (np.asarray(c) for c in b.columns)
            if not len(runs):
                continue
            goes_on = runs[0] == run
            fresh = np.concatenate(([not (goes_on and r1[0] == last)], (runs[1:] != runs[:-1]) | (r1[1:] != r1[:-1])))
            tail = (runs[-1], r1[-1])
            runs, r1 = runs[fresh], r1[fresh]
            out = []
            if len(runs):
                group = np.cumsum(np.concatenate(([0], runs[1:] != runs[:-1])))
                several = np.bincount(group) > 1
                if goes_on and runs[0] == run:
                    several[0] = True
                    if not many:
                        out.append(first)
                out = np.concatenate((np.array(out, np.int64), r1[several[group]]))
                ends = bool(several[-1]) or (group[-1] == 0 and goes_on and many)
                first, many = (first if goes_on and group[-1] == 0 else r1[np.searchsorted(group, group[-1])]), ends
            run, last = tail
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(out, np.int64))], names=["r1"])

    found = docs.select("r1", "bytes").mapInArrow(scan, "run long, r1 long")
    both = found.repartition("run").sortWithinPartitions("run", "r1").mapInArrow(meet, "r1 long")
    return both.groupBy("r1").agg(F.count("*").alias("n_passages"))


def remove_repeats(df: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", words: int = 50, gram: int = 35) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which also starts anywhere else in the table.

    Strings are of UTF-8 bytes and never cross rows; they are judged on the input. `length` must exceed 104.
    Returns a row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, `kept`, the
    remaining bytes, and n_passages. Passages of over `words` words may be shorter than `length` bytes and so stay; where
    other rows have them, too, n_passages is over 0. It counts runs of `gram` words (`shared_passages`), so that it may
    also tell of passages of `gram` to `words` words; rows equal in id and text are one row for it.

    Null text is empty. A text shorter than `length` stays. Repeated rows are repeats of each other and go
    whole. Null doc_ids are carried; other columns are not read. An empty table gives an empty table.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("doc_id", F.col("t").cast("binary").alias("bytes"), *(k.alias(n) for k, n in zip(row_key("doc_id", "t"), ("r1", "r2"))))
    runs = _scan(docs, length)
    twice = cut(runs.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(partitions(spark), -(-total // RANGE))
    # rows that are equal have one list of runs; only texts that have any are kept for what follows
    lists = runs.join(twice, "gram", "left_semi").groupBy("r1", "r2").agg(F.collect_set(F.struct("at", "first", "last")).alias("runs"))
    lists = lists.select("r1", "r2", *[F.col("runs").getField(n).alias(n) for n in ("at", "first", "last")])
    held = cut(_packed(docs).join(lists, ["r1", "r2"]))
    repeats = _repeats(_suffixes(held, length), length, ranges)
    spans = repeats.groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for data, got in zip(b.column(1), b.column(2)):
                raw, merged = unpack(data.as_py()), []
                if got.is_valid:
                    start, end = (np.asarray(x) for x in got.values.flatten())
                    for s, e in zip(start[o := np.argsort(start)].tolist(), end[o].tolist()):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                at, kept = 0, []
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                for k, v in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "r1", *out])

    kind = df.schema[doc_id].dataType.simpleString()
    some = held.join(spans, ["r1", "r2"], "left").select("doc_id", "bytes", "spans", "r1").mapInArrow(run, f"doc_id {kind}, r1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("long")
    plain = docs.select("doc_id", "r1", "r2", F.octet_length("bytes").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"), F.col("bytes").alias("kept"))
    whole = plain.join(held.select("r1", "r2").distinct(), ["r1", "r2"], "left_anti").drop("r2")
    done = some.unionByName(whole).join(shared_passages(docs, words, gram), "r1", "left")
    return done.drop("r1").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)).cast("long"))
