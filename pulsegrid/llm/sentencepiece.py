"""SentencePiece encoding and decoding by suffix-array matching and relaxation over the matched edges."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .suffix_dedup import multikey_order

MARK = "▁"
#: Characters indexed at a time, chunks that a worker remembers, and pairs of pieces (a power of two) whose fit it
#: remembers, each in the place its hash names. They bound memory; no result depends on them.
INDEXED, REMEMBERED, KNOWN = 150_000, 200_000, 1 << 20
_ODD = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Stands before a chunk that has no space in front.
_BARE = "\x01"


def load(path: str) -> dict:
    """What encoding needs of a model file, read on the driver: pieces, ranks, byte pieces, and the file's digest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {"pieces": [sp.id_to_piece(i) for i in plain], "ids": plain, "ranks": [-sp.get_score(i) for i in plain], "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}, "size": n, "digest": hashlib.sha256(Path(path).read_bytes()).hexdigest()}


class Places(dict):
    """Chunk to its place; one that is asked for the first time gets the next place and is listed as new."""

    def __init__(self, chunks: list[str]):
        super().__init__(zip(chunks, range(len(chunks))))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        place = self[chunk] = len(self)
        return place


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that have `count` items each: the row of every item, and its number within the row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


class Tokenizer:
    """Exact BPE with byte fallback for models whose pieces hold the space mark only in front and no newline."""

    def __init__(self, model: dict):
        self.pieces, self.ids, self.ranks = model["pieces"], np.array(model["ids"]), model["ranks"]
        self.at = {p: k for k, p in enumerate(self.pieces)}
        if any("\n" in p or (MARK in p.lstrip(MARK)) or (p.startswith(2 * MARK) and p.strip(MARK)) for p in self.pieces):
            raise ValueError("pieces across words or lines")
        self.byte = [model["bytes"][b] for b in range(256)]
        chars = sorted({c for p in self.pieces for c in p})
        if any(c not in self.at for c in chars) or len(chars) > 65_000:
            raise ValueError("every character of a piece must be a piece")
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.split: dict[int, tuple[int, int]] = {}
        whole = [k for k, p in enumerate(self.pieces) if self.merge(p, k) == [k]]
        self.whole = np.array(whole)
        self.length = np.array([len(p) for p in self.pieces])
        self.longest = -(-int(self.length.max()) // 4) * 4
        codes = np.zeros((len(whole), self.longest), np.uint16)
        for r, k in enumerate(whole):
            codes[r, : len(self.pieces[k])] = self.code[[ord(c) for c in self.pieces[k]]]
        high = np.where(np.arange(self.longest) < self.length[self.whole][:, None], codes, np.uint16(0xFFFF))
        self.low, self.high = self._pack(codes), self._pack(high)
        self.short = self.length[self.whole] <= 4
        self.known, self.fits = np.full(KNOWN, -1, np.int64), np.zeros(KNOWN, bool)
        cuts = ((self.at.get(p[:i]), self.at.get(p[i:]), self.ranks[k]) for k, p in enumerate(self.pieces) for i in range(1, len(p)))
        joins = {x * len(self.pieces) + y: rank for x, y, rank in cuts if x is not None and y is not None}
        self.joins = np.array(sorted(joins) or [-1], np.int64)
        self.join_ranks = np.array([joins.get(k, 0.0) for k in self.joins.tolist()])
        self.spines = [self._spines(side) for side in (0, 1)]
        self.keep([], np.zeros(0, np.int32), np.zeros(1, np.int64))

    def keep(self, chunks: list[str], flat: np.ndarray, offset: np.ndarray) -> None:
        """Remember these chunks and their ids, and nothing else."""
        self.places, self.flat, self.offset, self.again = Places(chunks), flat, offset, np.zeros(len(chunks), bool)

    def forget(self) -> None:
        """Forget the chunks that no batch has asked for again since the last time."""
        at = np.flatnonzero(self.again)
        count = self.offset[at + 1] - self.offset[at]
        row, step = _ragged(count)
        self.keep(list(compress(self.places, self.again.tolist())), self.flat[self.offset[at][row] + step], np.concatenate(([0], np.cumsum(count))))

    @staticmethod
    def _pack(codes: np.ndarray) -> np.ndarray:
        x = codes.reshape(len(codes), -1, 4).astype(np.uint64)
        return (x[..., 0] << np.uint64(48)) | (x[..., 1] << np.uint64(32)) | (x[..., 2] << np.uint64(16)) | x[..., 3]

    def merge(self, text: str, whole: int = -1) -> list[int]:
        """Plain BPE: join the best pair, the leftmost of equals, until none is a piece; unknown characters are
        -1 - code point. With `whole`, the last join that makes that piece is noted."""
        n = len(text)
        sym = [self.at.get(c, -ord(c) - 1) for c in text]
        part, nxt, prv = list(text), [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, str, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (k := self.at.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (self.ranks[k], i, part[i] + part[j], j))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if not part[i] or nxt[i] != j or part[i] + part[j] != joined:
                continue
            k = self.at[joined]
            if k == whole:
                self.split[k] = (sym[i], sym[j])
            part[i], sym[i], part[j] = joined, k, ""
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [s for s, p in zip(sym, part) if p]

    def _spines(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each piece the symbols that stand at one end of it while it is made, each with the rank that uses it up:
        where a piece's begin, how many they are, symbols, ranks."""
        symbols, ranks, count = [], [], []
        for k in range(len(self.pieces)):
            end, x, n = float("inf"), k, len(symbols)
            while True:
                symbols.append(x)
                ranks.append(end)
                if x not in self.split:
                    break
                end, x = self.ranks[x], self.split[x][side]
            count.append(len(symbols) - n)
        return np.cumsum(count) - count, np.array(count), np.array(symbols), np.array(ranks)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a: no join across the border comes before one that uses up its parts."""
        (begin_a, count_a, symbols_a, ranks_a), (begin_b, count_b, symbols_b, ranks_b) = self.spines[1], self.spines[0]
        row, step = _ragged(count_a[a] * count_b[b])
        i, j = np.divmod(step, count_b[b][row])
        i, j = i + begin_a[a][row], j + begin_b[b][row]
        key = symbols_a[i] * len(self.pieces) + symbols_b[j]
        spot = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        hit = np.flatnonzero(self.joins[spot] == key)
        rank = self.join_ranks[spot[hit]]
        out = np.ones(len(a), bool)
        out[row[hit[(rank < ranks_a[i[hit]]) & (rank <= ranks_b[j[hit]])]]] = False
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.pieces) + b
        spot = (key * _ODD >> np.int64(40)) & (KNOWN - 1)
        miss = self.known[spot] != key
        fits = self.fits[spot]
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            got = self._fit(*np.divmod(new, len(self.pieces)))
            fits[miss] = got[back]
            spot = (new * _ODD >> np.int64(40)) & (KNOWN - 1)
            spot, one = np.unique(spot, return_index=True)
            self.known[spot], self.fits[spot] = new[one], got[one]
        return fits

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of a piece in the indexed text: (position, piece)."""
        padded = np.concatenate((codes, np.zeros(self.longest + 4, np.uint16))).astype(np.uint64)
        four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
        where = np.flatnonzero(codes)
        words = np.stack([four[where + 4 * j] for j in range(self.longest // 4)], axis=1)
        order = multikey_order(words, "quicksort") if len(where) else where
        index, words = where[order], words[order]

        def bound(q: np.ndarray, right: bool) -> np.ndarray:
            lo, hi = (np.searchsorted(words[:, 0], q[:, 0], side=s) for s in ("left", "right"))
            if right:  # beyond the first word a short piece's bound is all ones or all zeros
                lo = np.where(self.short, hi, lo)
            else:
                hi = np.where(self.short, lo, hi)
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                s, t = words[mid], q[live]
                less, same = np.zeros(len(live), bool), np.ones(len(live), bool)
                for j in range(1, q.shape[1]):
                    less |= same & (s[:, j] < t[:, j])
                    same &= s[:, j] == t[:, j]
                up = (less | same) if right else less
                lo[live[up]] = mid[up] + 1
                hi[live[~up]] = mid[~up]
                live = live[lo[live] < hi[live]]
            return lo

        lo, hi = bound(self.low, False), bound(self.high, True)
        count = hi - lo
        row, step = _ragged(count)
        return index[lo[row] + step], self.whole[row]

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all `chunks`, and where each one's end; the spaces in front are part of a chunk."""
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        ids, counts, a = [], [], 0
        while a < len(chunks):
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + INDEXED)) + 1
            got, count = self._learn(chunks[a:z])
            ids.append(got)
            counts.append(count)
            a = z
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(c) for c in chunks])
        begin = np.cumsum(size + 1) - size - 1
        codes = self.code[points]
        codes[begin + size] = 0
        pos, piece = self.edges(codes)
        # unknown characters are edges of their own; -1 stands for a border that any piece may follow
        odd = np.flatnonzero(codes == 0)
        odd = odd[np.isin(odd, begin + size, invert=True)]
        pos, piece = np.concatenate((pos, odd)), np.concatenate((piece, np.full(len(odd), -1)))
        stop = pos + np.where(piece < 0, 1, self.length[piece])
        level = stop - np.repeat(begin, size + 1)[pos]
        by = np.argsort(level.astype(np.uint16) if int(size.max()) < 1 << 16 else level, kind="stable")
        pos, piece, stop, level = pos[by], piece[by], stop[by], level[by]
        last = np.full(len(codes) + 1, -2)
        last[begin] = -1
        cuts = np.searchsorted(level, np.arange(1, (level[-1] if len(level) else 0) + 2))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before, p = last[pos[a:z]], piece[a:z]
            ok = (before == -1) | (p < 0)
            if len(ask := np.flatnonzero(~ok)):
                ok[ask] = self._fits(before[ask], p[ask])
            last[stop[a:z][ok]] = p[ok]
        # walk every chunk back from its end; then the tokens of all chunks in order
        rows, steps = np.flatnonzero(size), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        now = (begin + size)[rows]
        while len(rows):
            p = last[now]
            now = now - np.where(p < 0, 1, self.length[p])
            steps.append((now, p))
            live = now > begin[rows]
            now, rows = now[live], rows[live]
        spot, p = (np.concatenate(x) for x in zip(*steps))
        by = np.argsort(spot)
        spot, p = spot[by], p[by]
        ids = np.where(p < 0, -1, self.ids[p])
        if len(odd):
            raw = [[self.byte[b] for b in chr(points[x]).encode("utf-8", "surrogatepass")] for x in spot[p < 0].tolist()]
            count = np.ones(len(p), np.int64)
            count[p < 0] = [len(r) for r in raw]
            ids = np.repeat(ids, count)
            ids[ids < 0] = [b for r in raw for b in r]
            spot = np.repeat(spot, count)
        ends = np.searchsorted(spot, begin + size)
        return ids.astype(np.int32), np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and where each text's begin and end."""
        if len(self.places) > REMEMBERED:
            self.forget()
        parts, was = list(map(_chunks, texts)), len(self.places)
        chunk = np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64)
        if new := self.places.new:
            ids, ends = self.learn([c[1:] if c[:1] == _BARE else MARK + c if c[:1] != MARK else c for c in new])
            self.flat, self.offset = np.concatenate((self.flat, ids)), np.concatenate((self.offset, ends + len(self.flat)))
            self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
            self.places.new = []
        self.again[chunk[chunk < was]] = True
        count = self.offset[chunk + 1] - self.offset[chunk]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(self.offset[chunk] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.concatenate(([0], np.cumsum(list(map(len, parts)), dtype=np.int64)))]


def _chunks(text: str) -> list[str]:
    """The chunks that no piece crosses: a word without the mark of the space in front of it, _BARE and a word where
    none is, a newline as _BARE and itself; where several spaces meet, marks and what follows them."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text or _BARE in text:
        return [c if c[0] == MARK else _BARE + c for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.replace("\n", f" {_BARE}\n {_BARE}").split(" ") if "\n" in text else text.split(" ")


def byte_table(model: dict) -> list[bytes]:
    """What each id stands for; control and unknown ids for nothing."""
    table = [b""] * model["size"]
    for p, i in zip(model["pieces"], model["ids"]):
        table[i] = p.replace(MARK, " ").encode()
    for b, i in model["bytes"].items():
        table[i] = bytes([b])
    return table


def text_of(ids: list[int], table: list[bytes]) -> str:
    raw = b"".join(map(table.__getitem__, ids))
    return raw[raw[:1] == b" " :].decode("utf-8", "replace")


_ready: dict[str, Tokenizer] = {}


def _tokenizer(model: dict) -> Tokenizer:
    """One tokenizer for each worker process and model."""
    if model["digest"] not in _ready:
        _ready[model["digest"]] = Tokenizer(model)
    return _ready[model["digest"]]


def _slices(sizes: list[int], size: int = 600_000) -> Iterator[tuple[int, int]]:
    a, held = 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= size:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def _add(df: DataFrame, fields: list[T.StructField], column: str, run, keep_column: bool = True) -> DataFrame:
    names = {x.name for x in fields}
    keep = [k for k, f in enumerate(df.schema.fields) if f.name not in names and (keep_column or f.name != column)]
    kept = [df.schema.fields[k] for k in keep]
    spot = df.columns.index(column)
    out = [f.name for f in [*kept, *fields]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, cols in run(b.column(spot)):
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(*rows) for k in keep), *cols], names=out)
            del b
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(each, T.StructType([*kept, *fields]))


def encode(df: DataFrame, model_path: str, text: str = "text", tokens: str = "tokens", count: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """All rows and columns of `df` (without the text itself, if it isn't to be kept) with `tokens` (ids as the model's own library gives them) and their `count`.

    Texts are cut at spaces and newlines, which no piece crosses. For each batch the distinct pieces of text that
    the worker has not met are joined, a suffix array over them is sorted, every vocabulary piece is looked up in
    it by binary search, and the occurrences, as edges sorted by where they end, are relaxed from left to right:
    an edge holds if its piece may follow the one that holds at its start. That gives BPE's result. Unknown
    characters become bytes.

    Null and empty texts have no tokens. Repeated rows are encoded alike. Columns of the two output names are
    replaced. An empty table gives an empty table. The model (a file of fixed size) is read on the driver.
    """
    model = load(model_path)

    def run(col: pa.Array) -> Iterator[tuple]:
        tok = _tokenizer(model)
        for a, z in _slices(pc.fill_null(pc.utf8_length(col), 0).to_pylist()):
            ids, edge = tok.encode([t or "" for t in col.slice(a, z - a).to_pylist()])
            yield (a, z - a), (pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)), pa.array(np.diff(edge)))

    return _add(df, [T.StructField(tokens, T.ArrayType(T.IntegerType())), T.StructField(count, T.LongType())], text, run, keep_text)


def decode(df: DataFrame, model_path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """All rows and columns of `df` with the text that the ids stand for. A null list gives an empty text."""
    model = load(model_path)

    def run(col: pa.Array) -> Iterator[tuple]:
        table = byte_table(model)
        for a, z in _slices(pc.fill_null(pc.list_value_length(col), 0).to_pylist()):
            yield (a, z - a), (pa.array([text_of(x.values.to_numpy().tolist(), table) if x.is_valid else "" for x in col.slice(a, z - a)], pa.string()),)

    return _add(df, [T.StructField(text, T.StringType())], tokens, run)
