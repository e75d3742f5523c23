"""Byte-level BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sentencepiece import _add, _slices

#: Chunks that a worker remembers, and the longest of them. They bound memory; no result depends on them.
REMEMBERED, LONGEST = 600_000, 200

#: The pattern that cuts texts before the merges, with places for letters, numbers and neither.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
#: Code points that became letters or numbers, or are meant to, after Unicode 16, by which these vocabularies cut texts.
LATER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    r"\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def _listed(kind: str) -> str:
    """The characters of a class up to U+FFFF as ranges, which the plain engine looks up faster than `regex` does properties."""
    one = regex.compile(f"(?V1)[{kind}--[{LATER}]]")
    inside = np.array([bool(one.match(chr(c))) for c in range(0x10000)])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return "".join(f"\\u{a:04x}-\\u{z - 1:04x}" for a, z in edge.reshape(-1, 2).tolist())


class Cutter:
    """Cuts texts into chunks; those with characters beyond U+FFFF by properties."""

    def __init__(self):
        letter, number, space = (_listed(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
        self.near = re.compile(PATTERN.format(letter=f"[{letter}]", number=f"[{number}]", other=f"[^{space}{letter}{number}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.any = regex.compile("(?V1)" + PATTERN.format(letter=rf"[\p{{L}}--[{LATER}]]", number=rf"[\p{{N}}--[{LATER}]]", other=rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]"))

    def __call__(self, text: str) -> list[str]:
        return (self.near if text.isascii() or max(text) <= "\uffff" else self.any).findall(text)


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in these vocabularies: the visible ones for themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def load(path: str) -> dict:
    """What coding needs of a vocabulary file, read on the driver. Only what this operator does the same way is taken: byte-level
    BPE without normaliser, dropout or a space put in front."""
    file = json.loads(Path(path).read_text())
    model, pre = file["model"], file["pre_tokenizer"] or {}
    plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if file["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or not plain:
        raise ValueError("not a plain byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        raise ValueError("added tokens that depend on what stands around them")
    byte, vocab = byte_chars(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    strings = {i: bytes(map(byte.__getitem__, s)) for s, i in vocab.items()} | {i: s.encode() for s, i in added.items()}
    return {"bytes": [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], "added": added, "strings": [strings.get(i, b"") for i in range(max(strings) + 1)]}


class Memory(dict):
    """Chunk to its ids. Chunks that come again survive when the older half is forgotten."""

    def __init__(self, model: dict):
        super().__init__()
        self.bytes, self.older = model["bytes"], {}
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(model["merges"])}
        self.joined = [x for _, _, x in model["merges"]]

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        got = self.older.pop(chunk, None)
        if got is None:
            got = self.merge(chunk.encode())
        if len(chunk) <= LONGEST:
            if len(self) * 2 >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Join the pair of the least rank, the leftmost of equals, until no pair has one. Queue entries whose symbols have
        been joined to others since are skipped."""
        ids, rank_of = list(map(self.bytes.__getitem__, raw)), self.ranks.get
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j == n or ids[i] < 0 or rank_of(ids[i] << 32 | ids[j]) != top >> 32:
                continue
            x = ids[i] = self.joined[top >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(x << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank_of(ids[k] << 32 | x)) is not None:
                heapq.heappush(queue, r << 32 | k)
        return tuple(x for x in ids if x >= 0)


class Coder:
    def __init__(self, model: dict):
        self.memory, self.added, self.chunks = Memory(model), model["added"], Cutter()
        longest_first = sorted(filter(None, self.added), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def encode(self, text: str) -> list[int]:
        if self.marks is None or not self.marks.search(text):
            return list(chain.from_iterable(map(self.memory.__getitem__, self.chunks(text))))
        out: list[int] = []
        for k, part in enumerate(self.marks.split(text)):
            out.extend([self.added[part]] if k % 2 else chain.from_iterable(map(self.memory.__getitem__, self.chunks(part))))
        return out


_ready: dict[str, Coder] = {}


def _coder(path: str, model: dict) -> Coder:
    """One coder for each worker process and vocabulary."""
    if path not in _ready:
        _ready[path] = Coder(model)
    return _ready[path]


def encode(df: DataFrame, vocabulary: str, text: str = "text", tokens: str = "tokens", count: str = "n_tokens", packed: str | None = None, keep_text: bool = True) -> DataFrame:
    """All rows and columns of `df` (without the text itself, if it isn't to be kept) with `tokens` (ids as the vocabulary's own
    library gives them), their `count` and, if named, `packed`: the ids as unsigned 32-bit little-endian integers.

    Added tokens are cut out first, then texts are cut into chunks by the vocabulary's pattern, and in each chunk the pairs of
    neighbouring symbols are merged in the order of their ranks. A worker remembers chunks it has met.

    Null and empty texts have no tokens. Repeated rows are encoded alike. Columns of the output names are replaced. An empty
    table gives an empty table. The vocabulary (a file of fixed size) is read on the driver.
    """
    model = load(vocabulary)

    def run(col: pa.Array) -> Iterator[tuple]:
        coder = _coder(vocabulary, model)
        for a, z in _slices(pc.fill_null(pc.utf8_length(col), 0).to_pylist()):
            lists = [coder.encode(t) if t else [] for t in col.slice(a, z - a).to_pylist()]
            edge = np.cumsum([0, *map(len, lists)])
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(edge[-1]))
            cols = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)), pa.array(np.diff(edge))]
            if packed:
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]))
            yield (a, z - a), cols

    fields = [T.StructField(tokens, T.ArrayType(T.IntegerType())), T.StructField(count, T.LongType())]
    return _add(df, [*fields, *([T.StructField(packed, T.BinaryType())] if packed else [])], text, run, keep_text)


def decode(df: DataFrame, vocabulary: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """All rows and columns of `df` with the text that the ids stand for: their strings joined, bytes that are no UTF-8
    replaced by U+FFFD. Ids that the vocabulary doesn't have, null ones included, stand for nothing; a null list for an empty text."""
    strings = load(vocabulary)["strings"]
    size = len(strings)

    def run(col: pa.Array) -> Iterator[tuple]:
        for a, z in _slices(pc.fill_null(pc.list_value_length(col), 0).to_pylist()):
            out = []
            for x in col.slice(a, z - a):
                ids = pc.drop_null(x.values).to_numpy() if x.is_valid else np.zeros(0, np.int32)
                if len(ids) and (ids.min() < 0 or ids.max() >= size):
                    ids = ids[(ids >= 0) & (ids < size)]
                out.append(b"".join(map(strings.__getitem__, ids.tolist())).decode("utf-8", "replace"))
            yield (a, z - a), (pa.array(out, pa.string()),)

    return _add(df, [T.StructField(text, T.StringType())], tokens, run)
