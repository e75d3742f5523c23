"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role MIDDLE text CLOSE. These strings never occur inside an escaped role or text.
OPEN, MIDDLE, CLOSE = b"<s>[INST]", b"[/INST]", b"</s>"
_CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
#: Bytes of output that one assembly step holds.
STEP = 4 << 20


def escape(col: pa.Array) -> pa.Array:
    """Double every backslash, then break control strings with one after their first character."""
    return pc.replace_substring_regex(pc.replace_substring(col, "\\", "\\\\"), _CONTROL, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string column as (data, starts, lengths)."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, loss_role: str) -> tuple[pa.Array, list, list]:
    """Format the turns; conversation i has the turns first[i] .. first[i + 1]. Returns the formatted column and, for
    each conversation, where the texts under the loss mask start and end (code points)."""
    learn = np.asarray(pc.equal(roles, loss_role).to_numpy(zero_copy_only=False))
    parts = [OPEN, _bytes(escape(roles)), MIDDLE, _bytes(escape(texts)), CLOSE]
    n = len(roles)
    length = np.stack([np.full(n, len(p)) if isinstance(p, bytes) else p[2] for p in parts], axis=1) if n else np.zeros((0, 5), np.int64)
    ends = np.cumsum(length.ravel()).reshape(n, 5)
    begin = ends - length
    total = int(ends[-1, -1]) if n else 0
    out = np.empty(total, np.uint8)
    for k, p in enumerate(parts):
        if isinstance(p, bytes):
            out[begin[:, k, None] + np.arange(len(p))] = np.frombuffer(p, np.uint8)
        else:
            data, start, size = p
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(begin[:, k], size) + step] = data[np.repeat(start, size) + step]
    edge = np.concatenate((begin[:, 0], [total]))[first]
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    base = np.repeat(points[edge[:-1]], np.diff(first))
    starts, stops = points[begin[:, 3]] - base, points[ends[:, 3]] - base
    col = pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out))
    rows = [np.flatnonzero(learn[a:z]) + a for a, z in zip(first[:-1], first[1:])]
    return col, [starts[r] for r in rows], [stops[r] for r in rows]


def format_chats(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """`(conv_id, formatted, loss_start, loss_end)`, a row for each conversation of `(conv_id, turn, role, text)`.

    Turns are ordered by turn, ties by role, then text; repeated rows are turns of their own. Null roles and texts
    are empty, null turns come first, and rows with a null conv_id form one conversation. Control strings inside
    roles and texts are escaped and come back on `parse`. The loss mask covers the texts of `loss_role` as they
    stand in `formatted`, as spans of code points. Other columns are not read; an empty table gives an empty table.
    A conversation is one output value, so its rows meet in one task; output is assembled a few MB at a time.
    """
    turns = (
        df.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()
            roles, texts = flat.field("role"), flat.field("text")
            first = np.asarray(lists.offsets).astype(np.int64)
            first -= first[0]
            size = np.concatenate(([0], np.cumsum(_bytes(texts)[2] + 64)))
            low = 0
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(size[first], size[first[low]] + STEP, side="right")) - 1)
                a, z = int(first[low]), int(first[high])
                col, starts, stops = assemble(roles.slice(a, z - a), texts.slice(a, z - a), first[low : high + 1] - a, loss_role)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), col, pa.array(starts, kind), pa.array(stops, kind)], names=["conv_id", "formatted", "loss_start", "loss_end"])
                low = high

    return turns.mapInArrow(run, "conv_id long, formatted string, loss_start array<long>, loss_end array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from `format_chats`: turn count and digests of turns and of text under the loss mask."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, start, stop in zip(*(b.column(i) for i in (1, 2, 3))):
                text = text.as_py()
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(start.as_py(), stop.as_py()))
                for k, v in zip(out, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=["conv_id", *out])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
