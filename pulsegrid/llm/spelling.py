"""Grouping of spelling variants by a bidirectional FM index over a delimited vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .ranks import rank_levels

#: Letters of a vocabulary that one index holds, searches that go on at a time, and words with one key that are kept
#: together. They bound memory; no result depends on them.
INDEXED, SEARCHED, TOGETHER = 200_000, 8192, 20_000
LETTERS = r"[A-Za-zÀ-ÿ]"
_END, _MARK = 0, 1


class Index:
    """FM index of |word|word|...|word| and of the same text backwards. `occ[i, c]` counts letter c before place i of a
    transform, `begin[c]` the letters below c in all."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(f"|{'|'.join(words)}|".encode("utf-32-le"), np.uint32)
        bars = np.cumsum([0, *(len(w) + 1 for w in words)])
        letters = np.unique(points)
        self.letters = letters
        codes = np.searchsorted(letters, points) + 2
        codes[bars] = _MARK
        self.width = len(letters) + 2
        self.bars, self.n = bars, len(codes) + 1
        self.occ, order = zip(*(self._transform(np.concatenate((c, [_END]))) for c in (codes, codes[::-1])))
        self.order = order[0]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=self.width))[:-1])) + 1
        self.begin[_END] = 0

    def _transform(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.empty(len(codes), np.int64)
        order[rank_levels(codes)[-1]] = np.arange(len(codes))
        occ = np.zeros((len(codes) + 1, self.width), np.int32)
        occ[np.arange(1, len(codes) + 1), codes[order - 1]] = 1
        return np.cumsum(occ, axis=0, out=occ), order

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of codes, -1 for letters that the index doesn't have, and their lengths."""
        size = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        spot = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        rows = np.full((len(words), int(size.max()) + 1), -1, np.int64)
        rows[np.arange(rows.shape[1]) < size[:, None]] = np.where(self.letters[spot] == points, spot + 2, -1)
        return rows, size

    def step(self, side: int, near: np.ndarray, far: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extend matches by letter c at the front (side 0) or the back (side 1). A match is an interval of suffix ranks in the
        text (of the side, `near`) and one of the same size in the other direction (`far`)."""
        occ = self.occ[side]
        low, high = occ[near], occ[near + size]
        held = high - low
        held[np.arange(self.width) >= c[:, None]] = 0
        at = np.arange(len(c))
        new = low[at, c]
        return self.begin[c] + new, far + held.sum(1), (high[at, c] - new) * (c >= 0)

    def search(self, rows: np.ndarray, size: np.ndarray, exact: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) for every indexed word that is `rows`' word with one letter inserted, deleted or replaced behind the first
        `exact` letters. For side 1 rows, index and words are read from left to right, for side 0 from right to left.

        The exact part is matched against the direction of reading, up to the mark in front of it; then the match turns round
        and goes on with at most one error, up to the mark behind. Of equal results of two edits (a letter of a pair deleted,
        say) only one is followed.
        """
        q = np.flatnonzero(size > 0)
        near, far, left = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n)
        for k in range(int(exact.max()) + 1):  # the last one of each is the mark
            live = k <= exact[q]
            c = np.where(k < exact[q], rows[q, np.maximum(exact[q] - 1 - k, 0)], _MARK)
            go = np.flatnonzero(live & (c >= 0))
            near[go], far[go], left[go] = self.step(1 - side, near[go], far[go], left[go], c[go])
            left[live & (c < 0)] = 0
            q, near, far, left = (x[left > 0] for x in (q, near, far, left))
        near, far = far, near
        at, edited = exact[q], []
        while len(q):
            occ = self.occ[side]
            low = occ[near]
            held = occ[near + left] - low
            below = np.cumsum(held, axis=1) - held
            wanted = rows[q, at]  # -1 behind the end
            inner = at < size[q]
            skip = inner & ((at + 1 >= size[q]) | (rows[q, np.minimum(at + 1, rows.shape[1] - 1)] != wanted) | (wanted < 0))
            edited.append((q[skip], at[skip] + 1, near[skip], far[skip], left[skip]))
            s, c = np.nonzero(held[:, 2:])
            c = c + 2
            to = (q[s], self.begin[c] + low[s, c], far[s] + below[s, c], held[s, c].astype(np.int64))
            other = c != wanted[s]
            edited.append((to[0][other], at[s][other], *(x[other] for x in to[1:])))  # inserted
            swap = other & inner[s]
            edited.append((to[0][swap], at[s][swap] + 1, *(x[swap] for x in to[1:])))
            on = ~other & inner[s]
            q, near, far, left, at = (*(x[on] for x in to), at[s][on] + 1)
        q, at, near, far, left = (np.concatenate(x) for x in zip(*edited)) if edited else [np.zeros(0, np.int64)] * 5
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(q):
            end = at == size[q]
            c = np.where(end, _MARK, rows[q, at])
            ok = c >= 0
            q, at, end = q[ok], at[ok], end[ok]
            near, far, left = self.step(side, near[ok], far[ok], left[ok], c[ok])
            done = end & (left > 0)
            front = (near if side == 0 else far)[done]
            found.append((q[done], np.searchsorted(self.bars, self.order[front])))
            on = ~end & (left > 0)
            q, at, near, far, left = q[on], at[on] + 1, near[on], far[on], left[on]
        return tuple(np.concatenate(x) for x in zip(*found))


def one_edit_away(index: Index, queries: list[str], words: list[str], front: bool) -> Iterator[tuple[str, int]]:
    """(query, number of the word): the indexed words one edit from each query whose error lies behind the first half (front), or
    those whose error lies in front of the second half and that don't begin with the first."""
    for a in range(0, len(queries), SEARCHED):
        some = queries[a : a + SEARCHED]
        if front:
            rows, size = index.codes(some)
            yield from ((some[i], j) for i, j in zip(*(x.tolist() for x in index.search(rows, size, size // 2, 1))))
        else:
            rows, size = index.codes([w[::-1] for w in some])
            for i, j in zip(*(x.tolist() for x in index.search(rows, size, size - size // 2, 0))):
                if not words[j].startswith(some[i][: len(some[i]) // 2]):
                    yield some[i], j


def near_words(words: DataFrame, min_length: int) -> DataFrame:
    """`(word, near, near_n)`, each pair in both directions: words of `(word, n)`, all distinct and of `min_length` (2 at least) code
    points or more, that differ by one inserted, deleted or replaced code point.

    One of the halves of a word is in the other word unchanged, so that words are dealt by their first and again by their last
    min_length // 2 code points, which lie in the halves. Each task indexes its words key by key, INDEXED letters at a
    time, and searches those of the same keys. Keys with over TOGETHER words are cut into blocks; each of them is searched for
    all words of the key.
    """
    k = min_length // 2
    keys = F.explode(F.array(F.struct(F.lit(True).alias("front"), F.substring("word", 1, k).alias("key")), F.struct(F.lit(False).alias("front"), F.substring("word", -k, k).alias("key"))))
    dealt = words.select("word", "n", keys.alias("_")).select("word", "n", "_.*")
    many = dealt.groupBy("front", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > TOGETHER)
    blocks = F.coalesce(F.ceil(F.col("rows") / TOGETHER), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("word"), blocks).cast("int")
    spread = dealt.join(many, ["front", "key"], "left").select("word", "n", "front", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    spread = spread.select("front", "key", "block", "word", "n", (F.col("mine") == F.col("block")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, str, int, bool]] = []
        size, last = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            for front in (True, False):
                words = [(w, n) for f, w, n, h in held if f == front and h]
                if not words:
                    continue
                index, names = Index([w for w, _ in words]), [w for w, _ in words]
                pairs = list(one_edit_away(index, [w for f, w, _, _ in held if f == front], names, front))
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], pa.string()), pa.array([names[j] for _, j in pairs], pa.string()), pa.array([words[j][1] for _, j in pairs], pa.int64())], names=["word", "near", "near_n"])

        for b in batches:
            for front, key, block, word, n, mine in zip(*(c.to_pylist() for c in b.columns)):
                if size >= INDEXED and (front, key, block) != last:
                    yield from out()
                    held, size = [], 0
                last = front, key, block
                held.append((front, word, n, mine))
                size += len(word)
        if held:
            yield from out()

    tasks = partitions(words.sparkSession)
    return spread.repartition(tasks, "front", "key", "block").sortWithinPartitions("front", "key", "block").mapInArrow(run, "word string, near string, near_n long")


def word_counts(docs: DataFrame, changed: Column | None = None, text: str = "text", min_length: int = 6, min_n: int = 5) -> DataFrame:
    """`(word, n)`: maximal runs of letters, A-Z lower-cased, as `changed` (an expression over the columns of `docs` and `word`)
    makes them, of at least `min_length` code points and with at least `min_n` occurrences in all."""
    runs = F.regexp_extract_all(F.col(text), F.lit(LETTERS + "{%d,}" % min_length), F.lit(0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = docs.withColumn("word", F.explode(F.transform(runs, lambda w: F.translate(w, upper, lower))))
    if changed is not None:
        words = words.withColumn("word", changed)
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)


def group_variants(words: DataFrame, min_length: int = 6, times: int = 5) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` for a vocabulary `(word, n)` of distinct words of `min_length` code points or more.

    Words are near if they differ by one inserted, deleted or replaced code point; n_near counts a word's near words. Its form
    is the near word of largest n (of equals the first in code-point order) if that n is at least `times` its own, else null;
    root follows forms to the last, and is the word itself where it has none. n grows along forms, so that there are no
    circles; paths are halved round by round.

    An empty vocabulary gives an empty table. Null words are left out.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).filter(F.col("word").isNotNull()))
    best = near_words(words, min_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_"), "near")).alias("best"))
    form_n = -F.col("best._")
    is_form = form_n >= times * F.col("n")
    formed = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, form_n).alias("form_n")))
    links = formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    return formed.join(links.select("word", F.col("root").alias("last")), "word", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
