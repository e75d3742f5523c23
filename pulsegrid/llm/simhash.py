"""SimHash near-duplicates: a byte-position index with count filtering, then connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, full_key, hot_keys, join_per_key
from .components import components

#: Distinct fingerprints that one task compares at a time; larger buckets are cut into a grid of such blocks.
BLOCK = 2000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the text's shingles in their order; a shorter text is one shingle, one without words has none."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(parts) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 where there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the text's shingle hashes; 0 for a text without words."""
    return majority(shingles(text, words))


def fingerprints(df: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, fp)`, a row for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _covering(shared: int) -> list[int]:
    """Bit masks of byte triples such that any `shared` of the 8 byte positions hold one of them whole."""
    if shared < 3:
        raise ValueError("at most 5 differing bits")
    todo, out = {frozenset(c) for c in combinations(range(8), shared)}, []
    triples = [frozenset(c) for c in combinations(range(8), 3)]
    while todo:
        best = max(triples, key=lambda t: (sum(t <= s for s in todo), sorted(t)))
        out.append(best)
        todo = {s for s in todo if not best <= s}
    return [sum(0xFF << 8 * i for i in t) for t in out]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, bits: int, shared: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints: tally equal bytes, then count bits."""
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        x = fps[i + 1 :] ^ fps[i]
        near = np.flatnonzero((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= shared)
        near = near[np.bitwise_count(x[near]) <= bits] + i + 1
        other = np.unique(label[near], return_index=True)
        for lab, at in zip(*other):
            if lab != label[i]:
                out.append((i, int(near[at])))
                label[label == lab] = label[i]
    return out


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """`(src, dst)`: links between distinct fingerprints that keep every component of the whole link graph.

    At most `bits` differing bits leave at least 8 - bits byte positions equal (the guaranteed matches). The index
    lists fingerprints under combinations of three (position, byte) items chosen so that every set of that many
    equal positions holds one whole combination; a pair that meets in a list has its equal bytes tallied, and
    only pairs that reach the guaranteed number are verified. A list too long for one task is cut into blocks and
    every pair of blocks is compared as its own task, so a hot list is spread and none of its links is lost.
    """
    shared, masks = 8 - bits, _covering(8 - bits)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    grid = keyed.join(sizes, ["t", "key"]).withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    cells = grid.select("t", "key", "fp", F.explode(F.when(F.col("g") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x.cast("int"), F.col("b")).alias("lo"), F.greatest(x.cast("int"), F.col("b")).alias("hi"))))).alias("c"))
    dealt = cells.select("t", "key", "c.lo", "c.hi", "fp").repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, key, lo, hi, fp = cols
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            src, dst = [], []
            for s, e in zip(np.concatenate(([0], new)).tolist(), np.concatenate((new, [len(t)])).tolist()):
                if e - s > 1:
                    for i, j in forest(fp[s:e].view(np.uint64), bits, shared):
                        src.append(int(fp[s + i]))
                        dst.append(int(fp[s + j]))
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            last = tuple(c[-1] for c in held[:4])
            same = np.flatnonzero((held[0] == last[0]) & (held[1] == last[1]) & (held[2] == last[2]) & (held[3] == last[3]))[0]
            if same:
                yield found([c[:same] for c in held])
                held = [c[same:] for c in held]
        if held is not None:
            yield found(held)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(df: DataFrame, words: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, fingerprint, component_id)`: a row for each row of `df`.

    Fingerprints link at `bits` or fewer differing bits; `component_id` is the smallest doc_id that can be reached
    over links. Copies share a fingerprint and are one node. A text without words (null, empty, white space) has
    fingerprint zero and is linked like any other. Ids are of any type that has an order. Null doc_ids take part in
    linking but are nobody's smallest id; a component of nothing else has a null id. Repeated rows stay; other columns are not read. An empty table gives
    an empty table.
    """
    docs = cut(fingerprints(df, words, doc_id, text))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reach = components(links(nodes.select("fp"), bits))
    member = cut(nodes.join(reach.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = join_per_key(member, least, "root", F.col("fp")).select("fp", "component_id")
    return join_per_key(docs, by_fp, "fp", F.col("doc_id")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For `similar`: 64-bit words of a wide fingerprint, bits of an index key, deals of all bits into keys, differing bits of
#: a candidate pair, candidates a node from which on nodes of a list are crowded, and nodes in one block of a long list.
WIDE, KEY_BITS, DEALS, WIDE_BITS, CROWD, WIDE_BLOCK = 4, 16, 4, 64, 2, 1000


def _again(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of hashes (splitmix64); the 0-th is the hash itself."""
    if not k:
        return hashes
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_W = [f"w{k}" for k in range(WIDE)]


def _nodes(df: DataFrame, words: int) -> DataFrame:
    """`(k1, k2, id, node, n, w0..)` for `(k1, k2, id, text)`: the digest and size of the set of shingles, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out = np.zeros((b.num_rows, 2 + WIDE), np.uint64)
            for i, t in enumerate(b.column(3)):
                found = np.unique(shingles(t.as_py(), words))
                out[i] = [xxhash.xxh64_intdigest(found.tobytes()), len(found), *(majority(_again(found, k)) for k in range(WIDE))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c.copy()) for c in out.view(np.int64).T)], names=["k1", "k2", "id", "node", "n", *_W])

    return df.mapInArrow(run, "k1 long, k2 long, id long, node long, n long, " + ", ".join(f"{w} long" for w in _W))


def _cells(nodes: DataFrame, whole: bool) -> DataFrame:
    """The index lists of every node: all bits of the fingerprint are dealt into keys, DEALS times in another order."""
    bits = 64 * WIDE
    orders = [np.random.RandomState(k).permutation(bits) for k in range(DEALS)]
    keys = bits // KEY_BITS * DEALS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                cols = [np.asarray(c) for c in part.columns]
                on = np.unpackbits(np.ascontiguousarray(np.stack(cols[2:], axis=1)).view(np.uint8), axis=1)
                dealt = np.ascontiguousarray(np.concatenate([np.packbits(on[:, o], axis=1) for o in orders], axis=1)).view(np.uint16)
                cell = (dealt.astype(np.int64) + (np.arange(keys, dtype=np.int64) << KEY_BITS)).ravel()
                rest = [pa.array(np.repeat(c, keys)) for c in cols] if whole else []
                yield pa.RecordBatch.from_arrays([pa.array(cell), *rest], names=["cell", *(["node", "n", *_W] if whole else [])])

    cols = ["node", "n", *_W]
    return nodes.select(*cols).mapInArrow(run, ", ".join(f"{c} long" for c in ["cell", *(cols if whole else [])]))


def _near(cell: np.ndarray, n: np.ndarray, fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All candidates among rows sorted by cell, with their differing bits: pairs of a cell whose sizes allow `similarity` and that
    differ in at most WIDE_BITS bits."""
    left, right, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, d = np.arange(len(cell)), 0
    while True:
        d += 1
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        m = at[np.minimum(n[at], n[at + d]) >= similarity * np.maximum(n[at], n[at + d]) - 1e-9]
        apart = np.bitwise_count(fps[m] ^ fps[m + d]).sum(axis=1, dtype=np.int64)
        near = apart <= WIDE_BITS
        left.append(m[near])
        right.append(m[near] + d)
        far.append(apart[near])
    a, b, far = map(np.concatenate, (left, right, far))
    return a, b, far


def _chosen(cell: np.ndarray, n: np.ndarray, fps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of `_near`: all where what they join has CROWD a row or fewer, else a spanning tree; and a row of each such crowd."""
    a, b, far = _near(cell, n, fps, similarity)
    if not len(a):
        return a, b, a
    order = np.lexsort((b, a, far))
    a, b = a[order], b[order]
    take = []
    label, left = np.arange(len(cell)), np.arange(len(a))
    while len(left := left[label[a[left]] != label[b[left]]]):  # the nearest pair out of every part, until none is left
        x, y = label[a[left]], label[b[left]]
        least = np.full(len(cell), len(a))
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        best = np.unique(least[least < len(a)])
        take.append(best)
        x, y, to = label[a[best]], label[b[best]], np.arange(len(cell))
        while (to[x] != to[y]).any():
            low = np.minimum(to[x], to[y])
            np.minimum.at(to, x, low)
            np.minimum.at(to, y, low)
            to = to[to]
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    crowd = np.bincount(label[a], minlength=len(cell)) > CROWD * np.bincount(label, minlength=len(cell))
    take = np.unique(np.concatenate([*take, np.flatnonzero(~crowd[label[a]])]))
    return a[take], b[take], np.flatnonzero(crowd)


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """`(a, b)`: pairs a < b of nodes that share an index list and are near by their fingerprints, or, of a crowd of such nodes,
    as many as keep it together, and, b being null, one of its nodes. A list too long for one task is cut into blocks, and every
    pair of blocks is a task of its own."""
    long = _cells(nodes, False).groupBy("cell").agg(F.count("*").alias("c")).filter(F.col("c") > WIDE_BLOCK).select("cell", F.ceil(F.col("c") / WIDE_BLOCK).cast("int").alias("g"))
    grid = _cells(nodes, True).join(F.broadcast(long), "cell", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = grid.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("b")).alias("lo"), F.greatest(x, F.col("b")).alias("hi")))))
    dealt = dealt.select("cell", F.col("c.lo").cast("long").alias("lo"), F.col("c.hi").cast("long").alias("hi"), "node", "n", *_W)
    dealt = dealt.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "node")

    def found(cols: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
        a, b, more = _chosen(np.cumsum(new), cols[4], np.stack(cols[5:], axis=1).view(np.uint64), similarity)
        out = [np.concatenate((cols[3][a], cols[3][more])), pa.concat_arrays([pa.array(cols[3][b]), pa.nulls(len(more), pa.int64())])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: _by_list(batches, found), "a long, b long").distinct()


def _by_list(batches: Iterator[pa.RecordBatch], found: Callable[[list[np.ndarray], np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `found` makes of whole lists, of rows sorted by their first three columns, and of where a list begins."""

    def lists(cols: list[np.ndarray]) -> pa.RecordBatch:
        return found(cols, np.concatenate(([True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))))

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        held = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
        same = np.flatnonzero(np.logical_and.reduce([c == c[-1] for c in held[:3]]))[0]
        if same:
            yield lists([c[:same] for c in held])
            held = [c[same:] for c in held]
    if held is not None:
        yield lists(held)


def _differences(held: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """`(node, family, n, d, e)` for `(node, family, size, s)`: n is the size of the set s, d holds in what s differs from the
    shingles that over half of its family's sets have, and e is what the node adds to what a pair needs.

    Whatever shingles a family is compared with, those in which two of its sets differ are those that are in one d only. So
    two sets link if and only if their d share at least e + e shingles.
    """
    often = held.select("family", "size", F.explode("s").alias("h")).groupBy("family", "size", "h").agg(F.count("*").alias("c")).filter("2 * c > size")
    often = often.groupBy("family").agg(F.collect_list("h").alias("often"))
    many = F.coalesce("often", F.array().cast("array<long>"))
    d = F.concat(F.array_except("s", many), F.array_except(many, "s"))
    rows = join_per_key(held, often, "family", F.col("node"), "left", hot).select("node", "family", F.size("s").alias("n"), d.alias("d"))
    return rows.withColumn("e", (F.size("d") - F.lit((1 - similarity) / (1 + similarity)) * F.col("n")) / 2)


def _sure(rows: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """`(src, dst)`: edges that join all pairs of a family that link even if their d share nothing. Each node of such a pair
    links to the node with the family's least e, too."""
    sized = rows.select("node", "family", "n", "e", F.size("d").alias("m"))
    hub = sized.groupBy("family").agg(F.min(F.struct("e", "node", "n", "m")).alias("hub"))
    both = join_per_key(sized, hub, "family", F.col("node"), hot=hot).filter("node <> hub.node").withColumn("t", F.col("n") + F.col("hub.n"))
    i = (F.col("t") - F.col("m") - F.col("hub.m")) / 2
    return both.filter(i >= F.lit(similarity) * (F.col("t") - i) - F.lit(1e-9)).select(F.col("node").alias("src"), F.col("hub.node").alias("dst"))


def _rest(rows: DataFrame, hot: DataFrame, reach: DataFrame, similarity: float) -> DataFrame:
    """`(a, b)`, a < b: pairs of a family that are not yet joined by `reach`, all that link among them.

    Shingles of the d are put in one order, the rarest in the family first. Two d that share k shingles share one among the
    first len - k + 1 of both. Shingles that one group alone has are left out, as no pair needs them. A node is dealt under the
    first shingles that the least e of another group's nodes asks for, as the one with the lesser e of a pair under fewer still.
    """
    need = lambda e: F.greatest(F.ceil(e - F.lit(1e-6)), F.lit(1))
    rooted = cut(rows.join(reach, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = rooted.groupBy("family", "root").agg(F.min("e").alias("e"))
    least = groups.groupBy("family").agg(F.min(F.struct("e", "root")).alias("x"), F.count("*").alias("c")).filter("c > 1").select("family", "x")
    least = join_per_key(groups, least, "family", F.col("root"), hot=hot).filter("root <> x.root").groupBy("family").agg(F.first("x").alias("x"), F.min("e").alias("y"))
    other = F.when(F.col("root") == F.col("x.root"), F.col("y")).otherwise(F.col("x.e"))
    longest = F.lit((1 - similarity) / (1 + similarity) / similarity) * F.col("n")  # a d holds 2 e + this many shingles at most, if its set is not too long for a link
    apart = cut(join_per_key(rooted, least, "family", F.col("node"), hot=hot).withColumn("least", F.greatest(other, F.col("e") - longest)).select("node", "family", "root", "e", "least", "d"))
    each = apart.select("node", "family", "root", "e", "least", F.explode("d").alias("h")).select("node", "root", "e", "least", F.struct("family", "h").alias("key"))
    shared = cut(each.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key", "c"))
    each = join_per_key(each, shared, "key", F.col("node"), hot=hot_keys(shared, "key", "c"))
    own = Window.partitionBy("node")
    each = each.withColumn("pos", F.row_number().over(own.orderBy("c", "key"))).withColumn("m", F.count("*").over(own))
    dealt = cut(each.filter(F.col("pos") <= F.col("m") - need(F.col("e") + F.col("least")) + 1).select("key", "node", "root", "e", "pos", "m"))
    p = dealt.filter(F.col("pos") <= F.col("m") - need(2 * F.col("e")) + 1).alias("p")
    k = need(F.col("p.e") + F.col("q.e"))
    both = p.join(dealt.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.struct("p.e", "p.node") < F.struct("q.e", "q.node")) & (F.col("p.root") != F.col("q.root")) & (F.col("p.pos") <= F.col("p.m") - k + 1) & (F.col("q.pos") <= F.col("q.m") - k + 1))
    return both.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def similar(df: DataFrame, cols: list[str], words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(k1, k2, root)`: for each row of `df`, by its `full_key` of `cols`, the group that it is in.

    Texts are sets of shingles of `words` words. Two texts link if the Jaccard similarity of their sets, counted in
    full, is at least `similarity`; groups are what links join. Pairs to be counted come from SimHash fingerprints
    of WIDE * 64 bits, indexed under keys of KEY_BITS bits: so some links may be missed, but none is wrong. What candidates
    join is a family. Where a list holds a crowd of near copies, only a spanning tree of its candidates is made, and all links of
    its family are found from what its sets differ in, without counting all pairs, so that no candidate is lost. Texts with
    one set (all without words, too) are one node. Null doc_ids and repeated rows are rows like others.
    Also returns `id`, the doc_id. An empty table gives an empty table.
    """
    k1, k2 = full_key(cols)
    keyed = df.select(k1.alias("k1"), k2.alias("k2"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = cut(_nodes(keyed, words))
    nodes = rows.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in _W])
    found = cut(candidates(nodes.filter("n > 0"), similarity))
    pairs = found.filter("b is not null").select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = [np.unique(shingles(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "k.k1", "k.k2"), "node")
    texts = keyed.join(wanted, ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
    sets = cut(texts.mapInArrow(run, "node long, s array<long>"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` that link, counted in full, as edges."""
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        sized = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("t")).filter(F.col("i") >= F.lit(similarity) * (F.col("t") - F.col("i")) - F.lit(1e-9))
        return sized.select(F.col("a").alias("src"), F.col("b").alias("dst"))

    links = cut(linked(pairs))
    more = found.filter("b is null").select(F.col("a").alias("node"))
    if more.isEmpty():
        reach = components(links)
    else:
        family = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("root", "family")
        crowded = more.distinct().join(family, "node").select("family").distinct()
        sizes = cut(family.groupBy("family").agg(F.count("*").alias("size")).join(crowded, "family"))
        hot = cut(hot_keys(sizes, "family", "size"))
        held = join_per_key(family, sizes, "family", F.col("node"), hot=hot).join(sets, "node")
        differ = cut(_differences(cut(held), hot, similarity))
        links = cut(links.union(_sure(differ, hot, similarity)))
        reach = components(links)
        rest = cut(_rest(differ, hot, reach, similarity).join(pairs, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            reach = components(links.union(linked(rest)))
    return rows.select("k1", "k2", "id", "node").join(reach, "node", "left").select("k1", "k2", "id", F.coalesce("root", "node").alias("root"))
