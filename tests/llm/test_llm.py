import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat, line_dedup, mixing, pii, quality, sentencepiece, sharding, simhash, suffix_dedup, winnow
from pulsegrid.llm.queries import ORACLES, QUERIES, model_path

from ..conftest import same_rows

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, "x\n\nx", "a"), (3, "x\n\nx", "a"), (None, "null id " * 20, "b"), (5, "é日" * 300, "b"), (6, "w " * 60_000, "a"), (7, " \t\n", "a")]


def odd(spark, empty=False):
    return spark.createDataFrame([] if empty else ODD, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(-1)).withColumn("kept", F.lit("clash"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    df = odd(spark, empty)
    n = 0 if empty else len(ODD)
    for out in (
        line_dedup.dedup_lines(df), sharding.shard(df, size=101), quality.judge(df), sentencepiece.encode(df, model_path()), pii.extract(df), mixing.plan(df),
        simhash.near_duplicates(df), suffix_dedup.remove_repeats(df), winnow.fingerprint_with_edits(df),
    ):
        assert len(out.collect()) == n
    turns = spark.createDataFrame([] if empty else [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x")], "conv_id long, turn long, role string, text string")
    assert len(chat.digests(chat.format_chats(turns)).collect()) == (0 if empty else 2)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_simhash_against_all_pairs(spark):
    docs = texts(spark)
    fps = {d: simhash.fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    ids = sorted(docs)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in docs}


def test_simhash_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(150)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= 4
        root[find(e.src)] = find(e.dst)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert find(a) == find(b)


@pytest.mark.parametrize("length,rows", [(400, 20_000), (200, 60)])
def test_repeats_against_brute_force(spark, monkeypatch, length, rows):
    monkeypatch.setattr(suffix_dedup, "RANGE", rows)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(length + 150)
    extra = [(10_000 + i, word(rng.randrange(300)) + passage[rng.randrange(60) : length + 150 - rng.randrange(60)] + word(rng.randrange(300))) for i in range(120)]
    extra += [(20_000, "ab" * 700), (20_001, "a" * 1500), (20_002, ""), (20_003, "é" * 500)]
    docs = [*list(texts(spark).items())[:120], *extra]
    seen = Counter(b[i : i + length] for _, t in docs for b in [t.encode()] for i in range(len(b) - length + 1))
    want = {}
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length).collect()} == want


def test_pieces_equal_the_library(spark):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=model_path())
    docs = texts(spark) | {-1: "  a  b\n\n c" + " " * 37 + "the", -2: "\0 日本 🎉 " + "x" * 3000, -3: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in sentencepiece.decode(sentencepiece.encode(df, model_path()), model_path()).collect():
        assert r.tokens == sp.encode(docs[r.doc_id]) and r.decoded == docs[r.doc_id]


def test_base_patterns_equal_plain_regular_expressions():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("ab1.@_ +-()9") for _ in range(60))
        plain = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert pii.emails(t) == plain
        ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for s, k, e in pii.base_spans(t) if k == 1] == ips


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to a{i}@mail.example.com about this, number {i}") for i in range(8)] + [(90, "please write to 55-88-77x about this, number 3"), (91, "the year was 2024 and 1999")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[90].spans == "email:16:25" and got[90].n_found == 1 and got[91].spans == ""


def test_winnowing_against_brute_force(spark):
    docs = texts(spark)
    got = {r.doc_id: r for r in QUERIES["op10_winnowing"](spark, SF).collect()}
    ids = sorted(docs, reverse=True)
    for i, d in enumerate(ids):
        t, nxt = docs[d], docs[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    by = defaultdict(set)
    for d, t in docs.items():
        by[t].add(got[d].fingerprint)
        where = [int(x.split("@")[1]) for x in got[d].fingerprint.split(",") if x]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        grams = max(words - winnow.GRAM + 1, min(words, 1))
        ends = [-1, *where, grams]
        assert all(b - a <= winnow.WINDOW for a, b in zip(ends, ends[1:])) or grams < winnow.WINDOW
    assert all(len(x) == 1 for x in by.values())


def test_mixing_meets_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 800 else "b" if i < 950 else "c") for i in range(1000)], "doc_id long, text string, source string")
    got = {r.source: r.c for r in mixing.plan(df, max_epochs=2.0).groupBy("source").agg(F.sum("copies").alias("c")).collect()}
    assert got["a"] == 800 and got["c"] == 100
    w = {r.source: r.weight for r in mixing.plan(df, max_epochs=None, entropy=1.0).select("source", "weight").distinct().collect()}
    import math

    assert abs(-sum(x * math.log(x) for x in w.values()) - 1.0) < 1e-6


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_texts = {r.doc_id: r.text for r in docs.collect()}
    good = cp.STAGES[0][1](spark, docs, SF).cache()
    assert all(set(r.text.split("\n")) <= set(all_texts[r.doc_id].split("\n")) for r in good.collect())
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    lines = cp.STAGES[1][1](spark, good, SF).cache()
    assert all(set(r.text.split("\n")) <= set(all_texts[r.doc_id].split("\n")) for r in lines.collect())
    once = cp.STAGES[2][1](spark, lines, SF).cache()
    groups = defaultdict(list)
    for r in simhash.similar(lines, cp.COLUMNS).collect():
        groups[r.root].append(r.id)
    kept = {min(g) for g in groups.values()}
    assert sorted(r.doc_id for r in once.collect()) == sorted(kept)
    mixed = cp.STAGES[3][1](spark, once, SF)
    assert {r.doc_id for r in mixed.collect()} == kept
    coded = cp.STAGES[4][1](spark, mixed, SF).collect()
    assert len(coded) == mixed.count() and all(r.round_trip for r in coded)


def test_copies_of_a_page_keep_their_lines(spark):
    import corpus_pipeline as cp

    rows = [(i, f"first line of {min(i, 20)}\nsecond line of {min(i, 20)}\nmenu", "en", "a", 0) for i in range(30)]
    got = cp.drop_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert {r.doc_id: r.text for r in got} == {i: f"first line of {min(i, 20)}\nsecond line of {min(i, 20)}" for i in range(30)}


def test_rows_without_an_id_of_their_own_are_judged_by_row(spark):
    good = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, good[0], "a"), (None, "short", "a"), (1, good[1], "a"), (1, "short", "a"), (2, good[2], None), (2, None, "a"), (3, good[3], "b")]
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if r[1] in good)


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece as lib

    import corpus_pipeline as cp

    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, text(90 + i)) for i in range(60)]
    for i in range(60):  # up to five words apart, so similarities lie on both sides of 0.8
        near = list(rows[i][1])
        for k in rng.sample(range(len(near)), i % 6):
            near[k] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, near))
    rows += [(200 + i, rows[0][1][:k] + [f"y{i}"] + rows[0][1][k + 1 :]) for i, k in enumerate(range(0, 80, 2))]
    rows += [(None, text(70)), (None, rows[5][1]), (7, text(75)), (300, ["short"])]
    rows = [(d, " ".join(t) + "\nthe same menu", "en", "a", 0) for d, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    left = [(d, t.split("\n")[0]) for d, t, *_ in rows if len(t.split()) >= 50]

    def grams(t):
        p = t.split()
        return {tuple(p[i : i + 5]) for i in range(len(p) - 4)}

    sets, root = [grams(t) for _, t in left], list(range(len(left)))
    alike = [(i, j) for i in range(len(left)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in left:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    groups = defaultdict(list)
    for r, x in zip(root, left):
        groups[r].append(x)
    kept = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert len(left) > len(kept) > 60
    sp = lib.SentencePieceProcessor(model_file=model_path())
    got = cp.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in got) == Counter((d, tuple(sp.encode(t))) for d, t in kept)


def test_near_dedup_tells_rows_apart_without_ids(spark):
    import corpus_pipeline as cp

    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[1]), (6, texts[2]), (6, texts[3])]
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter((r.doc_id, r.text) for r in cp.drop_near_copies(spark, df, SF).collect()) == Counter([(None, texts[0]), (5, texts[1]), (6, texts[2]), (6, texts[3])])
