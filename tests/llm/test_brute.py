"""The operators against plain versions written out of their contracts, and odd rows with values."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import common, line_dedup, mixing, pii, quality, sentencepiece, sharding, simhash, suffix_dedup, winnow
from pulsegrid.llm.queries import QUERIES, model_path

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
M64 = (1 << 64) - 1


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    """The base patterns as their contract has them."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.findall("[0-9]", m)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(4)
    made = [t for t in texts(spark).values()]
    bits = ["4539 1488 0343 6467", "4539-1488-0343-6467", "79927398713", "+1 (243) 555-5526", "+44 20.7946.0958", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b.c", "x.y@z-1.example.com.", "4111111111111111", "12345678901234", "é@ü.de", "+1", "@", "0.0.0.0@a.b"]
    made += ["".join(rng.choice([*bits, " ", "x", "9", "-", "."]) for _ in range(rng.randrange(14))) for _ in range(400)]
    made += ["", None]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.extract(df).collect():
        want = plain_spans(made[r.doc_id] or "")
        count = Counter(n for *_, n in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        base = ",".join(f"{n}:{s}:{e}" for s, _, e, n in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert not Counter(base.split(",") if base else []) - Counter(r.spans.split(","))
        assert r.n_spans == len(r.spans.split(",")) * bool(r.spans)


def test_unseen_identifiers_in_recurring_contexts_are_found(spark):
    """Seeds stand in a context; identifiers of shapes that no pattern knows, in the same context, are found: recall over 0.9."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(100):
        secret = f"{rng.getrandbits(160):040x}" if i < 80 else f"KEY-{rng.getrandbits(60)}-Z"
        rows.append((i, " ".join(word() for _ in range(20)) + f' token = "{secret}" ' + " ".join(word() for _ in range(20)) + f" {rng.randrange(10**6)} " + word()))
    long = "y" * 5000
    rows += [(200 + i, f"please {long} to user{i}@mail.example.com or go") for i in range(6)] + [(210, f"please {long} to 77-1234-x or go"), (211, f"please {long[:-1]} to 78-1234-x as told")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i in range(80, 100) if f"secret:{rows[i][1].index('KEY-')}" in got[i].spans]
    assert len(found) >= 18 and all(got[i].n_secret == 1 and got[i].n_found == 0 for i in range(80))
    assert got[210].n_found == 1 and got[211].n_found == 0  # whole words count, however long


def test_fingerprints_against_the_contract(spark):
    def plain(t):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            return 0
        grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))

    docs = list(texts(spark).values()) + ["", None, " \t\n", "One", "É ÀB c", "a b c", "a\x1cb c d e", "w " * 30_000]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = {i: plain(t) for i, t in enumerate(docs)}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in want.items()}
    root = {i: i for i in want}
    for _ in want:
        was = dict(root)
        for i in want:
            for j in want:
                if (want[i] ^ want[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j])
        if was == root:
            break
    assert {i: c for i, (_, c) in got.items()} == root


def test_names_as_ids(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"), ("c", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), (None, "a"), ("c", "c")}
    assert Counter(r.doc_id for r in winnow.fingerprint_with_edits(df).collect()) == Counter(r[0] for r in rows)


def _marks(spark, docs):
    """Winnowing by hand: rolling hashes one after the other, then every window's rightmost least."""
    words = sorted({w for t in docs for w in WORDS.findall(t)})
    word = {r.w: r.h & M64 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & M64 if n else x
    grams = {}
    for t in docs:
        w = [word[x] for x in WORDS.findall(t)]
        k, out, h = min(winnow.GRAM, len(w)), [], 0
        for i, x in enumerate(w):
            h = turn(h, 1) ^ x
            if i >= k:
                h ^= turn(w[i - k], k)
            if i >= k - 1:
                out.append(h - (h >> 63 << 64))
        grams[t] = out
    every = sorted({g for gs in grams.values() for g in gs})
    mixed = {r.g: r.h for r in spark.createDataFrame([(g,) for g in every], "g long").select("g", F.xxhash64("g").alias("h")).collect()}
    marks = {}
    for t, gs in grams.items():
        h = [mixed[g] for g in gs]
        n = min(winnow.WINDOW, len(h))
        marks[t] = sorted({min(range(i, i + n), key=lambda j: (h[j], -j)) for i in range(len(h) - n + 1)}) if h else []
        marks[t] = [(h[i], i) for i in marks[t]]
    return marks


def test_every_mark_and_likeness_against_plain_winnowing(spark):
    docs = dict(list(texts(spark).items())[:80]) | {1000 + i: t for i, t in enumerate(["a b c", "a b d", "a", "", "a b c d", "a b c d e", "w " * 100, "x y " * 50, " ".join(f"w{k * k % 37}" for k in range(300)), *(" ".join(f"v{k}" for k in range(n)) for n in (3, 4, 18, 19, 20))])}
    docs[10**15], docs[-(10**15)] = "far above everything else here", "far below everything else here"
    ids = sorted(docs, reverse=True)
    edited = {}
    for i, d in enumerate(ids):
        t, nxt = docs[d], docs[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        edited[d] = t[: len(t) - half] + nxt[:half]
    marks = _marks(spark, {*docs.values(), *edited.values()})

    def likeness(a, b):
        a, b = ({h for h, _ in marks[x]} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    shown = lambda t: ",".join(f"{h & M64:X}@{i}" for h, i in marks[t])
    got = {r.doc_id: r for r in winnow.fingerprint_with_edits(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()}
    for i, d in enumerate(ids):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(docs[d]), hashlib.sha256(edited[d].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(docs[d]), shown(edited[d]))
        assert r.near_edited == pytest.approx(likeness(docs[d], edited[d])) and r.near_next == pytest.approx(likeness(docs[d], docs[ids[(i + 1) % len(ids)]]))
    assert got[1000].near_next == 0.0 or docs[ids[ids.index(1000) + 1]] == docs[1000]
    assert got[1000].fingerprint != got[1001].fingerprint


def test_equal_digests_of_different_strings_are_told_apart(spark, monkeypatch):
    """Even where all digests collide, only equal bytes go."""
    monkeypatch.setattr(suffix_dedup.Hasher, "prefixes", lambda self, data: np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64))
    full = np.frombuffer("".join(random.Random(1).choice("ab") for _ in range(40)).encode(), np.uint8).reshape(4, 10)
    full = np.vstack((full, full[:2]))
    a, b = np.array([0, 0, 1, 2, 1]), np.array([4, 1, 5, 3, 4])
    col = np.array([0, 1, 2, 3, 2])
    assert suffix_dedup._same_bytes(full, 6, a, b, col).tolist() == [bytes(full[i, c : c + 6]) == bytes(full[j, c : c + 6]) for i, j, c in zip(a, b, col)]


def test_equal_rows_are_repeats_of_each_other(spark):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(1, t)] * 40 + [(2, t[:500]), (3, "".join(rng.choice("ijk ") for _ in range(900))), (None, None)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter({(1, 900, 900, 1): 40, (2, 500, 500, 1): 1, (3, 900, 0, 0): 1, (None, 0, 0, 0): 1})


HELPERS = ["_bad", "_salt", "salt", "_host", "_kept", "_all", "_keys", "_k", "_n", "ways", "hot", "c0", "c1", "s", "o", "t", "b", "blocks", "total", "rank", "upto", "hit", "k1", "k2", "common", "n", "root", "fp", "_ways", "sum", "row"]


def test_no_column_name_clashes(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + "\nmenu line", "ab"[i % 2]) for i in range(30)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({h: F.concat(F.lit(f"{h}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for h in HELPERS})
    plain = df.select("doc_id", "text", "source")
    for op in (lambda d: line_dedup.dedup_lines(d), lambda d: mixing.plan(d), lambda d: mixing.realise(mixing.plan(d, max_epochs=2.0)), lambda d: quality.keep_good(d, max_ratio=0.4, min_docs=5), lambda d: sharding.shard(d), lambda d: sentencepiece.decode(sentencepiece.encode(d, model_path()), model_path())):
        with_all, without = op(df), op(plain)
        for r in with_all.collect():
            assert all(r[h] == f"{h}:{'?' if r.doc_id is None else r.doc_id}" for h in HELPERS)
        assert Counter(map(str, with_all.select(without.columns).collect())) == Counter(map(str, without.collect()))


def test_hot_keys_are_bounded_and_every_row_stays(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4000).cast("string")).alias("k"), "id")
    small = rows.groupBy("k").agg(F.max("id").alias("m"))
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert common.hot_keys(sizes, "k").count() <= common.HOT and common.hot_keys(sizes, "k").filter("k = 'hot'").first().ways > 300
    joined = common.join_per_key(rows, small.filter("k <> '7'"), "k", F.col("id"), "left")
    assert sorted(r.id for r in joined.collect()) == list(range(20_000))
    assert {(r.k, r.m is None) for r in joined.select("k", "m").distinct().collect()} == {(r.k, r.k == "7") for r in rows.select("k").distinct().collect()}


def test_realised_rows_have_places(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i < 60 else "b") for i in range(80)]
    got = mixing.realise(mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_epochs=2.0)).collect()
    places = defaultdict(list)
    for r in got:
        places[r.source, r.block].append(r.place)
    assert sorted(places["a", 1]) == list(range(1, 61)) and sorted(places["b", 1]) == list(range(1, 21))
    assert sorted(places["b", 2]) == list(range(1, len(places["b", 2]) + 1))  # the last, partial permutation is its beginning


def test_kept_texts_lose_common_lines(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"the  Menu É\tline\n{body(i)}\n\nThe menu É line", "s") for i in range(30)] + [(40, "The menu é line\n" + body(40), "s"), (41, "the menu É line " * 13, "s"), (42, "the Menu É line\n" + body(42), None)]
    got = {r.doc_id: r.text for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: f"{body(i)}\n" for i in range(30)} | {40: rows[30][1], 42: rows[32][1]}


def test_pieces_of_long_words_and_spaces(spark):
    import sentencepiece as lib

    sp, rng = lib.SentencePieceProcessor(model_file=model_path()), random.Random(9)
    odd = [" ", "  ", "\n", "a\n\nb", "\n a", "a \n", " a", "a  b", "▁a ▁▁b", "\x01a b\n\x01", " " * 700, "ab" * 1500 + " " * 40 + "日本語" * 400]
    odd += ["".join(rng.choice(["a", " ", "  ", "\n", "the", "▁", "\x01", "é", "日", "ab", "    ", "ing", "2024", "\0", "🎉", "\r"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(2)
    for r in sentencepiece.decode(sentencepiece.encode(df, model_path()), model_path()).collect():
        assert r.tokens == sp.encode(odd[r.doc_id]) and r.decoded == odd[r.doc_id].replace("▁", " ")


ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "short"), (4, "short"), (5, "é日 " * 3000), (6, " ".join(f"a{k}" for k in range(80))), (6, " ".join(f"b{k}" for k in range(80))), (None, " ".join(f"c{k}" for k in range(80))), (7, " ".join(f"a{k}" for k in range(80)))]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_odd_rows(spark, empty):
    """Every stage by itself: nulls, empties, repeated rows and ids, columns with clashing names, an empty table."""
    import corpus_pipeline as cp

    rows = [] if empty else [(d, t, None if d == 5 else "en", "s" if d != 3 else None, 0) for d, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({h: F.lit(1) for h in ("_k1", "_k2", "hit", "tokens", "copies", "n")})
    out = [Counter((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()) for _, stage in cp.STAGES[:4]]
    coded = cp.encode_pieces(spark, docs, SF).collect()
    if empty:
        assert out == [Counter()] * 4 and coded == []
        return
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    assert out[0] == Counter([(6, a), (6, b), (None, c), (7, a)])
    assert out[1] == Counter(ODD)
    assert out[2] == Counter([(1, None), (4, "short"), (5, "é日 " * 3000), (6, a), (6, b), (None, c)])
    assert set(out[3]) == set(ODD) and len(coded) == len(ODD)
    assert {(r.doc_id, r.n_tokens) for r in coded if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}


def test_registered_queries_return_their_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_line_dedup", "op2_sharding", "op3_quality_rules", "op4_sentencepiece", "op5_pii", "op6_mixing", "op7_simhash", "op8_suffix_dedup", "op10_winnowing"):
        assert QUERIES[name](spark, SF).count() == n


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(4000)).encode() + b"\t" + b"y" * 9000 + b"\n tail"
    whole = suffix_dedup.Passages(50, 35)
    want = whole.words(text)
    monkeypatch.setattr(suffix_dedup, "SCAN", 1000)
    cut = suffix_dedup.Passages(50, 35)
    cut.hasher = whole.hasher
    assert len(want) == len(text.split()) == len(cut.words(text)) and (cut.words(text)[:4000] == want[:4000]).all() and cut.words(text)[-1] == want[-1]
    assert len(cut.words(b"")) == 0 and len(cut.words(b" \n ")) == 0


def test_shared_passages_against_all_runs(spark):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [word(n) for n in (51, 60, 45, 34, 20)]
    docs = []
    for i in range(300):
        parts = word(rng.randrange(60))
        for p in rng.sample(range(5), rng.randrange(3)):
            parts += passages[p] + word(rng.randrange(1, 40))
        docs.append((i, " ".join(parts)))
    docs += [(1000 + i, " ".join(word(10) + passages[0] + word(10))) for i in range(400)] + [(2000, ""), (2001, None), (2002, docs[0][1]), (2003, " ".join(["a"] * 200)), (2004, " ".join(["a"] * 90))]

    def sharing(k):
        seen = defaultdict(set)
        for i, t in docs:
            w = (t or "").split()
            for j in range(len(w) - k + 1):
                seen[tuple(w[j : j + k])].add(i)
        return {i for v in seen.values() if len(v) > 1 for i in v}

    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.n_passages for r in suffix_dedup.remove_repeats(df).collect()}
    flagged = {i for i, n in got.items() if n > 0}
    assert len(got) == len(docs) and sharing(51) <= flagged <= sharing(35)
