"""Periodic runs, spelling variants and byte-level BPE against plain versions, and odd rows with values."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, runs, spelling
from pulsegrid.llm.queries import QUERIES, vocabulary_path

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_runs(w, min_length=6, times=4):
    """For each period all stretches that repeat at it; of the periods of a stretch the least."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (4, 3), (10, 2)])
def test_maximal_pairs_are_all_runs(limits):
    rng = random.Random(str(limits))
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            kinds = rng.choice([1, 2, 3, 5, 30])
            w = [rng.randrange(kinds) for _ in range(rng.randrange(80))]
            if rng.random() < 0.5 and w:
                s, p = rng.randrange(len(w)), rng.randrange(1, 10)
                for i in range(s + p, len(w)):
                    w[i] = w[i - p]
                for _ in range(rng.randrange(2)):
                    w[rng.randrange(len(w))] = 99
            docs.append(w)
        ids, count = np.array([x for d in docs for x in d], np.int64), [len(d) for d in docs]
        first = np.cumsum([0, *count]).tolist()
        want = sorted(((first[k] + s, n, q) for k, d in enumerate(docs) for s, n, q in plain_runs(d, *limits)), key=lambda r: (r[0], r[2]))
        assert [tuple(r) for r in runs.find(ids, np.repeat(np.arange(len(docs)), count), *limits).tolist()] == want


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    want = texts(spark)
    assert got.keys() == want.keys()
    for i, t in want.items():
        w = WORDS.findall(t)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        found = plain_runs(w)
        first = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), sha("".join("%d,%d,%d\n" % x for x in found)), sha(collapsed(w, found)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*first, 1000 * first[1] // first[2]) if first else (None,) * 4)
    assert sum(r.n_runs for r in got.values()) > 5


def test_runs_of_odd_rows(spark):
    made = [None, "", " \t\n", "a " * 5, "a " * 6, "x" + " b c" * 300, "a b c d e f g h " * 4, "one\x1ctwo " * 7, "z", ("p q r s t " * 4).strip() + " u"]
    rows = [(k % 3 or None, t, "old", k) for k, t in enumerate(made * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, place int")
    out = runs.find_runs(df)
    assert out.columns == ["doc_id", "text", "place", "n_words", "runs", "collapsed"]
    got = {r.place: r for r in out.collect()}
    assert len(got) == 2 * len(made)
    for k, t in enumerate(made * 2):
        w = WORDS.findall(t or "")
        found = plain_runs(w)
        assert (got[k].n_words, [tuple(r) for r in got[k].runs], got[k].collapsed) == (len(w), found, collapsed(w, found))
    assert runs.find_runs(df.limit(0)).collect() == []
    long = spark.createDataFrame([("a b " * 100_000,)], "text string")
    assert [tuple(r) for r in runs.find_runs(long).first().runs] == [(0, 200_000, 2)]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(count, times=5):
    by = defaultdict(set)
    for w in count:  # words one edit apart share a word with one code point less, or are such a pair
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[x].add(w)
    close = {w: {x for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by[d] if near(w, x)} for w in count}
    form = {w: min(c, key=lambda x: (-count[x], x), default=None) for w, c in close.items()}
    form = {w: f if f is not None and count[f] >= times * count[w] else None for w, f in form.items()}
    out = {}
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, count[w], len(close[w]), count[form[w]] if form[w] else None)
    return out


def test_index_finds_all_words_one_edit_away():
    rng = random.Random(2)
    for t in range(150):
        letters, size = ("ab", "abcdé")[t % 2], rng.choice([6, 7, 8, 12])
        words = list({"".join(rng.choice(letters) for _ in range(rng.randrange(6, size + 3))) for _ in range(rng.randrange(1, 60))} | {"aaaaaa", "aaaaaaa"})
        asked = list(dict.fromkeys(words + ["".join(rng.choice(letters + "z") for _ in range(rng.randrange(6, size + 1))) for _ in range(10)]))
        index = spelling.Index(words)
        got = [(q, words[j]) for front in (True, False) for q, j in spelling.one_edit_away(index, asked, words, front)]
        assert sorted(got) == sorted((q, w) for q in asked for w in words if near(q, w))


def test_spelling_query_against_brute_force(spark):
    count = Counter()
    for i, t in texts(spark).items():
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 6
    want = plain_groups({w: n for w, n in count.items() if n >= 5})
    got = {r.word: tuple(r) for r in QUERIES["op12_spelling_variants"](spark, SF).collect()}
    assert got == want and any(r[1] for r in want.values())


@pytest.mark.parametrize("together,indexed", [(20_000, 200_000), (7, 60)])
def test_spelling_of_odd_words(spark, monkeypatch, together, indexed):
    """Long chains of forms, ties, marks in words, very long words and hot beginnings, also where keys are cut into small blocks."""
    monkeypatch.setattr(spelling, "TOGETHER", together)
    monkeypatch.setattr(spelling, "INDEXED", indexed)
    rng = random.Random(5)
    count = {"chains" + "abcdefghijkl"[:k]: 5 ** (k + 1) for k in range(12)}
    count |= {"colour": 7, "colours": 40, "colourd": 40, "ab|cdef": 9, "ab||cdef": 50, "|bcdefg": 3, "y" * 3000: 6, "y" * 3001: 60, "é" * 6: 5, "é" * 7: 26}
    count |= {"prefix" + "".join(rng.choice("ab") for _ in range(7)): rng.randrange(5, 900) for _ in range(60)}
    rows = [*count.items(), (None, 4)]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n int"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r) for r in got.collect()} == plain_groups(count)
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_word_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straße STRASSE straße"), (3, "abcdeF abcdef2abcdef ABCDEÀ abcdeà x " * 2), (3, "abcdef")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    assert {tuple(r) for r in spelling.word_counts(df, min_n=1).collect()} == {("straße", 2), ("strasse", 1), ("abcdef", 7), ("abcdeÀ", 2), ("abcdeà", 2)}
    assert spelling.word_counts(df.limit(0)).collect() == []


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_query_against_the_library(spark):
    lib, got = library(), {r.doc_id: r for r in QUERIES["op13_bpe"](spark, SF).collect()}
    for i, t in texts(spark).items():
        ids = lib.encode(t, add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False)) == sha(t)


def test_bpe_of_odd_texts_and_ids():
    lib, model, rng = library(), bpe.load(vocabulary_path()), random.Random(3)
    coder = bpe.Coder(model)
    bits = ["a", "the", "<|endoftext|>", " ", "  ", "\n", "'s", "'ll", "é", "՘", "꟎1", "5", "٣", "²", "漢字", "\x1c", " ", "　", "\U0003d000", "!", "<|endo", "aaaaaaa", "'", "​", "\x85", "é", "👍🏽"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert coder.encode(t) == lib.encode(t, add_special_tokens=False).ids, t
        ids = [rng.randrange(50257) for _ in range(rng.randrange(8))]
        assert b"".join(model["strings"][i] for i in ids).decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False)
    long = "ab" * 60_000
    assert coder.encode(long) == lib.encode(long, add_special_tokens=False).ids


def test_every_character_is_cut_as_in_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    lib, coder = ByteLevel(add_prefix_space=False, use_regex=True), bpe.Coder(bpe.load(vocabulary_path()))
    for c in [*range(0, 0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2A6D0, 0x2B000), *range(0x32380, 0x32400), *range(0x3CFF0, 0x3D010)]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}1{chr(c)}!{chr(c)} b"
            assert coder.chunks(t) == [t[a:z] for _, (a, z) in lib.pre_tokenize_str(t)], hex(c)


def test_bpe_forgets_and_keeps_results(monkeypatch):
    model = bpe.load(vocabulary_path())
    t = " ".join(f"word{k % 97}x{k % 89}" for k in range(3000))
    want = bpe.Coder(model).encode(t)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    coder = bpe.Coder(model)
    assert coder.encode(t) == want and len(coder.memory) + len(coder.memory.older) <= 40


def test_bpe_of_odd_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "", 8), (2, "hi <|endoftext|>", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    out = bpe.encode(df, vocabulary_path(), packed="raw")
    assert out.columns == ["doc_id", "text", "tokens", "n_tokens", "raw"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, None, [], 0, b""), (1, None, [], 0, b""), (None, "", [], 0, b""), (2, "hi <|endoftext|>", [5303, 220, 50256], 3, np.array([5303, 220, 50256], "<u4").tobytes())], key=str)
    assert bpe.encode(df.limit(0), vocabulary_path()).collect() == []
    ids = spark.createDataFrame([(0, None), (1, []), (2, [5303, -1, None, 99_999]), (3, [128])], "k int, tokens array<int>")
    assert {r.k: r.decoded for r in bpe.decode(ids, vocabulary_path()).collect()} == {0: "", 1: "", 2: "hi", 3: "�"}
    assert bpe.decode(ids.limit(0), vocabulary_path()).collect() == []
    with pytest.raises(ValueError):
        bpe.load(str(vocabulary_path()).replace("byte_bpe_50k", "word_bpe_49k"))
