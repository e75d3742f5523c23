"""Near copies whose links are not among the nearest of a list."""

import random

from pulsegrid.llm import simhash


def _roots(texts):
    """Groups that all pairs with a Jaccard similarity of 0.8 or more join, by brute force."""
    sets, root = [set(simhash.shingles(t, 5).tolist()) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {frozenset(i for i in range(len(texts)) if top(i) == k) for k in set(map(top, range(len(texts))))}


def test_no_candidate_of_a_long_list_is_lost(spark):
    r = random.Random(1)
    base, texts = [f"w{r.randrange(10**6)}" for _ in range(120)], []
    for _ in range(200):
        t = list(base)
        for _ in range(2):
            t[r.randrange(120)] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {}
    for row in simhash.similar(df, ["doc_id", "text"]).collect():
        groups.setdefault(row.root, set()).add(row.id)
    assert set(map(frozenset, groups.values())) == _roots(texts)


def _copies(r, n, edits):
    base, texts = [f"w{r.randrange(10**6)}" for _ in range(150)], []
    for _ in range(n):
        t = list(base)
        for _ in range(edits(r)):
            t[r.randrange(150)] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(t))
    return list(dict.fromkeys(texts))


def _grouped(spark, monkeypatch, texts):
    """Groups of `similar`, and the rows of each table of pairs that it counts in full."""
    made, real = [], simhash.cut

    def cut(df):
        out = real(df)
        if {"a", "b"} <= set(df.columns):
            made.append(out.filter("b is not null").count())
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    groups = {}
    for row in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id", "text"]).collect():
        groups.setdefault(row.root, set()).add(row.id)
    return set(map(frozenset, groups.values())), made


def test_pairs_of_near_copies_do_not_grow_with_the_square(spark, monkeypatch):
    """Many of these 379 texts link to none: 71,631 pairs, of which hardly any need be counted beyond the first."""
    r = random.Random(2)
    texts = _copies(r, 500, lambda r: min(14, int(r.expovariate(0.25))))
    groups, made = _grouped(spark, monkeypatch, texts)
    assert groups == _roots(texts) and len(groups) > 100
    assert len(made) == 2 and made[0] < 40 * len(texts) and made[1] < 2 * len(texts)


def test_links_by_shared_edits_are_found(spark, monkeypatch):
    """No text is near what all have in common: links are between texts that were edited at the same places, also of two bases."""
    r = random.Random(3)
    texts = _copies(r, 200, lambda r: r.choice((4, 5, 6)))
    for t in texts[:60]:
        t = t.split(" ")
        t[r.randrange(150)] = "again"
        texts.append(" ".join(t))
    texts += _copies(r, 100, lambda r: r.choice((3, 4)))
    groups, made = _grouped(spark, monkeypatch, texts)
    assert groups == _roots(texts) and sum(len(g) > 1 for g in groups) > 40
