"""The dialect of log rules: results written out, and the same as those of a linear-time engine that reads the dialect itself."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.patterns import BadPattern, compiled, replacement, to_java
from pulsegrid.operators.logs import Rule, apply_rules, mask_sequences

#: pattern, placeholder, text, result
WRITTEN = [
    ("[[:digit:]]+", "X", "card 4111", "card X"), ("[a&&b]", "X", "a&b&c", "XXXXc"), (r"\pL+", "X", "é1ß", "X1X"), (r"\z", "!", "ab", "ab!"), (r"\Q.*\E", "X", "a.*b", "aXb"),
    (r"\Qa", "X", "ab", "Xb"), (r"\x{41}", "X", "A", "X"), (r"(?U)a+", "X", "aaa", "XXX"), (r"(?U)a+?", "X", "aaa", "X"), ("a$", "X", "a\na", "a\nX"), ("(?m)a$", "X", "a\na", "X\nX"),
    ("(?m)^$", "X", "a\n\n", "a\nX\nX"), ("^", "X", "a\nb", "Xa\nb"), ("(?m)^", "X", "a\nb\n", "Xa\nXb\nX"), ("a*", "x", "baac", "xbxcx"), ("a*?", "x", "baac", "xbxaxaxcx"), ("a*?", "x", "", "x"),
    ("", "x", "ab", None), (r"\d", "X", "5٣", "X٣"), (r"\w+", "X", "aé_9", "XéX"), (r"\s", "X", "a\x0b b", "a\x0bXb"), ("[[:space:]]", "X", "a\x0b b", "aXXb"), (r"\bé", "X", "aé é", "aX é"), (r"\B", "|", "ab", "a|b"),
    (r"[\d-x]", "X", "5-x", "XXX"), ("[]a]", "X", "]a", "XX"), ("[^]a]", "X", "]ab", "]aX"), ("[a-]", "X", "a-", "XX"), ("[[:word:]-]+", "X", "a-b c", "X X"), ("[[:^alpha:]]", "X", "a1é", "aXX"), ("[[a]", "X", "[a", "XX"),
    (r"\p{Greek}+", "X", "aαβ", "aX"), (r"\p{^Greek}", "X", "aα", "Xα"), (r"\P{L}", "X", "a1", "aX"), (r"[^\pL\d]", "X", "aé1!", "aé1X"), ("(?i)straSSe", "X", "STRAsse", "X"), ("(?i)k", "X", "kKK", "XXX"),
    ("(?i)[^a]", "X", "Aab", "AaX"), ("(?i:a)b", "X", "AbAB", "XAB"), ("a(?i)b|c", "X", "aBC", "XX"), (".", "X", "a\n\r", "X\nX"), ("(?s).", "X", "a\n", "XX"), (r"\012", "X", "a\nb", "aXb"), (r"\x0a", "X", "a\n", "aX"),
    ("a{,2}", "X", "a{,2}", "X"), ("a{2}", "X", "aaa", "Xa"), ("a{02}", "X", "a{02}", "X"), ("{", "X", "{", "X"), ("(a)(b)?", "[$1$2]", "aab", "[a][ab]"), ("(a)(b)", "$2$1", "ab", "ba"), ("(a)", "$1x", "a", ""), ("(a)", "${1}x", "a", "ax"),
    ("(?P<n>a)", "<$n>", "a", "<a>"), ("(?<n_1>a)", "<$n_1>", "a", "<a>"), ("(?P<1>a)(b)", "$1", "ab", "a"), ("a", "$$", "a", "$"), ("a", "$", "a", "$"), ("a", "$ $-", "a", "$ $-"), ("a", r"\1", "a", r"\1"), ("(a)", "$10", "a", ""), ("(a)", "${1}0", "a", "a0"),
    ("(a)", "$01", "a", ""), ("a", "$0$0", "a", "aa"), ("(?:a|b|cd)+", "X", "abcdx", "Xx"), ("(|a)+", "X", "b", "XbX"), ("a||b", "X", "b", "XbX"), ("x*", "-", "é", "-é-"), ("[[:punct:]]", "X", "a^b", "aXb"), ("é", "X", "é", "X"), (r"\_\-", "X", "_-", "X"),
    (r"(\w+)@(\w+)\.com", "$2", "joe@ex.com", "ex"), ("a|ab", "X", "ab", "Xb"), ("(?:a|ab)(?:c|bcd)", "X", "abcd", "X"), ("^*a", "X", "a", "X"), (r"[\x00-\x1f]", "X", "a\tb", "aXb"), (r"[[:cntrl:]]", "X", "\x7f", "X"), (r"\C", "X", "a", None), ("a**", "X", "a", None),
    ("a{2}{3}", "X", "a", None), ("(a{999}){2}", "X", "a", None), ("x{1001}", "X", "x", None), ("(?=a)", "X", "a", None), ("(?!a)", "X", "a", None), ("(?<=a)", "X", "a", None), (r"(a)\1", "X", "aa", None), ("a++", "X", "a", None), ("(", "X", "(", None), (")", "X", ")", None),
    ("[a", "X", "a", None), ("[b-a]", "X", "a", None), (r"[a-\d]", "X", "a", None), ("[[:nope:]]", "X", "a", None), (r"\pX", "X", "a", None), (r"\8", "X", "a", None), (r"\e", "X", "a", None), ("*a", "X", "a", None), ("a|*", "X", "a", None), ("(?P<a>x)(?P<a>y)", "X", "xy", None),
    ("(?x)a", "X", "a", None), ("\\", "X", "a", None), (r"\x{110000}", "X", "a", None), (r"\xg0", "X", "a", None), ("(?P<a-b>x)", "X", "x", None), ("x{2,1}", "X", "x", None), ("(?i-)a", "X", "a", None),
]


def test_written_results(spark):
    assert len(WRITTEN) > 100
    for pattern, _, _, want in WRITTEN:
        assert (to_java(pattern) is None) == (want is None), pattern
    good = [w for w in WRITTEN if w[3] is not None]
    df = spark.createDataFrame([tuple(w[2] for w in good)], ", ".join(f"c{k} string" for k in range(len(good))))
    got = df.select(*[mask_sequences(F.col(f"c{k}"), p, r).alias(f"c{k}") for k, (p, r, _, _) in enumerate(good)]).first()
    assert [(p, g) for (p, *_), g in zip(good, got)] == [(p, w) for p, *_, w in good]


def test_random_patterns_match_as_in_a_linear_time_engine(spark):
    rng, engine = random.Random(8), duckdb.connect()
    atoms = ["a", "b", "é", ".", "[ab]", "[^a]", r"\d", r"\w", r"\s", "[[:upper:]]", r"\pL", r"\b", "^", "$", "(a)", "(?:b|c)", "(?i:A)", "|", "(?s:.)", r"\Qa.\E", "(?m)^", "(?m:$)", "[é-ü]", "1", r"\x41", "(|a)", "[^[:alnum:]]"]
    patterns = {"".join(rng.choice(atoms) + rng.choice(["", "", "", "*", "+", "?", "*?", "+?", "{2}", "{1,2}", "{0,2}?"]) for _ in range(rng.randrange(1, 5))) for _ in range(500)}
    texts = ["".join(rng.choice(["a", "b", "c", "é", "ü", "1", " ", "\n", "A", "a.", "_"]) for _ in range(rng.randrange(9))) for _ in range(30)]
    kept, want = [], []
    for p in sorted(patterns):
        try:
            rows = [engine.execute("SELECT regexp_matches(?, ?), regexp_replace(?, ?, 'X', 'g')", [t, p, t, p]).fetchone() for t in texts]
        except duckdb.Error:
            assert to_java(p) is None, p
            continue
        kept.append(p)
        want.append(rows)
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for a in range(0, len(kept), 40):
        cols = [c for p in kept[a : a + 40] for c in (F.col("t").rlike(to_java(p)), F.regexp_replace("t", compiled(p).replacing, "X"))]
        got = df.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()
        for k, p in enumerate(kept[a : a + 40]):
            for t, g, w in zip(texts, got, want[a + k]):
                assert (g[2 * k], g[2 * k + 1]) == w, (p, t)


def test_rules_do_not_repeat_masks(spark):
    rules = [Rule("mask_sequences", r"[a-z]+@[a-z]+", "[mail]"), Rule("exclude_at_match", "@"), Rule("include_at_match", "[.]"), Rule("mask_sequences", "[[:digit:]]+", "#")]
    df = spark.createDataFrame([(1, "a@b 12."), (2, "A@ 3."), (3, "x"), (4, None), (5, ".")], "k long, message string")
    out = apply_rules(df, rules)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == {(1, "[mail] #."), (5, ".")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[mail]") == 1
    assert apply_rules(df, [Rule("mask_sequences", "x", "y")]).count() == 5


def test_a_pattern_that_java_lacks_fails_the_job(spark):
    df = spark.createDataFrame([("a",)], "message string")
    with pytest.raises(Exception, match="(?i)script|pattern"):
        apply_rules(df, [Rule("mask_sequences", r"\p{Klingon}", "x")]).collect()
    with pytest.raises(BadPattern):
        compiled("(")
    assert replacement("$x", "(a)") == ""
