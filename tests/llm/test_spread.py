"""Hot keys, equal rows and many splitters are spread and planned, with the same results."""

import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import common, line_dedup, mixing, quality, winnow


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def fullest(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("doc_id,text", [("null", "concat('text ', id)"), ("7", "concat('text ', id)"), ("null", "'same text'")])
def test_mixing_spreads_rows_without_ids_and_equal_ids(many_parts, monkeypatch, doc_id, text):
    monkeypatch.setattr(mixing, "BLOCK", 500)
    df = many_parts.range(0, 20_000, 1, 40).selectExpr(f"cast({doc_id} AS bigint) AS doc_id", "if(id % 20 = 0, 'b', 'a') AS source", f"{text} AS text", "id AS other")
    out = common.cut(mixing.plan(df, max_epochs=2.0))
    assert fullest(out) < 4_000
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.max("place").alias("last"), F.sum("copies").alias("copies"), F.first("epochs").alias("epochs")).collect()
    for r in got:
        assert r.n == r.places == r.last and abs(r.copies - r.n * r.epochs) <= 2
    assert {r.source: r.n for r in got} == {"a": 19_000, "b": 1_000}


def test_line_dedup_spreads_equal_pages(many_parts):
    df = many_parts.range(0, 20_000, 1, 40).selectExpr("cast(null AS bigint) AS doc_id", "'h' AS source", "if(id % 2 = 0, 'same\nline', concat('page ', id, '\nline')) AS text")
    out = common.cut(line_dedup.dedup_lines(df))
    assert fullest(out) < 4_000
    assert {(r.text, r.n_dropped) for r in out.filter("n_dropped = 2").collect()} == {("", 2)} and out.filter("n_dropped = 1").count() == 10_000


def test_a_common_line_goes_and_depleted_documents_are_rejected(spark):
    """A line on over a tenth of a small host's documents counts, copies of a text as one; a lone document's line doesn't."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    line = words("common", 20)
    rows = [(k, "s", f"{words(k, 90)}\n{line}" if k < 4 else words(k, 60)) for k in range(30)] + [(40, "s", f"{words(40, 55)}\n{line}"), (41, "t", words(41, 60)), (42, "t", words(41, 60)), (43, "t", words(41, 60))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[k].n_common_words == 20 and got[k].kept for k in range(4))
    assert got[40].n_common_words == 20 and not got[40].kept and not got[40].base_failed  # 55 of 75 words are left
    assert all(got[k].kept and got[k].n_common_words == 0 for k in (5, 41, 42, 43))


def test_ten_thousand_splitters_are_planned_in_seconds(spark):
    bounds = [f'{{"has":true,"id":{3 * k},"tie":0}}' for k in range(10_000)]
    key = F.struct(F.lit(True).alias("has"), F.col("id").alias("id"), F.lit(1).cast("long").alias("tie"))
    began = time.time()
    got = spark.range(0, 40_000, 97).select("id", winnow._bucket(key, bounds, "bigint").alias("b")).collect()
    assert time.time() - began < 20
    assert all(r.b == min(r.id // 3 + 1, 10_000) for r in got)


@pytest.mark.parametrize("kind,ids", [("string", ["b", None, 'q"\\', "é", ""]), ("date", ["2024-01-02", None, "2023-12-31"]), ("timestamp", ["2024-01-02 03:04:05.678901", None, "2023-12-31 00:00:00"]), ("decimal(20,3)", ["1.5", "-2", None, "7"])])
def test_ids_of_any_type_keep_their_order(spark, monkeypatch, kind, ids):
    monkeypatch.setattr(winnow, "SAMPLE", 2)
    df = spark.createDataFrame([(i, f"text {i} {k}") for k, i in enumerate(ids * 3)], "i string, text string").select(F.col("i").cast(kind).alias("doc_id"), "text")
    out = winnow.with_next(df, "doc_id", "text", lambda x: x).select("doc_id", "text", F.col("next.text").alias("after")).collect()
    after = {r.text: r.after for r in out}
    at, seen = next(iter(after)), []
    for _ in out:
        seen.append(at)
        at = after[at]
    assert len(out) == 3 * len(ids) == len(set(seen)) and at == seen[0]  # one ring through all rows
    value = {r.text: r.doc_id for r in out}
    falls = sum((value[a] is None and value[b] is not None) or (value[a] is not None and value[b] is not None and value[a] < value[b]) for a, b in zip(seen, seen[1:] + seen[:1]))
    assert falls == 1


def test_contexts_find_the_secrets_that_are_no_seeds(spark):
    """On a given table: the pattern in front of the seeds finds at least nine of ten of the secrets that are held out."""
    from pulsegrid.llm.queries import QUERIES

    got = QUERIES["op5_pii"](spark, "/root/testdata/sf0.1").agg(F.sum("n_secret"), F.sum("n_held_out"), F.sum("n_confirmed")).first()
    print(got)
    assert got[1] >= 10 and got[2] >= 0.9 * got[1] and got[0] > 5 * got[1]
