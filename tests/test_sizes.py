"""Results that must not depend on a table's size or on how it is dealt."""

from datetime import datetime, timedelta

from pulsegrid.operators import hosts
from pulsegrid.plans import ingest, streams
from pulsegrid.streaming import jobs


def test_cpu_topology_takes_the_first_of_equal_places(spark):
    schema = "host string, pos long, physical_id int, core_id int, vendor string, model string, family string, mhz double"
    rows = [("h", 5, None, None, "v0", "m0", "f0", 9.0), ("h", 1, None, None, "v1", "", "f1", 0.0), ("h", 1, None, None, "v2", "m2", "f2", 2.0), ("h", 1, None, None, "v3", "m3", "f3", 3.0)]
    got = hosts.cpu_topology(spark.createDataFrame(rows, schema).coalesce(1)).first()
    assert (got.vendor, got.model, got.family, got.mhz, got.logical, got.cores) == ("v1", "m2", "f1", 2.0, 4, 4)


def test_the_whole_text_does_not_travel_with_each_piece(spark, tmp_path):
    """A text of 200 pieces: what is shuffled is about the text, not 200 times it."""
    text = "".join(f"é{i * i} " for i in range(14_000))
    spark.createDataFrame([(i, text + str(i)) for i in range(20)] + [(20, "short"), (21, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = ingest.capped_lines(spark, str(tmp_path))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows.keys() == set(range(21)) and all(r.whole and r.fits for r in rows.values()) and rows[20].n == 1 and rows[0].n > 200
    scan = spark.read.parquet(f"{tmp_path}/documents.parquet")
    exploded = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert exploded and all("text#" not in x.split("], ")[-1] for x in exploded) and scan.count() == 22


def test_sources_of_a_stream_are_dealt_into_groups(spark, tmp_path):
    schema = "source_id long, offset long, ts timestamp, line string"
    for k in range(3):
        rows = [(s if s else None, 2 * k + j, None, line) for s in range(300) for j, line in enumerate(("A" + "x" * (s % 7), "more"))]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = jobs.run_all(jobs.stream_multiline(stream, "A", 3_600_000, dealt=4), str(tmp_path))
    got = {(r.source_id, r.offset, r.message) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(s if s else None, 2 * k + 1, "A" + "x" * (s % 7) + "\nmore") for s in range(300) for k in range(2)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 30  # not one for each source


def test_entities_of_a_host_are_dealt_into_parts(spark, tmp_path):
    """Most parts have no row at time 10; yet an entity that is not there begins anew at 20."""
    schema = "host string, dev string, ts timestamp, n double"
    at = lambda t: datetime(2024, 1, 1) + timedelta(seconds=t)
    for t, devs in ((0, range(50)), (10, (7,)), (20, range(50))):
        spark.createDataFrame([("h", f"d{d}", at(t), float(d * t)) for d in devs], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        made = jobs.drain(jobs.stream_counter_rate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "dev", "ts", ["n"], parts=8), str(tmp_path))
    assert {(r.dev, r.ts, r.rate) for r in made.collect()} == {("d7", at(10), 7.0), ("d7", at(20), 7.0)}


def test_a_batch_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(30_000).selectExpr("id AS k", "repeat('x', 50) AS t")
    ends = [0]
    for stream in streams._as_stream(df, str(tmp_path), "k"):
        assert stream.isStreaming
        ends.append(spark.read.parquet(f"{tmp_path}/in").agg({"k": "max"}).first()[0])
    assert len(list((tmp_path / "parts" / "part=0").glob("*.parquet"))) > 1 and ends == sorted(ends) and ends[-1] == 29_999
    assert spark.read.parquet(f"{tmp_path}/in").count() == 30_000
