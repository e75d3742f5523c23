"""Multi-line assembly of sources that many tasks share, against a plain fold."""

import random
import re
from datetime import datetime, timedelta

import pytest

from pulsegrid.operators import logs

ZERO = datetime(2024, 1, 1)


def plain(rows, pattern, timeout, cap):
    """Rows (source, offset, seconds or None, line), in order: the messages, and each row's group."""
    out, gids, state = [], {}, {}
    for source, offset, t, line in sorted(rows, key=lambda r: r[:2]):
        held, size, last, gid = state.get(source, ([], 0, None, 0))
        idle = timeout is not None and last is not None and t is not None and last[1] is not None and t - last[1] >= timeout
        if re.match(pattern, line or "") and line is not None or idle:
            gid += 1
            if held:
                out.append((source, *last, "\n".join(held)))
            held, size = [], 0
        held, size, last = [*held, line or ""], size + len((line or "").encode()) + 1, (offset, t)
        gids[source, offset] = gid
        if size > cap:
            out.append((source, *last, "\n".join(held)))
            held, size = [], 0
        state[source] = held, size, last, gid
    return out + [(s, *last, "\n".join(held)) for s, (held, _, last, _) in state.items() if held], gids


@pytest.mark.parametrize("seed", range(6))
def test_blocks_give_the_same_messages_as_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source in ("a", "b", "hot", None):
        offset = t = 0
        for _ in range(rng.choice([1, 30, 400])):
            offset += rng.choice([1, 1, 2, 7, 50])
            t += rng.choice([0, 0, 0.25, 0.5, 1, 3])
            line = rng.choice(["x", "é", "", "Start " if source != "hot" or seed % 2 else "y", None, "long " * rng.randrange(9)])
            rows.append((source, offset, None if rng.random() < 0.1 or seed == 2 else t, line))
    rows = [r for r in rows if r[0] is not None]
    timeout, cap, span = [(None, 20, 10), (1, 60, 16), (1, 10**6, 5), (0.5, 0, 10), (3, 33, 1), (2, 100, 1 << 20)][seed]
    df = spark.createDataFrame([(s, o, None if t is None else ZERO + timedelta(seconds=t), x) for s, o, t, x in rows], "source_id string, offset long, ts timestamp, line string")
    want, gids = plain(rows, "Start", timeout, cap)
    got = [(r.source_id, r.offset, None if r.ts is None else (r.ts - ZERO).total_seconds(), r.message) for r in logs.assemble_multiline(df, "Start", timeout, cap, span).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.source_id, r.offset): r.gid for r in logs.line_groups(df, "Start", timeout, span).collect()} == gids


def test_a_hot_source_without_starts_is_spread(spark):
    df = spark.range(0, 200_000, 1, 8).selectExpr("'s' AS source_id", "id AS offset", "cast(null AS timestamp) AS ts", "concat('line ', id) AS line")
    out = logs.assemble_multiline(df, "none", None, 5000, 4096)
    rows = sorted(out.select("offset", "message").collect())
    assert "\n".join(r.message for r in rows) == "\n".join(f"line {k}" for k in range(200_000))
    ends = [len(r.message) + 1 for r in rows]
    assert all(5000 < n <= 5000 + 13 for n in ends[:-1]) and rows[-1].offset == 199_999
    plan = logs.assemble_multiline(df, "none", None, 5000, 4096)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if " Window [" in x]
    assert windows and all("offset" not in x or "_block" in x for x in windows)  # lines are put in order in blocks only


def test_no_lines(spark):
    df = spark.createDataFrame([], "source_id long, offset int, ts timestamp, line string")
    assert logs.assemble_multiline(df, "x").collect() == [] and logs.line_groups(df, "x").collect() == []
