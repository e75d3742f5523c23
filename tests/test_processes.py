"""Create times of processes against a plain fold."""

import random
from datetime import datetime, timedelta

import pytest

from pulsegrid.operators import counters

ZERO = datetime(2024, 1, 1)


def plain(rows, slack):
    """Rows (host, pid, snapshot, reading): the pinned value of each."""
    times = sorted({(h, t) for h, _, t, _ in rows})
    before = {b: a[1] for a, b in zip(times, times[1:]) if a[0] == b[0]}
    out, held = {}, {}
    for h, p, t, c in sorted(rows, key=lambda r: r[:3]):
        last = held.get((h, p))
        if last and last[0] == before.get((h, t)) and last[1] is not None and c is not None and abs(last[1] - c) < slack:
            held[h, p] = t, last[1]
        else:
            held[h, p] = t, c
        out[h, p, t] = held[h, p][1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pinned_times_are_those_of_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for h in ("a", "b"):
        for p in range(6):
            c, step = 10**12, [1, 700, 1500, 2500, 0, 5000][p]
            for t in range([5, 80, 33, 200][seed]):
                c += rng.randrange(-step, step + 1) if seed != 3 or p else 1990
                if rng.random() > 0.05:
                    rows.append((h, p, t, None if rng.random() < 0.02 else c))
    df = spark.createDataFrame([(h, p, ZERO + timedelta(seconds=10 * t), c, "x") for h, p, t, c in rows], "host string, pid int, snap_ts timestamp, create_time long, _note string")
    out = counters.pin_create_time(df)
    assert out.columns == [*df.columns, "pinned"]
    got = {(r.host, r.pid, (r.snap_ts - ZERO).seconds // 10): r.pinned for r in out.collect()}
    assert got == plain(rows, 2000)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_no_processes(spark):
    df = spark.createDataFrame([], "host string, pid int, snap_ts timestamp, create_time long")
    assert counters.pin_create_time(df).collect() == []
