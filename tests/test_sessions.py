import random
from datetime import datetime, timedelta

import pytest

from fotoloom.operators.sessions import sessions

SCHEMA = "device string, at timestamp_ntz, id int, entity string, _t int"  # with clashing names
HOUR = 3600


def brute(rows, gap):
    out, by = [], {}
    for d, t, i, *_ in rows:
        if d is not None and t is not None and i is not None:
            by.setdefault(d, []).append((t, i))
    for d, line in by.items():
        line.sort()
        run = [line[0]]
        for x in line[1:]:
            if x[0] - run[-1][0] > timedelta(seconds=gap):
                out.append((d, run[0][1], run[-1][1], run[0][0], run[-1][0], len(run)))
                run = []
            run.append(x)
        out.append((d, run[0][1], run[-1][1], run[0][0], run[-1][0], len(run)))
    return sorted(out)


def found(spark, rows, gap, **kw):
    df = sessions(spark.createDataFrame(rows, SCHEMA), "device", "at", "id", gap, **kw)
    assert df.columns == ["entity", "first_id", "last_id", "start", "end", "seconds", "events"]
    got = df.collect()
    assert all(r.seconds == (r.end - r.start).total_seconds() for r in got)
    return sorted((r.entity, r.first_id, r.last_id, r.start, r.end, r.events) for r in got)


def test_the_gap_is_inclusive_and_days_do_not_matter(spark):
    t = datetime(2024, 2, 28, 22)
    rows = [("a", t, 9, "x", 1), ("a", t + timedelta(hours=6), 2, "x", 1), ("a", t + timedelta(hours=12, microseconds=1), 3, "x", 1), ("b", t, 4, None, None)]
    assert found(spark, rows, 6 * HOUR) == brute(rows, 6 * HOUR)
    assert len(found(spark, rows, 6 * HOUR)) == 3


def test_nulls_ties_repetitions_and_no_rows(spark):
    t = datetime(1969, 12, 31, 23, 59, 59, 999999)
    rows = [(None, t, 1, None, 0), ("a", None, 2, None, 0), ("a", t, None, None, 0), ("a", t, 8, None, 0), ("a", t, 8, None, 0), ("a", t, 5, None, 0)]
    assert found(spark, rows, HOUR) == [("a", 5, 8, t, t, 3)]
    assert found(spark, [], HOUR) == []


@pytest.mark.parametrize("seed,gap,cells", [(1, 6 * HOUR, 36), (2, 6 * HOUR, 3), (3, 0.000010, 63), (4, 90, 5), (5, 0, 36)])
def test_against_brute_force(spark, seed, gap, cells):
    rng = random.Random(seed)
    rows = []
    for d in "abc":
        t = datetime(1969, 12, 30) + timedelta(seconds=rng.randrange(10**6))
        for _ in range(300):
            micro = round(gap * 1e6)
            t += timedelta(microseconds=rng.choice([0, 1, micro, micro + 1, max(0, micro - 1), rng.randrange(2 * micro + 2), micro // 36, micro * 70]))
            rows.append((d, t, rng.randrange(10**6), None, None))
    rng.shuffle(rows)
    assert found(spark, rows, gap, cells_per_gap=cells) == brute(rows, gap)


def test_one_entity_with_most_events(spark):
    rng = random.Random(7)
    rows = [("hot", datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(30 * 86400)), i, None, None) for i in range(3000)]
    rows += [(f"d{i}", datetime(2024, 1, 1), i, None, None) for i in range(50)]
    assert found(spark, rows, 600) == brute(rows, 600)
