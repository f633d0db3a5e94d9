import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from fotoloom.llm.runs import collapse_runs

SCHEMA = "device string, at timestamp_ntz, id int, v array<float>, block int, seq string, entity int"  # with clashing names


def brute(rows, gap, similarity):
    by, out = {}, []
    for d, t, i, v, *_ in rows:
        if d is not None and t is not None and i is not None:
            by.setdefault(d, []).append((t, i, v))
    usable = lambda v: v is not None and len(v) == 2 and None not in v and any(v)
    for d, line in by.items():
        line.sort(key=lambda x: x[:2])
        run = []
        for x in [*line, None]:
            ok = x is not None and run and usable(x[2]) and usable(run[-1][2]) and x[0] - run[-1][0] <= timedelta(seconds=gap)
            if ok:
                a, b = np.float64(x[2]), np.float64(run[-1][2])
                ok = a @ b >= similarity * np.sqrt((a @ a) * (b @ b))
            if not ok:
                if len(run) > 1:
                    out.append((d, run[0][1], run[-1][1], len(run)))
                run = []
            run.append(x)
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for d in ("a", "b", "c"):
        t = datetime(2024, 3, 31, 1)
        for _ in range(150 if d == "a" else 20):
            t += timedelta(seconds=rng.choice([0, 1, 15, 15.000001, 40]))
            v = rng.choice([[1.0, 0.0], [1.0, 0.0], [1.0, 0.1], [0.0, 2.0], None, [], [0.0, 0.0], [1.0], [1.0, None]] if rng.random() < 0.3 else [[1.0, 0.0], [2.0, 0.1]])
            rows.append((d, t, rng.randrange(10**6), v, 1, "x", 2))
    rows += [(None, t, 1, [1.0, 0.0], 1, "x", 2), ("a", None, 2, [1.0, 0.0], 1, "x", 2), ("a", t, None, [1.0, 0.0], 1, "x", 2), rows[5], rows[5]]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay as small as asked for
    try:
        got = collapse_runs(spark.createDataFrame(rows, SCHEMA), "device", "at", "id", "v", 15, 0.92, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sorted((r.entity, r.first_id, r.last_id, r.events) for r in got) == brute(rows, 15, 0.92)
    assert all(r.seconds == (r.last_t - r.first_t) / 1e6 for r in got)


def test_one_run_through_every_range_and_no_rows(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + timedelta(seconds=k), k, [1.0, 0.0], 1, "x", 2) for k in range(500)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = collapse_runs(df, "device", "at", "id", "v", 15, 0.92, 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [(r.entity, r.first_id, r.last_id, r.events, r.seconds) for r in got] == [("a", 0, 499, 500, 499.0)]
    assert collapse_runs(df.limit(0), "device", "at", "id", "v", 15, 0.92, 2).count() == 0
