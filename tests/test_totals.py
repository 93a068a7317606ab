"""Aggregates that run on over batches, against a plain fold in Python."""
import datetime as dt
import random
from collections import Counter

import pytest

from changeloom.streaming.totals import ChangingTotals, RunningOver

SCHEMA = "k string, ums_id_ long, ums_ts_ timestamp, v long, w string"
START = dt.datetime(2024, 1, 1)
AGGS = {"n": ("count", ""), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "w"),
        "a": ("avg", "v"), "f": ("first", "w"), "l": ("last", "v")}


def batches(seed=3, n=60, parts=2):
    """Mostly one key, some null keys and values, times out of order within and over batches."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i,
             START + dt.timedelta(seconds=5 * i + rng.randrange(-20, 20)),
             rng.choice([None, rng.randrange(50)]), rng.choice([None, "x", "yy", "z"]))
            for i in range(n)]
    return [rows[i * n // parts:(i + 1) * n // parts] for i in range(parts)]


def folded(rows):
    v = [r[3] for r in rows if r[3] is not None]
    w = [r[4] for r in rows if r[4] is not None]
    return (len(rows), sum(v) if v else None, min(v, default=None), max(w, default=None),
            sum(v) / len(v) if v else None, rows[0][4], rows[-1][3])


def order(row):
    return row[2], row[1]


@pytest.mark.parametrize("block_rows", [7, 1_000_000])
def test_changing_totals(spark, tmp_path, block_rows):
    first = spark.createDataFrame(batches()[0], SCHEMA)
    totals = ChangingTotals(first, str(tmp_path / "t"), ["k"], AGGS, buckets=3,
                            block_rows=block_rows)
    history = {}
    for number, rows in enumerate(batches()):
        want = Counter()
        for row in sorted(rows, key=order):
            seen = history.setdefault(row[0], [])
            if seen:
                want[(row[0], *folded(seen), False)] += 1
            seen.append(row)
            want[(row[0], *folded(seen), True)] += 1
        frame = spark.createDataFrame(rows, SCHEMA)
        # the second batch is given twice, as after a failure
        for _ in range(2 if number == 1 else 1):
            got = totals(frame, number)
            assert got.columns == totals.schema.names
            assert Counter(map(tuple, got.collect())) == want
    empty = totals(spark.createDataFrame([], SCHEMA), 2)
    assert empty.count() == 0


@pytest.mark.parametrize("preceding,block_rows", [(None, 7), (0, 1_000_000), (2, 7)])
def test_running_over(spark, tmp_path, preceding, block_rows):
    first = spark.createDataFrame([], SCHEMA)
    over = RunningOver(first, str(tmp_path / "o"), ["k"], AGGS, preceding, lateness=60,
                       buckets=3, block_rows=block_rows)
    got = Counter()
    last = [("z", 1000, START + dt.timedelta(days=1), 1, "x")]
    for number, rows in enumerate([*batches(), last]):
        frame = spark.createDataFrame(rows, SCHEMA)
        if number == 1:
            over(frame, number)
        got += Counter(map(tuple, over(frame, number).collect()))
    want, history = Counter(), {}
    for row in sorted(sum(batches(), []), key=order):
        seen = history.setdefault(row[0], [])
        seen.append(row)
        want[(*row, *folded(seen if preceding is None else seen[-preceding - 1:]))] += 1
    assert got == want


@pytest.mark.parametrize("preceding", [None, 5])
def test_running_over_late_timeless_and_idle_rows(spark, tmp_path, preceding):
    def at(hours):
        return START + dt.timedelta(hours=hours)
    given = [[("a", 1, at(0), 1, None), ("a", 2, at(1), 2, None), ("t", 3, None, 5, None)],
             [("a", 4, at(0.5), 9, None), ("b", 5, at(2), 7, None)],       # 4 is late
             [("b", 6, at(30), 1, None)],              # the watermark is 28 hours past row 5
             [("a", 7, at(31), 4, None), ("t", 8, None, 6, None), ("b", 9, at(40), 1, None)],
             [("b", 10, at(41), 1, None)]]
    over = RunningOver(spark.createDataFrame([], SCHEMA), str(tmp_path / "o"), ["k"],
                       {"s": ("sum", "v")}, preceding, idle_hours=24, buckets=2)
    got = {}
    for number, rows in enumerate(given):
        for r in over(spark.createDataFrame(rows, SCHEMA), number).collect():
            got[r["ums_id_"]] = r["s"]
    # the newest row waits for the watermark; a is forgotten before row 7, b before row 6
    assert got == {1: 1, 2: 3, 3: 5, 5: 7, 6: 1, 7: 4, 8: 11, 9: 2}
