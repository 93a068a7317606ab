"""Patterns against a recursive definition of a match, written independently of the matcher."""

import json
import random

import pytest
from pyspark.sql import functions as F

from changeloom.patterns import Output, OutputField, PatternSpec, Stage, match_pattern

ORDER = ["ums_ts_", "ums_id_"]


def definition(events, stages, within):
    """All matches of one key: events are (seconds, id, kind); stages (kind, letters, quantifier, n)."""
    def holds(pos, letters):
        return letters is None or events[pos][2] in letters

    positive = []
    nots = []
    for kind, letters, quantifier, n in stages:
        if kind.startswith("not"):
            nots.append((kind, letters))
        else:
            least = {"": 1, "oneormore": 1}.get(quantifier, n)
            most = least if quantifier in ("", "times") else len(events)
            positive.append((kind, letters, least, most, quantifier, nots))
            nots = []
    trailing = nots
    found = set()

    def forbidden(kind, guards, low, high):
        return any(k == kind and any(holds(p, letters) for p in range(low, high))
                   for k, letters in guards)

    def finish(taken):
        if trailing:
            nxt = taken[-1] + 1
            if nxt >= len(events) or forbidden("notnext", trailing, nxt, nxt + 1):
                return
            if within > 0 and events[nxt][0] - events[taken[0]][0] >= within:
                return
        if within > 0 and events[taken[-1]][0] - events[taken[0]][0] >= within:
            return
        found.add(tuple(taken))

    def enter(i, taken, greedy_letters):
        if i == len(positive):
            finish(taken)
            return
        kind, letters, least, most, quantifier, guards = positive[i]
        prev = taken[-1]
        if quantifier == "timesoptional":
            enter(i + 1, taken, None)
        pos = prev + 1
        if kind == "followedby":
            while pos < len(events) and not holds(pos, letters):
                pos += 1
        if pos >= len(events) or not holds(pos, letters):
            return
        if greedy_letters and any(holds(p, greedy_letters) for p in range(prev + 1, pos + 1)):
            return
        if forbidden("notnext", guards, prev + 1, prev + 2) or \
                forbidden("notfollowedby", guards, prev + 1, pos + 1):
            return
        repeat(i, [*taken, pos], 1)

    def repeat(i, taken, count):
        _, letters, least, most, quantifier, _ = positive[i]
        after = positive[i + 1][5] if i + 1 < len(positive) else []
        if count >= least:
            enter(i + 1, taken, letters if quantifier == "timesgreedy" else None)
        if count < most:
            pos = taken[-1] + 1
            while pos < len(events) and not holds(pos, letters):
                pos += 1
            open_loop = quantifier not in ("", "times")
            if pos < len(events) and not (open_loop and forbidden(
                    "notfollowedby", after, taken[-1] + 1, pos + 1)):
                repeat(i, [*taken, pos], count + 1)

    for s in range(len(events)):
        if holds(s, positive[0][1]):
            repeat(0, [s], 1)
    return {tuple(events[p][1] for p in m) for m in found}


def run(spark, events, stages, within, key_by=("k",), strategy="no_skip", **kw):
    df = spark.createDataFrame(events, "s long, ums_id_ long, kind string, k int") \
        .withColumn("ums_ts_", F.timestamp_seconds("s")).drop("s")
    spec = PatternSpec(tuple(Stage(k, None if c is None else F.col("kind").isin(*c), q, n)
                             for k, c, q, n in stages), key_by, strategy, within, Output(
        "agg", (OutputField("head", "ums_id_", "a"), OutputField("last", "ums_id_", "z"),
                OutputField("count", "", "n"), OutputField("sum", "ums_id_", "total"))))
    out = match_pattern(df, spec, ORDER, **kw)
    return sorted((*[r[k] for k in key_by], r["a"], r["z"], r["n"], r["total"])
                  for r in out.collect())


def sample(seed, n=60, keys=2):
    rng = random.Random(seed)
    second, events = 0, []
    for i in range(n):
        second += rng.choice([0, 1, 1, 2, 9])
        # powers keep the sum of ids telling
        events.append((second, i * i + 3 * i, rng.choice("abcdx"), rng.randrange(keys)))
    return events


def expected(events, stages, within):
    out = []
    for key in {e[3] for e in events}:
        mine = sorted(e[:3] for e in events if e[3] == key)
        out += [(key, m[0], m[-1], len(m), sum(m)) for m in definition(mine, stages, within)]
    return sorted(out)


SHAPES = {
    "strict": [("begin", "a", "", 1), ("next", "ab", "", 1)],
    "relaxed": [("begin", "a", "", 1), ("followedby", "b", "", 1), ("followedby", "c", "", 1)],
    "mixed": [("begin", "ab", "", 1), ("followedby", "bc", "", 1), ("next", "cd", "", 1)],
    "not_next": [("begin", "a", "", 1), ("notnext", "b", "", 1), ("followedby", "c", "", 1)],
    "not_next_last": [("begin", "a", "", 1), ("followedby", "b", "", 1), ("notnext", "c", "", 1)],
    "not_between": [("begin", "a", "", 1), ("notfollowedby", "d", "", 1), ("followedby", "c", "", 1)],
    "times": [("begin", "ab", "times", 2), ("followedby", "c", "times", 2)],
    "times_next": [("begin", "a", "", 1), ("next", "bc", "times", 2)],
    "any": [("begin", None, "", 1), ("next", None, "", 1)],
    "one_or_more": [("begin", "a", "oneormore", 1), ("followedby", "b", "", 1)],
    "one_or_more_next": [("begin", "a", "", 1), ("followedby", "ab", "oneormore", 1), ("next", "c", "", 1)],
    "times_or_more": [("begin", "c", "", 1), ("followedby", "ab", "timesormore", 2), ("followedby", "d", "", 1)],
    "greedy": [("begin", "c", "", 1), ("followedby", "ab", "timesgreedy", 2), ("followedby", "bd", "", 1)],
    "optional": [("begin", "c", "", 1), ("followedby", "a", "timesoptional", 2), ("followedby", "b", "", 1)],
    "optional_last": [("begin", "c", "", 1), ("followedby", "a", "timesoptional", 1)],
    "loop_then_not": [("begin", "a", "oneormore", 1), ("notfollowedby", "d", "", 1), ("followedby", "b", "", 1)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("within", [-1, 14])
def test_against_definition(spark, shape, within):
    stages = SHAPES[shape]
    events = sample(len(shape) * 7, n=40 if within < 0 else 70)
    assert run(spark, events, stages, within) == expected(events, stages, within)


@pytest.mark.parametrize("shape", ["strict", "mixed", "not_next_last", "not_between",
                                   "one_or_more_next", "greedy"])
def test_split_keys_give_the_same(spark, shape):
    stages = SHAPES[shape]
    events = sample(11, n=120, keys=1)
    assert run(spark, events, stages, 14, block_rows=10) == expected(events, stages, 14)


def test_split_adjacent_without_bound(spark):
    events = sample(4, n=150, keys=1)
    assert run(spark, events, SHAPES["strict"], -1, block_rows=6) == \
        expected(events, SHAPES["strict"], -1)


@pytest.mark.parametrize("shape", ["relaxed", "mixed", "not_next", "not_between", "times_next"])
def test_split_keys_without_bound(spark, shape):
    events = sample(21, n=90, keys=1) + [(s, i + 100_000, c, 1) for s, i, c, _ in sample(5, n=8)]
    assert run(spark, events, SHAPES[shape], -1, block_rows=13) == \
        expected(events, SHAPES[shape], -1)


def test_skip_strategies(spark):
    events = [(i, i, "a", 0) for i in range(1, 8)]
    pairs = [("begin", "a", "times", 2)]
    all_pairs = run(spark, events, pairs, -1)
    assert [r[1:3] for r in all_pairs] == [(i, i + 1) for i in range(1, 7)]
    past = run(spark, events, pairs, -1, strategy="skip_past_last_event")
    assert [r[1:3] for r in past] == [(1, 2), (3, 4), (5, 6)]
    assert run(spark, events, pairs, -1, strategy="skip_to_first") == all_pairs
    assert run(spark, events, pairs, -1, strategy="skip_to_last") == all_pairs
    triples = [("begin", "a", "times", 3)]
    last = run(spark, events, triples, -1, strategy="skip_to_last")
    assert [r[1:3] for r in last] == [(1, 3), (3, 5), (5, 7)]
    grow = [("begin", "a", "oneormore", 1)]
    assert [r[1:3] for r in run(spark, events, grow, -1, strategy="skip_past_last_event")] == \
        [(i, i) for i in range(1, 8)]


def test_timeouts(spark):
    events = [(0, 1, "a", 0), (3, 2, "b", 0), (4, 3, "a", 0), (30, 4, "b", 0), (31, 5, "a", 0)]
    df = spark.createDataFrame(events, "s long, ums_id_ long, kind string, k int") \
        .withColumn("ums_ts_", F.timestamp_seconds("s"))
    spec = PatternSpec((Stage("begin", "kind = 'a'"), Stage("followedby", "kind = 'b'")), ("k",),
                       within_seconds=10, output=Output("timeout"))
    assert sorted(r["ums_id_"] for r in match_pattern(df, spec, ORDER).collect()) == [3, 5]


def test_refused():
    with pytest.raises(ValueError):
        PatternSpec((Stage("next"),))
    with pytest.raises(ValueError):
        PatternSpec((Stage("begin"), Stage("notfollowedby")))
    with pytest.raises(ValueError):
        Stage("notnext", None, "oneormore")
    with pytest.raises(ValueError):
        Output("agg", (OutputField("max", "a"), OutputField("min", "a")))
    with pytest.raises(ValueError):
        PatternSpec.from_json(json.dumps({"pattern_seq": [{"pattern_type": "begin"}],
                                          "strategy": "whatever"}))


@pytest.mark.parametrize("strategy", ["skip_past_last_event", "skip_to_first", "skip_to_last"])
@pytest.mark.parametrize("shape", ["times", "relaxed", "mixed"])
def test_skip_strategies_in_blocks(spark, strategy, shape):
    """One key in blocks of seven, against a walk over all matches in order."""
    events, stages = sample(31, n=70, keys=1), SHAPES[shape]
    mine = sorted(e[:3] for e in events)
    times = {e[1]: e[:2] for e in mine}
    want, point = [], None
    for m in sorted(definition(mine, stages, -1), key=lambda m: times[m[0]]):
        taken = [times[i] for i in m]
        if point is not None and (taken[0] <= point if strategy == "skip_past_last_event"
                                  else taken[0] < point):
            continue
        want.append((0, m[0], m[-1], len(m), sum(m)))
        resume = {"skip_past_last_event": taken[-1], "skip_to_first": taken[0],
                  "skip_to_last": taken[1 if shape == "times" else 0]}[strategy]
        point = resume if point is None else max(point, resume)
    assert run(spark, events, stages, -1, strategy=strategy, block_rows=7) == sorted(want)
