import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from changeloom.llm import near_dups, suffixes
from changeloom.llm.near_dups import (AGREE, BANDS, COORDS, LONG, PERCENT, ROWS, keep_one,
                                      near_duplicates, sketch)


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
        sets[i] = grams or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    pairs = {(a, b) for ids in index.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def answer(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = answer(near_duplicates(docs))
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert any(c != i for i, (_, c) in want.items())


def test_chains_groups_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows, text = [], base
    for i in range(30):  # a chain: each a small step from the one before
        rows.append((100 - i, " ".join(text)))
        text = list(text)
        text[int(rng.integers(120))] = f"new{i}"
    rows += [(200 + i, " ".join(base)) for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "Two words"), (304, "two WORDS"),
             (305, "É two words here now"), (306, "é two words here now")]
    rows += [(400, "one " * 20000), (401, "one " * 10000)]
    got = answer(near_duplicates(spark.createDataFrame(
        [(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")))
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}
    assert got[304] == (1, 303, False) and got[300] == (0, 300, True)
    assert got[306][1] == 306  # only A-Z are lower-cased


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(None, text), (7, text), (7, text), (None, "lone text of a few words more")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [
        ("7", 46, "7", True), ("7", 46, "7", True), ("None", 3, "None", True),
        ("None", 46, "7", False)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice([f"w{i}" for i in range(500)], n))


def test_one_row_of_each_group_stays_with_null_and_shared_ids(spark):
    one, two, three, four = (prose(80, seed) for seed in range(4))
    rows = [(7, one, "a"), (None, one, "a"), (None, one + " more", "b"),  # null beside named
            (None, two, "y"), (None, two, "x"), (None, two + " more", "z"),  # null only
            (20, three, "a"), (20, four, "a"), (3, four + " more", "a"),  # shared, one a copy
            (30, None, "a"), (30, None, "b"), (31, "", "a"), (None, " ", "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    lone = [r for r in got if r[0] is None and (r[1] or "").strip()]
    assert len(lone) == 1 and lone[0] in [(None, two, "x"), (None, two + " more", "z")]
    assert sorted(map(str, got)) == sorted(map(str, lone + [
        (7, one, "a"), (20, three, "a"), (3, four + " more", "a"), (30, None, "a"),
        (31, "", "a"), (None, " ", "a"), (None, "", "a")]))
    left = {r.text for r in suffixes.without_repeats(kept, chars="").collect()}
    assert {one, three, four + " more", lone[0][1]} <= left


def test_each_row_goes_by_its_own_text(spark):
    one, two = prose(80, 5), prose(80, 6)
    rows = [(9, one), (9, two), (4, two + " more"), (None, one), (1 << 62, one)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in got) == [
        ("4", 77, 4, True), (str(1 << 62), 76, 9, False), ("9", 76, 4, False),
        ("9", 76, 9, True), ("None", 76, 9, False)]


def test_empty_table(spark):
    frame = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert frame.collect() == []


@pytest.mark.parametrize("block", [5, 4096])
def test_buckets_in_many_components_are_compared_across(spark, block):
    rng = np.random.default_rng(5)
    core = [f"c{i}" for i in range(70)]
    rows = [(i, " ".join(core + [f"x{i // 2}y{k}" for k in range(20)]
                         + [f"z{i}"])) for i in range(24)]
    rows = [rows[i] for i in rng.permutation(24)]
    got = answer(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"),
                                 block=block))
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}


def test_sketch_filter_misses_far_fewer_pairs_than_the_bands():
    alike = PERCENT / 100
    byte = alike + (1 - alike) / 256  # of two coordinates' low bytes
    bands = (1 - alike ** ROWS) ** BANDS
    for n, least in zip((COORDS, LONG), AGREE):
        missed = sum(math.comb(n, k) * byte ** k * (1 - byte) ** (n - k) for k in range(least))
        assert missed < bands / 10


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 62, 600).astype(np.uint64)
    own = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    alike = (sketch(both) == sketch(np.concatenate([both, own]))).mean()
    assert 0.6 < alike < 0.9
    one = sketch(both[:1])
    assert len(np.unique(one)) > 100 and one.max() < np.iinfo(np.uint64).max


@pytest.mark.parametrize("block", [64, 4096])
def test_pairs_of_a_large_group_are_in_proportion_to_its_members(spark, monkeypatch, block):
    """Copies of one text, about 0.65 to 0.8 alike: far fewer pairs are checked than there are."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 2, 3])):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    checked = []
    verified = near_dups.verified

    def counted(pairs, sets, percent):
        checked.append(pairs.count())
        return verified(pairs, sets, percent)
    monkeypatch.setattr(near_dups, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = answer(near_duplicates(docs, block=block))
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}
    # of 79,800; a set has so many first ranks in each pair of blocks
    assert sum(checked) < (40 if block == 4096 else 60) * len(rows)
