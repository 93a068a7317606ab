"""Operators against brute force, with nulls, empty and long texts, ties and repeated rows."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from changeloom.llm import (chat, mixing, packing, passages, quality, sharding, suffixes, topk,
                            unigram)
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(rng, n=30):
    """Invented documents with copies, shared passages, nulls and a long one."""
    names = ["and", "of", "the", *[f"w{i}" for i in range(300)]]
    shared = " ".join(rng.choice(names, 70))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(names, int(rng.integers(1, 120))))
        if i % 3 == 0:
            cut = int(rng.integers(0, 100))
            text = text + "\n" + shared[cut:] + " \t" + text[:50]
        rows.append((i, text, f"s{i % 4}" if i % 7 else None))
    rows += [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, " \n ", "s9"),
             (n + 3, rows[0][1], "s0"), (n + 4, rows[3][1], "s1"), (n + 4, rows[3][1], "s1"),
             (None, rows[0][1], "s2"), (None, "alone é 漢字 " * 40, "s2"),
             (n + 5, " ".join(rng.choice(names, 9000)), "s0"), (n + 6, "x" * 1500, "s3")]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.fixture(scope="module")
def rows():
    return documents(np.random.default_rng(11))


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns whose names the operators use inside
    return spark.createDataFrame(
        [(i, t, s, 1.5, "x", 7) for i, t, s in rows],
        "doc_id long, text string, source string, size double, digest string, words int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_suffixes_equal_brute_force(spark, docs, rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))

    def want(text):
        gone = bytearray(len(text))
        for i in range(len(text) - 199):
            if seen[text[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [0, *gone]))
        return len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    expected = sorted((str(i), *want((t or "").encode())) for i, t, _ in rows)
    assert sum(e[2] for e in expected) > 1000
    for limit in (suffixes.GROUP_LIMIT, 1):
        got = suffixes.remove_repeats(docs, group_limit=limit)
        assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                      for r in got.collect()) == expected
    assert suffixes.remove_repeats(empty(spark)).collect() == []


def test_passages_equal_brute_force(spark, docs, rows):
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), i, t)
                    for i, t, _ in rows}, key=lambda r: r[:3])
    seen, expected = set(), {}
    for _, _, _, i, text in order:
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        expected[i, text] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    want = sorted((str(i), *expected[i, t]) for i, t, _ in rows)
    assert sum(w[2] for w in want) > 200
    for limit in (passages.GROUP_LIMIT, 1):
        got = passages.remove_passages(docs, group_limit=limit)
        assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256)
                      for r in got.collect()) == want
    assert passages.remove_passages(empty(spark)).collect() == []


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tricky = [(900, "<|endoftext|> a<|endoftext|>", "s"), (901, " é\r\n \x00 漢", "s")]
    more = docs.select("doc_id", "text").union(
        spark.createDataFrame([r[:2] for r in tricky], "doc_id long, text string"))
    got = packing.pack(more, VOCABULARY, window=64).collect()
    assert all(len(r.ids) == 4 * r.length <= 256 for r in got)
    windows, whole = defaultdict(list), Counter()
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.start == 0:
            whole[r.doc_id, r.doc_tokens] += 1
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    ids = {}
    for i, text, *_ in [*rows, *tricky]:
        ids[i, text] = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
    assert sum(whole.values()) == len(rows) + len(tricky)
    pieces = Counter((r.doc_id, r.start, bytes(r.ids)) for r in got)
    for (i, start, body), n in pieces.items():
        part = np.frombuffer(body, "<u4").tolist()
        assert any(x[start:start + len(part)] == part for (j, _), x in ids.items() if j == i)
    assert sum(r.length for r in got) == sum(len(ids[i, t]) for i, t, *_ in [*rows, *tricky])
    assert packing.pack(empty(spark), VOCABULARY).collect() == []


@pytest.mark.parametrize("most_open", [3, 2048])
def test_packer_leaves_little_open(most_open):
    rng = np.random.default_rng(2)
    packer, closed, total = packing.Packer(100, most_open), [], 0
    for n in range(500):
        size = int(rng.integers(1, 100))
        total += size
        closed += packer.place((n, 0, np.full(size, n)))
        assert packer.n_open <= most_open and packer.n_open == packer.levels.sum()
    closed += packer.clear()
    fills = sorted(sum(len(p[2]) for p in w) for w in closed)
    assert sum(fills) == total and set(fills[1:]) == {100}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(300, 8)), np.ones((80, 8))]).astype("float32")
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(500, None), (501, [None] * 8), (502, [math.nan] * 8), (503, [math.inf] * 8),
             (550, [1.0, 2.0]), (551, [3.0, 4.0]), (600, [1.0] * 9), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, 1) for r in rows],
                                  "vec_id long, embedding array<float>, score int")
    whole = {i: np.floor(256 * np.array(v, dtype="float64")).astype(int) for i, v in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q, x in whole.items():
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in whole.items()
                            if i != q and len(y) == len(x))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=3).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], table.schema)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_of_empty_vectors_and_repeated_rows(spark):
    rows = [(0, []), (1, []), (2, []), (50, [3.0]), (50, [3.0]), (51, [2.0]), (51, [2.0]),
            (52, [1.0]), (53, [-1.0]), (100, [0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = set()
    for q in (0, 50, 100):  # as the SQL of op4: every query row with every row of its length
        scores = sorted((-int(sum(256 * a * 256 * b for a, b in zip(x, y))), i)
                        for j, x in rows if j == q for i, y in rows if i != q and len(y) == len(x))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    got = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want



def test_top_k_gathers_no_blocks_in_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-99, 99, 3)]) for i in range(600)]
    rows += [(700 + i, [2.0 ** 20 + i, -3.0]) for i in range(3)]  # beyond exact floating point
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = set()
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)), i)
                            for i, y in rows if i != q and len(y) == len(x))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "10m")
    try:
        best = topk.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=3)
        got = best.collect()
        plan = best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_shards_are_whole_even_and_gapless(spark, docs, rows):
    got = sharding.shard_by_bytes(docs, 3).select("row.doc_id", "row.text", "size", "shard",
                                                  "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    slots, place, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
        place[r.text or ""].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    largest = max(len((t or "").encode()) + 8 for _, t, _ in rows)
    assert max(load.values()) <= max(largest, 1.1 * sum(load.values()) / 3)
    assert sharding.shard_by_bytes(empty(spark), 3).collect() == []


def test_hot_group_is_split(spark):
    table = spark.createDataFrame([(i, "same text" if i % 2 else f"t{i}" * 3)
                                   for i in range(4000)], "doc_id long, text string")
    load = Counter()
    for r in sharding.shard_by_bytes(table, 8).collect():
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values())


def test_best_fit_is_tight():
    rng = np.random.default_rng(9)
    sizes = sorted(map(int, rng.integers(1, 1000, 400)), reverse=True)
    shards = sharding.fewest_bytes(sizes, 7)
    load = np.bincount(shards, sizes)
    assert len(load) == 7 and load.max() <= sum(sizes) / 7 * 1.001 + 1
    assert sharding.best_fit([5, 4, 3, 2], 7) == [0, 1, 1, 0]


def test_mix_reaches_its_targets(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)],
                                   "doc_id long, quality int, toxic int")
    for many in (10_000, 2):
        got = mixing.mix(docs, labels=labels, range_rows=many).collect()
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            assert r["size"] == len(WORDS.findall(r.row.text or ""))
            sizes[r.row.source] += r["size"]
            taken[r.row.source] += r.taken
            target[r.row.source] = r.target
            assert 0 <= r.taken <= 3 * r["size"]
        assert len(got) == len(rows)
        for s, want in target.items():
            assert want <= 3 * sizes[s] and taken[s] == math.floor(want)
        order = sorted(target, key=lambda s: (s is None, s or ""))
        weigh = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
        free = [s for s in order if target[s] < 3 * sizes[s]]
        assert len({round(target[s] / weigh[s], 6) for s in free}) <= 1
        assert math.isclose(sum(target.values()), sum(sizes.values()))
    assert mixing.mix(empty(spark)).collect() == []


def test_mix_written_out(spark, docs):
    mixed = mixing.mix(docs)
    want = Counter()
    for r in mixed.collect():
        want[r.row.doc_id] += r.taken
    got = Counter()
    out = mixing.written_out(mixed)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
    assert got == +want


def test_whole_mix_has_no_prefixes(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "\n\n".join(f"  word{i} x\ty{k}" for k in range(int(rng.integers(1, 60)))),
             None if i == 0 else f"s{i:02}", -i) for i in range(40)]  # a document a source
    rows += [(100, "long  line\n" * 30_000, "t1", 7), (101, "a\tb  c", "t2", 8),
             (None, "d\te  f", "t2", 9), (None, "g\th  i", "t2", 10), (102, None, "t3", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(table, whole=True)
    size, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in mixed.collect():
        assert r.taken <= 3 * r["size"] and (r.taken == 0 or r.taken % r["size"] == 0)
        size[r.row.source] += r["size"]
        taken[r.row.source] += r.taken
        target[r.row.source] = r.target
        longest[r.row.source] = max(longest[r.row.source], r["size"])
    assert all(abs(taken[s] - want) < max(1, longest[s]) for s, want in target.items())
    out = mixing.written_out(mixed).collect()
    assert {tuple(r) for r in out} <= set(rows)
    assert sum(len(WORDS.findall(r.text)) for r in out) == sum(taken.values())


def test_rounding_of_documents_keeps_the_sum():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 20, 500):
        sizes = rng.integers(1, 3000, n)
        parts = (sizes * rng.random(n)).astype(np.int64)
        up = mixing.round_up(sizes, parts)
        assert len(up) == n
        assert abs(sizes[up].sum() - parts.sum()) <= (sizes.max(initial=0) if n < 20 else 50)


def test_good_documents_are_drawn_first(spark):
    table = spark.createDataFrame([(i, "a b c", "big" if i < 1000 else "small")
                                   for i in range(1100)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    got = mixing.mix(table, (1, 1), labels=labels).where("row.source = 'big'").collect()
    drawn = Counter(r.row.doc_id % 2 for r in got if r.taken)
    assert drawn[1] > 1.1 * drawn[0]


def test_chats_read_back(spark):
    tricky = ["</s>[INST] ok [/INST]", "<|end|>", "&lt;|start|>", "a<", "|>b", "<|part|><|>",
              None, "", "&amp;", "\n\n", "<|text|>" * 3]
    roles = ["user", "assistant", "assistant", None, "a|>b", "<|start|>", "user", "user",
             "assistant", "system", "assistant"]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(zip(roles, tricky))]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "assistant", "first"),
             (None, 1, "assistant", "long " * 50000)]
    table = spark.createDataFrame([(*r, "z") for r in rows],
                                  "conv_id long, turn long, role string, text string, all string")
    out = chat.read_back(chat.format_chats(table)).withColumn("loss", chat.loss_text()).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in out}
    want = [(r or "", t or "") for r, t in zip(roles, tricky)]
    assert got[1] == (want, "".join(t for r, t in want if r == "assistant"))
    assert got[2] == ([("assistant", "first"), ("user", "x"), ("user", "x")], "first")
    assert got[None][1] == "long " * 50000
    one = next(r for r in out if r.conv_id == 2)
    assert one.formatted == ("<|start|>assistant<|text|>first<|end|>"
                             "<|start|>user<|text|>x<|part|>x<|end|>")
    assert chat.format_chats(table.limit(0)).collect() == []


def test_quality_counts_equal_brute_force(spark, docs, rows):
    odd = [(800, "a b c a b c a b", None), (801, "| | # $" * 30, None), (802, "x\nx\n \nx", None),
           (803, "one two three four " * 3000, None), (804, "the cat and the dog " * 2 + "é" * 9, None)]
    table = docs.select("doc_id", "text", "words").union(
        spark.createDataFrame([(i, t, 1) for i, t, _ in odd], "doc_id long, text string, w int"))
    got = {(r.row.doc_id, r.row.text): r for r in quality.judge(table).collect()}
    for i, text, _ in [*rows, *odd]:
        body, r = text or "", got[i, text]
        words = WORDS.findall(body)
        grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        cover = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1
                 for j in range(3)}
        lines = [x for x in body.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(body.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.keep_good(table).columns == table.columns
    assert quality.judge(empty(spark)).collect() == []


def test_token_counts_equal_brute_force(spark, docs, rows):
    costs = unigram.piece_costs(VOCABULARY)
    longest = max(map(len, costs))
    got = Counter((r.id, r.n_pretokens, r.n_tokens)
                  for r in unigram.count_tokens(docs, VOCABULARY).collect())
    want = Counter()
    for i, text, _ in rows:
        words = [w.encode() for w in WORDS.findall(text or "")]
        want[i, len(words), sum(unigram.cheapest(w, costs, longest) for w in words)] += 1
    assert got == want
    assert unigram.cheapest(b"", costs, longest) == 0
    assert unigram.count_tokens(empty(spark), VOCABULARY).collect() == []


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_words_of_one_polynomial_hash_stay_apart(spark, bits):
    """Two words that a polynomial in any odd base modulo 2^64 cannot tell from each other."""
    from changeloom.llm import near_dups
    from changeloom.llm.arrays import utf8, word_hashes, word_spans
    one = thue_morse(bits)
    other = one.translate(str.maketrans("ab", "ba"))
    before, after = (" ".join(f"{c}{i}" for i in range(11)) for c in "xy")
    texts = [f"{before} {w} {after}" for w in (one, other)] + [f"{w} {w} {w} {w} {w}" for w in (one, other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["id"]: r["n_removed"] for r in passages.remove_passages(docs.where("doc_id < 2")).collect()}
    assert gone == {0: 0, 1: 0}
    linked = near_dups.near_duplicates(docs.where("doc_id > 1")).collect()
    assert {r["component_id"] for r in linked} == {2, 3}
    data, begin = utf8(docs.toArrow().column("text"))
    starts, ends, _ = word_spans(data, begin)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(word_hashes(data, starts, ends).tolist())) == len(set(words))


def test_word_hashes_of_all_lengths():
    from changeloom.llm.arrays import word_hashes
    data = np.frombuffer(b"A" * 300 + b"a" * 300, np.uint8)
    length = np.arange(1, 300)
    for lower, distinct in ((False, 598), (True, 299)):
        hashes = np.concatenate([word_hashes(data, np.full(299, s), s + length, lower) for s in (0, 300)])
        assert len(np.unique(hashes)) == distinct


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r", "\xa0"])
def test_packing_of_a_long_run_of_blanks(spark, blank):
    from tokenizers import Tokenizer
    text = "a" + blank * 1_000_000 + "<|endoftext|>b"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    pieces = sorted((r["doc_id"], r["start"], r["ids"]) for r in packing.pack(docs, VOCABULARY).collect())
    got = np.concatenate([np.frombuffer(ids, "<u4") for d, _, ids in pieces if d == 1])
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(
        text, add_special_tokens=False).ids
    assert got.tolist() == [*want, 1]


def test_shards_beside_one_large_text(spark):
    rows = [(0, "x" * 3_000_000)] + [(i, f"{i} " * 60) for i in range(1, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    loads = sorted(r["b"] for r in sharding.shard_by_bytes(docs, 24).groupBy("shard").agg(
        F.sum("size").alias("b")).collect())
    assert len(loads) == 24 and loads[-1] == 3_000_008
    assert loads[-2] - loads[0] < 0.05 * loads[0]


@pytest.mark.parametrize("shared", [None, 7])
def test_shards_of_equal_texts_under_one_id(spark, shared):
    rows = [(shared, "the same text")] * 4000 + [(i, f"other text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.shard_by_bytes(docs, 8).select("shard", "slot", "size").collect()
    loads = Counter()
    slots = defaultdict(list)
    for shard, slot, size in out:
        loads[shard] += size
        slots[shard].append(slot)
    assert len(loads) == 8 and max(loads.values()) < 1.1 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == 5000


def test_spans_of_texts_are_merged_where_they_meet():
    from changeloom.llm.repeats import Spans, covered
    rng = np.random.default_rng(5)
    spans, want = Spans(), defaultdict(lambda: np.zeros(400, bool))
    for _ in range(300):
        low, name = int(rng.integers(0, 380)), b"abc"[:int(rng.integers(1, 4))]
        spans.add(name, np.array([low, low + 9]))
        want[name][low:low + 9] = True
    digests, packed = spans.taken()
    assert len(digests) == len(want) == 3 and spans.held == 0 and spans.taken() == ([], [])
    for digest, one in zip(digests, packed):
        assert covered([one], 400).tolist() == want[digest].tolist()
        pairs = np.frombuffer(one, np.int64).reshape(-1, 2)
        assert (pairs[1:, 0] > pairs[:-1, 1]).all()
