"""The stages of the pipeline against what they are meant to keep."""
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from changeloom.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The documents after each stage, each written and read as the next one's input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, out[-1], sf).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5
    assert all(a.dtypes == stages[0].dtypes for a in stages[:-1])


def test_quality_rules_drop_what_they_reject(stages):
    want = {r.row.doc_id for r in quality.judge(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want
    assert 0 < len(want) < stages[0].count()


def test_one_document_of_each_group_stays(stages):
    def grams(text):
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    before = {r.doc_id: grams(r.text) for r in stages[1].collect()}
    kept = [r.doc_id for r in stages[2].collect()]
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sorted(before):
        for b in sorted(before):
            both = len(before[a] & before[b]) if a < b else 0
            if both and 100 * both >= 75 * len(before[a] | before[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(kept) == sorted({find(i) for i in before})


def test_repeated_bytes_go_from_all_texts(stages):
    texts = {r.doc_id: r.text.encode() for r in stages[2].collect()}
    seen = Counter(t[i:i + 200] for t in texts.values() for i in range(len(t) - 199))
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[3].collect()}
    for i, text in texts.items():
        gone = bytearray(len(text))
        for k in range(len(text) - 199):
            if seen[text[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(text, gone) if not g).decode("utf-8", "ignore")
        if all(gone):
            assert i not in got
        else:
            assert got[i][0] == left and got[i][1] == len(left)


def test_mix_takes_three_passes_at_most_and_hits_its_targets(stages):
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in stages[3].collect():
        sizes[r.source] += len(WORDS.findall(r.text))
    for r in stages[4].collect():
        taken[r.source] += len(WORDS.findall(r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 3 and abs(sum(taken.values()) - sum(sizes.values())) < 50
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)


def test_mix_holds_whole_texts(stages):
    whole = {(r.doc_id, r.text, r.n_chars) for r in stages[3].collect()}
    assert {(r.doc_id, r.text, r.n_chars) for r in stages[4].collect()} <= whole


def test_windows_hold_every_document_of_the_mix(stages):
    rows = Counter(r.doc_id for r in stages[4].collect())
    ends, fill = Counter(), defaultdict(int)
    for r in stages[5].collect():
        assert len(r.ids) == 4 * r.length
        fill[r.sequence_id] += r.length
        ends[r.doc_id] += np.frombuffer(r.ids, "<u4")[-1] == 1 and (
            r.start + r.length == r.doc_tokens)
    assert ends == rows and max(fill.values()) <= 2048


def odd_rows(spark):
    text = " ".join(f"the word{i} of{i} it{i}" for i in range(40))
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, None),
            (2, text, None, "s", None, "x"), (2, text, None, "s", None, "x"),
            (3, text + " and more", "en", "s", 5, "x"), (None, text, "en", "s", 5, "x"),
            (4, " ".join(f"of the thing number {i}" for i in range(4000)), "en", "t", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long, digest string")


def test_stages_take_odd_rows_and_empty_tables(spark, sf):
    for docs in (odd_rows(spark), odd_rows(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs.isEmpty() else n > 0
