"""Substring dedup over words: fixed blocks as anchors of exact repeats.

Candidates come from :mod:`changeloom.llm.repeats`.  In each group the pieces lie in order
of document and place.  Their non-overlapping blocks of ``BLOCK`` words are the index; every
rolling window of ``BLOCK`` words probes it.  A window of ``WIDTH`` words always holds a
whole block of the piece it repeats, so windows around a hit are the only ones that can be
repeats.  Hits grow to maximal runs: a window belongs to a run if its whole word sequence
came before, in an earlier document or earlier in its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import (mix, table, utf8, window_hashes, word_hashes, word_spans)
from changeloom.llm.repeats import GROUP_LIMIT, covered, distinct_texts, repeated_spans

WIDTH, GRAM, BLOCK = 20, 5, 10


def words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_spans(data, begin)
    return word_hashes(data, starts, ends), bounds


def later_windows(groups: np.ndarray, pieces: pa.Array, place: np.ndarray) -> list[np.ndarray]:
    """For each piece (in order of document and place) its windows that came before."""
    raw, begin = utf8(pieces)
    symbols, begin = np.frombuffer(raw.tobytes(), np.uint64), begin // 8
    count = place >> 8 & 255
    owner = np.repeat(np.arange(len(place)), np.diff(begin))
    within = np.arange(len(symbols)) - begin[owner]
    # blocks and windows are only compared inside their group
    group = mix(groups.view(np.uint64))[owner]
    blocks = window_hashes(symbols, BLOCK) ^ group
    whole = within + BLOCK <= np.diff(begin)[owner]
    index, times = np.unique(blocks[whole & (within % BLOCK == 0)], return_counts=True)
    if not len(index):
        return [np.zeros(c, bool) for c in count.tolist()]
    spot = np.minimum(np.searchsorted(index, blocks), len(index) - 1)
    hit = whole & (index[spot] == blocks)
    # a block finds itself; only a second place makes it an anchor
    rolling = np.bincount(spot[hit], minlength=len(index))
    hit &= rolling[spot] > 1
    near = np.concatenate(([0], np.cumsum(hit)))
    windows = np.flatnonzero(within < count[owner])
    some = near[windows + WIDTH - BLOCK + 1] > near[windows]
    windows = windows[some]
    full = (window_hashes(symbols, WIDTH) ^ group)[windows]
    late = np.ones(len(windows), dtype=bool)
    late[np.unique(full, return_index=True)[1]] = False
    marks = np.zeros(len(symbols), dtype=bool)
    marks[windows] = late
    return [marks[b:b + c] for b, c in zip(begin[:-1].tolist(), count.tolist())]


_RESULT = pa.schema([("digest", pa.binary()), ("first_id", pa.int64()), ("n_words", pa.int64()),
                     ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                     ("kept", pa.string())])


def _taken_out(with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = utf8(batch.column("text")), batch.column("spans").to_pylist()
            data, begin = texts
            rows = []
            for i, (digest, first) in enumerate(zip(batch.column("digest").to_pylist(),
                                                    batch.column("id").to_pylist())):
                # bytes.split() splits at the same six bytes as the word pattern
                all_words = data[begin[i]:begin[i + 1]].tobytes().split()
                left = all_words
                if spans[i]:
                    gone = covered(spans[i], len(all_words))
                    left = [w for w, g in zip(all_words, gone.tolist()) if not g]
                kept = b" ".join(left)
                rows.append((digest, first, len(all_words), len(all_words) - len(left),
                             hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "replace") if with_text else None))
            if rows:
                yield table(_RESULT, *zip(*rows))
    return of


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    with_text: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept``) for each row.

    A word goes if a window of ``WIDTH`` words around it came before: in a document of
    smaller id (null ids last, then by content), or earlier in its own.  Rows of equal text
    but larger id are repeats throughout; repeated rows (id and text) get one answer.  Null
    and empty texts have no words.  The key must be a long.
    """
    rows, texts = distinct_texts(docs, key, text)
    spans = repeated_spans(texts, words, WIDTH, GRAM, later_windows, True, group_limit)
    done = texts.join(spans, "digest", "left").mapInArrow(
        _taken_out(with_text), "digest binary, first_id long, n_words long, n_removed long, "
        "kept_sha256 string, kept string")
    both = rows.join(done, "digest")
    copy = ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("n_words") >= WIDTH)

    def unless_copy(name: str, instead: Column) -> Column:
        return F.when(copy, instead).otherwise(F.col(name)).alias(name)
    out = [F.col("id"), F.col("n_words"), unless_copy("n_removed", F.col("n_words")),
           unless_copy("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()))]
    return both.select(*out, *[unless_copy("kept", F.lit(""))] if with_text else [])
