"""Byte-level dedup by column-wise construction of suffix order and common prefixes.

The pieces of one or many anchors are a collection of short strings, lined up at their
anchors.  Columns go from right to left; each round puts one more byte before every string,
a stable sort by that byte turns the order of the suffixes of one column into that of the
next (the collection's Burrows-Wheeler step), and the common prefix of two neighbours is one
more than the least between them in the old order.  A window whose suffix shares ``WIDTH``
bytes with a neighbour is repeated.  Equal windows lie in the same column, as their anchors
are equal, so columns need no merging, and there are 368 rounds however long a text is; over
whole texts there would be as many rounds as the longest text has bytes, each a pass over
all files.  The external files are those of Spark's shuffle, read in order of the anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import table, utf8
from changeloom.llm.repeats import GROUP_LIMIT, covered, distinct_texts, repeated_spans

WIDTH, GRAM = 200, 32


def raw_bytes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, begin


def column_order(columns: np.ndarray, width: int, starts: int) -> np.ndarray:
    """For the first ``starts`` columns: whose ``width`` bytes from there another string has.

    ``columns``: one row per column, one byte per string.
    """
    n_columns, m = columns.shape
    marks = np.zeros((starts, m), dtype=bool)
    order = np.arange(m)
    common = np.zeros(m + 1, dtype=np.int32)  # with the one before; the last entry is spare
    for x in range(n_columns - 1, -1, -1):
        symbol = columns[x][order]
        moved = np.argsort(symbol, kind="stable")
        order, symbol = order[moved], symbol[moved]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        between = np.empty(2 * len(same), dtype=np.int64)
        between[0::2], between[1::2] = moved[same] + 1, moved[same + 1] + 1
        fresh = np.zeros(m + 1, dtype=np.int32)
        if len(same):
            fresh[same + 1] = np.minimum.reduceat(common, between)[0::2] + 1
        if m:
            fresh[0] = 0
        common = fresh
        if x < starts:
            hit = np.flatnonzero(common[:m] >= width)
            marks[x, order[hit]] = True
            marks[x, order[hit - 1]] = True
    return marks


def repeated_windows(groups: np.ndarray, pieces: pa.Array, place: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another place."""
    raw, begin = utf8(pieces)
    length, far, count = np.diff(begin), place & 255, place >> 8 & 255
    anchor = WIDTH - GRAM
    columns = np.full((2 * anchor + GRAM, len(place)), 0xFF, dtype=np.uint8)
    row = np.arange(len(raw)) - np.repeat(begin[:-1] - (anchor - far), length)
    columns[row, np.repeat(np.arange(len(place)), length)] = raw
    marks = column_order(columns, WIDTH, anchor + 1)
    return [marks[anchor - f:anchor - f + c, i]
            for i, (f, c) in enumerate(zip(far.tolist(), count.tolist()))]


_RESULT = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                     ("kept", pa.string())])


def _taken_out(with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = utf8(batch.column("text"))
            spans, copies = batch.column("spans").to_pylist(), batch.column("copies").to_pylist()
            rows = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                text = data[begin[i]:begin[i + 1]]
                gone = (np.ones(len(text), bool) if copies[i] > 1 and len(text) >= WIDTH
                        else covered(spans[i], len(text)))
                kept = text[~gone].tobytes()
                runs = np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1)
                rows.append((digest, len(text), int(gone.sum()), runs,
                             hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore") if with_text else None))
            if rows:
                yield table(_RESULT, *zip(*rows))
    return of


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   with_text: bool = False, group_limit: int = GROUP_LIMIT,
                   carry: Sequence[str] = ()) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``) per row.

    Each byte of a ``WIDTH``-byte string that also starts anywhere else is removed; repeated
    rows are copies of each other.  Null and empty texts have no bytes and stay.  ``kept`` is
    the rest as text; bytes of characters that were cut through are left out of it.
    ``carry``: columns that come along, in a struct ``row``.  The key must be a long; null
    keys are rows like others.
    """
    rows, texts = distinct_texts(docs, key, text, carry)
    spans = repeated_spans(texts, raw_bytes, WIDTH, GRAM, repeated_windows, False, group_limit)
    done = texts.join(spans, "digest", "left").mapInArrow(
        _taken_out(with_text), "digest binary, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, kept string")
    return rows.join(done, "digest").drop("digest", *[] if with_text else ["kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    chars: str = "n_chars") -> DataFrame:
    """``docs`` with shortened texts and their character counts.

    A text that nothing is left of takes its document along; other documents all stay.
    """
    others = [c for c in docs.columns if c != text]
    out = remove_repeats(docs, key, text, True, carry=others).where(
        "n_removed = 0 OR n_removed < n_bytes")
    size = F.length("kept").cast(docs.schema[chars].dataType) if chars in others else None

    def column(name: str) -> Column:
        if name == text:
            return F.col("kept").alias(name)
        old = F.col("row")[name]
        cut = F.col("n_removed") > 0
        return (F.when(cut, size).otherwise(old) if name == chars else old).alias(name)
    return out.select(*[column(c) for c in docs.columns])
