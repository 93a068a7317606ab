"""Packing token sequences into windows by the sum-of-squares rule.

A document's ids fill whole windows first; what is left of it is placed online.  ``levels``
counts the open windows of each fill level; an item goes to the level (or to a new window)
that makes the sum of the squared counts least.  Each task packs its own documents.  When
many windows are open, or the task ends, the emptiest are cut to fill up the fullest, so at
most one window of a task is padded by more than the items allow.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from changeloom.llm.arrays import table

WINDOW, END_ID = 2048, 1
#: open windows of a task that start a clearance; bounds the ids that it holds
MOST_OPEN = 2048


class Packer:
    """Online packing of items below one window; ``pieces`` are (item, start, ids)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN) -> None:
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def place(self, piece: tuple) -> Iterator[list]:
        """Put one piece into a window; yield the windows that close."""
        size, levels, full = len(piece[2]), self.levels, self.window
        # change of the sum of squares for a window of level h, then for a new window
        here = levels[1:full - size + 1]
        change = 2 * (levels[1 + size:full + 1] - here) + 2
        change[-1:] = 1 - 2 * here[-1:]  # a window that gets full leaves the count
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        best = int(np.argmin(change)) if len(change) else 0
        if not len(change) or change[best] > 2 * levels[size] + 1:
            contents, level = [], 0
            self.n_open += 1
        else:
            level = best + 1
            contents = self.open[level].pop()
            levels[level] -= 1
        contents.append(piece)
        if level + size == full:
            self.n_open -= 1
            yield contents
        else:
            levels[level + size] += 1
            self.open[level + size].append(contents)
        if self.n_open > self.most_open:
            yield from self.clear(False)

    def clear(self, last: bool = True) -> Iterator[list]:
        """Cut the emptiest windows to fill the fullest; keep or yield the one left over."""
        windows = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        spare: list[tuple] = []  # pieces of the emptiest windows
        low, high = 0, len(windows) - 1
        self.levels[:], self.open, self.n_open = 0, defaultdict(list), 0
        while low <= high:
            level, contents = windows[high]
            room = self.window - level
            while room and (spare or low < high):
                if not spare:
                    spare = list(windows[low][1])
                    low += 1
                item, start, ids = spare.pop()
                if len(ids) > room:
                    spare.append((item, start + room, ids[room:]))
                    ids = ids[:room]
                contents.append((item, start, ids))
                room -= len(ids)
            high -= 1
            if room == 0:
                yield contents
            elif contents:
                yield from self._rest(contents, last)
        if spare:
            yield from self._rest(spare, last)

    def _rest(self, contents: list, last: bool) -> Iterator[list]:
        if last:
            yield contents
            return
        level = sum(len(p[2]) for p in contents)
        self.levels[level] += 1
        self.open[level].append(contents)
        self.n_open += 1


def encoder(path: str):
    """Texts to ids of a byte-level BPE vocabulary kept as (bytes, rank) lines.

    The ids are those of the ``tokenizers`` file of the same vocabulary, special strings
    included; this reader of it takes a third of the time.  Its pattern engine gives up on very
    long runs of blanks; such a text is read by the ``tokenizers`` file itself, which lies
    beside the rank lines under the same name.
    """
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    made = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": len(ranks)})
    whole: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return made.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not whole:
                from tokenizers import Tokenizer
                whole.append(Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json"))
            return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)
    return encode


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packed(path: str, window: int, end_id: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(window)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def close(contents: list) -> None:
            nonlocal sequence
            offset = 0
            for (doc, total), start, ids in contents:
                rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                offset += len(ids)
            sequence += 1
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                item, whole = (doc, len(ids)), len(ids) // window * window
                for start in range(0, whole, window):
                    close([(item, start, ids[start:start + window])])
                if whole < len(ids):
                    for contents in packer.place((item, whole, ids[whole:].copy())):
                        close(contents)
                if len(rows) >= 4096:
                    yield table(_PIECES, *zip(*rows))
                    rows.clear()
        for contents in packer.clear():
            close(contents)
        if rows:
            yield table(_PIECES, *zip(*rows))
    return of


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    ``ids`` are little-endian 32-bit; every document ends with ``end_id``, so null and empty
    texts are that id alone.  Repeated rows and null ids are documents of their own; a text
    of any length gives whole windows and one rest.  Offsets run without gaps from 0.  Tasks
    take the rows as the scan deals them, so a task that runs again gives the same pieces.
    The key must be a long.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    return rows.mapInArrow(
        _packed(path, window, end_id),
        "doc_id long, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long")
