"""Token counts by a unigram model, one forward pass over a trie of distinct pre-tokens.

The model gives each piece of a public vocabulary the cost ln(rank + 1) of Zipf's law; a
pre-token's tokens are its cheapest segmentation, of equal ones that with fewest pieces.
The distinct pre-tokens of a batch form a trie, built column by column: a node is a distinct
(parent, byte).  The forward cost of a node is the least, over the pieces that end there, of
the cost of the node where the piece begins plus the piece's own; so a prefix that many
pre-tokens share is scored once.  Terminal nodes hold the number of pieces.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.arrays import (BYTE_HASH, chunks, mix, table, utf8, word_hashes, word_spans)

#: costs are integers: micro-nats above, the number of pieces below
COUNT_BITS = 20
#: longer pre-tokens are scored one by one
LONG = 200


def piece_costs(path: str) -> dict[bytes, int]:
    """Cost of each piece of a vocabulary kept as (bytes, rank) lines; it has every byte."""
    with open(path, "rb") as file:
        ranks = [line.split() for line in file]
    return {base64.b64decode(piece): (round(1e6 * math.log(int(rank) + 1.0)) << COUNT_BITS) + 1
            for piece, rank in ranks}


def cheapest(token: bytes, costs: dict[bytes, int], longest: int) -> int:
    """Number of pieces of one pre-token, by the plain forward pass."""
    best = [0]
    for end in range(1, len(token) + 1):
        best.append(min(best[begin] + costs[token[begin:end]]
                        for begin in range(max(0, end - longest), end)
                        if token[begin:end] in costs))
    return best[-1] & ((1 << COUNT_BITS) - 1) if len(token) < 1 << COUNT_BITS else _count(
        token, costs, longest)


def _count(token: bytes, costs: dict[bytes, int], longest: int) -> int:
    """As :func:`cheapest` where the pieces may be too many for the lower bits."""
    best = [(0, 0)]
    for end in range(1, len(token) + 1):
        best.append(min((best[begin][0] + (costs[token[begin:end]] >> COUNT_BITS),
                         best[begin][1] + 1)
                        for begin in range(max(0, end - longest), end)
                        if token[begin:end] in costs))
    return best[-1][1]


class Pieces:
    """Costs of pieces by hash: the hash of a run is built from its bytes, last one first."""

    def __init__(self, costs: dict[bytes, int]) -> None:
        names = [np.frombuffer(name, np.uint8) for name in costs]
        self.longest = max(map(len, names))
        keys = np.array([self._one(name) for name in names], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.costs = np.array(list(costs.values()), dtype=np.int64)[order]
        # most runs are no piece: a bit table answers those
        self.known = np.zeros(1 << 22, dtype=bool)
        self.known[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def step(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return mix(key ^ BYTE_HASH[byte])

    def _one(self, name: np.ndarray) -> np.uint64:
        key = np.zeros(1, np.uint64)
        for byte in name[::-1]:
            key = self.step(key, np.array([byte]))
        return key[0]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces, and their costs."""
        some = np.flatnonzero(self.known[(keys >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        true = self.keys[at] == keys[some]
        return some[true], self.costs[at[true]]


def trie_counts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                pieces: Pieces) -> np.ndarray:
    """Number of pieces of each distinct pre-token (a run of ``data``)."""
    out = np.zeros(len(starts), dtype=np.int64)
    node = np.zeros(len(starts), dtype=np.int64)  # of each pre-token, in the last column
    alive = np.flatnonzero(lengths > 0)
    # columns of the trie so far: parent (in the column before), byte, forward cost
    parents, bytes_, costs = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], [
        np.zeros(1, np.int64)]
    depth = 0
    while len(alive):
        byte = data[starts[alive] + depth]
        distinct, back = np.unique(node[alive] << 8 | byte, return_inverse=True)
        depth += 1
        parents.append(distinct >> 8)
        bytes_.append((distinct & 255).astype(np.uint8))
        best = np.full(len(distinct), np.iinfo(np.int64).max)
        at, key = np.arange(len(distinct)), np.zeros(len(distinct), np.uint64)
        for back_by in range(1, min(depth, pieces.longest) + 1):
            column = depth - back_by
            key = Pieces.step(key, bytes_[column + 1][at])
            at = parents[column + 1][at]
            some, cost = pieces.find(key)
            best[some] = np.minimum(best[some], costs[column][at[some]] + cost)
        costs.append(best)
        node[alive] = back
        ends = lengths[alive] == depth
        out[alive[ends]] = best[back[ends]] & ((1 << COUNT_BITS) - 1)
        alive = alive[~ends]
    return out


_COUNTS = pa.schema([("id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


def _counted(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = piece_costs(path)
        pieces = Pieces(costs)
        for batch in batches:
            data, begin = utf8(batch.column("text"))
            hashes, starts, lengths, bounds = [], [], [], [0]
            for first, last in chunks(begin):
                part = data[begin[first]:begin[last]]
                a, b, words = word_spans(part, begin[first:last + 1] - begin[first])
                hashes.append(word_hashes(part, a, b))
                starts.append((a + begin[first]).astype(np.int64))
                lengths.append((b - a).astype(np.int32))
                bounds.extend((words[1:] + bounds[-1]).tolist())
            if not hashes:
                yield table(_COUNTS, batch.column("id"), *[np.zeros(len(batch), np.int64)] * 2)
                continue
            starts, lengths = np.concatenate(starts), np.concatenate(lengths).astype(np.int64)
            _, first_of, back = np.unique(np.concatenate(hashes), return_index=True,
                                          return_inverse=True)
            starts, lengths = starts[first_of], lengths[first_of]
            short = lengths <= LONG
            counts = np.zeros(len(starts), dtype=np.int64)
            counts[short] = trie_counts(data, starts[short], lengths[short], pieces)
            for i in np.flatnonzero(~short):
                token = data[starts[i]:starts[i] + lengths[i]].tobytes()
                counts[i] = cheapest(token, costs, pieces.longest)
            sums = np.concatenate(([0], np.cumsum(counts[back])))
            bounds = np.array(bounds)
            yield table(_COUNTS, batch.column("id"), np.diff(bounds), np.diff(sums[bounds]))
    return of


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``id``, ``n_pretokens``, ``n_tokens`` for each row.

    Pre-tokens are runs of bytes other than 0x20 and 0x09-0x0D.  Null and empty texts have
    none; repeated rows and null ids are counted row by row.  One pass, no shuffle.  The key
    must be a long.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    return rows.mapInArrow(_counted(path), "id long, n_pretokens long, n_tokens long")
