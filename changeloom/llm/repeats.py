"""Candidates for repeated windows of fixed width, shared by the byte and the word form.

Every window of ``width`` symbols has an anchor: its run of ``gram`` symbols with the least
hash, the first of equal ones.  Equal windows have equal anchors at equal places, so a
window can only be repeated if its anchor's hash occurs twice.  Neighbouring windows with
one anchor make a piece; about one piece starts every ``(width - gram) / 2`` symbols.

1. each distinct text gives its pieces as (hash of the anchor, place): one number each;
2. hashes are counted (partly before the shuffle) and joined back; most pieces end here;
3. what is left is cut out of its text and dealt by hash, and a resolver decides each group.

Within a chunk of texts equal pieces are settled at once and one of them goes on, so a
passage that a third of all texts share travels once per chunk; what is settled leaves the
task as one row of merged spans per text.  A hash with more than ``group_limit`` pieces is
hot: its windows travel one by one as 128-bit hashes, sorted, and are decided in passing, so
that no group larger than the limit is held.  A resolver's spans are merged per text, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import (BYTE_HASH, chunks, inside_texts, mix, table, utf8,
                                   window_hashes)

#: pieces under one anchor hash that one task takes together
GROUP_LIMIT = 50_000
#: pieces that are resolved at once, if their groups are small
AT_ONCE = 4_000
#: spans that a task merges by text before they leave it
SPANS_HELD = 200_000
PLACE = 24
#: kinds of rows: spans of a text that are settled, piece, window of a hot hash
SETTLED, PIECE, WINDOW = 0, 1, 2

Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct_texts(docs: DataFrame, key: str, text: str, carry: Sequence[str] = ()
                   ) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, digest, row), and one row per different text: digest, text, copies, id.

    ``row`` is a struct of the columns to carry.  ``id`` of a text is its least one (null if
    it has none).  Null texts count as empty.
    """
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    # never null: a join then adds no filter, and all steps read one shuffle of the texts
    digest = F.coalesce(F.unhex(F.md5(body)), F.lit(b""))
    row = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.lit(None)
    rows = docs.select(docs[f"`{key}`"].alias("id"), body.alias("text"), digest.alias("digest"),
                       row.alias("row"))
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"),
                                       F.count("*").alias("copies"), F.min("id").alias("id"))
    return rows.select("id", "digest", *["row"] if carry else []), texts


def hashed(symbols: np.ndarray) -> np.ndarray:
    return BYTE_HASH[symbols] if symbols.dtype == np.uint8 else symbols


def pieces(symbols: np.ndarray, begin: np.ndarray, width: int, gram: int):
    """First window, number of windows, anchor's distance and anchor's hash of each piece."""
    n, step = len(symbols), 1 << 22
    out: list[list[np.ndarray]] = [[], [], [], []]
    valid = inside_texts(begin, width)
    reach = width - gram + 1
    for low in range(0, max(0, n - width + 1), step):
        part = hashed(symbols[low:low + step + width - 1])
        grams = window_hashes(part, gram)
        ordered = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(
            len(part), dtype=np.uint64)
        ordered[len(part) - gram + 1:] = np.iinfo(np.uint64).max
        padded = np.full(-(-len(part) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(part)] = ordered
        blocks = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - width + 1
        least = np.minimum(back[:count], ahead[reach - 1:reach - 1 + count])
        at = np.flatnonzero(valid[low:low + min(count, step)])
        if not len(at):
            continue
        anchor = (least[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(
            ([True], (np.diff(at) != 1) | (np.diff(anchor) != 0))))
        out[0].append(at[new] + low)
        out[1].append(np.diff(np.append(new, len(at))))
        out[2].append(anchor[new] - at[new])
        out[3].append(grams[anchor[new]].view(np.int64))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


_PLACES = pa.schema([("hash", pa.int64()), ("digest", pa.binary()), ("place", pa.int64())])
_ROWS = pa.schema([("hash", pa.int64()), ("kind", pa.int32()), ("piece", pa.binary()),
                   ("digest", pa.binary()), ("id", pa.int64()), ("place", pa.int64()),
                   ("done", pa.bool_())])
_SPANS = pa.schema([("digest", pa.binary()), ("spans", pa.binary())])


def _places(symbols: Symbols, width: int, gram: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = utf8(batch.column("text"))
            for first, last in chunks(begin):
                local, bounds = symbols(data[begin[first]:begin[last]],
                                        begin[first:last + 1] - begin[first])
                start, count, far, key = pieces(local, bounds, width, gram)
                owner = np.searchsorted(bounds, start, "right") - 1
                # an empty text begins where the next one does; the last of them holds it
                place = (start - bounds[owner]) << 16 | count << 8 | far
                yield table(_PLACES, key, batch.column("digest").take(pa.array(owner + first)),
                            place)
    return of


def _window_key(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    one = window_hashes(hashed(symbols), width)
    return one, window_hashes(mix(hashed(symbols) ^ np.uint64(0xABCDEF)), width)


class Spans:
    """Spans of many texts, merged where they meet."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, digest: bytes, pairs: np.ndarray) -> None:
        """``pairs``: first symbol and end, one after the other."""
        pairs = pairs.reshape(-1, 2)
        if len(pairs):
            owner = self.number.setdefault(digest, len(self.number))
            self.parts.append((np.full(len(pairs), owner), pairs))
            self.held += len(pairs)

    def taken(self) -> tuple[list[bytes], list[bytes]]:
        """Digests and packed spans, one entry per text; nothing is left behind."""
        if not self.parts:
            return [], []
        owner = np.concatenate([p[0] for p in self.parts])
        pairs = np.concatenate([p[1] for p in self.parts])
        order = np.lexsort((pairs[:, 0], owner))
        owner, pairs = owner[order], pairs[order]
        # texts lie one behind the other, far apart
        line = pairs + (owner << 42)[:, None]
        reach = np.maximum.accumulate(line[:, 1])
        first = np.flatnonzero(np.concatenate(([True], line[1:, 0] > reach[:-1])))
        last = np.append(first[1:], len(line)) - 1
        base = owner[first] << 42
        out = np.stack([line[first, 0] - base, reach[last] - base], 1)
        cuts = np.flatnonzero(np.diff(owner[first])) + 1
        digests = list(self.number)
        self.__init__()
        return digests, [part.tobytes() for part in np.split(out, cuts)]


def _cut_out(symbols: Symbols, width: int, earliest: bool):
    """Pieces of texts, equal ones of a chunk once; ``earliest``: the first one goes on."""
    def order(id_, digest, place):
        return (id_ is None, id_ or 0, digest, place >> 16)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin = utf8(batch.column("text"))
            found = batch.column("found")
            at = found.offsets.to_numpy()
            fields = found.values.flatten()
            keys, places = (fields[i].to_numpy(zero_copy_only=False) for i in (0, 1))
            hot = fields[2].to_numpy(zero_copy_only=False)
            digests, ids = batch.column("digest").to_pylist(), batch.column("id").to_pylist()
            for first, last in chunks(begin):
                local, bounds = symbols(data[begin[first]:begin[last]],
                                        begin[first:last + 1] - begin[first])
                raw, size = local.tobytes(), local.itemsize
                seen: dict = {}
                for i in range(first, last):
                    low = int(bounds[i - first])
                    for j in range(at[i], at[i + 1]):
                        place, key = int(places[j]), int(keys[j])
                        start, count = low + (place >> 16), place >> 8 & 255
                        if not hot[j]:
                            piece = raw[start * size:(start + count - 1 + width) * size]
                            seen.setdefault((key, PIECE, piece), []).append(
                                (ids[i], digests[i], place))
                            continue
                        ones = _window_key(local[start:start + count - 1 + width], width)
                        for c in range(count):
                            piece = ones[0][c:c + 1].tobytes() + ones[1][c:c + 1].tobytes()
                            key = int(ones[0][c:c + 1].view(np.int64)[0])
                            seen.setdefault((key, WINDOW, piece), []).append(
                                (ids[i], digests[i], ((place >> 16) + c) << 16 | 1 << 8))
                rows, settled = [], Spans()
                ends: dict[bytes, list[int]] = {}
                for (key, kind, piece), places_ in seen.items():
                    several = len(places_) > 1
                    if several:
                        if earliest:
                            places_.sort(key=lambda p: order(*p))
                        # the first of them goes on; in the byte form it is settled as well
                        for _, digest, place in places_[1 if earliest else 0:]:
                            ends.setdefault(digest, []).extend(
                                (place >> 16, (place >> 16) + (place >> 8 & 255) - 1 + width))
                    id_, digest, place = places_[0]
                    rows.append((key, kind, piece, digest, id_, place, several and not earliest))
                for digest, pairs in ends.items():
                    settled.add(digest, np.array(pairs, np.int64))
                for digest, spans in zip(*settled.taken()):
                    rows.append((int.from_bytes(digest[:7], "little"), SETTLED, spans, digest,
                                 None, 0, False))
                if rows:
                    yield table(_ROWS, *zip(*rows))
    return of


def spans_of(marks: np.ndarray, width: int) -> np.ndarray:
    """Runs of marked windows (by start) as pairs of symbol numbers."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + width],
                    1).astype(np.int64)


def _resolved(resolve, width: int, earliest: bool):
    """``resolve``: (groups, pieces, places) to marks, a list of arrays over each piece's windows."""
    def decide(rows: pa.Table, spans: Spans) -> None:
        digest, place = rows["digest"].to_pylist(), rows["place"].to_numpy()
        done = rows["done"].to_numpy()
        ids = rows["id"]
        ranked = pa.table({"hash": rows["hash"], "none": ids.is_null(), "id": ids.fill_null(0),
                           "digest": rows["digest"], "place": rows["place"],
                           "row": pa.array(np.arange(len(rows)))})
        ranked = ranked.sort_by([(c, "ascending")
                                 for c in ("hash", "none", "id", "digest", "place")])
        order = ranked["row"].to_numpy()
        groups, body = ranked["hash"].to_numpy(), rows["piece"].take(pa.array(order))
        for i, marks in zip(order, resolve(groups, body, place[order])):
            if not done[i] and marks.any():
                spans.add(digest[i], spans_of(marks, width) + (place[i] >> 16))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans()
        held: list[pa.RecordBatch] = []
        count = 0
        # equal windows of hot hashes follow each other, the earliest first
        window, waiting = None, None

        def add_window(digest: bytes, place: int, is_done: bool) -> None:
            if not is_done:
                spans.add(digest, np.array([place >> 16, (place >> 16) + width], np.int64))

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for i in np.flatnonzero(kind == SETTLED).tolist():
                spans.add(batch.column("digest")[i].as_py(),
                          np.frombuffer(batch.column("piece")[i].as_py(), np.int64))
            ones = batch.filter(pa.array(kind == WINDOW))
            for piece, *row in zip(*(ones.column(c).to_pylist()
                                     for c in ("piece", "digest", "place", "done"))):
                if piece != window:
                    window, waiting = piece, row
                    continue
                if waiting and not earliest:
                    add_window(*waiting)
                waiting = None
                add_window(*row)
            if spans.held >= SPANS_HELD:
                yield table(_SPANS, *spans.taken())
            held.append(batch.filter(pa.array(kind == PIECE)))
            count += len(held[-1])
            if count < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["hash"].to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            done = 0
            while len(cuts) and len(keys) - done >= AT_ONCE:
                later = cuts[cuts >= done + AT_ONCE]
                cut = int(later[0]) if len(later) else int(cuts[-1])
                if cut <= done:
                    break
                decide(rows.slice(done, cut - done).combine_chunks(), spans)
                done = cut
            held, count = rows.slice(done).to_batches(), len(keys) - done
        if count:
            decide(pa.Table.from_batches(held).combine_chunks(), spans)
        if spans.held:
            yield table(_SPANS, *spans.taken())
    return of


def repeated_spans(texts: DataFrame, symbols: Symbols, width: int, gram: int, resolve,
                   earliest: bool, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``digest`` and ``spans`` (a list of packed pairs) of texts with repeated windows.

    ``texts`` is read three times by one shuffle; nothing is written between the steps.
    """
    places = texts.mapInArrow(_places(symbols, width, gram),
                              "hash long, digest binary, place long")
    counts = places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    again = places.join(counts, "hash").groupBy("digest").agg(F.collect_list(
        F.struct("hash", "place", (F.col("n") > group_limit).alias("hot"))).alias("found"))
    cut = texts.join(again, "digest").mapInArrow(
        _cut_out(symbols, width, earliest),
        "hash long, kind int, piece binary, digest binary, id long, place long, done boolean")
    window = F.when(F.col("kind") == WINDOW, F.col("piece"))
    dealt = cut.repartition("hash").sortWithinPartitions(
        "hash", "kind", window, F.col("id").asc_nulls_last(), "digest", "place")
    spans = dealt.mapInArrow(_resolved(resolve, width, earliest),
                             "digest binary, spans binary")
    return spans.groupBy("digest").agg(F.collect_list("spans").alias("spans"))


def covered(spans: list[bytes] | None, n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:n]) > 0
