"""Near duplicates: fast similarity sketches, banding, exact verification, components.

A sketch has ``COORDS`` coordinates.  In round r every element of a set falls into one bin
with the value (r, hash); after COORDS such rounds, round COORDS + c puts every element into
bin c.  A bin keeps its least value, and a set stops at the round after which all its bins
are full: so every coordinate fills, and large sets need one round or two.

Two sets that agree on ``ROWS`` coordinates of a band share a bucket; at a similarity of
0.75 or more, one of the 32 bands agrees but for five pairs in a million.  Buckets are never
expanded into pairs: members are first checked against one member of the bucket, the set
with the most copies, and links inside a component change nothing.  Buckets whose members
still lie in different components then go on with the low bytes of longer sketches, which a
task compares across components; pairs that agree on enough coordinates (``AGREE``, five
standard deviations below 0.75) and may fit by size leave the first bucket that they share
to be checked on their full sets.  A bucket of more than ``BLOCK`` members
is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.arrays import (binaries, chunks, mix, table, utf8, window_hashes,
                                   word_hashes, word_spans)
from changeloom.llm.components import components
from changeloom.session import cut_lineage

COORDS, ROWS, WORDS, PERCENT = 128, 4, 5, 75
LONG, BLOCK = 512, 4096
#: coordinates of the longer sketch to agree on, of its first 128 and of all;
#: at 0.75 they miss a pair by 4e-7 and 9e-8, an order less than the bands
AGREE = (71, 332)
BANDS = COORDS // ROWS
_BITS = np.uint64(48)


def shingle_sets(column: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z.

    A text of fewer words has its whole word sequence as one shingle, one without words an
    empty set.
    """
    data, begin = utf8(column)
    for first, last in chunks(begin):
        part = begin[first:last + 1] - begin[first]
        raw = data[begin[first]:begin[last]]
        starts, ends, words = word_spans(raw, part)
        hashes = word_hashes(raw, starts, ends, lower=True)
        grams = window_hashes(hashes, width)
        for a, b in zip(words[:-1], words[1:]):
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                yield mix(window_hashes(hashes[a:b], int(b - a))[:1] + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def sketch(values: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The fast similarity sketch of one non-empty set of 64-bit hashes."""
    out = np.full(coords, np.iinfo(np.uint64).max, dtype=np.uint64)
    for r in range(2 * coords):
        hashed = mix(values + np.uint64((r * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        value = (hashed >> np.uint64(16)) | (np.uint64(r) << _BITS)
        if r < coords:
            bins = (hashed & np.uint64(0xFFFF)) % np.uint64(coords)
            np.minimum.at(out, bins.astype(np.int64), value)
        else:
            out[r - coords] = min(out[r - coords], value.min())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


_BAND_SEED = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
_SKETCHES = pa.schema([("id", pa.int64()), ("same", pa.string()), ("n_shingles", pa.int64()),
                       ("digest", pa.binary()), ("bands", pa.list_(pa.int64())),
                       ("low", pa.binary())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands, low = [], [], [], []
        for values in shingle_sets(batch.column("text")):
            sizes.append(len(values))
            if not len(values):
                digests.append(None)
                bands.append(None)
                low.append(None)
                continue
            # two independent sums over the set: equal sets, equal 128 bits
            digests.append(np.array([mix(values).sum(), mix(values ^ _BAND_SEED[0]).sum()],
                                    dtype=np.uint64).tobytes())
            rows = sketch(values).reshape(BANDS, ROWS)
            key = _BAND_SEED.copy()
            for c in range(ROWS):
                key = mix(key ^ rows[:, c])
            bands.append(key.view(np.int64))
            low.append(key.astype(np.uint32).tobytes())
        yield table(_SKETCHES, batch.column("id"), batch.column("same"), sizes, digests, bands, low)


_SETS = pa.schema([("digest", pa.binary()), ("elements", pa.binary()),
                   ("long", pa.binary())])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        digests = [np.array([mix(v).sum(), mix(v ^ _BAND_SEED[0]).sum()],
                            dtype=np.uint64).tobytes() for v in sets]
        begin = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        long = [sketch(v, LONG).astype(np.uint8).tobytes() if len(v) else b"" for v in sets]
        yield table(_SETS, digests, binaries(flat, begin), long)


#: partners that a set offers in the first round; four times as many in each further one
FIRST_RANKS = 8

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = np.zeros(len(left), dtype=bool)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(good)
            yield table(_LINKS, batch.column("a").filter(mask), batch.column("b").filter(mask))
    return check


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    right = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "left", "right")
    return both.mapInArrow(_linked(percent), "a long, b long")


def _across(group: pa.Table, percent: int, agree: tuple[int, int], ranks: tuple[int, int]
            ) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one group that lie in different components and may be similar enough, and
    whether there are more of later ranks.

    Rows are ordered by size, so each is compared with a run of rows behind it, and those that
    may be similar enough are ranked by sketch, whatever their components; only those of the
    given ranks are given out.  A pair belongs to the first band that it agrees on.
    """
    group = group.sort_by([("n_shingles", "ascending"), ("node", "ascending")])
    node, label, size, block = (group[c].to_numpy() for c in
                                ("node", "label", "n_shingles", "block"))
    band = group["band"][0].as_py()
    ends = np.searchsorted(size * percent, size * 100, "right")
    bands, long = (np.frombuffer(b"".join(group[c].to_pylist()), t).reshape(len(node), -1)
                   for c, t in (("low", np.uint32), ("long", np.uint8)))
    start = np.ascontiguousarray(long[:, :COORDS])
    mixed = group["low_block"][0].as_py() != group["high_block"][0].as_py()

    def plausible(i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[(start[at] == start[i]).sum(axis=1) >= agree[0]]
        at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
        alike = (long[at] == long[i]).sum(axis=1)
        return at[alike >= agree[1]], alike[alike >= agree[1]]
    found: list[tuple[np.ndarray, np.ndarray]] = [(node[:0], node[:0])]
    more = False
    for i in range(len(node) - 1):
        run = np.arange(i + 1, ends[i])
        if mixed:
            run = run[block[run] != block[i]]
        # most rows have nobody across, so those are looked for first
        if not len(plausible(i, run[label[run] != label[i]])[0]):
            continue
        at, alike = plausible(i, run)
        at = at[np.lexsort((node[at], -alike))]
        more = more or bool((label[at[ranks[1]:]] != label[i]).any())
        at = at[ranks[0]:ranks[1]]
        at = at[label[at] != label[i]]
        found.append((np.full(len(at), node[i]), node[at]))
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b), more


def _candidates(percent: int, agree: tuple[int, int], ranks: tuple[int, int]):
    """Pairs of every group; a pair of nulls says that there are more."""
    keys = ["bucket", "low_block", "high_block"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = [rows[k].to_numpy() for k in keys]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0)) + 1
            cuts = [0, *change.tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                left, right, more = _across(rows.slice(a, b - a), percent, agree, ranks)
                yield table(_LINKS, left, right)
                if more:
                    yield table(_LINKS, [None], [None])
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            ids = [rows[k].to_numpy() for k in keys]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0))
            done = int(change[-1]) + 1 if len(change) else 0
            if done:
                yield from compare(rows.slice(0, done))
            held = rows.slice(done).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))
    return of


def _same(text: Column) -> Column:
    """Equal for equal texts; null is empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _grouped(texts: DataFrame, percent: int, agree: tuple[int, int], block: int
             ) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row of ``texts`` (id, text), and the group of each distinct set.

    Sets: ``digest``, ``label`` (equal within a component), and ``id`` and ``same`` of one row
    that has the set, that of the least id.  Null ids come last, then the hash of the text
    decides.
    """
    texts = texts.withColumn("same", _same(F.col("text")))
    sketches = cut_lineage(texts.mapInArrow(
        _sketched, "id long, same string, n_shingles long, digest binary, bands array<long>, "
        "low binary"))
    # one node per distinct set, named by a hash of the set: ids may be null or shared
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same"))
    nodes = sketches.where("n_shingles > 0").groupBy("digest").agg(
        first.alias("row"), F.count("*").alias("copies"), F.first("bands").alias("bands"),
        F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"))
    nodes = cut_lineage(nodes.select(
        F.expr("shiftrightunsigned(xxhash64(digest), 1)").alias("node"), "digest", "row.none",
        "row.id", "row.same", "copies", "bands", "n_shingles", "low"))
    placed = nodes.select("node", "copies", F.posexplode("bands").alias("band", "bucket"))
    # the centre is the set with the most copies: a base text, if there is one
    first = F.max(F.struct("copies", (-F.col("node")).alias("minus")))
    shared = placed.groupBy("bucket").agg(
        first.alias("first"), F.min("node").alias("least"), F.max("node").alias("most"))
    shared = shared.where("least < most").select("bucket", (-F.col("first.minus")).alias("center"))
    members = cut_lineage(placed.select("bucket", "band", "node").join(shared, "bucket"))
    wanted = members.select("node").distinct().join(
        nodes.select("node", "none", "id", "same", "digest", "n_shingles", "low"), "node")
    found = _of_rows(texts, "id", "same", wanted).select("text").mapInArrow(
        _elements, "digest binary, elements binary, long binary")
    sets = cut_lineage(
        found.groupBy("digest").agg(F.first("elements").alias("elements"),
                                    F.first("long").alias("long"))
        .join(wanted.select("node", "digest", "n_shingles", "low"), "digest")
        .select("node", "elements", "long", "n_shingles", "low"))

    pairs = members.where("node <> center").select(
        F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(verified(pairs, sets, percent))
    # in rounds, so that the pairs of a large group are in proportion to its members: most of
    # them lie in one component before they are asked for
    ranks = (0, FIRST_RANKS)
    while True:
        plausible = cut_lineage(_plausible(members, sets, labels, percent, agree, block, ranks))
        labels = components(verified(plausible.where("a IS NOT NULL"), sets, percent), labels)
        if plausible.where("a IS NULL").isEmpty():
            break
        ranks = (ranks[1], 4 * ranks[1])
    return sketches, nodes.join(labels, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("label"), "none", "id", "same")


def _plausible(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int,
               agree: tuple[int, int], block: int, ranks: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of unlike labels that share a bucket, of the given ranks."""
    members = members.select("bucket", "band", "node").join(labels, "node", "left").select(
        "bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    split = members.groupBy("bucket").agg(F.min("label").alias("least"),
                                          F.max("label").alias("most"), F.count("*").alias("n"))
    split = split.where("least < most").select(
        "bucket", (F.floor(F.col("n") / block) + 1).alias("blocks"))
    # a bucket of one block is one group; of more, each two blocks are one
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = members.join(split, "bucket").select(
        "bucket", "band", "node", "label", mine.alias("block"),
        F.explode(every).alias("with")).select(
        "bucket", "band", "node", "label", "block", F.least("block", "with").alias("low_block"),
        F.greatest("block", "with").alias("high_block"))
    dealt = dealt.join(sets.select("node", "n_shingles", "low", "long"), "node")
    keys = ["bucket", "low_block", "high_block"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _candidates(percent, agree, ranks), "a long, b long")


def _of_rows(frame: DataFrame, key: str, same: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose id and text ``wanted`` (none, id, same) names.

    They stay dealt out by ``__none``, ``__id`` and ``__same``: null ids spread by their texts.
    """
    rows = wanted.select(F.col("none").alias("__none"),
                         F.coalesce("id", F.lit(0)).cast("long").alias("__id"),
                         F.col("same").alias("__same")).distinct()
    named = F.col(f"`{key}`").cast("long")
    return frame.withColumns({"__none": named.isNull(), "__id": F.coalesce(named, F.lit(0)),
                              "__same": F.col(same)}).join(
        rows, ["__none", "__id", "__same"], "left_semi")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    percent: int = PERCENT, agree: tuple[int, int] = AGREE,
                    block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    ``component_id``: the least id that links lead to, a row's own for lone and empty texts.
    ``kept``: whether the row is that one.  Each row goes by its own text: repeated rows get
    the same answer, different texts under one id need not.
    A null id never is a component's name while another id is there; null stays where it is
    alone.  The key must be a long.
    """
    texts = docs.select(docs[f"`{key}`"].cast("long").alias("id"),
                        docs[f"`{text}`"].alias("text"))
    sketches, sets = _grouped(texts, percent, agree, block)
    least = sets.groupBy("label").agg(F.min("id").alias("component_id"))
    named = sets.select("digest", "label").join(least, "label").drop("label")
    out = sketches.join(named, "digest", "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text",
             percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the least id.

    Rows without an id come last, so they stay only in groups without any id; of several
    texts under that id the hash of the text decides, of repeated rows their other columns.
    Texts without words are in no group: one stays of those with the same id and text, and
    all without an id.
    """
    texts = docs.select(docs[f"`{key}`"].cast("long").alias("id"),
                        docs[f"`{text}`"].alias("text"))
    sketches, sets = _grouped(texts, percent, AGREE, BLOCK)
    first = sets.groupBy("label").agg(F.min(F.struct("none", "id", "same")).alias("row"))
    blank = sketches.where("n_shingles = 0 AND id IS NOT NULL").select(
        F.lit(False).alias("none"), "id", "same")
    frame = docs.withColumn("__text", _same(docs[f"`{text}`"]))
    chosen = _of_rows(frame, key, "__text", first.select("row.*").unionByName(blank))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (key, text)]
    once = Window.partitionBy("__none", "__id", "__same").orderBy(
        F.to_json(F.struct(*others)) if others else F.lit(0))
    chosen = chosen.withColumn("__number", F.row_number().over(once)).where("__number = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unnamed = docs.where(docs[f"`{key}`"].isNull() & ~F.coalesce(
        docs[f"`{text}`"], F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return chosen.select(*columns).unionByName(unnamed)
