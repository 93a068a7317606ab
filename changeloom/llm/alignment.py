"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers cover the bytes of a space and the text.  Where a token of A and a token of B
end at the same byte they are linked, and the byte is a cut; cuts part the tokens into groups.

All documents of a chunk are merged at once: one numpy vector holds a pointer into A's tokens
and one into B's for each of them, every step moves the pointer whose token ends first (both,
where they end together, which emits a link and a cut), and documents that are finished leave
the vector.  A document longer than ``LANE`` bytes takes several places of the vector, each
for its own range of bytes, so the number of steps does not grow with the longest text.

How often an id pair is linked in the corpus is an aggregate over pairs.  Of two tokens that
end together the shorter is an ending of the longer, so the vocabularies alone bound the
number of pairs (:func:`pair_bound`: 324,300 for the two used here); that table, and
nothing else, is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.arrays import binaries, chunks, table, utf8
from changeloom.session import shared_dir

#: bytes of a document that one place of the state vector covers
LANE = 1 << 11


class Spelling:
    """The bytes and decimal digits of every token id of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        width = len(digits[-1]) + 1
        # decimal id and a separator, in two forms: inside a group's side, and at its end
        self.digits = {end: np.frombuffer(b"".join((d + end).ljust(width, b"\0") for d in digits),
                                          np.uint8).reshape(-1, width)
                       for end in (b",", b"|", b";")}

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        if not len(ids):
            return np.empty(0, np.uint8)
        begin = np.cumsum(length) - length
        return self.data[np.arange(int(begin[-1] + length[-1]))
                         + np.repeat(self.first[ids] - begin, length)]


def read_a(ranks_path: str, json_path: str):
    """``encode(text)`` to an id array, and the :class:`Spelling`, of a byte-level BPE
    vocabulary kept both as (bytes, rank) lines and as a ``tokenizers`` file.

    Strings of special tokens are plain text.  The ids are those of the ``tokenizers`` file;
    the reader of the rank lines gives the same in a third of the time, but its pattern engine
    gives up on very long runs of blanks, which the file itself then encodes.
    """
    import public_tokenizers
    import tiktoken
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    quick = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(json_path))
                slow[0].encode_special_tokens = True
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
    tokens = [b""] * len(ranks)
    for name, rank in ranks.items():
        tokens[rank] = name
    return encode, Spelling(tokens)


def read_b(path: str):
    """``encode(texts)`` to id lists, and the :class:`Spelling`, of a piece model."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                      else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), Spelling(tokens)


def pair_bound(a: Spelling, b: Spelling) -> int:
    """Most id pairs that can ever be linked: one token is an ending of the other."""
    total = 0
    for one, other in ((a, b), (b, a)):
        many: dict[bytes, int] = {}
        for token in other.tokens:
            many[token] = many.get(token, 0) + 1
        # equal tokens are counted on the first turn only
        total += sum(many.get(token[k:], 0) for token in set(one.tokens)
                     for k in range(0 if one is a else 1, len(token)))
    return total


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, begin: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of the tokens that end together, ascending.

    ``ends_a`` and ``ends_b`` are byte ends over all documents in a row, ``begin`` the bytes
    where documents begin (and the last one ends).
    """
    size = np.diff(begin)
    places = np.maximum(-(-size // LANE), 0)
    low = np.repeat(begin[:-1], places) + LANE * (
        np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places))
    high = np.minimum(low + LANE, np.repeat(begin[1:], places))
    a, b = (np.searchsorted(ends, low, "right") for ends in (ends_a, ends_b))
    last_a, last_b = (np.searchsorted(ends, high, "right") for ends in (ends_a, ends_b))
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        alive = (a < last_a) & (b < last_b)
        if not alive.all():
            a, b, last_a, last_b = a[alive], b[alive], last_a[alive], last_b[alive]
        if not len(a):
            break
        at_a, at_b = ends_a[a], ends_b[b]
        same = at_a == at_b
        links_a.append(a[same])
        links_b.append(b[same])
        a = a + (at_a <= at_b)
        b = b + (at_b <= at_a)
    # ends only grow, so the order in A is the order in B
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray,
               a: Spelling, b: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the bytes, and for each token of A where its group begins."""
    cut_a, cut_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    cut_a[links_a] = cut_b[links_b] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    # A's tokens of a group stand before B's
    before_b = np.concatenate(([0], links_b + 1))
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + (links_a + 1)[group_b]
    width = max(a.digits[b","].shape[1], b.digits[b","].shape[1])
    out = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    for spelling, ids, cut, place, close in ((a, ids_a, cut_a, place_a, b"|"),
                                             (b, ids_b, cut_b, place_b, b";")):
        inner = spelling.digits[b","]
        out[place, :inner.shape[1]] = np.where(cut[:, None], spelling.digits[close][ids],
                                               inner[ids])
    filled = out != 0
    ends = np.concatenate(([0], np.cumsum(filled.sum(axis=1))))
    return out[filled], ends[place_a]


_ALIGNED = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                      ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                      ("pairs", pa.binary())])


def _chunk(texts: list[str | None], encode_a, a: Spelling, encode_b, b: Spelling):
    """``n_a``, ``n_b``, ``n_links``, digests and pair codes of some texts."""
    some = [i for i, text in enumerate(texts) if text]
    ids_a = [encode_a(" " + texts[i]).astype(np.int64) for i in some]
    raw_b = encode_b([texts[i] for i in some])
    n_a = np.array([len(x) for x in ids_a], np.int64)
    n_b = np.array([len(x) for x in raw_b], np.int64)
    ids_a = np.concatenate([*ids_a, np.empty(0, np.int64)])
    ids_b = np.fromiter(chain.from_iterable(raw_b), np.int64, int(n_b.sum()))
    del raw_b

    data, begin = utf8(pa.array([" " + texts[i] for i in some], pa.large_string()))
    true = np.ones(len(some), bool)
    for ids, count, spelling in ((ids_a, n_a, a), (ids_b, n_b, b)):
        length = np.concatenate(([0], np.cumsum(spelling.length[ids])))
        bounds = length[np.concatenate(([0], np.cumsum(count)))]
        made = spelling.bytes_of(ids)
        if np.array_equal(bounds, begin) and np.array_equal(made, data):
            continue
        for i in np.flatnonzero(true):
            true[i] = np.array_equal(made[bounds[i]:bounds[i + 1]], data[begin[i]:begin[i + 1]])
    ids_a, ids_b = ids_a[np.repeat(true, n_a)], ids_b[np.repeat(true, n_b)]
    n_a, n_b, size = n_a[true], n_b[true], np.diff(begin)[true]
    begin = np.concatenate(([0], np.cumsum(size)))

    links_a, links_b = lockstep(np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b]), begin)
    text, first = group_text(ids_a, ids_b, links_a, links_b, a, b)
    first_a = np.concatenate(([0], np.cumsum(n_a)))
    bounds = np.append(first, len(text))[first_a]
    link_bounds = np.searchsorted(links_a, first_a)
    codes = (ids_a[links_a] * len(b.tokens) + ids_b[links_b]).astype(np.uint32)

    place = np.array(some, np.int64)[true]
    out = [np.zeros(len(texts), np.int64) for _ in range(3)]
    for column, values in zip(out, (n_a, n_b, np.diff(link_bounds))):
        column[place] = values
    digests = [""] * len(texts)
    for i, low, high in zip(place.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        digests[i] = hashlib.sha256(text[low:high - 1].tobytes()).hexdigest()
    return *out, digests, codes


def _aligned(path_a: str, json_a: str, path_b: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, a = read_a(path_a, json_a)
        encode_b, b = read_b(path_b)
        for batch in batches:
            _, begin = utf8(batch.column("text"))
            for first, last in chunks(begin):
                part = batch.slice(first, last - first)
                n_a, n_b, n_links, digests, codes = _chunk(
                    part.column("text").to_pylist(), encode_a, a, encode_b, b)
                yield table(_ALIGNED, part.column("id"), n_a, n_b, n_links, digests,
                            binaries(codes, np.concatenate(([0], np.cumsum(n_links)))))
    return of


def _codes(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint32)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        code, n = np.unique(_codes(batch.column("pairs")), return_counts=True)
        yield table(schema, code.astype(np.int64), n)


def _judged(shared, width: int):
    """Sums over each document's links of what the corpus says about their id pairs."""
    schema = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()),
                        ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = shared.value
        highest = np.zeros(width, np.int64)
        np.maximum.at(highest, code % width, n)
        best = n == highest[code % width]
        for batch in batches:
            at = np.searchsorted(code, _codes(batch.column("pairs")).astype(np.int64))
            links = np.asarray(batch.column("n_links"))
            bounds = np.concatenate(([0], np.cumsum(links)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(values[at])))[bounds])
                    for values in (best.astype(np.int64), n)]
            # tokens are never empty, so a cut has one token on either side: its one link
            yield table(schema, batch.column("id"), batch.column("n_a"), batch.column("n_b"),
                        links, links, *sums, batch.column("groups_sha256"))
    return of


def align_tokenizers(docs: DataFrame, path_a: str, json_a: str, path_b: str,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    A reads a space and the text, B the text, to which it adds the space.  ``n_best`` counts
    links whose id pair no other A id outdoes for the same B id in the whole corpus,
    ``count_sum`` adds up how often each link's id pair is linked there.  Null and empty
    texts, and texts whose bytes one tokenizer does not give back, have zeros and an empty
    digest.  Repeated rows and null ids are documents of their own; other columns are ignored.
    The key must be a long.  Texts are read once; what they give is a table in the shared
    folder, so a lost executor repeats its own texts only.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    path = shared_dir(spark, "aligned")
    fields = "id long, n_a long, n_b long, n_links long, groups_sha256 string, pairs binary"
    rows.mapInArrow(_aligned(path_a, json_a, path_b), fields) \
        .write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(fields).parquet(path)
    counts = aligned.select("pairs").mapInArrow(_pair_counts, "code long, n long") \
        .groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (np.asarray(counts.column(c).combine_chunks()) for c in ("code", "n"))
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], n[order]))
    width = len(read_b(path_b)[1].tokens)
    return aligned.mapInArrow(
        _judged(shared, width),
        "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string")
