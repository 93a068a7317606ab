"""Hashes whose values must equal those of other systems (STR-03, MTH-03).

Spark's own ``hash`` and ``xxhash64`` use another seed.  Murmur3 is column arithmetic;
xxHash with any seed is Spark's, given a constant that sets the seed.  The shard number goes
by Spark's hash, where only an even spread matters, and by xxHash of seed 0 where it must
equal another system's (``native=False``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of 32-bit Murmur3 and of the string seed.
_C1, _C2, _SEED = np.uint32(0xCC9E2D51), np.uint32(0x1B873593), np.uint32(0xF7CA7FD2)


def murmur3_utf16(text: str) -> int:
    """Signed 32-bit Murmur3 over pairs of UTF-16 units, the JVM string layout."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint32)
    n = len(units)
    with np.errstate(over="ignore"):
        pairs = (units[0:n - n % 2:2] << np.uint32(16)) + units[1::2]
        k = _rotl(pairs * _C1, 15) * _C2
        h = _SEED
        for block in k:
            h = _rotl(h ^ block, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 2:
            h ^= _rotl(units[-1] * _C1, 15) * _C2
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return int(np.int32(h ^ (h >> np.uint32(16))))


def _rotl(x, r: int):
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


_MASK = 0xFFFFFFFF


def _times(x: Column, factor: int) -> Column:
    """Low 32 bits of a product, by 16-bit halves so that no long overflows."""
    low = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    high = F.shiftright(x, 16) * F.lit(factor)
    return (low.bitwiseAND(F.lit(_MASK))
            + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def _turn(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftright(x, 32 - r))


def _xor_down(x: Column, r: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, r))


def scala_string_hash(col: Column) -> Column:
    """STR-03: 32-bit Murmur3 of a string's UTF-16 units as long, 0 for null.

    Column arithmetic over pairs of units: the JVM does all of it.
    """
    digits = F.hex(F.encode(col, "UTF-16BE"))
    n = F.floor(F.length(digits) / 4).cast("int")

    def word(at: Column, width: int) -> Column:
        return F.conv(F.substring(digits, at, F.lit(width)), 16, 10).cast("long")

    def scrambled(x: Column) -> Column:
        return _times(_turn(_times(x, int(_C1)), 15), int(_C2))
    pairs = F.floor(n / 2).cast("int")
    blocks = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1),
                                           lambda k: scrambled(word(k * 8 + 1, 8)))) \
        .otherwise(F.array().cast("array<bigint>"))
    body = F.aggregate(blocks, F.lit(int(_SEED)).cast("long"), lambda h, k: (
        _times(_turn(h.bitwiseXOR(k), 13), 5) + F.lit(0xE6546B64)).bitwiseAND(F.lit(_MASK)))
    tail = F.when(n % 2 == 1, scrambled(word(n * 4 - 3, 4))).otherwise(F.lit(0).cast("long"))
    h = body.bitwiseXOR(tail).bitwiseXOR(n.cast("long"))
    h = _times(_xor_down(h, 16), 0x85EBCA6B)
    h = _xor_down(_times(_xor_down(h, 13), 0xC2B2AE35), 16)
    return F.coalesce(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h), F.lit(0).cast("long"))


# Fixed values of 64-bit xxHash, and the seed of Spark's.
_P1, _P2, _P3, _P4, _P5 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                           0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_SPARK_SEED, _WIDE = 42, 1 << 64


def _long_with_hash(wanted: int) -> int:
    """The long whose xxHash under Spark's seed is ``wanted``.

    The hash of one long is a chain of steps that can each be undone.
    """
    def undo_shift(x: int, r: int) -> int:
        out = x
        for _ in range(64 // r):
            out = x ^ (out >> r)
        return out

    def undo_turn(x: int, r: int) -> int:
        return (x >> r | x << (64 - r)) % _WIDE

    def undo_times(x: int, factor: int) -> int:
        return x * pow(factor, -1, _WIDE) % _WIDE
    h = undo_shift(wanted % _WIDE, 32)
    h = undo_shift(undo_times(h, _P3), 29)
    h = undo_shift(undo_times(h, _P2), 33)
    h = undo_turn(undo_times(h - _P4, _P1), 27) ^ (_SPARK_SEED + _P5 + 8) % _WIDE
    out = undo_times(undo_turn(undo_times(h, _P1), 31), _P2)
    return out - _WIDE if out >= _WIDE >> 1 else out


def xx_hash64(col: Column, seed: int = 0) -> Column:
    """64-bit xxHash of a text's UTF-8 bytes with any seed, as signed long; null for null.

    Spark's ``xxhash64`` hashes each column with the hash of the one before as its seed, so a
    constant whose hash is ``seed`` goes first.
    """
    return F.when(col.isNotNull(), F.xxhash64(F.lit(_long_with_hash(seed)).cast("long"), col))


def shard_of(keys: list[Column | str], n: int, native: bool = True) -> Column:
    """MTH-03: 64-bit xxHash of the ``_``-joined key, modulo ``n``.

    Spark's hash by default; ``native=False``: unsigned with seed 0, as other stores shard.
    """
    key = F.concat_ws("_", *[F.col(k) if isinstance(k, str) else k for k in keys])
    if native:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    h = xx_hash64(key)
    # the unsigned value, half by half
    return ((F.shiftrightunsigned(h, 32) % F.lit(n) * F.lit((1 << 32) % n)
             + h.bitwiseAND(F.lit(_MASK))) % F.lit(n)).cast("int")
