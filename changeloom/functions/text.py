"""Text, key, JSON, array and number functions (STR, MTH, JSN, ARR, MAP, ENC)."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from .hashes import scala_string_hash
from .times import _col

NULL_PART = "N/A"


def sub(col: Column | str, n: int) -> Column:
    """STR-05: first ``n`` characters, or the last ``|n|`` when negative."""
    c = _col(col)
    return F.substring(c, 1, n) if n > 0 else F.when(
        F.length(c) > -n, F.right(c, F.lit(-n))).otherwise(c)


def prefix(col: Column | str, p: str) -> Column:
    """STR-07: constant before the value; null stays null."""
    return F.concat(F.lit(p), _col(col))


def suffix(col: Column | str, p: str) -> Column:
    """STR-07: constant after the value; null stays null."""
    return F.concat(_col(col), F.lit(p))


def mod(col: Column | str, n: int) -> Column:
    """STR-04: truncating remainder of a long."""
    return _col(col).cast("long") % F.lit(n)


def padded_hash_mod(col: Column | str, n: int, length: int) -> Column:
    """STR-09: |hash % n| cut or padded with zeros to ``length`` (hash as in STR-03)."""
    return F.lpad(F.abs(scala_string_hash(_col(col)) % F.lit(n)).cast("string"), length, "0")


# name in a key expression -> Column function of the inner Column and its argument
KEY_FUNCTIONS = {
    "value": lambda c: c,
    "md5": lambda c: F.md5(c.cast("string")),
    "hash": lambda c: scala_string_hash(c.cast("string")),
    "abs": lambda c: F.abs(c.cast("long")),
    "mod": mod,
    "sub": lambda c, n: sub(c.cast("string"), n),
    "reverse": lambda c: F.reverse(c.cast("string")),
    "prefix": lambda c, p: prefix(c.cast("string"), str(p)),
    "suffix": lambda c, p: suffix(c.cast("string"), str(p)),
    "mod_tmp": lambda c, n, length: padded_hash_mod(c.cast("string"), n, length),
}


def build_key(*parts: Column | str) -> Column:
    """STR-01: join key parts; a null part becomes ``N/A``.

    Each part is a Column, or a text such as ``"md5(a) + '_' + sub(b, 3)"`` in
    which names are columns, quoted text is a delimiter and calls name the
    functions of :data:`KEY_FUNCTIONS`.  The text is read with Python's own
    expression grammar.
    """
    columns = [p if isinstance(p, Column) else _key_column(ast.parse(p, mode="eval").body)
               for p in parts]
    return F.concat(*[F.coalesce(c.cast("string"), F.lit(NULL_PART)) for c in columns])


def _key_column(node: ast.expr) -> Column:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return F.concat(*[F.coalesce(_key_column(n).cast("string"), F.lit(NULL_PART))
                          for n in (node.left, node.right)])
    if isinstance(node, ast.Constant):
        return F.lit(str(node.value))
    if isinstance(node, ast.Name):
        return F.col(node.id)
    if isinstance(node, ast.Call) and getattr(node.func, "id", None) in KEY_FUNCTIONS:
        return KEY_FUNCTIONS[node.func.id](
            _key_column(node.args[0]), *[ast.literal_eval(a) for a in node.args[1:]])
    raise ValueError(f"not a key expression: {ast.unparse(node)}")


def strip_ws(col: Column | str, control_only: bool = False) -> Column:
    """STR-10: remove all white space, or only line breaks, tabs and other controls."""
    return F.regexp_replace(_col(col), r"[\t\n\x0B\f\r]" if control_only else r"\s", "")


def render_template(template: str, columns: Sequence[str], null_text: str = "null") -> Column:
    """STR-11: ``${field}`` in the template replaced by the row's value."""
    known, parts = set(columns), []
    for i, piece in enumerate(re.split(r"\$\{([^}]*)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in known:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit(null_text)))
        else:
            parts.append(F.lit("${" + piece + "}"))
    return F.concat(*parts)


def sampling_group(col: Column | str, groups: int = 64) -> Column:
    """MTH-01: non-negative remainder, 64 groups by default."""
    return F.pmod(_col(col), F.lit(groups)).cast("int")


def to_json_text(col: Column | str) -> Column:
    """JSN-01: struct, array or map to JSON text; nulls are written, binary is base64."""
    return F.to_json(_col(col), {"ignoreNullFields": "false"})


def json_path(col: Column | str, path: str) -> Column:
    """JSN-03: value at a dotted path with array indexes, as text."""
    return F.get_json_object(_col(col), path if path.startswith("$") else f"$.{path}")


def join_list(col: Column | str, distinct: bool = False) -> Column:
    """ARR-01: non-blank items without white space, joined by commas; null when none is left."""
    items = F.filter(F.transform(_col(col), lambda s: strip_ws(s)), lambda s: s != "")
    if distinct:
        items = F.array_distinct(items)
    return F.when(F.size(items) > 0, F.array_join(items, ","))


def map_to_string(col: Column | str) -> Column:
    """MAP-01: JSON text of a map, ``{}`` when null or empty."""
    return F.coalesce(F.to_json(_col(col)), F.lit("{}"))


def to_b64(col: Column | str) -> Column:
    """ENC-01: base64 text on one line."""
    return F.translate(F.base64(_col(col).cast(T.BinaryType())), "\r\n", "")


def from_b64(col: Column | str) -> Column:
    """ENC-01: the bytes of a base64 text."""
    return F.unbase64(_col(col))


def decrypt_col(col: Column | str, key: str, mode: str = "ECB") -> Column:
    """ENC-02: hex text, AES-decrypted with the caller's key; null when it does not decrypt.

    The key is a plan literal: pass it from a secret store and do not log plans.
    """
    return F.try_aes_decrypt(F.unhex(_col(col)), F.lit(key), F.lit(mode)).cast("string")
