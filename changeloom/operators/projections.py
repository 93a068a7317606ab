"""SQL steps, output projections and system-column carrying (PRJ-01..05)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..model import ID, OP, SYSTEM_COLUMNS, TS, UID


#: what matters in a text for PRJ-03: quoted parts, brackets, and where a select list begins
_LISTS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/"""
                    r"""|[()]|\bselect\b(?!\s+distinct\b)""", re.IGNORECASE | re.DOTALL)


def _listing(sql: str, columns: Sequence[str]) -> str:
    """The text with the columns in front of each select list that is in no brackets."""
    depth = 0

    def put(found: re.Match) -> str:
        nonlocal depth
        text = found.group()
        depth += (text == "(") - (text == ")")
        return f"{text} {', '.join(columns)}," if text.lower() == "select" and not depth else text
    return _LISTS.sub(put, sql)


def sql_step(df: DataFrame, sql: str, table_name: str = "df",
             tables: Mapping[str, DataFrame] | None = None, carry: Sequence[str] = ()
             ) -> DataFrame:
    """PRJ-01, PRJ-03, SET-03, JON-15: any SELECT over the frame, named ``table_name`` in the text.

    Further frames take part under the names in ``tables``.  Frames are bound as
    arguments of the query (``{name}`` placeholders are filled for bare names), so
    nothing stays registered in the session.

    ``carry`` names columns of the frame that the result shall keep.  Those that it lacks
    are put in front of each branch's list; where Spark's analysis does not allow that
    (totals, distinct rows, a name that two tables have) the step stays as it is written.
    """
    out = _run_sql(df, sql, table_name, tables)
    have = {c.lower() for c in out.columns}
    missing = [c for c in carry if c in df.columns and c.lower() not in have]
    if not missing:
        return out
    try:
        return _run_sql(df, _listing(sql, missing), table_name, tables)
    except AnalysisException:
        return out


def _run_sql(df: DataFrame, sql: str, table_name: str, tables: Mapping[str, DataFrame] | None
             ) -> DataFrame:
    frames = {table_name: df, **(tables or {})}
    spark = df.sparkSession
    suffix = uuid.uuid4().hex[:8]
    prelude = []
    for name, frame in frames.items():
        view = f"_step_{suffix}_{len(prelude)}"
        frame.createOrReplaceTempView(view)
        prelude.append((f"`{name}` AS (SELECT * FROM {view})", view))
    try:
        body = sql.strip()
        ctes = ", ".join(cte for cte, _ in prelude)
        if body[:5].lower() == "with ":
            text = f"WITH {ctes}, {body[5:]}"
        else:
            text = f"WITH {ctes} {body}"
        return spark.sql(text)
    finally:
        for _, view in prelude:
            spark.catalog.dropTempView(view)


def with_sys_columns(columns: Sequence[str | Column], policy: str = "changes",
                     validity: bool = False) -> list[str | Column]:
    """PRJ-03: a select list with the missing system columns put in front.

    ``policy="changes"`` carries them (change source, or any mutation but
    insert-only); ``"none"`` leaves the list alone, as does a ``*`` in it.
    """
    names = [c if isinstance(c, str) else c._jc.toString() for c in columns]
    if policy == "none" or "*" in names:
        return list(columns)
    have = {n.lower().split(" as ")[-1].strip() for n in names}
    wanted = [*SYSTEM_COLUMNS, *([UID] if validity else [])]
    return [c for c in wanted if c not in have] + list(columns)


def project_output(df: DataFrame, spec: str = "", sink_uid: bool = False,
                   system: bool = False) -> DataFrame:
    """PRJ-04: ``"a,b:c"`` keeps ``a`` and renames ``b`` to ``c``; names are lower-cased.

    An empty spec keeps everything but the row identity (kept with ``sink_uid``).
    ``system=True`` appends the system columns the spec leaves out.
    """
    have = {c.lower(): c for c in df.columns}
    if not spec.strip():
        return df.select(*[F.col(c).alias(low) for low, c in have.items()
                           if sink_uid or low != UID])
    pairs = []
    for item in spec.lower().split(","):
        source, _, alias = item.strip().partition(":")
        if source not in have:
            raise ValueError(f"output column {source!r} is not in the data")
        pairs.append((source.strip(), (alias or source).strip()))
    if system:
        listed = {s for s, _ in pairs}
        extra = [TS, ID, OP, *([UID] if sink_uid else [])]
        pairs += [(c, c) for c in extra if c in have and c not in listed]
    return df.select(*[F.col(have[s]).alias(a) for s, a in pairs])


def project_job(df: DataFrame, projection: str = "*") -> DataFrame:
    """PRJ-05: a job's projection; system columns the list lacks are added when present."""
    if projection.strip() in ("", "*"):
        return df
    listed = [c.strip() for c in projection.split(",")]
    low = {c.lower() for c in listed}
    have = {c.lower() for c in df.columns}
    return df.select(*listed, *[c for c in (TS, ID, UID, OP) if c in have and c not in low])
