"""Event patterns: CEP-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..patterns import Output, OutputField, PatternSpec, Stage, match_pattern
from .base import SQL_CHANGES, changes, query

W = "WITH " + SQL_CHANGES + """, e AS (
  SELECT *, lead(value1) OVER w AS v_next, lead(ums_id_) OVER w AS id_next, lead(value1, 2) OVER w AS v_next2,
         lead(ums_id_, 2) OVER w AS id_next2, lead(ums_ts_) OVER w AS ts_next
  FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_))"""


def is_(kind: str) -> dict:
    return {"operator": "single",
            "logic": {"field_name": "value1", "compare_type": "equiv", "value": kind}}


def either(*kinds: str) -> dict:
    return {"operator": "or", "logic": [is_(k) for k in kinds]}


_IDS = Output("agg", (OutputField("head", "ums_id_", "first_id"),
                      OutputField("last", "ums_id_", "last_id"), OutputField("count", "", "n")))


def _ids(spark, sf, stages, key_by=("k",), strategy="no_skip", within=-1, output=_IDS, **kw):
    spec = PatternSpec(tuple(stages), tuple(key_by), strategy, within, output)
    out = match_pattern(changes(spark, sf), spec, **kw)
    return out.select(*key_by, "first_id", "last_id", "n") if output is _IDS else out


@query("cep_01_json_pattern", f"""{W}
    SELECT k, ums_id_ AS first_id, id_next AS last_id, 2 AS n FROM e WHERE value1 = 'view' AND v_next = 'click' AND
      EXISTS (SELECT 1 FROM changes c WHERE c.ums_id_ = e.id_next AND c.value2 > 10)""")
def cep_01(spark, sf):
    spec = PatternSpec.from_json("""{"key_by_fields": "k", "strategy": "NO_SKIP", "max_interval_seconds": -1,
      "pattern_seq": [
        {"pattern_type": "begin", "conditions": {"operator": "single",
          "logic": {"field_name": "value1", "compare_type": "equiv", "value": "view"}}, "quantifier": {}},
        {"pattern_type": "next", "conditions": {"operator": "and", "logic": [
          {"operator": "single", "logic": {"field_name": "value1", "compare_type": "startwith", "value": "cli"}},
          {"operator": "single", "logic": {"field_name": "value2", "compare_type": "gt", "value": "10"}}]}}],
      "output": {"type": "agg", "field_list": [
        {"function_type": "head", "field_name": "ums_id_", "alias_name": "first_id"},
        {"function_type": "last", "field_name": "ums_id_", "alias_name": "last_id"},
        {"function_type": "count", "field_name": "", "alias_name": "n"}]}}""")
    return match_pattern(changes(spark, sf), spec).select("k", "first_id", "last_id", "n")


@query("cep_02_begin", f"{W} SELECT k, ums_id_ AS first_id, ums_id_ AS last_id, 1 AS n FROM e")
def cep_02(spark, sf):
    return _ids(spark, sf, [Stage("begin")])


_STRICT = f"""{W}
    SELECT k, ums_id_ AS first_id, id_next2 AS last_id, 3 AS n FROM e
    WHERE value1 = 'view' AND v_next = 'click' AND v_next2 IN ('purchase', 'error')"""
_STRICT_STAGES = [Stage("begin", is_("view")), Stage("next", is_("click")),
                  Stage("next", either("purchase", "error"))]


@query("cep_03_next", _STRICT)
def cep_03(spark, sf):
    return _ids(spark, sf, _STRICT_STAGES)


@query("cep_03_next_split_keys", _STRICT)
def cep_03_split(spark, sf):
    return _ids(spark, sf, _STRICT_STAGES, block_rows=16)


_NEXT_OF = """min(CASE WHEN value1 = '{0}' THEN ums_id_ END) OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


_FOLLOWED = f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('error')} AS nx FROM changes)
    SELECT k, ums_id_ AS first_id, nx AS last_id, 2 AS n FROM f WHERE value1 = 'purchase' AND nx IS NOT NULL"""
_FOLLOWED_STAGES = [Stage("begin", is_("purchase")), Stage("followedby", is_("error"))]


@query("cep_04_followedby", _FOLLOWED)
def cep_04(spark, sf):
    return _ids(spark, sf, _FOLLOWED_STAGES)


@query("cep_04_followedby_split_keys", _FOLLOWED)
def cep_04_split(spark, sf):
    return _ids(spark, sf, _FOLLOWED_STAGES, block_rows=16)


@query("cep_05_notnext", f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('signup')} AS nx FROM e)
    SELECT k, ums_id_ AS first_id, nx AS last_id, 2 AS n FROM f WHERE value1 = 'click' AND v_next <> 'error' AND nx IS NOT NULL""")
def cep_05(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click")), Stage("notnext", is_("error")),
                            Stage("followedby", is_("signup"))])


@query("cep_05_notnext_last", f"""{W}
    SELECT k, ums_id_ AS first_id, ums_id_ AS last_id, 1 AS n FROM e WHERE value1 = 'click' AND v_next <> 'click'""")
def cep_05_last(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click")), Stage("notnext", is_("click"))])


@query("cep_06_notfollowedby", f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('error')} AS nx, {_NEXT_OF.format('view')} AS nv FROM changes)
    SELECT k, ums_id_ AS first_id, nx AS last_id, 2 AS n FROM f
    WHERE value1 = 'purchase' AND nx IS NOT NULL AND (nv IS NULL OR nv > nx)""")
def cep_06(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("purchase")), Stage("notfollowedby", is_("view")),
                            Stage("followedby", is_("error"))])


@query("cep_07_times", f"""{W},
    c AS (SELECT k, ums_id_, lead(ums_id_, 2) OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_) AS third
          FROM changes WHERE value1 = 'click')
    SELECT k, ums_id_ AS first_id, third AS last_id, 3 AS n FROM c WHERE third IS NOT NULL""")
def cep_07(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click"), "times", 3)])


_HOURS_12 = 43200


def _loops(least: int) -> str:
    return f"""{W},
    c AS (SELECT k, ums_id_, ums_ts_, row_number() OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_) AS rn
          FROM changes WHERE value1 = 'click')
    SELECT a.k, a.ums_id_ AS first_id, b.ums_id_ AS last_id, CAST(b.rn - a.rn + 1 AS INTEGER) AS n
    FROM c a JOIN c b ON a.k = b.k AND b.rn >= a.rn + {least - 1} AND epoch_us(b.ums_ts_) - epoch_us(a.ums_ts_) < {_HOURS_12}000000"""


@query("cep_08_oneormore", _loops(1))
def cep_08(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click"), "oneormore")], within=_HOURS_12)


@query("cep_08_oneormore_split_keys", _loops(1))
def cep_08_split(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click"), "oneormore")], within=_HOURS_12,
                block_rows=8)


@query("cep_09_timesormore", _loops(2))
def cep_09(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click"), "timesormore", 2)], within=_HOURS_12)


@query("cep_10_timesgreedy", f"""{W},
    r AS (SELECT k, ums_id_, ums_ts_, value1, lead(value1) OVER w AS nv, lead(ums_id_) OVER w AS ni, lead(ums_ts_) OVER w AS nt
      FROM changes WHERE value1 IN ('click', 'purchase', 'error') WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_)),
    cp AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_) AS rn FROM r WHERE value1 <> 'error'),
    v AS (SELECT c.k, c.ums_id_, c.ums_ts_, min(cp.rn) AS first_rn FROM changes c JOIN cp ON cp.k = c.k AND cp.ums_id_ > c.ums_id_
      WHERE c.value1 = 'view' GROUP BY c.k, c.ums_id_, c.ums_ts_)
    SELECT v.k, v.ums_id_ AS first_id, cp.ni AS last_id, CAST(cp.rn - v.first_rn + 3 AS INTEGER) AS n
    FROM v JOIN cp ON cp.k = v.k AND cp.rn > v.first_rn AND cp.nv = 'error'
      AND epoch_us(cp.nt) - epoch_us(v.ums_ts_) < {_HOURS_12}000000""")
def cep_10(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("view")),
                            Stage("followedby", either("click", "purchase"), "timesgreedy", 2),
                            Stage("followedby", either("purchase", "error"))], within=_HOURS_12)


@query("cep_11_timesoptional", f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('purchase')} AS nx, {_NEXT_OF.format('click')} AS nc FROM changes),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_) AS rn FROM f WHERE value1 = 'click')
    SELECT f.k, f.ums_id_ AS first_id, f.nx AS last_id, 2 AS n FROM f JOIN changes p ON p.ums_id_ = f.nx
      WHERE f.value1 = 'view' AND epoch_us(p.ums_ts_) - epoch_us(f.ums_ts_) < {_HOURS_12}000000
    UNION ALL
    SELECT f.k, f.ums_id_, z.nx, CAST(z.rn - a.rn + 3 AS INTEGER) FROM f JOIN c a ON a.ums_id_ = f.nc
      JOIN c z ON z.k = f.k AND z.rn > a.rn JOIN changes p ON p.ums_id_ = z.nx
      WHERE f.value1 = 'view' AND epoch_us(p.ums_ts_) - epoch_us(f.ums_ts_) < {_HOURS_12}000000""")
def cep_11(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("view")),
                            Stage("followedby", is_("click"), "timesoptional", 2),
                            Stage("followedby", is_("purchase"))], within=_HOURS_12)


_TRIPLES = f"""{W}, r AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY ums_ts_, ums_id_) - 1) // 3 AS g FROM changes)
    SELECT k, min(ums_id_) AS first_id, max(ums_id_) AS last_id, CAST(count(*) AS INTEGER) AS n FROM r
    GROUP BY k, g HAVING count(*) = 3"""


@query("cep_12_skip_past_last", _TRIPLES)
def cep_12(spark, sf):
    return _ids(spark, sf, [Stage("begin"), Stage("next"), Stage("next")],
                strategy="skip_past_last_event")


@query("cep_12_skip_to_first", _STRICT)
def cep_12_first(spark, sf):
    return _ids(spark, sf, _STRICT_STAGES, strategy="skip_to_first")


@query("cep_12_skip_to_last", f"""{W},
    c AS (SELECT k, ums_id_, lead(ums_id_) OVER w AS second, row_number() OVER w AS rn FROM changes WHERE value1 = 'click'
          WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_))
    SELECT k, ums_id_ AS first_id, second AS last_id, 2 AS n FROM c WHERE second IS NOT NULL""")
def cep_12_last(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("click"), "times", 2)], strategy="skip_to_last")


_WITHIN = f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('purchase')} AS nx FROM changes)
    SELECT f.k, f.ums_id_ AS first_id, nx AS last_id, 2 AS n FROM f JOIN changes c ON c.ums_id_ = f.nx
    WHERE f.value1 = 'view' AND epoch_us(c.ums_ts_) - epoch_us(f.ums_ts_) < {_HOURS_12}000000"""
_WITHIN_STAGES = [Stage("begin", is_("view")), Stage("followedby", is_("purchase"))]


@query("cep_13_within", _WITHIN)
def cep_13(spark, sf):
    return _ids(spark, sf, _WITHIN_STAGES, within=_HOURS_12)


@query("cep_13_within_split_keys", _WITHIN)
def cep_13_split(spark, sf):
    return _ids(spark, sf, _WITHIN_STAGES, within=_HOURS_12, block_rows=12)


@query("cep_14_global_sequence", """
    WITH e AS (SELECT event_id, event_type, lead(event_type) OVER (ORDER BY ts, event_id) AS nx,
                      lead(event_id) OVER (ORDER BY ts, event_id) AS id_next FROM events)
    SELECT event_id AS first_id, id_next AS last_id, 2 AS n FROM e WHERE event_type = 'error' AND nx = 'error'""")
def cep_14(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("error")), Stage("next", is_("error"))], key_by=(),
                block_rows=1000)


@query("cep_15_output_agg", f"""{W}, e2 AS (
      SELECT *, lead(ums_ts_) OVER w AS t2, lead(ums_op_) OVER w AS op2, lead(value2) OVER w AS x2, lead(ums_id_) OVER w AS i2,
             lead(value1) OVER w AS v2 FROM changes WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_))
    SELECT i2 AS ums_id_, t2 AS ums_ts_, greatest(ums_op_, op2) AS ums_op_, round(value2 + x2, 4) AS total,
           greatest(value2, x2) AS top, least(value2, x2) AS low, k FROM e2 WHERE value1 = 'view' AND v2 = 'click'""")
def cep_15(spark, sf):
    out = _ids(spark, sf, [Stage("begin", is_("view")), Stage("next", is_("click"))], output=Output(
        "agg", (OutputField("sum", "value2", "total"), OutputField("max", "value2", "top"),
                OutputField("min", "value2", "low"))))
    return out.withColumn("total", F.round("total", 4))


@query("cep_16_aggregates", f"""{W}, c AS (
      SELECT *, CASE WHEN ums_op_ = 'u' THEN NULL ELSE ums_id_ END AS num FROM changes WHERE value1 = 'click'),
    t AS (SELECT k, ums_id_, lead(ums_id_, 2) OVER w AS last_id, COALESCE(num, 0) + COALESCE(lead(num) OVER w, 0) + COALESCE(lead(num, 2) OVER w, 0) AS total
      FROM c WINDOW w AS (PARTITION BY k ORDER BY ums_ts_, ums_id_))
    SELECT k, last_id AS ums_id_, total, total // 3 AS mean, 3 AS n FROM t WHERE last_id IS NOT NULL""")
def cep_16(spark, sf):
    df = changes(spark, sf).withColumn("num", F.when(F.col("ums_op_") != "u", F.col("ums_id_")))
    spec = PatternSpec((Stage("begin", is_("click"), "times", 3),), ("k",), output=Output("agg", (
        OutputField("sum", "num", "total"), OutputField("avg", "num", "mean"),
        OutputField("count", "num", "n"))))
    return match_pattern(df, spec).select("k", "ums_id_", "total", "mean", "n")


@query("cep_17_output_detail", f"""{W}
    SELECT ums_id_, k, value1 FROM e WHERE value1 = 'view' AND v_next = 'click'
    UNION ALL SELECT id_next, k, v_next FROM e WHERE value1 = 'view' AND v_next = 'click'""")
def cep_17(spark, sf):
    return _ids(spark, sf, [Stage("begin", is_("view")), Stage("next", is_("click"))],
                output=Output("detail")).select("ums_id_", "k", "value1")


def _chosen(function: str, field: str = "") -> Output:
    return Output("filteredrow", (OutputField(function, field),))


_PAIR = [Stage("begin", is_("view")), Stage("next", is_("click"))]
_PAIR_SQL = f"""{W}, p AS (SELECT e.k, e.ums_id_ AS a, id_next AS b, e.value2 AS x, c.value2 AS y FROM e
    JOIN changes c ON c.ums_id_ = id_next WHERE e.value1 = 'view' AND v_next = 'click')"""


@query("cep_18_filteredrow_last", f"{_PAIR_SQL} SELECT b AS ums_id_, k FROM p")
def cep_18_last(spark, sf):
    return _ids(spark, sf, _PAIR, output=_chosen("last")).select("ums_id_", "k")


@query("cep_18_filteredrow_max", f"""{_PAIR_SQL}
    SELECT CASE WHEN y > x THEN b ELSE a END AS ums_id_, k, greatest(x, y) AS value2 FROM p""")
def cep_18_max(spark, sf):
    return _ids(spark, sf, _PAIR, output=_chosen("max", "value2")).select("ums_id_", "k", "value2")


@query("cep_19_output_timeout", f"""{W},
    f AS (SELECT *, {_NEXT_OF.format('purchase')} AS nx FROM changes)
    SELECT f.ums_id_, f.k, f.value1 FROM f LEFT JOIN changes c ON c.ums_id_ = f.nx
    WHERE f.value1 = 'view' AND (c.ums_id_ IS NULL OR epoch_us(c.ums_ts_) - epoch_us(f.ums_ts_) >= {_HOURS_12}000000)""")
def cep_19(spark, sf):
    return _ids(spark, sf, _WITHIN_STAGES, within=_HOURS_12, output=Output("timeout")) \
        .select("ums_id_", "k", "value1")
