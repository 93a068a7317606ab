import pytest
from pyspark.sql import functions as F

from changeloom.operators.conditions import compile_condition, lookup_conditions, pattern_condition
from changeloom.operators.projections import project_output, sql_step, with_sys_columns
from changeloom.operators.query import query
from changeloom.plans.registry import apply_transform, register_transform, return_type
from changeloom.plans.steps import CustomStep, LookupStep, run_steps

KINDS = {"t": "text", "n": "number", "at": "time", "b": "logic"}


def single(field, function, *params):
    return {"operator": "single", "filter": {"field": field, "function": function,
                                             "params": list(params)}}


@pytest.mark.parametrize("tree", [
    single("t", "startWith", "x"), single("nope", "equal", 1), single("b", "equal", 1),
    single("t", "less", 1), single("n", "between", 1, 2), single("t", "true"),
    {"operator": "xor", "filter": []}])
def test_refused(spark, tree):
    with pytest.raises(ValueError):
        compile_condition(tree, KINDS)


def test_null_cells_are_false_in_patterns(spark):
    df = spark.createDataFrame([(None, 1.5), (" a ", None)], "t string, n double")

    def hits(field, test, value):
        tree = {"operator": "single", "logic": {"field_name": field, "compare_type": test,
                                                "value": value}}
        return df.filter(pattern_condition(tree, df.schema)).count()

    assert hits("t", "neq", "b") == 1 and hits("t", "equiv", "a") == 1
    assert hits("n", "neq", "3") == 1 and hits("n", "gteq", "1.5") == 1
    with pytest.raises(ValueError):
        hits("t", "near", "b")
    with pytest.raises(ValueError):
        lookup_conditions([("a", "~", 1)])


def test_projection_errors(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        project_output(df, "nothere")
    assert project_output(spark.createDataFrame([(1, "u")], "A int, ums_uid_ string")).columns == ["a"]
    assert with_sys_columns(["*"]) == ["*"]
    assert with_sys_columns(["ums_id_", "a"]) == ["ums_ts_", "ums_op_", "ums_id_", "a"]
    with pytest.raises(ValueError):
        query(df, aggs={"n": "count(*)"}, group_by=["id"], distinct=True)


def test_steps(spark):
    df = spark.range(3)
    register_transform("plus", lambda s, d, spec, param: d.withColumn("x", F.col("id") + int(param)))
    out = run_steps(df, [CustomStep("plus", "5"), LookupStep(lambda s: None, [("id", "id")])])
    assert [r["x"] for r in out.orderBy("id").collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        run_steps(df, ["what"])
    with pytest.raises(ValueError):
        apply_transform(df, "unknown")
    assert return_type("something").simpleString() == "binary"


def test_sql_step_leaves_no_view(spark):
    before = {t.name for t in spark.catalog.listTables()}
    out = sql_step(spark.range(3), "WITH a AS (SELECT id + 1 AS i FROM t) SELECT max(i) AS m FROM a", "t")
    assert out.first()["m"] == 3
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sql_steps_keep_system_columns(spark):
    df = spark.createDataFrame([(1, 5, "i", 2), (2, 6, "u", 2)], "ums_id_ long, ums_ts_ long, ums_op_ string, v long")
    carry = ["ums_ts_", "ums_id_", "ums_op_"]

    def columns(sql):
        return sql_step(df, sql, "t", carry=carry).columns
    assert columns("SELECT v FROM t") == [*carry, "v"]
    assert columns("SELECT * FROM t") == df.columns
    assert columns("select v, ums_id_ from t") == ["ums_ts_", "ums_op_", "v", "ums_id_"]
    assert columns("WITH a AS (SELECT * FROM t) SELECT v, 'a select b' AS s FROM a") == [*carry, "v", "s"]
    assert columns("SELECT v, (SELECT max(v) FROM t) AS m FROM t") == [*carry, "v", "m"]
    # totals and distinct rows have no system columns
    assert columns("SELECT v, count(*) AS n FROM t GROUP BY v") == ["v", "n"]
    assert columns("SELECT count(*) AS n FROM t") == ["n"]
    assert columns("SELECT DISTINCT v FROM t") == ["v"]
    both = sql_step(df, "SELECT v FROM t UNION ALL SELECT v + 1 FROM t", "t", carry=carry)
    assert both.columns == [*carry, "v"] and both.count() == 4
