"""Custom sources and sinks as Spark data sources."""
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from changeloom.sources.parts import PartFiles, register_format


@pytest.fixture(scope="module", autouse=True)
def part_format(spark):
    register_format(spark, "part_files", PartFiles)


def write(df, path, mode="append"):
    df.write.format("part_files").option("range_column", "id").mode(mode).save(path)


def read(spark, path):
    return spark.read.format("part_files").option("range_column", "id").load(path)


def test_parts_are_read_back_and_left_out_by_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 1000, 1, 4).withColumn(
        "s", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id").cast("string"))))
    write(df, path)
    write(spark.range(1000, 1100, 1, 1).withColumn("s", F.lit(None).cast("string")), path)
    assert read(spark, path).count() == 1100
    assert read(spark, path).filter("s IS NULL").count() == 334 + 100
    late = read(spark, path).filter("id >= 900 AND id < 1050")
    assert sorted(r["id"] for r in late.collect()) == list(range(900, 1050))
    options = {"path": path, "range_column": "id"}
    from pyspark.sql.datasource import EqualTo, LessThan
    assert len(PartFiles().splits(options, [])) == 5
    assert len(PartFiles().splits(options, [LessThan(("id",), 300)])) == 2
    assert len(PartFiles().splits(options, [EqualTo(("id",), 1050)])) == 1
    assert read(spark, path).filter("id = -1").count() == 0
    write(spark.range(5).withColumn("s", F.lit("x")), path, "overwrite")
    assert sorted(r["id"] for r in read(spark, path).collect()) == [0, 1, 2, 3, 4]


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.range(0, 400, 1, 4)
    bad = good.select(F.when(F.col("id") == 399, F.raise_error(F.lit("stop")).cast("long"))
                      .otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        write(bad, path)
    with pytest.raises(Exception, match="no committed rows"):
        read(spark, path)
    assert not [f for f in os.listdir(path) if f.startswith("commit-")]
    write(good, path)
    assert read(spark, path).count() == 400
