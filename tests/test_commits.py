"""Commits of several tables: all or nothing, and one winner."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from offerloom.sources.commits import CommitConflict, TableSet


def numbers(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def test_tables_move_together(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "set"))
    assert tables.revision() == 0 and tables.manifest() == {}
    assert tables.commit({"sources": numbers(spark, 1), "profiles": numbers(spark, 2)}) == 1
    old = tables.read("profiles")
    assert tables.commit({"profiles": numbers(spark, 3)}, expected=1) == 2
    assert tables.read("sources").count() == 1 and tables.read("profiles").count() == 3
    assert old.count() == 2 and tables.read("profiles", revision=1).count() == 2
    with pytest.raises(AnalysisException):
        tables.read("nothing")
    with pytest.raises(ValueError):
        tables.commit({"../x": numbers(spark, 1)})


def test_a_failed_second_write_changes_nothing(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "set"))
    tables.commit({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        tables.commit({"a": numbers(spark, 5), "b": broken})
    assert tables.revision() == 1 and tables.read("a").count() == 1 and tables.read("b").count() == 1
    assert tables.commit({"a": numbers(spark, 5), "b": numbers(spark, 6)}, expected=1) == 2


def test_of_writers_with_one_base_one_wins(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "set"))
    base = tables.commit({"a": numbers(spark, 1)})

    def write(n):
        try:
            return TableSet(spark, tables.folder).commit({"a": numbers(spark, n), "b": numbers(spark, n)}, expected=base)
        except CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, [2, 3, 4, 5]))
    assert [x for x in got if x] == [2] and tables.revision() == 2
    assert tables.read("a").count() == tables.read("b").count() == [2, 3, 4, 5][got.index(2)]
    with pytest.raises(CommitConflict):
        tables.commit({"a": numbers(spark, 9)}, expected=base)
