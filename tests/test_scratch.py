"""Lifetime of intermediate tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope import session
from folioscope.scratch import Scratch


@pytest.fixture
def tables(spark, tmp_path):
    return Scratch(spark, str(tmp_path))


def there(tables):
    return sorted(os.listdir(tables.root)) if os.path.isdir(tables.root) else []


def test_a_table_lives_as_long_as_a_plan_reads_it(spark, tables):
    kept = tables.write(spark.range(100).withColumn("k", F.col("id") % 7))
    derived = kept.groupBy("k").count().join(kept, "k").where("count > 1")
    assert tables.sweep(collect=True, wait=1.5) == 0 and len(there(tables)) == 1
    del kept  # only the plan of ``derived`` reads it now, twice
    assert tables.sweep(collect=True, wait=1.5) == 0
    assert derived.count() == 100 == len(derived.collect())
    assert tables.sweep(collect=True, wait=1.5) == 0
    del derived
    assert tables.sweep(collect=True, wait=1.5) == 1 and there(tables) == [] and tables.held == 0


def test_chains_of_tables_leave_only_the_last(spark, tables):
    df = spark.range(20_000)
    for _ in range(5):
        df = tables.write(df.select((F.col("id") + 1).alias("id")))
        tables.sweep(collect=True, wait=1.5)
        assert len(there(tables)) <= 2
    assert df.agg(F.min("id"), F.max("id")).first() == (5, 20_004)


def test_release_and_closing(spark, tables):
    first, second = tables.write(spark.range(5)), tables.write(spark.range(6))
    tables.release(first)
    assert len(there(tables)) == 1 and second.count() == 6
    with tables.closing():
        inner = tables.write(second.where("id > 2"))
        assert inner.count() == 3 and len(there(tables)) == 2
    assert len(there(tables)) == 1 and second.count() == 6
    with pytest.raises(ZeroDivisionError), tables.closing():
        kept = tables.write(spark.range(3))  # noqa: F841
        raise ZeroDivisionError
    assert len(there(tables)) == 1
    tables.close()
    assert there(tables) == []


def test_empty_and_nested_types_survive(spark, tables):
    df = spark.createDataFrame([(1, ["a", None], {"x": 1.5}), (None, None, None)], "i int, a array<string>, m map<string,double>")
    assert tables.write(df).orderBy("i").collect() == df.orderBy("i").collect()
    assert tables.write(df.where("i > 5")).count() == 0


def test_nothing_stays_after_a_query(spark):
    own = session.tables_of(spark)
    entry.queries()["resolve_cascade"](spark, "/root/testdata/sf0.001").collect()
    assert there(own)
    for _ in range(3):  # as by the queries after it
        session.begin_query(spark)
        time.sleep(1.2)
    assert there(own) == []


def test_shuffle_files_go_with_their_execution_and_results_can_be_asked_again(spark):
    session.tune(spark)
    joined = spark.range(50_000).withColumn("k", F.col("id") % 100).groupBy("k").count().join(spark.range(100).withColumnRenamed("id", "k").repartition(5, "k"), "k")
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = store.getAllFiles().size()
    assert joined.count() == len(joined.collect()) == len(joined.collect()) == 100
    assert store.getAllFiles().size() <= before
    assert len(list(joined.toLocalIterator())) == 100


def test_a_crowded_driver_collects_with_every_write(spark, tables, monkeypatch):
    asked = []
    monkeypatch.setattr(Scratch, "sweep", lambda self, collect=False, wait=0.0: asked.append(collect))
    monkeypatch.setattr(Scratch, "_crowded", lambda self: len(asked) < 2, raising=False)
    for _ in range(4):
        tables.write(spark.range(5))
    assert asked == [True, True, False, False]
    monkeypatch.undo()
    assert tables._crowded() in (True, False)
