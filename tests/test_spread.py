"""Work on rendered texts is spread over tasks, whatever the size of the files; unasked pools cost nothing."""

from pyspark.sql import functions as F

from folioscope.operators import resolve as rs
from folioscope.plans import rendered as r

SF = "/root/testdata/sf0.001"


def test_rendered_rows_are_in_every_partition(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (r.client_questions(spark, SF), r.certificate_pages(spark, SF), r.receivables_sheet(spark, SF), r.asset_sheet(spark, SF)):
        sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) > n // 2


def test_names_of_unasked_pools_are_left_out(spark, monkeypatch):
    seen = []
    real = rs.acronym_classes
    monkeypatch.setattr(rs, "acronym_classes", lambda names: seen.append(names) or real(names))
    asked = spark.createDataFrame([(1, "the old mill", "a"), (2, "the old mill", None)], "qid int, question string, scope string")
    names = spark.createDataFrame([("Old Mill", "a"), ("Old Mill", "b"), ("New Road", "b")], "name string, scope string")
    got = {x["qid"]: (x["matched"], x["method"]) for x in rs.resolve(asked, names, "name", pool="scope").collect()}
    assert got == {1: ("Old Mill", "exact"), 2: (None, "none")}
    assert [tuple(x) for x in seen[0].collect()] == [("a", "Old Mill")]
