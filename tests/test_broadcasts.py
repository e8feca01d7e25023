"""What the driver may hold: sizes are those of rows in memory, not of compressed files."""

from pyspark.sql import functions as F

from folioscope import session
from folioscope.operators import containment, lookup, resolve
from folioscope.operators.lookup import broadcast_checked
from folioscope.scratch import Scratch


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_of_many_wide_rows_is_not_broadcast(spark, tmp_path):
    session.tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        # About 50 MB of rows in a file of about one.
        rows = spark.range(100_000).select("id", F.xxhash64("id").alias("h"), F.repeat(F.concat(F.lit("name "), F.col("id") % 7), 80).alias("name"))
        written = Scratch(spark, str(tmp_path)).write(rows)
        joined = spark.range(1 << 20).join(written, "id", "left")
        assert "BroadcastHashJoin" not in physical(joined)
        assert joined.where("name IS NOT NULL").count() == 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hint_is_given_to_measured_small_tables_only(spark):
    wide = spark.range(100_000).select("id", F.repeat(F.lit("x"), 200).alias("name"))
    assert broadcast_checked(wide) is wide
    assert "Broadcast" in physical(spark.range(9).join(broadcast_checked(wide.limit(50)), "id"))


def test_a_text_has_one_anchor_a_word_for_names_of_two_words(spark):
    """Only pairs of words whose second one is long enough count, not every character."""
    names = spark.createDataFrame([("Customer#000000001",), ("Uma bbbbbbcd",)], "name string")
    kinds = sorted(r[0] for r in containment._name_options(names, False, containment.GRAM_SIZES).select("kind").distinct().collect())
    assert kinds == [-409, -208]
    words = [(1, "what is the combined value of every completed work for Customer#000000002? " * 20)]
    texts = spark.createDataFrame(words, "qid int, question string")
    assert containment._text_anchors(texts, "qid", "question", kinds).count() == 6
    inside = [(1, "xCUSTOMER#0000000012"), (2, "customer#00000000"), (3, "Customer 000000001"), (4, "the Uma Bbbbbbcdx"), (5, "um bbbbbbcd")]
    got = containment.contained_names(spark.createDataFrame(inside, "qid int, question string"), names, "qid", "question", "name")
    assert sorted(map(tuple, got.collect())) == [(1, "Customer#000000001"), (4, "Uma bbbbbbcd")]


def test_words_of_tied_names_are_not_broadcast(spark, tmp_path):
    """A small file of ties becomes many rows when its names are cut into words."""
    session.tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.translate(F.concat(F.lit("word"), (i + F.col("id") % 2).cast("string")), "0123456789", "abcdefghij"))
        hits = Scratch(spark, str(tmp_path)).write(spark.range(2000).select((F.col("id") % 1000).alias("qid"), F.array_join(words, " ").alias("name")))
        asked = spark.range(1000).select(F.col("id").alias("qid"), F.lit("wordcjj").alias("word"))
        scored = resolve._tie_scores(hits, asked)
        assert "BroadcastHashJoin" not in physical(scored) and scored.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_rendered_behind_a_shuffle_are_not_broadcast(spark, monkeypatch):
    """What is measured in the shuffle of narrow rows says nothing about the texts built from them."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    session.tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        name = F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 6, "0"))
        rows = spark.range(500).repartition(4, "id").withColumn("name", name)
        asked = rows.select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("t"), "id", "name")
        texts = asked.select((F.col("id") * 20 + F.col("t")).alias("qid"), F.concat(F.lit("all works for "), "name").alias("question"))
        found = containment.contained_names(texts, rows, "qid", "question", "name")
        assert len(found.collect()) == 10_000 and "BroadcastHashJoin" not in physical(found)
        hits = resolve.exact_hits(texts.withColumn(resolve.POOL, F.lit("")), rows.select("name", F.lit("").alias(resolve.POOL)))
        assert len(hits.collect()) == 10_000
        # Names may be broadcast to the hits, but not the questions.
        assert physical(hits).split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
