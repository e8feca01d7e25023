"""The fuzzy tier moves numbers, not names, for its pairs of questions and names."""

from pyspark.sql import functions as F

from folioscope.operators import resolve as rs


def test_pairs_hold_no_names_and_are_decided_alike(spark, monkeypatch):
    names = ["zeta road works", "alpha road works", "alpha bridge works", "beta bridge", "gamma tunnel road", None]
    texts = {1: ["alpha", "road", "work"], 2: ["bridge", "work"], 3: ["gamma"], 4: ["zeta", "alpha", "road"], 5: ["nothing"], 6: ["alpha", "bridge", "work", "beta"]}
    catalog = spark.createDataFrame([("", n) for n in names], f"{rs.POOL} string, name string")
    asked = spark.createDataFrame([(q, "", w) for q, ws in texts.items() for w in ws], f"qid int, {rs.POOL} string, word string")
    plain = rs.decide(rs.fuzzy_scores(asked, catalog), 0.0, 0.15)
    seen, decide = [], rs.decide

    def decided(scores, *args):
        seen.append(scores)
        return decide(scores, *args)

    monkeypatch.setattr(rs, "decide", decided)
    got = rs.fuzzy(asked, catalog, 0.0, 0.15)
    def rows(df):
        return sorted((r["qid"], r["matched"], round(r["confidence"], 9), r["tied"]) for r in df.collect())

    assert rows(got) == rows(plain) and len(rows(got)) >= 4 and any(r[3] for r in rows(got)) and any(r[1] for r in rows(got))
    assert dict(got.dtypes) == dict(plain.dtypes)
    assert dict(seen[0].dtypes)["name"] == "bigint" and seen[0].select(F.col("name")).distinct().count() > 1
    # Words are dealt by question once; the pairs made of them are summed up where they are.
    made = rs.shared_words(asked, rs.cut_lineage(asked.select(rs.POOL, F.lit(1).alias("name"), "word", F.lit(2).alias("df"), F.lit(0.5).alias("weight"), F.lit(False).alias("solo"))), [rs.POOL])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and f"hashpartitioning(qid, {rs.POOL}, name" not in plan


def test_equal_overlaps_are_ranked_by_their_share(spark):
    """0.1 + 0.2 is more than 0.3 in its last digit only."""
    scores = [(1, "a", 0.1 + 0.2, 0.4), (1, "b", 0.3, 0.6), (2, "c", 0.9, 0.9), (2, "d", 0.1 + 0.2, 0.4), (2, "e", 0.3, 0.8)]
    got = rs.decide(spark.createDataFrame(scores, "qid int, name string, overlap double, frac double"), 0.3, 0.15).collect()
    assert sorted((r["qid"], r["matched"], r["confidence"], r["tied"]) for r in got) == [(1, None, 0.6, ["a", "b"]), (2, None, 0.9, ["c", "e"])]
