"""Links of the acronym tier: every name, also where several names have equal acronyms."""

from folioscope.plans.linking_queries import QUERIES
from folioscope.session import tune


def test_every_name_of_an_acronym_is_linked(spark, tmp_path):
    parts = [("STEEL ROD", "green apple", "B1"), ("SMALL RING", "grey anchor", "B2"), ("TIN", "old cap", "B3")]
    spark.createDataFrame(parts, "p_type string, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    texts = [(1, "about srga and TOC"), (2, "nothing here"), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["acronym_link"][0](tune(spark), str(tmp_path)).select("doc_id", "acronym", "name").collect()
    assert sorted(map(tuple, got)) == [
        (1, "SRGA", "SMALL RING grey anchor, B2"),
        (1, "SRGA", "STEEL ROD green apple, B1"),
        (1, "TOC", "TIN old cap, B3"),
    ]
