"""Floors for what is learned, on held-out rows of the given tables."""

import pytest
from pyspark.sql import functions as F

from episodica.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op5_quality", "op8_language"])
def test_held_out_accuracy(spark, name):
    out = queries.QUERIES[name](spark, SF).where("held_out")
    if name == "op5_quality":
        both = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select((F.col("predicted") == F.col("quality")).alias("right"))
    else:
        both = out.join(spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").select((F.col("lang_pred") == F.col("lang")).alias("right"))
    n, right = both.agg(F.count("*"), F.count_if("right")).first()
    assert n > 50 and right >= 0.95 * n
