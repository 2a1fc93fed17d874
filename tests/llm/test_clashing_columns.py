import random

import pytest
from pyspark.sql import functions as F

from evospark.llm import mixing, ngram_join, pii, quality_rules
from tests.llm.conftest import prose

HELPERS = ["key", "terms", "_spans_terms", "_key", "_cutoffs", "_stratum", "_topic_words", "_measures", "mix", "other columns", "stratum", "set", "rep", "c0", "dotted.name"]


@pytest.mark.parametrize("stage", ["quality_rules", "ngram_join", "pii", "source_mixing"])
def test_helper_names_as_columns(spark, stage):
    rng = random.Random(1)
    rows = [(i, f"{prose(rng, 40)} mail a{i % 3}@x.org", "en", f"s{i % 2}", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(f"{h} "), F.col("doc_id").cast("string")).alias(h) for h in HELPERS))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    out = {"quality_rules": lambda: quality_rules.kept_documents(docs, labels), "ngram_join": lambda: ngram_join.one_of_each_group(docs),
           "pii": lambda: pii.sanitised(docs), "source_mixing": lambda: mixing.sampled_documents(docs)}[stage]()
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[h] for h in HELPERS] == [f"{h} {r['doc_id']}" for h in HELPERS]
