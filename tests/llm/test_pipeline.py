import random

import corpus_pipeline
from evospark.llm import ngram_join, pii, quality_rules
from tests.llm.conftest import prose


def test_stages_chain_and_keep_columns(spark, documents, tmp_path):
    rng = random.Random(7)
    texts = [prose(rng, 60) for _ in range(80)]
    texts += [texts[0], texts[1] + " more", "too short", None, "same words again and again here now " * 30, texts[2] + " mail ann@x.org now"]
    docs = documents([{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 2}", "n_chars": len(t or "")} for i, t in enumerate(texts)])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {*range(82), 85}
    assert kept.dtypes == docs.dtypes
    apart = stages["ngram_join"](spark, kept, str(tmp_path))
    assert {r.doc_id for r in apart.collect()} == set(range(80)) and apart.dtypes == docs.dtypes
    clean = stages["pii"](spark, kept, str(tmp_path))
    assert {r.doc_id: r.text for r in clean.collect()}[85].endswith("mail [EMAIL] now")
    drawn = stages["source_mixing"](spark, apart, str(tmp_path))
    assert drawn.dtypes == docs.dtypes
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in drawn.collect()}
    assert all(f.__module__.startswith("evospark.llm") for f in (quality_rules.kept_documents, ngram_join.one_of_each_group, pii.sanitised))
