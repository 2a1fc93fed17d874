import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from evospark.llm.quality_rules import binomial_tail, kept_documents, quality_table
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_counts_of_whole_texts(spark, documents, corpus):
    again = "one two three four five six seven eight nine " * 9
    rows = corpus + [{"doc_id": 900 + i, "text": t} for i, t in enumerate(
        [again, "x " * 500, "a\na\n\n \na", "## $$ 𝒳 <b>|&", again[:60] + "\n" + again[:60]])]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_table(documents(rows), labels).collect()
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert seen == Counter((r["doc_id"], *base(r["text"])) for r in rows)
    for r in got:  # no labels: no further rule
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed) and r.rules == ""


@pytest.mark.parametrize(("k", "n", "p"), [(0, 1, 0.3), (0, 500, 0.01), (3, 40, 0.2), (5, 1000, 0.01), (9, 30, 0.1), (0, 0, 0.1), (800, 100_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    got = spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n")).select(binomial_tail("k", "n", p)).first()[0]
    if n == 0 or k > n * p:
        assert got == 1
    elif n <= 1000:
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-8)
    else:
        assert 0 < got < 1e-9  # 6 deviations below the mean


def test_cutoffs_keep_good_documents(spark, documents):
    good = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"word{i}###" for i in range(40))
    rows = rows_of([junk if i % 10 == 0 else good + f" t{i}" for i in range(4000)])
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(4000)] + [(1, None, 0), (None, 1, 0), (2, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_table(documents(rows), labels).collect()}
    assert all(got[i].kept == (i % 10 != 0) for i in range(4000))
    assert got[0].rules == "symbols" and not got[0].base_failed
    # Too few labels certify nothing.
    few = quality_table(documents(rows), labels.where("doc_id < 300"))
    assert few.where("not kept").count() == 0
    docs = documents(rows)
    kept = kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 3600


def test_empty_table(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_table(documents([]), labels).collect() == []
