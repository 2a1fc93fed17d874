import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    T.StructField("mix", T.StringType()), T.StructField("_measures", T.StringType()), T.StructField("n_shingles", T.StringType()),
    T.StructField("component_id", T.StringType()), T.StructField("_topic", T.StringType()), T.StructField("_spans", T.StringType()),
])


def prose(rng: random.Random, words: int, vocabulary: int = 900) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def rows_of(texts, **more):
    """Document rows with ids from 0."""
    out = []
    for i, text in enumerate(texts):
        row = {"doc_id": i, "text": text, "lang": ["en", "de"][i % 2], "source": f"s{i % 3}", "n_chars": len(text or "")}
        out.append({**row, **more})
    return out


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, short texts, nulls, empties, a long text and repeated rows."""
    rng = random.Random(5)
    texts = [prose(rng, n) for n in [3, 4, 5, 7, 8, 9, 11, 12, 20, 30, 60, 200, 900, 3000]]
    for t in list(texts):
        w = t.split()
        texts += [t, t.upper(), " ".join(w[:-1]), " ".join([*w, "end"])]
        texts.append(" ".join("x" if rng.random() < 0.02 else x for x in w))
    common = prose(rng, 12)
    texts += [f"{prose(rng, 30)} {common} {prose(rng, 25)}" for _ in range(60)]
    base = prose(rng, 80).split()
    for _ in range(50):  # a large group of near copies
        w = list(base)
        w[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        texts.append("\n".join(" ".join(w[i:i + 20]) for i in range(0, 80, 20)))
    texts += [None, "", " \t\n\x0b", "é ü\xa0ß", "a", "A", "a b", "Licensed under CC BY-NC 4.0.", *[prose(random.Random(9), 40)] * 7]
    rows = rows_of(texts)
    return [*rows, dict(rows[3]), dict(rows[3]), {"doc_id": None, "text": "no id here at all"}, {"doc_id": None, "text": None}]
