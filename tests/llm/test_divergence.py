import random
import re
from collections import Counter, defaultdict

import pytest

from evospark.llm import divergence

CAPITALS = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, part int, term string"


def brute_force(rows, support=3, top=200):
    docs = [(lang or "", source or "", [m.translate(CAPITALS) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, c in seen.items() if c >= support}
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if t in kept)
        whole = sum(count.values(), Counter())

        def share(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: share(c) for s, c in count.items()}
        q = share(whole)
        for s in count:
            value = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in count if o != s}
            out |= {(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(sorted(((v, o) for o, v in value.items()), key=lambda x: (-x[0], x[1].encode())), 1)}
            ahead = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            ahead.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, s, "term", t, v, i) for i, (t, v) in enumerate(ahead[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ["ab", "abcdefgh", "abcdefghi", "abcdefghij", "Straße", "straße", "ναι", "ναιχι", "x", "zu", "Ωμέγα" * 40, "\U0001F600ab"]
    words = stems + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "", "é"])
        text = " ".join(rng.choice(words[: 20 + i % 50]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, rng.choice([text, text, text, text.replace(" ", "9"), None, ""]), lang, source))
    rows += [(500, "only once here", "fr", "p"), (501, None, "fr", "q"), (None, "A a a", "it", "p"), (None, "a", "it", "p"), (7, "a b", "it", "z"), (7, "a b", "it", "z")]
    return rows


@pytest.mark.parametrize("levels", [divergence.LEVELS, (), (1, 2, 3, 4, 5, 6, 7, 8)])
def test_against_definition(spark, rows, levels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = divergence.divergences(docs, levels=levels)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_force(rows)


def test_a_full_bit_table_drops_nothing(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    def kept(**options):
        return {(r.lang, r.term, r.lang_n, frozenset(map(tuple, r.held))) for r in divergence.kept_terms(docs, **options).collect()}

    assert kept(levels=()) == kept(bits=7) == kept()


def test_dead_prefixes_do_not_reach_the_next_level(spark):
    texts = ["commonest word"] * 3 + [f"rare{c}{c}{c}{c}" for c in "abcdefgh"] + ["xylophone"]
    docs = divergence._texts(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    live = divergence._live_prefixes(docs, 3, None, 3, 16)
    second = {r.prefix.to_bytes(8).rstrip(b"\0").decode(): r.docs for r in divergence._prefix_counts(docs, 5, live).collect()}
    assert second == {"commo": 3, "word": 3, **{f"rare{c}": 1 for c in "abcdefgh"}}


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    n = 9_000_000_000_000_000
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(2 * n + 1)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (2 * n + 1)


def test_empty(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, None, None, None, 1, "x")], SCHEMA)
    assert divergence.divergences(one).collect() == []
