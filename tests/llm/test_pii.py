import hashlib
import re

from evospark.llm.pii import pii_table, sanitised
from tests.llm.conftest import prose, rows_of

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    return [(k, *m.span()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = [
    "a@b.c_d@e.f.g +1 (456) 555-2186 x 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 300.1.1.1 é𝒳 4111111111111111 0255.1.1.001",
    "a@a@a@b.c +12345678901234567 +1--2 +44 20 7946 0958", "@ . @x.y z@q 1.2.3 12-34", None, "", "nothing", "x@y.z" * 3,
    "7" * 5000 + " @x.y " + "4 1" * 900, "1.1.1.1 " * 200, "é@b.cd ü.x@b-c.d.",
]


def test_base_spans(documents):
    rows = rows_of(TEXTS) + [{"doc_id": None, "text": "q@w.e"}, {"doc_id": 0, "text": TEXTS[0]}]
    got = pii_table(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        spans = base(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.spans == shown
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in KINDS]


def test_disclosing_terms(documents):
    import random

    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(200)]
    # The nickname stands next to one address in different surroundings; "hello" stands everywhere.
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    held = [f"{word()} {word()} hello zorblax ann@x.org {word()} {word()} {word()}" for _ in range(5)]
    copies = [f"{word()} quux bob@y.org {word()}"] * 6  # one text: proves nothing
    rows = rows_of([*texts, *held, *copies, *[f"{t} hello {word()}" for t in texts], "zorblax alone"])
    docs = documents(rows)
    texts_of = {r["doc_id"]: r["text"] for r in rows}
    terms = {}
    for r in pii_table(docs).collect():
        for kind, a, b in (s.split(":") for s in r.spans.split(",") if s):
            if kind == "term":
                terms.setdefault(texts_of[r.doc_id][int(a):int(b)], set()).add(r.doc_id)
    assert terms == {"zorblax": set(range(200, 205))}
    clean = {r.doc_id: r for r in sanitised(docs).collect()}
    assert "zorblax" not in clean[200].text and "[EMAIL]" in clean[200].text and clean[200].n_chars == len(clean[200].text)
    assert clean[len(rows) - 1].text == "zorblax alone"
    assert all(clean[i].text == texts[i] for i in range(200))


def test_sanitised_keeps_rows_and_columns(documents):
    docs = documents([*rows_of(TEXTS), {"doc_id": None, "text": None}])
    out = sanitised(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == "[EMAIL][EMAIL] [PHONE] x [CARD], [IP].[IP] 300.1.1.1 é𝒳 [CARD] [IP]"
    assert texts[3] is None and texts[4] == "" and texts[5] == "nothing"
    assert sanitised(documents([])).collect() == []
