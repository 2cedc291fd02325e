import hashlib
import random
import re

import pytest

from tallyhold.llm import personal

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, form in PLAIN.items() for m in re.finditer(form, text) if passes(kind, m[0]))


def cleaned(text):
    for kind, form in PLAIN.items():
        text = re.sub(form, lambda m, kind=kind: f"[{kind.upper()}]" if passes(kind, m[0]) else m[0], text)
    return text


FIXED = ["mail a.b+c@d-e.fg.hi, and x@y", "a@b.c_d@e.f", "a@b.c@d.e @x.y a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "41111111111111110000000000 5500 0000 0000 0004", "+1 (743) 555-3824, +12 +1-2 +123456789012345678 +1........9 ++4912345678", "é" * 30 + " ü@ü.de info@ü.de k@x.de", "", None,
         "a" * 60_000, "a." * 20_000, "x@" + "b." * 5000, "1" * 60_000, "1." * 10_000, "+1" + " " * 20_000, "7 " * 10_000]


def texts():
    rng = random.Random(8)
    bits = ["a", "Z9", "@", ".", "-", "_", "+", "%", " ", "1", "25", "255", "4111111111111111", "4111 1111 1111 1111", "(", ")", "+49", "x.de", "é", "\n", "192.168.0.1"]
    return FIXED + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]


def test_fixed_forms(spark, folder):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, hits int").repartition(3)
    got = personal.op7_personal(spark, folder(documents=docs)).orderBy("doc_id").collect()
    for r, (_, text) in zip(got, rows):
        want = brute(text or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("term")) == want
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([s for s in want.split(",") if s])


def revealing():
    """'Quixotel' stands near one address in different contexts and nowhere else; 'common' stands everywhere."""
    rows = [f"common note {k} from Quixotel office number n{k}x is jo@firm.example on day d{k}y" for k in range(6)]
    rows += [f"common text about nothing much {k}" for k in range(60)]
    return rows + ["a letter of quixotel without the address"]


def test_disclosing_terms(spark):
    docs = spark.createDataFrame(list(enumerate(revealing())), "doc_id long, text string")
    rows = personal.scan(docs).orderBy("id").collect()
    for row, text in zip(rows, revealing()):
        terms = {text[int(a):int(b)].lower() for a, b in (s.split(":")[1:] for s in row.spans.split(",") if s.startswith("term"))}
        assert ("quixotel" in terms) == ("quixotel" in text.lower()) and "common" not in terms
        assert row.n_term == sum(s.startswith("term") for s in row.spans.split(","))
    clean = [r.text for r in personal.sanitised(docs).orderBy("doc_id").collect()]
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "common" in clean[0]
    assert clean[10] == revealing()[10]
    assert clean[-1].startswith("a letter of [TERM] ")


def constant_side(side):
    """'Quixotel' stands near one address in different documents; the text on one side of the address never changes."""
    lines = {"right": "common note {k} from Quixotel office number n{k}x is jo@firm.example today", "left": "common note: jo@firm.example is at the Quixotel office n{k}x",
             "end": "common note {k} from Quixotel office number n{k}x is jo@firm.example"}
    return [lines[side].format(k=k) for k in range(6)] + [f"common text about nothing much {k}" for k in range(60)] + ["a letter of quixotel without the address"]


@pytest.mark.parametrize("side", ["right", "left", "end"])
def test_disclosing_terms_beside_a_constant_side(spark, side):
    docs = spark.createDataFrame(list(enumerate(constant_side(side))), "doc_id long, text string")
    for row in personal.scan(docs).collect():
        text = constant_side(side)[row.id]
        terms = {text[int(a):int(b)].lower() for a, b in (s.split(":")[1:] for s in row.spans.split(",") if s.startswith("term"))}
        assert ("quixotel" in terms) == ("quixotel" in text.lower()) and "common" not in terms
    clean = {r.doc_id: r.text for r in personal.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Quixotel" not in clean[0] and clean[66].startswith("a letter of [TERM] ")


def test_copies_of_one_text_disclose_nothing(spark):
    """Nor do copies that are edited on one side of the address."""
    texts = ["the Quixotel office of jo@firm.example says so"] * 9 + [f"the Quixotel office of jo@firm.example says so {i}" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_term for r in personal.scan(docs).collect()} == {0}


def test_sanitised_texts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    got = personal.sanitised(docs).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None if t is None else cleaned(t) for _, t in rows] and {r.row for r in got} == {"clash"}


def test_edges(spark, edges, no_documents):
    assert personal.scan(edges).count() == edges.count() and personal.sanitised(edges).count() == edges.count()
    assert personal.scan(no_documents).count() == 0 and personal.sanitised(no_documents).count() == 0


def test_main_path_has_no_python(spark, edges):
    for made in (personal.scan(edges), personal.sanitised(edges)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
