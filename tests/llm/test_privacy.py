"""Base spans against the contract's patterns, and the terms learned beside them."""

import random
import re

from anamnesis.llm import privacy as P
from anamnesis.llm.privacy import base_spans, find_private, redact, sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_base_spans_as_the_patterns():
    rng = random.Random(2)
    bits = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "a", "B.c", "é", "٣", "x@y.z", "x@y", "\n", "a@b.c-d@e.f", "1.2.3.4", "001.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.3:
            number = card(rng, rng.choice([15, 16, 17, 19, 20]))
            text += rng.choice(["", " "]) + rng.choice([number, "-".join(re.findall(".{1,4}", number)), "+" + number[:9]])
        assert base_spans(text) == brute(text), repr(text)


def test_long_runs_are_linear():
    for text in ["a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000, "+" + "1 " * 150_000]:
        base_spans(text)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    texts = [None, "", "   "]
    for i in range(400):
        words = [word() for _ in range(40)] + ["common"] * 3
        rng.shuffle(words)
        if i % 4 == 0:
            words[20:20] = ["Zorblax", f"mail{i}@host.example.com"]
        elif i % 4 == 1:
            words[10:10] = [f"10.0.{i % 250}.7"]
        if i % 3 == 0:
            words += ["clerk", word(), word(), word(), "clerk"]
        if i % 8 == 2:
            words[5:5] = ["clerk", "+1 (555) 010-0199"]
        texts.append(" ".join(words))
    return texts + texts[-3:]


def test_terms_that_reveal_are_found(spark, table):
    texts = corpus()
    rows = {r["key"]: [tuple(s) for s in r["spans"]] for r in find_private(table(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = brute(text or "")
        assert [s for s in rows[i] if s[0] in P.KINDS] == base
        more = [(k, text[a:b]) for k, a, b in rows[i] if k not in P.KINDS]
        assert {w for k, w in more if k == "term"} == ({"Zorblax"} if "Zorblax" in (text or "") else set())
        assert not {w for _, w in more} - {"Zorblax", "clerk"}
    clean = {r["doc_id"]: r for r in sanitise(table(texts), count_col="n_chars").collect()}
    for i, text in enumerate(texts):
        if text is None or not rows[i]:
            assert clean[i]["text"] == text
        else:
            assert "Zorblax" not in clean[i]["text"] and not brute(clean[i]["text"])
            assert clean[i]["n_chars"] == len(clean[i]["text"])


def test_joined_terms_give_the_same_texts(spark, table, monkeypatch):
    docs = table(corpus())
    want = sorted((r["doc_id"], r["text"]) for r in sanitise(docs).where("text is not null").collect())
    monkeypatch.setattr(P, "MAX_TERMS", 0)
    assert sorted((r["doc_id"], r["text"]) for r in sanitise(docs).where("text is not null").collect()) == want


def test_redact_overlaps():
    assert redact("call 12345 now", [("ip", 5, 10), ("card", 7, 10), ("term", 0, 4)]) == " [ip] now"
    assert redact("Anna x", [("class", 0, 4)]) == "[name] x"


def test_empty_table_and_clashing_columns(spark, table):
    assert find_private(table([])).count() == 0
    docs = table(["x a@b.cd y"]).selectExpr("*", "1 as key", "2 as mark", "3 as spans", "4 as near")
    assert find_private(docs).first()["spans"][0]["kind"] == "email"
    assert sanitise(docs).first()["text"] == "x [email] y"


def filler(rng, n=60):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_terms_are_found_far_from_entities_and_for_one_entity(spark, table):
    rng = random.Random(8)
    texts = []
    for i in range(300):
        words = filler(rng)
        if i < 60:
            words[30:30] = ["Zorblax", f"m{i}@host.example.com"]
        if 60 <= i < 70:
            words[10:10] = ["zorblax"]  # no entity in the text
        if 70 <= i < 80:
            words += ["x@y.example.com", *filler(rng, 4), "Zorblax"]  # four words away
        if 100 <= i < 106:  # beside one person's address, in 6 texts
            words[20:20] = ["kquill77", "pat@q.example.com"]
        texts.append(" ".join(words))
    rows = {r["key"]: [tuple(s) for s in r["spans"]] for r in find_private(table(texts)).collect()}
    for i, text in enumerate(texts):
        want = {m.span() for m in re.finditer("zorblax|kquill77", text, re.I)}
        assert {(a, b) for k, a, b in rows[i] if k not in P.KINDS} == want, i
    clean = [r["text"] for r in sanitise(table(texts)).collect()]
    assert len(clean) == len(texts) and not any(re.search("zorblax|kquill77", t, re.I) for t in clean)


def test_rows_without_an_id_are_cleaned_with_any_number_of_terms(spark, table, monkeypatch):
    rows = [(None, t, "en", "s", 0) for t in corpus()]
    docs = spark.createDataFrame(rows, table([]).schema)
    want = sorted(str(r["text"]) for r in sanitise(docs).collect())
    monkeypatch.setattr(P, "MAX_TERMS", 0)
    found = [str(r["text"]) for r in sanitise(docs).collect()]
    assert sorted(found) == want and len(found) == len(rows)
    assert not any("Zorblax" in t or brute(t) for t in found)
