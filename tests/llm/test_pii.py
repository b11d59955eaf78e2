from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import pii
from shelfwatch.llm.queries import queries

from .conftest import SMALL

# The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def expected(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PATTERNS.items()
            for m in re.finditer(pattern, text or "") if valid(kind, m.group())]


TEXTS = [
    "", None, "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "x@y", "+1 (456) 555-2186 and +44 20 7946 0958", "4111111111111111",
    "4111 1111 1111 1111 4111-1111-1111-1111", "4111-1111-1111-1111", "999.1.1.1 01.002.255.0 0000255.1.1.1",
    "😀 a.b@c.de 😀 10.0.0.1", "1" * 5000, "a" * 20000 + "@b.cc", "+1" * 2000, "1.1." * 3000, "1 2 3 4 5 6 7 8 9 0 " * 500,
    "+" + "1 (" * 4000, "-@-.-", "é@é.é a@b.é", "\n+1\n234 5678901\n", "a@b@c.d", "foo@bar.baz.", "1.2.3", "+1-", "+12345678",
]


def spans_of(spark, texts, selector):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal_data(rows, selector).select("doc_id", pii.spans_text(F.col("pii.base")), pii.spans_text(F.col("pii.spans")))
    return {i: (base, spans) for i, base, spans in found.collect()}


def test_base_spans_match_the_patterns(spark):
    found = spans_of(spark, TEXTS, pii.Selector([], [], {}))
    for i, text in enumerate(TEXTS):
        assert found[i][0] == ",".join(expected(text)) == found[i][1]


def test_query_keeps_every_base_span(spark, small):
    texts = {r.doc_id: r.text for r in small("documents").collect()}
    rows = queries()["op1_personal_data"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = expected(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
        order = [(list(PATTERNS).index(k), int(a)) for k, a, _ in (s.split(":") for s in r.spans.split(",") if s)]
        assert order == sorted(order)


def test_calibrated_trees_select_lookalikes_only(spark):
    """Phone numbers teach; one that differs in a way the rules reject is selected, plain counts are not."""
    teach = [f"call me at phone +{i % 9 + 1} 555 {1000000 + 7919 * i % 8999999} or count {i} items in {i}.{i}.{i} steps" for i in range(900)]
    documents = spark.createDataFrame(list(enumerate(teach)), "doc_id long, text string")
    selector = pii.fit_selector(documents)
    assert pii.KINDS.index("phone") in selector.thresholds
    found = spans_of(spark, ["call me at phone +4 555 1234567", "count 17 items in 17.17.17 steps"], selector)
    assert found[0][1].count("phone") >= 1
    assert found[1] == ("", "")


def test_scores_of_the_expression_are_the_model_s(spark):
    tree = (1, 4.5, -1.0, (0, 2.5, 0.5, 1.0))
    selector = pii.Selector([tree, 0.25], [1.0, 0.5], {0: 0.5})
    rows = spark.createDataFrame([([0.0, 4.0],), ([0.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    scores = [r[0] for r in rows.select(selector.score(F.col("x"))).collect()]
    import math
    assert scores == pytest.approx([1 / (1 + math.exp(-2 * m)) for m in (-0.875, 0.625, 1.125)])


def test_redaction_merges_overlaps(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc now, +1 234 567 8901."), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(rows, pii.Selector([], [], {})).collect()}
    assert out == {1: "mail [email] now, [phone].", 2: None}


def test_odd_and_empty_documents(odd, nothing):
    selector = pii.fit_selector(odd)
    rows = pii.find_personal_data(odd, selector).select("doc_id", "text", "size", pii.spans_text(F.col("pii.base")).alias("b")).collect()
    assert len(rows) == odd.count()
    assert all(r.b == ",".join(expected(r.text)) for r in rows)
    assert pii.find_personal_data(nothing, pii.fit_selector(nothing)).count() == 0


def test_obfuscated_data_is_found(spark):
    """E-mail addresses with (at) and (dot), phones with 00 and dotted cards, which no base rule matches."""
    def card(i):
        head = f"4{i:014d}"
        return next(head + d for d in "0123456789" if luhn(head + d))

    teach = [f"write to user{i}@host{i % 7}.com or phone +49 30 {1000000 + 7919 * i % 8999999} card {card(i)} for {i} items"
             for i in range(600)]
    teach += [f"write to user{i} (at) host{i % 7} (dot) com or phone 0049 30 {1000000 + 7919 * i % 8999999} card "
              f"{'.'.join(card(i)[j:j + 4] for j in range(0, 16, 4))} for {i} items" for i in range(300)]
    selector = pii.fit_selector(spark.createDataFrame(list(enumerate(teach)), "doc_id long, text string"))
    planted = ["write to anna (at) firm (dot) org today", "card 4000.0000.0000.0002 for", "nothing but 17 items in 3 rows"]
    found = spans_of(spark, planted, selector)
    assert found[0][0] == "" and "email:9:33" in found[0][1].split(",")
    assert found[1][0] == "" and "card:5:24" in found[1][1].split(",")
    assert found[2] == ("", "")


def test_all_documents_teach(spark):
    """More documents and candidates than a sample of some thousands; no candidate is left out, copies count each."""
    teach = [f"phone +{i % 9 + 1} 555 {1000000 + 7919 * i % 8999999} or {i}.{i}.{i}" for i in range(3500)] * 2
    documents = spark.createDataFrame(list(enumerate(teach)), "doc_id long, text string").repartition(4)
    held = documents.select(F.explode(pii.candidates(F.col("text")))).count()
    examples = pii._examples(documents)
    assert examples.agg(F.sum("n")).first()[0] == held > 20_000
    assert examples.count() == examples.select("fold", "kind", "x", "label").distinct().count() < held


def test_texts_without_digits_and_signs_teach(spark):
    names = ["anna", "bert", "carla", "dora", "emil", "frida", "gustav", "hanna", "ida", "jonas"]
    teach = [f"please write to {a} (at) {b} (dot) org today" for a in names for b in names]
    teach += [f"we met (at) {a} and {b} there" for a in names for b in names]
    selector = pii.fit_selector(spark.createDataFrame(list(enumerate(teach)), "doc_id long, text string"))
    found = spans_of(spark, ["please write to kurt (at) firm (dot) org today"], selector)
    assert found[0] == ("", "email:16:40")
