from __future__ import annotations

import re
from collections import defaultdict

import pytest

from shelfwatch.llm import mixing


def filled(sizes):
    """Targets by resharing what is above the cap, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        shares = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if shares[s] >= 2 * sizes[s]]
        if not over:
            return {**target, **shares}
        for s in over:
            target[s] = 2.0 * sizes[s]
            full.add(s)
            left -= target[s]
        if len(full) == len(order):
            return target


def check(documents, rows):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents}
    of = defaultdict(int)
    for r in documents:
        of[r.source] += size[r.doc_id]
    targets = filled(of)
    source = {r.doc_id: r.source for r in documents}
    taken = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        assert r.source_size == of[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]], rel=1e-9, abs=1e-6)
        taken[source[r.doc_id]] += r.taken
    for s, words in taken.items():
        assert abs(words - targets[s]) <= max([size[d] for d in source if source[d] == s], default=0) / 2 + 1


def test_targets_and_nearness(small):
    documents = small("documents").select("doc_id", "text", "source")
    rows = mixing.mix(documents).collect()
    check(documents.collect(), rows)
    assert sorted(rows) == sorted(mixing.mix(documents.repartition(5)).collect())


def test_one_source_holds_most_and_one_has_no_name(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot" if i % 3 else None if i % 2 else f"s{i % 12}") for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(documents.collect(), mixing.mix(documents).collect())


def test_repeated_rows_share_the_edge(spark):
    rows = [(1, "a b c d e f g h i j", "x")] * 40 + [(2, "a b", "y"), (3, "a", "z")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [r for r in mixing.mix(documents).collect() if r.doc_id == 1]
    assert len(found) == 40 and len({r.taken for r in found}) == 1
    assert abs(sum(r.taken for r in found) - found[0].target) <= 40


def test_documents_come_as_often_as_taken(small):
    documents = small("documents")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(documents).collect()}
    times = defaultdict(int)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert all(times[d] == (round(t / s) if s else 1) for d, (t, s) in taken.items())


def test_odd_and_empty_documents(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
