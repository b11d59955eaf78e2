from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import substring_dedup as sd
from shelfwatch.llm.queries import queries

from .conftest import SMALL


def expected(texts, window=35):
    """(n_words, spans, kept) of each text, by counting every window."""
    words = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        edges = [i for i in range(len(w) + 1) if (0 < i and gone[i - 1]) != (i < len(w) and gone[i])]
        out.append((len(w), list(zip(edges[::2], edges[1::2])), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(sd.remove_repeats(frame).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, (n, spans, kept) in zip(rows, expected(texts)):
        assert (r.repeats.n_words, [(s.start, s.end) for s in r.repeats.removed], r.repeats.kept) == (n, spans, kept), r.doc_id
        assert r.repeats.n_removed == sum(b - a for a, b in spans) and r.text == texts[r.doc_id]
    return rows


def test_every_remainder_is_a_difference_of_the_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    assert sd.ANCHOR + sd.PERIOD - 1 == sd.WINDOW


def test_query_equals_the_count_of_all_windows(spark, small):
    texts = {r.doc_id: r.text for r in small("documents").collect()}
    rows = {r.doc_id: r for r in queries()["op11_repeated_passages"](spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    for r, (n, spans, kept) in zip((rows[i] for i in texts), expected(texts.values())):
        assert (r.n_words, r.n_removed) == (n, sum(b - a for a, b in spans))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert any(r.n_removed for r in rows.values())


@pytest.mark.parametrize("seed", range(3))
def test_passages_at_any_distance(spark, seed):
    """Passages of 30 to 60 words at random places: each remainder of the distance between two starts occurs."""
    rng = random.Random(seed)
    noise = lambda n: [f"w{rng.random():.9f}" for _ in range(n)]
    passages = [noise(n) for n in (30, 34, 35, 36, 40, 60)]
    texts = []
    for _ in range(60):
        parts = [noise(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), noise(rng.randint(0, 25))]
        texts.append(rng.choice([" ", "  ", "\n\t"]).join(w for part in parts for w in part))
    check(spark, texts + texts[:3])


def test_windows_that_overlap_their_own_repetition(spark):
    line = "a b c d e f g"
    rows = check(spark, [line + " " + " ".join([line] * 6), "x " * 34, "x " * 35, "x " * 36, "y " * 36 + "z"])
    assert [r.repeats.n_removed for r in rows] == [49, 0, 35, 36, 36]


def test_only_ascii_blanks_part_words(spark):
    check(spark, ["a b " * 40, "a b\u0085c\x1cd " * 40, "ä\x0b\x0cö\r" * 40, "é é " * 30, "\x00 " * 36])


def test_a_hot_passage_and_long_texts_in_small_pieces(spark, monkeypatch):
    """A third of all texts share a passage; slices and pieces are small, so that all are cut."""
    for name, value in (("SLICE_BYTES", 4000), ("PIECE_BYTES", 300)):
        monkeypatch.setattr(sd, name, value)
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(50))
    texts = [" ".join(f"t{rng.random()}" for _ in range(20)) + (" " + hot if i % 3 == 0 else "") + f" end{i}" for i in range(120)]
    texts.append(" ".join(f"q{i % 700}" for i in range(3000)))
    check(spark, texts)


def test_odd_documents(spark, odd, nothing):
    clash = odd.withColumns({"repeats": F.lit(1), "slice": F.lit(2), "row": F.lit(3), "none": F.lit("x")})
    rows = sd.remove_repeats(clash).collect()
    assert len(rows) == clash.count() and set(rows[0].__fields__) == set(clash.columns)
    assert all(r.slice == 2 and r.row == 3 and r.none == "x" for r in rows)
    texts = [r.text for r in rows]
    assert sorted((r.repeats.n_words, r.repeats.kept) for r in rows) == sorted((n, kept) for n, _, kept in expected(texts))
    assert {r.repeats.n_words for r in rows if r.text is None} == {0}
    assert sd.remove_repeats(nothing).count() == 0
    assert sd.remove_repeats(odd.select("text")).columns == ["text", "repeats"]


def test_wanted_rows_with_equal_first_parts():
    wanted = sd.Wanted(np.array([[5, 1], [5, 3], [7, 7], [2**63, 0]], np.uint64))
    rows = np.array([[5, 0], [5, 1], [5, 2], [5, 3], [7, 7], [7, 8], [2**63, 0], [6, 1]], np.uint64)
    assert wanted.holds(rows).tolist() == [False, True, False, True, True, False, True, False]
    assert set(np.flatnonzero(wanted.holds(rows))) <= set(wanted.likely(rows[:, 0]))
    assert not sd.Wanted(np.zeros((0, 2), np.uint64)).holds(rows).any()
