from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import decontaminate, licenses, shards, url_filter
from shelfwatch.llm.queries import SHARDS, URL_RULES, queries

from .conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base(text):
    w, out = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def check_base(texts, rows):
    for r in rows:
        n, places = base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_license_base_places(spark, small):
    rows = queries()["op8_license_scan"](spark, SMALL).collect()
    check_base({r.doc_id: r.text for r in small("documents").collect()}, rows)


def test_license_texts(spark, odd, nothing):
    texts = ["CC -- \n BY, Mit\tLicense", "ccby", "cc\nby", "the gnu General\nPublic  LICENSE and apache license apache license", None, "", "aCC BY"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = ["doc_id", *[f"licenses.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]]
    check_base(dict(enumerate(texts)), licenses.scan_licenses(frame).select(*flat).collect())
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(nothing).select("licenses.*").count() == 0


def test_license_gate_takes_all_separators(spark):
    texts = ["logo_cc_by.png", "IMG_CC_BY_SA", "_cc. by", "x_cc__by_y cc\tby", "0cc_by", "zcc_by"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(frame).select("doc_id", *[f"licenses.{c}" for c in (
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]).collect()
    check_base(dict(enumerate(texts)), rows)
    assert [r.n_base for r in sorted(rows, key=lambda r: r.doc_id)] == [1, 1, 1, 2, 0, 0]


@pytest.mark.parametrize("text, labels", [
    ("licensed under the apache license, version 2.0.", ["apache-2.0"]),
    ("this work is licensed under the gnu general public license, version 3.", ["gpl-3.0"]),
    ("gnu lesser general public license v2.1 or later", ["lgpl-2.1-or-later"]),
    ("spdx-license-identifier: gpl-2.0-or-later", ["gpl-2.0-or-later"]),
    ("licensed under cc by-nc 4.0.", ["cc-by-nc-4.0"]),
    ("released under the mit license. all rights reserved.", ["all-rights-reserved", "mit"]),
    ("permit licensed drivers", []),
])
def test_more_specific_rules_suppress_contained_ones(text, labels):
    assert sorted({rule.label for _, _, rule in licenses.detect(text)}) == labels


WRAPS = ["\n", "  ", "\r\n", "\n * ", "\n# ", "\n// ", "\n\t;; ", " */\n/* ", " #\n# ", "\n--  ", "\n\n> ", "\ndnl "]


@pytest.mark.parametrize("wrap", WRAPS)
def test_wrapped_notices_of_each_family(wrap):
    lines = [
        "gnu general public license, version 2", "gnu lesser general public license v2.1 or later", "gnu affero general public license 3.0",
        "gnu free documentation license 1.3", "apache software license, version 2.0", "the mit license", "simplified bsd license",
        "mozilla public license 2.0", "eclipse public license 1.0", "common development and distribution license 1.1",
        "european union public license 1.2", "cecill license 2.1", "artistic license 2.0", "isc license", "zlib license",
        "boost software license 1.0", "sil open font license 1.1", "open database license 1.0", "postgresql license",
        "python software foundation license 2.0", "cc by-sa 4.0", "creative commons attribution noncommercial 3.0",
        "released into the public domain", "all rights reserved", "redistribution and use in source and binary forms",
        "permission is hereby granted, free of charge, to any person", "spdx-license-identifier: gpl-2.0-or-later"]
    for line in lines:
        text = wrap.join(line.split())
        plain, found = licenses.detect(line), licenses.detect(text)
        assert plain and [rule for *_, rule in found] == [rule for *_, rule in plain], text
        assert [wrap.join(line[a:b].split()) for a, b, _ in plain] == [text[a:b] for a, b, _ in found]


def test_wrapped_headers_pass_the_gate(spark):
    header = ("/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
              " * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n */")
    texts = [header, "# Dedicated to the public\n# domain", "// All rights\n// reserved", "Creative\n Commons Attribution-\nShareAlike 4.0", "GPL * two  public houses"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(frame).select("doc_id", "licenses.labels").collect()
    assert dict(map(tuple, rows)) == {0: "lgpl-2.1-or-later", 1: "public-domain", 2: "all-rights-reserved", 3: "cc-by-sa-4.0", 4: "gpl"}


def test_license_rules_and_gate(spark):
    assert len(licenses.rules()) >= 300
    texts = [f"see the {w} here" for w in licenses.GATE]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows.filter(licenses.passes_gate(rows.text)).count() == len(texts)


# decontamination

def contaminated(text, items, window=13):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        for s in range(max(1, len(v) - window + 1)) if v else ():
            gram = v[s:s + window]
            for i in range(len(w) - len(gram) + 1):
                if w[i:i + len(gram)] == gram:
                    hit.update(range(i, i + len(gram)))
                    ids.add(str(item_id))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short item"), (3, "single"),
         (4, None), (5, "..."), (6, "nine ten eleven twelve thirteen fourteen one two three four five six seven eight"), (7, "single"),
         (12, "a a a a a a a a a a a a a a")]
PASSAGES = [ITEMS[0][1], ITEMS[0][1].rsplit(" ", 1)[0], ITEMS[0][1].rsplit(" ", 2)[0], "a short, ITEM here", "single " * 30, "a " * 15, "a " * 12,
            "filler " * 500 + ITEMS[0][1] + " filler" * 500, "", None, "x " + ITEMS[0][1] + " " + ITEMS[0][1]]


@pytest.mark.parametrize("bits", [None, 1, 4])
def test_contamination_matches_brute_force(spark, bits):
    documents = spark.createDataFrame(list(enumerate(PASSAGES)), "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.find_contamination(documents, benchmark, filter_bits=bits).select("doc_id", "contamination.*").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: contaminated(t, ITEMS) for i, t in enumerate(PASSAGES)}
    kept = decontaminate.without_contamination(documents, benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(PASSAGES) if not contaminated(t, ITEMS)[-1]}


def test_contamination_by_a_window_of_many_items(spark):
    """A passage that a third of the items and most documents share; ids are sorted as strings."""
    passage = " ".join(f"w{i}" for i in range(14))
    benchmark = spark.range(1500).selectExpr("id AS item_id", f"IF(id % 3 = 0, '{passage}', concat('item ', id)) AS text")
    documents = spark.range(400).selectExpr("id AS doc_id", f"IF(id % 4 = 0, 'other words', upper('{passage}')) AS text")
    ids = ",".join(sorted(str(i) for i in range(0, 1500, 3)))
    rows = decontaminate.find_contamination(documents, benchmark).select("doc_id", "contamination.*").collect()
    assert len(rows) == 400
    shared = (14, 14, 500, hashlib.sha256(ids.encode()).hexdigest(), True)
    clean = (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert all(tuple(r)[1:] == (shared if r.doc_id % 4 else clean) for r in rows)


def test_words_of_contamination_are_those_of_the_contract(monkeypatch):
    """Words hashed over bytes, in pieces too, are the words of the pattern; equal words have equal hashes."""
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 7)
    texts = ["", "A b\u00c4 c9_d", " -- ", "\U0001f600x, MIT mit\x00Mit", "z" * 3000 + " end"]
    found = decontaminate._Words([t.encode() for t in texts])
    spelled = [found.spell(i, 1) for i in range(len(found.hashes))]
    assert spelled == [w for t in texts for w in words(t)]
    assert len(set(found.hashes.tolist())) == len(set(spelled))
    assert len(dict(zip(spelled, found.hashes.tolist()))) == len(set(zip(spelled, found.hashes.tolist())))


def test_contamination_of_odd_and_empty_tables(spark, odd, nothing, small):
    assert decontaminate.find_contamination(odd, small("benchmark")).count() == odd.count()
    assert decontaminate.without_contamination(odd, small("benchmark").limit(0)).columns == odd.columns
    assert decontaminate.without_contamination(odd, small("benchmark").limit(0)).count() == odd.count()
    assert decontaminate.find_contamination(nothing, small("benchmark")).count() == 0


# shards

def check_shards(documents, rows, n):
    texts = {}
    for r in documents:
        texts.setdefault(r.doc_id, []).append(r.text or "")
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n)) and len(rows) == len(documents)
    last = None
    for shard in sorted(by):
        members = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in members]
        assert ids == sorted(ids) and (last is None or last <= ids[0])  # contiguous in one order
        last = ids[-1]
        assert abs(sum(r.size for r in members) - total / n) <= max(r.size for r in rows)


def test_shards_are_contiguous_and_balanced(small):
    documents = small("documents")
    rows = shards.shard_by_bytes(documents, SHARDS).collect()
    check_shards(documents.collect(), rows, SHARDS)
    assert sorted(rows) == sorted(shards.shard_by_bytes(documents.repartition(7), SHARDS).collect())


def test_shards_of_repeated_odd_and_no_rows(spark, odd, nothing):
    rows = spark.createDataFrame([(5, "same text", "x")] * 3000 + [(6, "y", "z")], "doc_id long, text string, shard string")
    check_shards(rows.collect(), shards.shard_by_bytes(rows, 7).collect(), 7)
    assert shards.shard_by_bytes(odd, 3).count() == odd.count()
    assert shards.shard_by_bytes(nothing, 3).count() == 0


# urls

def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


URLS = ["http://example.org/es/x", "https://A.Example.ORG/en/123?q=1#x", "ftp://x.org", "http://org/", "example.org/es/", None, "", "http://",
        "http://notexample.com/de/", "http://x.com/de/y", "http://x.com/fr?x=/fr/", "http://x.com/fr/://y.org/", "http://com/fr/", "://b.org/?",
        "http://.org/a", "http://x..com/de/", "http://x.com#/de/", "http://example.org:80/es/", "http://é.org/ü"]


def test_urls_match_brute_force(spark, small):
    pages = small("pages").select("page_id", "url").union(spark.createDataFrame(list(enumerate(URLS, 10**6)), "page_id long, url string"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = url_filter.filter_urls(pages, rules).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url)


def test_urls_of_odd_and_empty_tables(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("a.b", "/", "allow"), ("A.b", "/", "block"), ("", "", "block"), ("c", "", "block")],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.a.b/", "r", "v")] * 2 + [(None, None, None, None), (2, "x://c", "", "")],
                                  "page_id long, url string, rule string, host string")
    rows = url_filter.filter_urls(pages, rules).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "a.b/", "block")] * 2 + [(None, None, "allow"), (2, "c", "block")], key=str)
    named = url_filter.filter_urls(pages.withColumn("rule_verdict", F.lit("own")), rules)
    assert {r.rule_verdict for r in named.collect()} == {"own"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
