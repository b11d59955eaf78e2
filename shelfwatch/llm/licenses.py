"""License scan by ordered signature rules.

A rule is a regular expression for one way of stating one license, with a keyword, a priority and a confidence. Rules come
from families (names, versions, identifiers) times statement forms, some three hundred in all, most specific first. A text
that holds no keyword is never scanned; a rule runs only if its keyword is in the text. Of overlapping detections the one of
higher priority wins: a detection that lies within the interval of one of higher (or equal) priority is suppressed.

Rules and keywords are matched on folded text: a run of blanks, line breaks and the comment marks next to them is one blank, and
a line break after a hyphen is nothing. Detections are reported by their places in the text itself.

The gate and the word count are Spark expressions; only texts that pass the gate go to the Python workers, in Arrow batches.
Nothing is shuffled.

Next to the rules stand base phrases, whose words stand consecutively whatever lies between them. They are always reported.

Defined cases: a null text is empty: no words, no places, empty label lists, score 0. Repeated documents are scanned one by
one. Whole texts of any length are scanned. Further columns stay; ``licenses`` of the input is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import WORD, WORD_EITHER_CASE, ascii_lower, in_small_batches, text_of

# Base phrases and their labels.
BASE = {
    ("gnu", "general", "public", "license"): "gpl",
    ("apache", "license"): "apache",
    ("cc", "by"): "cc-by",
    ("mit", "license"): "mit",
}

# License families: label, keyword, pattern of the name, versions, needs the word "license" after the name.
FAMILIES = [
    ("gpl", "general public", r"(?:gnu )?(?<!lesser )(?<!affero )general public", ("1.0", "2.0", "3.0"), True),
    ("gpl", "gpl", r"(?:gnu )?(?<![la])gpl", ("1.0", "2.0", "3.0"), False),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public", ("2.0", "2.1", "3.0"), True),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2.0", "2.1", "3.0"), False),
    ("agpl", "affero general public", r"(?:gnu )?affero general public", ("1.0", "3.0"), True),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1.0", "3.0"), False),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", ("1.1", "1.2", "1.3"), True),
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0"), True),
    ("mit", "mit", r"(?:the )?\bmit", (), True),
    ("bsd-2-clause", "bsd", r"(?:2-clause|two-clause|simplified) bsd", (), True),
    ("bsd-3-clause", "bsd", r"(?:3-clause|three-clause|new|modified) bsd", (), True),
    ("bsd-4-clause", "bsd", r"(?:4-clause|four-clause|original) bsd", (), True),
    ("mpl", "mozilla public", r"mozilla public", ("1.0", "1.1", "2.0"), True),
    ("epl", "eclipse public", r"eclipse public", ("1.0", "2.0"), True),
    ("cddl", "common development and distribution", r"common development and distribution", ("1.0", "1.1"), True),
    ("eupl", "european union public", r"european union public", ("1.0", "1.1", "1.2"), True),
    ("cecill", "cecill", r"cecill", ("1.0", "2.0", "2.1"), False),
    ("artistic", "artistic", r"artistic", ("1.0", "2.0"), True),
    ("isc", "isc", r"\bisc", (), True),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?", (), True),
    ("boost", "boost software", r"boost software", ("1.0",), True),
    ("ofl", "open font", r"(?:sil )?open font", ("1.0", "1.1"), True),
    ("odbl", "open database", r"open database", ("1.0",), True),
    ("wtfpl", "wtfpl", r"wtfpl", ("2.0",), False),
    ("postgresql", "postgresql", r"postgresql", (), True),
    ("python", "python software foundation", r"python software foundation", ("2.0",), True),
    *[(f"cc-{terms}", "cc", rf"\bcc[ -]{terms}", ("1.0", "2.0", "2.5", "3.0", "4.0"), False)
      for terms in ("by-nc-sa", "by-nc-nd", "by-nc", "by-sa", "by-nd", "by")],
    *[(f"cc-{label}", "creative commons", rf"creative commons (?:{name})", ("1.0", "2.0", "2.5", "3.0", "4.0"), False)
      for label, name in (
          ("by-nc-sa", "attribution[ -]non-?commercial[ -]share-?alike"),
          ("by-nc-nd", "attribution[ -]non-?commercial[ -]no-?deriv\\w+"), ("by-nc", "attribution[ -]non-?commercial"),
          ("by-sa", "attribution[ -]share-?alike"), ("by-nd", "attribution[ -]no-?deriv\\w+"), ("by", "attribution"))],
]

# Statements without a family: label, keyword, pattern, confidence.
STATEMENTS = [
    ("cc0", "cc0", r"\bcc0(?:[ -]1\.0)?\b", 0.9),
    ("cc0", "creative commons zero", r"creative commons zero", 0.9),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.8),
    ("unlicense", "unlicense", r"\bunlicense\b", 0.8),
    ("all-rights-reserved", "rights reserved", r"\ball rights reserved\b", 0.7),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 0.5),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 0.9),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person", 0.95),
    ("license-mention", "licen", r"\b(?:licen[cs]ed|released|distributed|available) under\b", 0.3),
]

# What a text must contain, lower-cased, to be scanned: every keyword above contains one of these or is listed itself.
GATE = sorted({"licen", "spdx", *[k for _, k, *_ in FAMILIES if k not in ("cc", "mit", "isc", "artistic", "apache")],
               *[k for _, k, *_ in STATEMENTS], "cc-by", "cc by", "apache", "artistic"})


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int      # the larger wins
    confidence: float
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, first the most specific."""
    out = []

    def add(label, keyword, priority, confidence, pattern):
        out.append(Rule(label, keyword, priority, confidence, re.compile(pattern)))

    lead = r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"
    published = r"(?:,? as published by the free software foundation[,;:]?(?: either)?)?"
    for label, keyword, name, versions, wants_word in FAMILIES:
        word = r" licen[cs]e" if wants_word else r"(?: licen[cs]e)?"
        for v in versions:
            number = re.escape(v) if not v.endswith(".0") else re.escape(v[:-2]) + r"(?:\.0)?"
            version = rf"{published},?(?: \(\w+\))?[ -](?:version |v\.? ?)?{number}(?![\d.]*\d)"
            add(f"{label}-{v}", keyword, 50, 1.0, rf"{lead}{name}{word}{version}")
            add(f"{label}-{v}-or-later", keyword, 60, 1.0, rf"{name}{word}{version}(?:(?: of the licen[cs]e)?,? or (?:\(at your option\) )?(?:any )?later|\+)")
            add(f"{label}-{v}", keyword, 40, 0.9, rf"{name}{word}{version}")
            add(f"{label}-{v}", "spdx", 70, 1.0, rf"spdx-license-identifier: {re.escape(label)}-{re.escape(v)}(?:-only)?\b(?!-)")
            add(f"{label}-{v}-or-later", "spdx", 71, 1.0, rf"spdx-license-identifier: {re.escape(label)}-{re.escape(v)}-or-later\b")
        add(label, keyword, 30, 0.8, rf"{lead}{name}{word}\b")
        add(label, keyword, 20, 0.6, rf"{name}{word}\b")
        add(label, "spdx", 65, 1.0, rf"spdx-license-identifier: {re.escape(label)}(?![\w.-])")
    for label, keyword, pattern, confidence in STATEMENTS:
        add(label, keyword, 10 if label == "license-mention" else 35, confidence, pattern)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label)))


@cache
def _by_keyword() -> dict[str, list[Rule]]:
    out = defaultdict(list)
    for rule in rules():
        out[rule.keyword].append(rule)
    return dict(out)


MARK = r"(?:[*/#;%!|>]++|--++>?|<!--++|(?:dnl|rem)(?=\s))"
GAP = re.compile(rf"(?:[^\S\r\n]++{MARK})?[^\S\r\n]*+(?:[\r\n]\s*+(?:{MARK}\s*+)*+)++|[^\S\r\n]++")


def folded(lowered: str) -> tuple[str, list[int], list[int]]:
    """The text with each gap as one blank; places in it after gaps of other length, and how much the text is longer there."""
    parts, at, more, done, length, removed = [], [], [], 0, 0, 0
    for m in GAP.finditer(lowered):
        gap, start = m[0], m.start()
        if gap == " ":
            continue
        wrapped = start > 1 and lowered[start - 1] == "-" and lowered[start - 2].isalnum() and ("\n" in gap or "\r" in gap)
        blank = "" if wrapped else " "
        parts += lowered[done:start], blank
        length += start - done + len(blank)
        removed += len(gap) - len(blank)
        done = m.end()
        at.append(length)
        more.append(removed)
    return "".join([*parts, lowered[done:]]), at, more


def detect(lowered: str) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in a lower-cased text, by start, suppressed ones left out."""
    flat, at, more = folded(lowered)
    more = [0, *more]

    def place(i: int) -> int:
        return i + more[bisect_right(at, i)]

    found = {
        (place(m.start()), place(m.end() - 1) + 1, rule)
        for keyword, held in _by_keyword().items() if keyword in flat
        for rule in held for m in rule.pattern.finditer(flat)
    }
    # a containing interval starts no later and ends no earlier: sweep by start, longest first, over what is still open
    kept, reach = [], defaultdict(int)  # priority -> farthest end so far
    for start, end, rule in sorted(found, key=lambda d: (d[0], -d[1], -d[2].priority, d[2].label)):
        if all(reach[p] < end for p in reach if p >= rule.priority):
            kept.append((start, end, rule))
        reach[rule.priority] = max(reach[rule.priority], end)
    return kept


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word's position, label) of each base phrase."""
    starts = {phrase[0]: [] for phrase in BASE}
    for i, word in enumerate(words):
        if word in starts:
            starts[word].append(i)
    return sorted(
        (i, label) for phrase, label in BASE.items() for i in starts[phrase[0]]
        if tuple(words[i:i + len(phrase)]) == phrase
    )


RESULT = ("n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "detections array<struct<label:string,start:int,end:int,confidence:double>>")


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        if text is None:
            rows.append((0, None, None, "", "", 0.0, []))
            continue
        places = base_places(re.findall(WORD, text))
        found = detect(text)
        base = {label for _, label in places}
        confidence = max([1.0 if places else 0.0, *(rule.confidence for _, _, rule in found)])
        rows.append((
            len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted(base)), ",".join(sorted(base | {rule.label for _, _, rule in found})), confidence,
            [(rule.label, start, end, rule.confidence) for start, end, rule in found],
        ))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
    return frame.astype({"first_word": "Int64", "last_word": "Int64"})


def passes_gate(text: Column) -> Column:
    lowered = F.lower(text)
    # base words with anything between them; no \b, which takes the separator _ for part of a word
    gate = lowered.rlike("cc" + WORD.replace("[^", "[", 1) + "by")
    gate = F.when(lowered.contains("cc"), gate).otherwise(F.lit(False))
    for keyword in GATE:  # its words, as a keyword may be wrapped
        gate = gate | reduce(Column.__and__, [lowered.contains(word) for word in keyword.split()])
    return gate


def scan_licenses(documents: DataFrame, into: str = "licenses") -> DataFrame:
    """The documents with one more column, a struct of n_words and the fields of ``RESULT``."""
    scan, text = F.pandas_udf(_scan, RESULT), text_of()
    found = in_small_batches(documents).withColumn(into, scan(F.when(passes_gate(text), ascii_lower(text))))
    names = [c.split()[0] for c in RESULT.split(", ")]
    return found.withColumn(into, F.struct(
        F.regexp_count(text, F.lit(WORD_EITHER_CASE)).cast("bigint").alias("n_words"),
        *[F.col(into)[n].alias(n) for n in names]))
