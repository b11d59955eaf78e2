"""Self-join on Jaccard similarity of word 5-grams by chosen paths.

Texts with the same set of shingles are one class. A class is sketched by minhashes: each is a token drawn from the set so
that two sets draw the same one with a probability equal to their similarity. One run of the join splits all sets by a drawn
token, and splits buckets that are too large again by the next; the drawn tokens are the path. Sets that meet in a bucket are
compared exactly. Runs draw independently and are repeated until a pair at the threshold fails to meet with a probability below
``MISS``. A run finds it with probability 0.8 by one token, 0.64 by two, so what lies in a bucket that is split takes part in
more runs (``RUNS``) than the rest (``FIRST_RUNS``): a pair either draws a common first token in one of the first runs, or it is
missed; if that bucket is split, both are in all runs and agree on both tokens in one of them.

- Paths are joined on narrow rows (class, run, path); buckets of one class end there, which leaves few.
- Bucket members are first compared by sketch, size and path: a pair belongs to the first run in which it meets, so each is
  compared and counted once and no list of pairs is needed. Only classes that still have a partner fetch their text.
- A bucket that stays too large is cut into blocks; every pair of blocks is a group of its own. Memory per task is bounded
  and no link is lost, however many near copies there are.
- A bucket yields one row per class: how many documents it links to, and one edge that ties it to its component.

Defined cases: texts shorter than five words have one shingle of all words; texts without words are alike only if equal;
null texts are empty ones. Repeated documents and exact copies count as links of each other. ``class_id`` is the smallest
doc_id of the component (nulls last). An empty table gives an empty result. Further columns stay in ``mark_groups``, where
``class_id``, ``n_links`` and ``kept`` of the input are replaced; names that start with ``_`` are reserved. ``keep_one`` keeps
all columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import WORD, ascii_lower, in_few_files, in_small_batches, spread_groups, text_of
from shelfwatch.llm.components import components, smallest_reachable, with_first

SHINGLE_WORDS = 5
THRESHOLD = 0.8
SPLITS = 2              # at most, in one run; what is still too large is cut into blocks, which loses nothing
MISS = 1e-8             # chance that a pair at the threshold never meets, whatever is split
FIRST_RUNS, RUNS = (math.ceil(math.log(MISS / 2) / math.log(1 - THRESHOLD**splits)) for splits in (1, SPLITS))
SKETCH = RUNS * SPLITS
BUCKET_ROWS = 3000      # compared in one task
BUCKET_SHINGLES = 3_000_000
MIXED_WORDS = 1 << 17   # hashed at once

_words = re.compile(WORD).findall

def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACES = _odd_numbers(SHINGLE_WORDS, 1)
DRAWS, SHIFTS = _odd_numbers(SKETCH, 2), _odd_numbers(SKETCH, 3)


class _WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_sets(lowered: Iterable[str], hashes: _WordHashes) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, in order; words of many texts are mixed at once."""
    held, n_held = [], 0
    for text in lowered:
        words = _words(text)
        held.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        n_held += len(words)
        if n_held > MIXED_WORDS:
            yield from _mixed_sets(held)
            held, n_held = [], 0
    if held:
        yield from _mixed_sets(held)


def _mixed_sets(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """From the word hashes of each text, the sorted distinct shingles."""
    h, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    total = np.full(len(h), SHINGLE_WORDS, np.uint64)  # of the shingle that starts at a word, if its text goes on so long
    for i in range(SHINGLE_WORDS):
        total[:len(h) - i] += _mixed(h[i:] * PLACES[i])
    total = _mixed(total)
    for words, end in zip(texts, ends):
        if len(words) < SHINGLE_WORDS:
            yield _short_set(words)
            continue
        found = np.sort(total[end - len(words):end - SHINGLE_WORDS + 1])
        yield found[np.concatenate([[True], found[1:] != found[:-1]])]


def _short_set(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    total = np.full(1, len(words), np.uint64)
    for i in range(len(words)):
        total += _mixed(words[i:i + 1] * PLACES[i])
    return _mixed(total)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 2048):
        drawn = (shingles[start:start + 2048] * DRAWS[:, None] + SHIFTS[:, None]).min(1)
        low = np.minimum(low, (drawn >> np.uint64(32)).astype(np.uint32))
    return low.view(np.int32)


def _describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = _WordHashes()
    for texts in batches:
        rows = []
        for text, shingles in zip(texts, shingle_sets(texts, hashes)):
            whole = shingles.tobytes() if len(shingles) else text.encode("utf-8", "surrogatepass")
            rows.append((hashlib.md5(whole).hexdigest() + ("" if len(shingles) else "-"), len(shingles), _sketch(shingles)))
        yield pd.DataFrame(rows, columns=["key", "n", "sketch"])


def _buckets(classes: DataFrame) -> tuple[DataFrame, int]:
    """Buckets of at least two classes: run, path, rows, shingles, _c; and the number of runs. Classes in a bucket that is too
    large take part in the further runs."""
    token = lambda split: F.get("_sketch", F.col("run") * SPLITS + split)
    small = (F.col("rows") <= BUCKET_ROWS) & (F.col("shingles") <= BUCKET_SHINGLES)

    def first_tokens(of: DataFrame, start: int, end: int) -> DataFrame:
        return (
            of.filter("_n > 0").select("_c", "_n", "_sketch", F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("run"))
            .select("run", F.xxhash64("run", token(0)).alias("path"), "_c", "_n")
        )

    def shared_only(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("run", "path").agg(F.count("*").alias("rows"), F.sum("_n").alias("shingles"))
        return store(rows.join(sizes.filter("rows > 1"), ["run", "path"]), "buckets")

    columns = ["run", "path", "rows", "shingles", "_c"]
    shared = shared_only(first_tokens(classes, 0, FIRST_RUNS))
    large = shared.filter(~small)
    if not large.head(1):
        return shared.select(columns), FIRST_RUNS
    again = classes.join(large.select("_c").distinct(), "_c", "left_semi")
    shared = shared.unionByName(shared_only(first_tokens(again, FIRST_RUNS, RUNS)))
    leaves = [shared.filter(small).select(columns)]
    for split in range(1, SPLITS):
        rows = (
            shared.filter(~small).join(classes.select("_c", "_sketch"), "_c")
            .select("run", F.xxhash64("path", token(split)).alias("path"), "_c", "_n")
        )
        shared = shared_only(rows)
        leaves.append((shared if split == SPLITS - 1 else shared.filter(small)).select(columns))
    return reduce(DataFrame.unionByName, leaves), RUNS


def _groups(classes: DataFrame) -> DataFrame:
    """Members of each group to compare: run, path, i, j (blocks), block, and the class's columns and paths.

    A bucket within bounds is one block, one group (0, 0).
    """
    buckets, runs = _buckets(classes)
    own = (
        buckets.groupBy("_c")
        .agg(F.collect_list(F.struct("run", "path", "rows", "shingles")).alias("own"))  # at most one of each run
    )
    met = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(  # 0: alone in that run
        F.get(F.filter("own", lambda o: o["run"] == r), F.lit(0))["path"], F.lit(0)))
    rows = store(in_few_files(own.withColumn("paths", met), "_c").select("_c", "paths", F.inline("own")), "paths")
    # where all members met in one earlier bucket, no pair is new
    edges = [f(F.col("paths")[r]).alias(f"{name}_{r}") for r in range(runs - 1) for name, f in (("low", F.min), ("high", F.max))]
    together = F.lit(False)
    for r in range(runs - 1):
        together = together | ((F.col("run") > r) & (F.col(f"low_{r}") == F.col(f"high_{r}")) & (F.col(f"low_{r}") != 0))
    news = rows.groupBy("run", "path").agg(*edges).filter(~together)
    blocks = F.ceil(F.greatest(F.col("rows") / BUCKET_ROWS, F.col("shingles") / BUCKET_SHINGLES))
    number = F.pmod(F.xxhash64("_c"), F.col("blocks")).cast("int")
    return (
        rows.join(news, ["run", "path"], "left_semi")
        .withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("bigint"))
        .withColumn("block", number)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        .select("run", "path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "_c", "paths")
        .join(classes.select("_c", "_n", "_sketch", "copies"), "_c")
    )


GROUP = ["run", "path", "i", "j"]


def _fewer_agree(least: int) -> float:
    """Chance that a pair at the threshold agrees on fewer of its minhashes."""
    return sum(math.comb(SKETCH, k) * THRESHOLD**k * (1 - THRESHOLD) ** (SKETCH - k) for k in range(least))


# pairs that agree on fewer minhashes are not compared exactly
LEAST_AGREEING = max(k for k in range(SKETCH) if _fewer_agree(k) <= 1e-9)


PAIRS = 1 << 15  # compared by sketch at once


def _starts(columns: Mapping[str, np.ndarray]) -> np.ndarray:
    """The rows with which the groups begin, of rows sorted by group."""
    keys = np.stack([columns[c] for c in GROUP])
    return np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))


def _pairs(columns: Mapping[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by group: the pairs (row, later row) that may be similar and are compared in this group."""
    n, sketch, paths, run, block = (columns[c] for c in ("_n", "_sketch", "paths", "run", "block"))
    crossing = columns["i"] != columns["j"]
    starts, place, runs = _starts(columns), np.arange(len(n)), np.arange(paths.shape[1])
    ends = np.append(starts[1:], len(n))
    partners = np.repeat(ends, ends - starts) - place - 1  # the later rows of each row's group
    upto = np.concatenate([[0], np.cumsum(partners)])
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, "right")) - 1)
        a = np.repeat(place[first:last], partners[first:last])
        b = a + 1 + np.arange(len(a)) - (upto[a] - upto[first])
        first = last
        allowed = (np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b])) & (~crossing[a] | (block[a] != block[b]))
        a, b = a[allowed], b[allowed]
        met = (paths[a] == paths[b]) & (paths[a] != 0) & (runs < run[a, None])  # in an earlier run
        a, b = a[~met.any(1)], b[~met.any(1)]
        alike = (sketch[a] == sketch[b]).sum(1) >= LEAST_AGREEING
        yield a[alike], b[alike]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """Rows sorted by group, in pieces that no group lies across, and what ``_pairs`` reads of them."""
    def columns_of(rows, names):
        return {c: rows[c].to_numpy() for c in names}

    def piece(rows):
        lists = {c: np.stack(rows[c].to_numpy()) for c in ("_sketch", "paths")}
        return rows, columns_of(rows, [*GROUP, "block", "_n"]) | lists

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        last = _starts(columns_of(held, GROUP))[-1] if len(held) else 0
        if last:
            yield piece(held.slice(0, last))
            held = held.slice(last)
    if held is not None and len(held):
        yield piece(held)


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that may be similar to another. Most groups are a few rows, so many are compared at once."""
    for rows, columns in _whole_groups(batches):
        keep = np.zeros(len(rows), bool)
        for a, b in _pairs(columns):
            keep[a] = keep[b] = True
        yield from rows.filter(pa.array(keep)).to_batches()


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Compare exactly: for each member with a link, the number of documents it links to and its component in the group."""
    frame = frame.sort_values("_c").reset_index(drop=True)
    sets = [np.frombuffer(b, np.uint64) for b in frame["set"]]
    n, copies = frame["_n"].to_numpy(), frame["copies"].to_numpy()
    columns = {c: frame[c].to_numpy() for c in [*GROUP, "block", "_n"]}
    columns |= {c: np.stack(frame[c].to_numpy()) for c in ("_sketch", "paths")}
    possible, linked = np.zeros((len(n), len(n)), bool), np.zeros((len(n), len(n)), bool)
    for a, b in _pairs(columns):
        possible[a, b] = True
    if possible.sum() <= 2 * len(n):
        for a, b in np.argwhere(possible):
            shared = np.intersect1d(sets[a], sets[b], assume_unique=True).size
            linked[a, b] = linked[b, a] = shared >= THRESHOLD * (n[a] + n[b] - shared) - 1e-9
    else:
        # tokens of one set only cannot be shared
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        tokens = tokens[counts > 1]
        held = [np.searchsorted(tokens, s[np.isin(s, tokens, assume_unique=True)]) for s in sets]
        possible |= possible.T
        for start in range(0, len(n), 256):
            allowed = possible[start:start + 256]
            if not allowed.any():
                continue
            shared = np.zeros(allowed.shape, np.float32)
            for first in range(0, len(tokens), 2048):
                has = np.zeros((len(n), 2048), np.float32)
                for k, h in enumerate(held):
                    has[k, h[np.searchsorted(h, first):np.searchsorted(h, first + 2048)] - first] = 1
                shared += has[start:start + len(allowed)] @ has.T
            both = n[start:start + len(allowed), None] + n
            linked[start:start + len(allowed)] = allowed & (shared >= THRESHOLD * (both - shared) - 1e-9)
    links = linked @ copies
    root = smallest_reachable(linked)
    some = links > 0
    keys = frame["_c"].to_numpy()
    return pd.DataFrame({"_c": keys[some], "links": links[some], "root": keys[root[some]]})


def _described(documents: DataFrame) -> DataFrame:
    """The documents, written with their place, class key, number of shingles and sketch."""
    about = F.pandas_udf(_describe, "key string, n int, sketch array<int>")(ascii_lower(text_of()))
    return store(
        in_small_batches(documents).withColumn("_about", about).select(
            *documents.columns, F.monotonically_increasing_id().alias("_place"), F.col("_about.key").alias("_key"),
            F.col("_about.n").alias("_n"), F.col("_about.sketch").alias("_sketch")), "described")


def _join_classes(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with a number ``_c``, and the links found: _c, links, root (a number too)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col("_place").alias("place")))
    classes = store(
        described.groupBy("_key").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("_n").alias("_n"),
                                      F.any_value("_sketch").alias("_sketch"))
        .withColumn("_c", F.monotonically_increasing_id()), "classes")
    members = _groups(classes)
    wanted = store(
        spread_groups(members, GROUP).sortWithinPartitions(*GROUP).mapInArrow(_with_partner, members.schema), "members")
    texts = (
        described.select("_place", "text")
        .join(wanted.select("_c").distinct().join(classes.select("_c", F.col("first.place").alias("_place")), "_c"), "_place")
    )

    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _WordHashes()
        for batch in batches:
            yield pd.Series([found.tobytes() for found in shingle_sets(batch, hashes)])

    as_set = F.pandas_udf(sets, "binary")(ascii_lower(text_of()))
    full = wanted.join(texts.select("_c", as_set.alias("set")), "_c")
    return classes, store(
        spread_groups(full, GROUP).groupBy(*GROUP).applyInPandas(_linked, "_c bigint, links bigint, root bigint"), "links")


RESULT = ("class_id", "n_links", "kept")


def mark_groups(documents: DataFrame) -> DataFrame:
    """The documents (text as a column) with class_id, n_links and kept: one row of each group of linked documents is kept,
    the one of the smallest doc_id."""
    described = _described(documents)
    classes, links = _join_classes(described)
    of = components(links.select(F.col("_c").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("_c", "_key", "first", "copies")
        .join(links.groupBy("_c").agg(F.sum("links").alias("links")), "_c", "left")
        .join(of.withColumnRenamed("node", "_c"), "_c", "left")
        .withColumn("component", F.coalesce("component", "_c"))
    )
    judged = store(with_first(known).select(
        "_key", F.col("component_first.doc_id").alias("_class"), F.col("component_first.place").alias("_kept"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links")), "judged")
    return described.join(judged, "_key").select(
        *[c for c in documents.columns if c not in RESULT], F.col("_class").alias("class_id"), F.col("_links").alias("n_links"),
        (F.col("_place") == F.col("_kept")).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group, with its own columns."""
    marked = mark_groups(documents.withColumnsRenamed({c: f"own_{c}" for c in RESULT if c in documents.columns}))
    return marked.filter("kept").drop(*RESULT).toDF(*documents.columns)
