"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

Contamination is containment: every run of ``window`` item words (or the whole of a shorter item) that occurs in a document
marks the words it covers. Containment is a set join with threshold 1, so one shingle of a window suffices as its prefix
filter, and the rarest one meets the fewest documents:

1. items are cut into windows, a table of (words, item); equal windows of several items are looked for once;
2. the shingles (adjacent word pairs) of all windows are counted over all documents;
3. each window is filed under its rarest shingle, with the shingle's offset in the window;
4. one pass over the documents: at each shingle under which a window is filed, the filed offsets and lengths give the only
   possible windows, which must lie within the document (positional and length bound); those whose hash is that of a
   window are candidates, with their words;
5. candidates are joined with the windows by their words, which is the exact comparison, and with the items after that.

Tasks know the benchmark only by two filters of at most ``2 ** MOST_BITS`` bits, whatever its size, and by the offsets and
lengths, at most ``window`` squared; a filter lets some strangers pass, which step 5 removes, and nothing else. So there is
one pass for any number of windows, and neither windows nor items go through the driver.

Documents with the same candidate words ask the join as one set, so a passage that a third of the documents holds is one
question; the answer is dealt back over ``SALTS`` parts. Documents without a candidate, nearly all, are not shuffled. The
items of one set, which its digest needs in order, lie in one row: at most the ids of the benchmark.

Defined cases: a null text has no words; an item without words has no window; a null item_id is the id "null"; equal item
ids are one item; repeated documents are judged one by one; with an empty benchmark nothing is hit. Words are hashed from
pieces of very long texts, of which only numbers are kept. Further columns of the documents stay, of whatever name, but for
one named as ``into``, which is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import WORD, ascii_lower, in_small_batches, text_of

WINDOW = 13
LEAST_PERCENT = 5            # of a contaminated document's words that are hit
MOST_BITS = 28               # of a filter, as a power of two: 32 MB
BITS_A_SHINGLE = 64          # of a smaller filter
SALTS = 16                   # parts over which the documents of one set of candidates are dealt
RUN_BYTES = 1 << 20          # texts hashed together; a longer one alone
PIECE_BYTES = 1 << 18        # bytes hashed at a time
FLUSH = 1 << 20              # hashes that a counting task holds

SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
IS_WORD = np.array([not SEPARATOR.match(bytes([b])) for b in range(256)])
_draw = np.random.default_rng(13)
BYTES = np.where(IS_WORD, _draw.integers(1, 2**64, 256, np.uint64), np.uint64(0))
BYTES[65:91] = BYTES[97:123]  # A-Z as a-z
PLACES = _draw.integers(0, 2**63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)

CANDIDATES = "array<struct<start:int,end:int,words:string>>"
DESCRIBED = pa.schema([("words", pa.string()), ("size", pa.int32()), ("whole", pa.int64()), ("shingles", pa.list_(pa.int64()))])
COUNTED = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per different window and item that contains it: words (joined by one blank) and item_id."""
    words = F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))).alias("words"))
        .distinct()
    )


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lots of (number of the text, offset, piece) of about PIECE_BYTES; longer texts are cut where no word is."""
    lot, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            cut = SEPARATOR.search(text, start + PIECE_BYTES)
            end = cut.start() if cut else len(text)
            lot.append((number, start, text[start:end]))
            size += end - start
            start = end
            if size >= PIECE_BYTES:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


class _Words:
    """The words of some texts, one text after the other: number of the text, first and last byte, 64-bit hash."""

    def __init__(self, texts: list[bytes]):
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        for lot in _pieces(texts):
            numbers, offsets = (np.array([piece[k] for piece in lot]) for k in (0, 1))
            base = np.cumsum([0, *(len(piece) + 1 for *_, piece in lot[:-1])])
            data = np.frombuffer(b" ".join(piece for *_, piece in lot), np.uint8)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], IS_WORD[data], [False]]).view(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            first = starts[0]
            place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
            hashes = _mixed(np.add.reduceat(BYTES[data[first:]] * PLACES[place & 1023], starts - first))
            piece = np.searchsorted(base, starts, "right") - 1
            shift = offsets[piece] - base[piece]
            parts.append((numbers[piece], starts + shift, ends + shift, hashes))
        self.number, self.start, self.end, self.hashes = map(np.concatenate, zip(*parts))
        self.sizes = np.bincount(self.number, minlength=len(texts))
        self.upto = np.cumsum(self.sizes)
        self.texts = texts

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that have a next one in their text, and the hash of both."""
        at = np.flatnonzero(self.number[:-1] == self.number[1:])
        return at, _mixed(self.hashes[at] * PLACES[0] + self.hashes[at + 1] * PLACES[1])

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, and their hashes as shingles of one word."""
        return np.arange(len(self.hashes)), _mixed(self.hashes * PLACES[2])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words that start at the given ones."""
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total += self.hashes[at + k] * PLACES[k % 1024]
        return _mixed(total)

    def spell(self, at: int, size: int) -> str:
        text = self.texts[self.number[at]]
        words = [text[a:b] for a, b in zip(self.start[at:at + size].tolist(), self.end[at:at + size].tolist())]
        return b" ".join(words).lower().decode(errors="replace")


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about RUN_BYTES."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


class _Filter:
    """A set of 64-bit hashes by their leading bits: holds every one of them, and some others."""

    def __init__(self, hashes: DataFrame, bits: int):
        """From a table with one column of hashes. At most 2 ** bits bits reach the driver, in rows of 4 KB."""
        place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
        rows = (
            hashes.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("part"))
            .agg(F.bitmap_construct_agg(F.pmod("place", F.lit(1 << 15))).alias("held")).collect()
        )
        self.shift = np.uint64(64 - bits)
        self.held = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
        for row in rows:
            self.held[row["part"] << 12:row["part"] + 1 << 12] = np.frombuffer(row["held"], np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, hash and shingles of each window."""
    for batch in batches:
        rows = []
        for window in batch.column(0).to_pylist():
            words = _Words([window.encode()])
            size = len(words.hashes)
            _, shingles = words.pairs() if size > 1 else words.singles()
            rows.append((window, size, words.windows(np.zeros(1, np.int64), size).view(np.int64)[0], shingles.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DESCRIBED)] if rows else
                                         [pa.array([], f.type) for f in DESCRIBED], schema=DESCRIBED)


def _count_shingles(documents: DataFrame, wanted: _Filter, singles: bool) -> DataFrame:
    """How often each shingle that passes occurs in all documents: shingle, n."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def counted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        shingles, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(n, pa.int64())], schema=COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found, size = shared.value, [], 0
        for batch in batches:
            for run in _runs(batch.column(0).to_pylist()):
                words = _Words(run)
                for _, hashes in [words.pairs()] + ([words.singles()] if singles else []):
                    found.append(hashes[wanted.passes(hashes)])
                    size += len(found[-1])
                if size >= FLUSH:
                    yield counted(found)
                    found, size = [], 0
        if size:
            yield counted(found)

    return (
        documents.select(text_of().cast("binary").alias("text")).mapInArrow(count, "shingle bigint, n bigint")
        .groupBy("shingle").agg(F.sum("n").alias("n"))
    )


def _file_windows(described: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window under its rarest shingle: words, size, whole, shingle, offset."""
    shingles = described.select("words", "size", "whole", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    return (
        shingles.join(counts, "shingle", "left").groupBy("words", "size", "whole").agg(rarest)
        .select("words", "size", "whole", "rarest.shingle", "rarest.offset")
    )


def _scan(documents: DataFrame, filed: DataFrame, bits: int, into: str) -> DataFrame:
    """The documents with ``into``: n_words and candidates."""
    places = [tuple(r) for r in filed.select("size", "offset").distinct().collect()]  # at most window squared
    shared = documents.sparkSession.sparkContext.broadcast(
        (_Filter(filed.select("shingle"), bits), _Filter(filed.select("whole"), bits), sorted(places)))

    def candidates(words: _Words) -> list[tuple[int, int]]:
        shingles, wholes, places = shared.value
        found = set()
        for single in (True, False):
            here = [(size, offset) for size, offset in places if (size == 1) == single]
            if not here:
                continue
            at, hashes = words.singles() if single else words.pairs()
            at = at[shingles.passes(hashes)]
            end = words.upto[words.number[at]]
            start = end - words.sizes[words.number[at]]
            for size, offset in here:
                first = (at - offset)[(at - offset >= start) & (at - offset + size <= end)]
                first = first[wholes.passes(words.windows(first, size))]
                found.update((int(i), size) for i in first)
        return sorted(found)

    def scan(texts: pd.Series) -> pd.DataFrame:
        n_words, found = [], []
        for run in _runs(list(texts)):
            words = _Words(run)
            of = [[] for _ in run]
            for at, size in candidates(words):
                number = words.number[at]
                first = at - int(words.upto[number] - words.sizes[number])
                of[number].append((first, first + size, words.spell(at, size)))
            n_words += words.sizes.tolist()
            found += of
        return pd.DataFrame({"n_words": n_words, "candidates": found})

    scanned = F.pandas_udf(scan, f"n_words bigint, candidates {CANDIDATES}")
    return documents.withColumn(into, scanned(text_of().cast("binary")))


def _hits(starts: pd.Series, ends: pd.Series, words: pd.Series, found: pd.Series) -> pd.Series:
    """Words covered by the candidates whose words were found."""
    hits = []
    for first, last, asked, answer in zip(starts, ends, words, found):
        hit, upto, known = 0, 0, set(() if answer is None else answer)
        for start, end in sorted((s, e) for s, e, w in zip(first, last, asked) if w in known):
            hit += max(0, end - max(start, upto))
            upto = max(upto, end)
        hits.append(hit)
    return pd.Series(hits, dtype="int64")


def _judge(documents: DataFrame, benchmark: DataFrame, window: int, filter_bits: int | None, into: str, items: bool) -> DataFrame:
    """The documents with ``into``; n_items and items_sha256 are only looked up if ``items``."""
    documents = in_small_batches(documents)
    windows = store(item_windows(benchmark, window), "windows")
    described = store(windows.select("words").distinct().mapInArrow(
        _describe, "words string, size int, whole bigint, shingles array<bigint>"), "described")
    total = described.agg(F.sum(F.size("shingles"))).first()[0] or 0
    bits = filter_bits or min(MOST_BITS, max(15, (BITS_A_SHINGLE * total).bit_length()))
    singles = bool(described.filter("size = 1").head(1))
    shingles = _Filter(described.select(F.explode("shingles")), bits)
    filed = store(_file_windows(described, _count_shingles(documents, shingles, singles)), "filed")
    scanned = store(_scan(documents, filed, bits, into), "scanned")

    c = F.col(into)
    asked = c["candidates"]["words"]
    key = F.sha2(F.array_join(F.array_sort(F.array_distinct(asked)), ","), 256)  # no word holds a comma
    some = F.size(c["candidates"]) > 0
    sets = store(scanned.filter(some).select(key.alias("set"), asked.alias("words")).distinct(), "sets") \
        .select("set", F.explode(F.array_distinct("words")).alias("words")).distinct()
    found = sets.join(filed.select("words"), "words")
    answers = found.groupBy("set").agg(F.collect_set("words").alias("found"))
    if items:
        found = store(found, "found")
        answers = found.groupBy("set").agg(F.collect_set("words").alias("found")).join(
            found.join(windows, "words").select("set", "item_id").distinct()
            .groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
            .select("set", F.size("ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("digest")), "set")
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    answer, salt = (f"{into}_{uuid.uuid4().hex}" for _ in range(2))  # names that no column has
    salted = salted.select(F.struct(*salted.columns).alias(answer))
    a = F.col(answer)
    asking = scanned.filter(some).withColumn(salt, F.monotonically_increasing_id() % SALTS)
    joined = asking.join(salted, (key == a["set"]) & (F.col(salt) == a["salt"]), "left")
    n_hit = F.pandas_udf(_hits, "bigint")(c["candidates"]["start"], c["candidates"]["end"], asked, a["found"])

    def verdict(df: DataFrame, n_hit, n_items, digest) -> DataFrame:
        # the number of hits is a column of its own first: used twice, it is computed once
        counted = df.withColumn(answer, F.struct(n_hit.alias("n_hit"), n_items.alias("n_items"), digest.alias("digest")))
        contaminated = (a["n_hit"] > 0) & (100 * a["n_hit"] >= LEAST_PERCENT * c["n_words"])
        judged = [c["n_words"].alias("n_words"), a["n_hit"].alias("n_hit")]
        if items:
            judged += [a["n_items"].alias("n_items"), a["digest"].alias("items_sha256")]
        return counted.withColumn(into, F.struct(*judged, contaminated.alias("contaminated"))).select(*documents.columns, *(
            [] if into in documents.columns else [into]))

    none, empty = F.lit(0).cast("bigint"), F.sha2(F.lit(""), 256)
    plain = verdict(scanned.filter(~some), none, none, empty)
    return plain.unionByName(verdict(
        joined, n_hit, F.coalesce(a["n_items"], none) if items else none, F.coalesce(a["digest"], empty) if items else empty))


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, filter_bits: int | None = None, into: str = "contamination",
) -> DataFrame:
    """The documents with one more column, ``into`` (one of that name is replaced): a struct of n_words, n_hit, n_items, items_sha256 and
    contaminated. ``filter_bits`` sets the filters' size as a power of two, for any of which the result is the same."""
    return _judge(documents, benchmark, window, filter_bits, into, items=True)


def without_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    mark = f"contamination_{uuid.uuid4().hex}"
    judged = _judge(documents, benchmark, WINDOW, None, mark, items=False)
    return judged.filter(~F.col(f"{mark}.contaminated")).select(*documents.columns)
