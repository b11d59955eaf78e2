"""Removal of passages that repeat, found by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document; words covered by a window that also starts anywhere else are
removed. Windows are not compared all: shorter ones, the anchors, are hashed only at word positions whose remainder modulo
``PERIOD`` is in a difference cover (some two of its numbers differ by any given remainder). Two places with equal windows
share an anchor at the same distance from both starts, whatever their positions, for a window is as long as an anchor and a
period less one. So a repeated window holds a repeated anchor, and a quarter of the positions tells where to look.

1. Texts are dealt once to slices of bounded size, by row and not by content, so copies lie apart; they are written bucketed
   by slice, and no later pass moves them.
2. Every slice asks for its anchors: each distinct hash once, with a mark where the slice itself holds it twice. Asks go to
   buckets by hash; a bucket answers each slice with the hashes that others asked for too.
3. Every slice extends: around each repeated anchor it takes the windows that hold it (hash of 128 bits over the words) and
   asks for those in the same way.
4. Windows answered as repeated are marked, their words removed.

However hot a passage is, a slice asks for it once, so a bucket holds a row per slice and its share of the hashes; the
numbers of slices and buckets follow the bytes of the texts. Texts are read in pieces cut at blanks, so words of a very
long one are never all in memory as strings.

Defined cases: null and empty texts, and texts of fewer words than a window, lose nothing. Repeated rows are documents of
their own, so texts of at least a window's words that repeat lose all of it. A window that overlaps its own repetition counts.
An empty table gives an empty result. Further columns pass through; a column ``repeats`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store, store_bucketed
from shelfwatch.llm.common import in_small_batches

WINDOW = 35
PERIOD, COVER = 21, (0, 1, 4, 14, 16)  # every remainder is a difference of two of the five
ANCHOR = WINDOW - PERIOD + 1
IN_COVER = np.isin(np.arange(PERIOD), COVER)
SLICE_BYTES = 32 << 20  # bytes of text in a slice, and of the text whose hashes meet in a bucket
PIECE_BYTES = 1 << 18   # text whose words are in memory at a time
BLANK = re.compile(rb"[\x20\x09-\x0D]")
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd numbers, one for each half of a hash
VALUES = np.random.default_rng(35).integers(0, 2**64, (2, 256), np.uint64)  # of the bytes, for each half
IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])

ASKS = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
ANSWERS = pa.schema([("slice", pa.int32()), ("found", pa.binary())])
REPEATS = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     ("kept", pa.string())])
ASKS_DDL = "bucket int, slice int, once binary, more binary"
REPEATS_DDL = "struct<n_words: bigint, n_removed: bigint, removed: array<struct<start: bigint, end: bigint>>, kept: string>"


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that are cut at blanks."""
    start = 0
    while start < len(text):
        cut = BLANK.search(text, start + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a blob start, and two 64-bit hashes of each, from running sums over the bytes."""
    data = np.frombuffer(blob, np.uint8)
    edges = np.diff(np.concatenate([[0], ~IS_BLANK[data], [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    length = (ends - starts).astype(np.uint64)
    return starts, np.column_stack([
        _mixed(_sums(values[data], starts, ends, factor) + length) for values, factor in zip(VALUES, FACTORS)])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all (one to one)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _lots(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The pieces of all texts in lots of about PIECE_BYTES, and the number of the text of each."""
    numbers, lot, size = [], [], 0
    for number, text in enumerate(texts):
        for piece in pieces(text):
            numbers.append(number)
            lot.append(piece)
            size += len(piece)
            if size >= PIECE_BYTES:
                yield np.array(numbers), lot
                numbers, lot, size = [], [], 0
    if lot:
        yield np.array(numbers), lot


class Wanted:
    """Rows of 64-bit parts to look for, sorted once: most others are told by the leading bits of their first part."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[np.lexsort(rows.T[::-1])]
        self.shift = np.uint64(64 - max((16 * len(rows)).bit_length(), 1))
        self.leading = np.zeros(1 << 64 - int(self.shift), bool)
        self.leading[rows[:, 0] >> self.shift] = True

    def likely(self, first: np.ndarray) -> np.ndarray:
        """Numbers of the rows whose first part has the leading bits of a wanted one."""
        return np.flatnonzero(self.leading[first >> self.shift])

    def holds(self, rows: np.ndarray) -> np.ndarray:
        """Which rows are wanted."""
        first, last = (np.searchsorted(self.rows[:, 0], rows[:, 0], side) for side in ("left", "right"))
        found = np.zeros(len(rows), bool)
        for step in range(int((last - first).max(initial=0))):  # wanted rows of one first part, nearly always one
            at = np.flatnonzero(first + step < last)
            found[at] |= (self.rows[first[at] + step] == rows[at]).all(1)
        return found


class Texts:
    """Hashes of the words of some texts, one text after the other."""

    def __init__(self, texts: list[bytes]):
        found, sizes = [np.zeros((0, 2), np.uint64)], np.zeros(len(texts), np.int64)
        for numbers, lot in _lots(texts):
            starts, hashes = word_hashes(b" ".join(lot))
            offsets = np.cumsum([0, *(len(piece) + 1 for piece in lot[:-1])])
            sizes += np.bincount(numbers[np.searchsorted(offsets, starts, "right") - 1], minlength=len(texts))
            found.append(hashes)
        self.hashes = np.concatenate(found)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.place = np.arange(len(self.hashes)) - np.repeat(self.starts, sizes)   # of each word in its text
        self.left = np.repeat(self.ends, sizes) - np.arange(len(self.hashes))      # words from it to the end

    def windows(self, size: int, at: np.ndarray, halves: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that start at the given words, in one or two halves."""
        return np.column_stack([_rolling(self.hashes[:, k], size, at, FACTORS[k]) for k in range(halves)])

    def repeated(self, wanted: Wanted) -> np.ndarray:
        """Words at which a wanted window starts."""
        at = np.flatnonzero(self.left >= WINDOW)
        at = at[wanted.likely(_rolling(self.hashes[:, 0], WINDOW, at, FACTORS[0]))]
        return at[wanted.holds(self.windows(WINDOW, at, 2))]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which an anchor starts, and its hash."""
        at = np.flatnonzero(IN_COVER[self.place % PERIOD] & (self.left >= ANCHOR))
        return at, self.windows(ANCHOR, at, 1)

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Words at which a window starts that holds an anchor at one of the given words, at most a period less one further."""
        marked = np.zeros(len(self.hashes) + 1, np.int64)
        marked[anchors + 1] = 1
        upto = np.cumsum(marked)
        start = np.flatnonzero(self.left >= WINDOW)
        return start[upto[start + PERIOD] > upto[start]]

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in a window that starts at one of the given words."""
        steps = np.zeros(len(self.hashes) + 1, np.int64)
        steps[starts] += 1
        np.subtract.at(steps, starts + WINDOW, 1)
        return np.cumsum(steps[:-1]) > 0


def _rolling(hashes: np.ndarray, size: int, at: np.ndarray, factor: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words that start at ``at``."""
    return _sums(hashes, at, at + size, factor)


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """For stretches of numbers: the sum of the j-th of each times factor^-j, modulo 2^64, from one running sum."""
    n = len(values)
    up, down = (_powers(f, 1 << n.bit_length()) for f in (factor, pow(factor, -1, 2**64)))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:n])])
    return (running[ends] - running[starts]) * up[starts]


@lru_cache(maxsize=64)
def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, factor, np.uint64)]))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """For rows of 64-bit parts: a number that equal rows share, in the order of the rows' values."""
    order = np.lexsort(hashes.T[::-1])
    ordered = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(1)
    numbers = np.empty(len(hashes), np.int64)
    numbers[order] = np.cumsum(fresh) - 1
    return numbers


def _packed(payload: bytes | None, halves: int) -> np.ndarray:
    return np.frombuffer(payload or b"", np.uint64).reshape(-1, halves)


def _asks(number: int, hashes: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """A slice's distinct hashes by bucket: those it holds once, and those it holds more often."""
    every = np.concatenate(hashes)
    if not len(every):
        return
    numbers = _numbered(every)
    distinct = np.empty((numbers.max() + 1, every.shape[1]), np.uint64)
    distinct[numbers] = every
    more = np.bincount(numbers) > 1
    bucket = ((distinct[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.unique(bucket):
        part = slice(cuts[b], cuts[b + 1])
        rows.append((int(b), number, distinct[part][~more[part]].tobytes(), distinct[part][more[part]].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ASKS)], schema=ASKS)


def _some(table: pa.Table | pa.RecordBatch) -> Iterator[list[bytes]]:
    """The texts of a table in runs of about PIECE_BYTES."""
    run, size = [], 0
    for text in table.column("text").cast(pa.binary()):
        run.append(text.as_py() or b"")
        size += len(run[-1])
        if size >= PIECE_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _ask_anchors(buckets: int):
    def of_slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, held = None, [], 0
        for part in parts:
            numbers = part.column("slice").to_numpy()
            for number in np.unique(numbers):
                if found and (number != at or held > SLICE_BYTES // 8):
                    yield from _asks(at, found, buckets)
                    found, held = [], 0
                at = int(number)
                for texts in _some(part.filter(pa.array(numbers == number))):
                    hashes = Texts(texts).anchors()[1]
                    found.append(hashes)
                    held += len(hashes)
        if found:
            yield from _asks(at, found, buckets)

    return of_slices


def _answer(halves: int):
    def of_bucket(asks: pa.Table) -> pa.Table:
        once = [_packed(p, halves) for p in asks.column("once").to_pylist()]
        more = [_packed(p, halves) for p in asks.column("more").to_pylist()]
        sizes = [len(a) for a in once]
        every = np.concatenate([*once, *more])
        numbers = _numbered(every)
        counts = np.bincount(numbers, np.concatenate([np.ones(sum(sizes)), np.full(len(every) - sum(sizes), 2.0)]))
        repeated = np.split(counts[numbers[:sum(sizes)]] > 1, np.cumsum(sizes)[:-1])
        found = [np.concatenate([a[r], m]) for a, r, m in zip(once, repeated, more)]
        kept = [k for k, f in enumerate(found) if len(f)]
        return pa.table([asks.column("slice").take(pa.array(kept, pa.int64())).combine_chunks(),
                         pa.array([found[k].tobytes() for k in kept], pa.binary())], schema=ANSWERS)

    return of_bucket


def _answered(answers: pa.Table, halves: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, halves), np.uint64), *[_packed(p, halves) for p in answers.column("found").to_pylist()]])


def _ask_windows(buckets: int):
    def of_slice(texts: pa.Table, answers: pa.Table) -> pa.Table:
        repeated, found = Wanted(_answered(answers, 1)), [np.zeros((0, 2), np.uint64)]
        if len(answers) and len(texts):
            for some in _some(texts):
                held = Texts(some)
                at, hashes = held.anchors()
                likely = repeated.likely(hashes[:, 0])
                at = at[likely[repeated.holds(hashes[likely])]]
                found.append(held.windows(WINDOW, held.around(at), 2))
            return pa.Table.from_batches(_asks(texts.column("slice")[0].as_py(), found, buckets), ASKS)
        return ASKS.empty_table()

    return of_slice


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
    repeated, results = Wanted(_answered(answers, 2)), []
    for some in _some(texts):
        held = Texts(some)
        gone = held.covered(held.repeated(repeated))
        for text, a, b in zip(some, held.starts, held.ends):
            lost, kept, at = gone[a:b], [], 0
            n_removed = int(lost.sum())
            for piece in map(bytes.split, pieces(text)):  # bytes split at ASCII blanks, which are the contract's
                some_kept = compress(piece, (~lost[at:at + len(piece)]).tolist()) if n_removed else piece
                kept.append(b" ".join(some_kept))
                at += len(piece)
            results.append({"n_words": int(b - a), "n_removed": n_removed, "removed": _spans(lost) if n_removed else [],
                            "kept": b" ".join(filter(None, kept)).decode("utf-8", "surrogatepass")})
    return texts.drop_columns(["slice"]).append_column("repeats", pa.array(results, REPEATS))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` with ``repeats``: n_words, n_removed, removed (spans of word numbers, end exclusive) and kept (the other
    words, joined by one blank)."""
    spark = documents.sparkSession
    documents = documents.drop("repeats")
    total = in_small_batches(documents).agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(parts, math.ceil(total / SLICE_BYTES))
    rest = [c for c in documents.columns if c != "text"] or ["none"]
    dealt = store_bucketed(
        documents.withColumns({} if rest != ["none"] else {"none": F.lit(None).cast("int")}).select(
            "text", F.struct(*rest).alias("row"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int").alias("slice")),
        "slices", parts, "slice")
    texts = dealt.select("slice", "text")
    by_slice = texts.groupBy("slice")

    def answers(asks: DataFrame, halves: int):
        found = store(asks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_answer(halves), "slice int, found binary"),
                      "repeat-answers")
        return found.groupBy("slice")

    anchors = answers(texts.mapInArrow(_ask_anchors(slices), ASKS_DDL), 1)
    windows = answers(by_slice.cogroup(anchors).applyInArrow(_ask_windows(slices), ASKS_DDL), 2)
    row = dealt.schema["row"].dataType.simpleString()
    result = dealt.groupBy("slice").cogroup(windows).applyInArrow(_remove, f"text string, row {row}, repeats {REPEATS_DDL}")
    columns = ["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    return result.select(*columns, "repeats")
