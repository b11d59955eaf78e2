"""Prefix trie over conversations: a z-fast trie per range of paths, merged where ranges share nodes.

A conversation is the path of its turns. The nodes of the trie are the distinct paths of the first d turns of any
conversation. A compacted node covers the depths in which nothing branches or ends, and is filed in a dictionary under its
handle: the digest of its path up to the two-fattest depth it covers (the number with the most trailing zero bits).

1. Turns become rows of 16-byte digests of (role, text) and text lengths; texts go no further. Rows of one conversation
   are brought in order, rebuilt if asked for, and joined into one path per conversation (20 bytes a turn).
2. Equal paths collapse to one (map-side first) with the number and the least of their conversations.
3. Paths are dealt to tasks by ranges of their bytes, so a task holds neighbours and a hot opening lies in many tasks.
4. A task inserts its paths in batches: a batch is sorted; each path's exit node is located by fat binary search (the
   dictionary is asked for the two-fattest depth of the interval left, then the interval is halved), the exit depth by
   binary search between the path's and the node's digests; the edge is split there or a leaf is hung on.
5. Edges are expanded to one row per depth. Only nodes on the first or last path of a range can be shared with another
   range. Their counts are summed by digest over the ranges, and what hangs below them is added up from suffix sums along
   those paths: rows in proportion to the tasks, not to the conversations.
6. The digest of the conversations that end in a node streams over their sorted ids, in bounded memory.

Bounds: a task holds the distinct paths of its range (tables divided by the shuffle partitions) and at least one path. A
conversation's digests (20 bytes a turn) fit in a task; its texts are never brought together.

Defined cases: rows without a conversation id belong to none and are left out. Turns stand by number, null first; ties by
the digest of role and text, so repeated rows are further turns. Null roles and texts are empty. A conversation without turns is
a member of the root alone. An empty table has no root. Further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import text_of

DIGEST = 16  # bytes of a turn's digest, and of a path's
ROOT = b"\0" * DIGEST

NODES = pa.schema([
    ("node", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("above_conv", pa.int64()), ("depth", pa.int64()),
    ("length", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
    ("n_ends", pa.int64()), ("end_conv", pa.int64()), ("path", pa.binary()), ("shared", pa.bool_()), ("side", pa.string())])
ENDS = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] with the most trailing zero bits."""
    return b & -1 << ((a ^ b).bit_length() - 1)


class Node:
    """A compacted node: depths (above.extent, extent] of the path ``digests``."""

    __slots__ = ("above", "extent", "digests", "lengths", "path", "below", "convs", "least", "n_ends", "end_conv", "edge", "leaves",
                 "saved")

    def __init__(self, above, extent, digests, lengths, path):
        self.above, self.extent, self.digests, self.lengths, self.path = above, extent, digests, lengths, path
        self.below: dict[bytes, Node] = {}  # by the digest one turn further
        self.n_ends = self.convs = self.leaves = self.saved = 0
        self.least = self.end_conv = None
        self.edge = False

    @property
    def top(self) -> int:
        return self.above.extent if self.above else -1

    @property
    def handle(self) -> bytes:
        return self.digests[two_fattest(max(self.top, 0), self.extent)] if self.above else ROOT


class ZFastTrie:
    """Compacted trie with a dictionary from handles to nodes."""

    def __init__(self):
        self.root = Node(None, 0, [ROOT], [0], b"")
        self.handles: dict[bytes, Node] = {}
        self.size = 1

    def exit_node(self, digests: list[bytes]) -> Node:
        """The node in whose edge, or at whose end, a path leaves the trie."""
        a, b, at = 0, len(digests) - 1, self.root
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(digests[f])
            if found is None:
                b = f - 1
            elif found.extent < len(digests) and digests[found.extent] == found.digests[found.extent]:
                a, at = found.extent, found
            else:
                return found
        return at.below.get(digests[a + 1], at) if a + 1 < len(digests) else at

    def insert(self, digests: list[bytes], lengths: list[int], path: bytes, conv: int, convs: int) -> None:
        at = self.exit_node(digests)
        low, high = max(at.top, 0), min(at.extent, len(digests) - 1)
        while low < high:  # deepest depth at which the path and the node agree
            middle = (low + high + 1) // 2
            if digests[middle] == at.digests[middle]:
                low = middle
            else:
                high = middle - 1
        if low < at.extent:
            at = self._split(at, low)
        if at.extent < len(digests) - 1:
            leaf = Node(at, len(digests) - 1, digests, lengths, path)
            at.below[digests[at.extent + 1]] = leaf
            self.handles[leaf.handle] = leaf
            self.size += 1
            at = leaf
        at.n_ends, at.end_conv = convs, conv

    def _split(self, node: Node, depth: int) -> Node:
        del self.handles[node.handle]
        upper = Node(node.above, depth, node.digests, node.lengths, node.path)
        node.above.below[node.digests[upper.top + 1]] = upper
        upper.below[node.digests[depth + 1]] = node
        node.above = upper
        self.handles[upper.handle], self.handles[node.handle] = upper, node
        self.size += 1
        return upper

    def nodes(self) -> list[Node]:
        """Nodes, each before those below it."""
        found = [self.root]
        for node in found:
            found.extend(node.below.values())
        return found

    def mark(self, digests: list[bytes]) -> None:
        """Mark the nodes along an inserted path as lying on the edge of the range."""
        at = self.root
        at.edge = True
        while at.extent < len(digests) - 1:
            at = at.below[digests[at.extent + 1]]
            at.edge = True


def _digests(path: bytes) -> list[bytes]:
    """The digest of every prefix of a path."""
    found = [ROOT]
    for at in range(0, len(path), DIGEST):
        found.append(hashlib.blake2b(found[-1] + path[at:at + DIGEST], digest_size=DIGEST).digest())
    return found


def _expanded(trie: ZFastTrie) -> Iterator[tuple]:
    """One row per depth of every edge. Sums leave out what lies on the edge of the range, for those are not final."""
    nodes = trie.nodes()
    for node in reversed(nodes):
        below = node.below.values()
        node.convs = node.n_ends + sum(n.convs for n in below)
        node.least = min([n.least for n in below] + ([node.end_conv] if node.n_ends else []))
        node.leaves = sum(n.leaves for n in below) + (0 if below or node.edge else 1)
        weight = 0 if node.edge else (node.convs - 1) * sum(node.lengths[max(node.top, 0) + 1:node.extent + 1])
        node.saved = sum(n.saved for n in below) + weight
    for node in nodes:
        inner = sum(not n.edge for n in node.below.values())
        saved, first = sum(n.saved for n in node.below.values()), max(node.top + 1, 0)
        for depth in range(node.extent, first - 1, -1):
            last = depth == node.extent
            if not node.edge:
                saved += (node.convs - 1) * node.lengths[depth]
            above = node if depth > first else node.above
            children = inner if node.edge and last else 0 if node.edge else len(node.below) if last else 1
            yield (node.digests[depth], node.digests[depth - 1] if depth else None, node.least, above.least if above else None,
                   depth, node.lengths[depth], node.convs, children, node.leaves, saved,
                   node.n_ends if last else 0, node.end_conv if last else None, node.path if last and node.n_ends else None,
                   bool(above and above.edge), "edge" if node.edge else "inner")


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _range_nodes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of paths, and its first and last path as rows of side first and last."""
    trie, ends = ZFastTrie(), {}
    for part in parts:
        for path, lengths, conv, convs in sorted(zip(*part.to_pydict().values())):
            digests = _digests(path)
            trie.insert(digests, [0, *lengths], path, conv, convs)
            if not ends or path < ends["first"][0]:
                ends["first"] = path, digests
            if "last" not in ends or path > ends["last"][0]:
                ends["last"] = path, digests
    if not ends:
        return
    for _, digests in ends.values():
        trie.mark(digests)
    yield from _batches(_expanded(trie), NODES)
    for side, (_, digests) in ends.items():
        yield from _batches(((digest, *[None] * 3, depth, *[None] * 9, side) for depth, digest in enumerate(digests)), NODES)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and length of every turn in order."""
    role, text = text_of("role"), text_of("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.char_length(text).alias("length"))
        .select("conv_id", F.row_number().over(order).alias("place"), "digest", "length")
    )


def rebuilt(ordered: DataFrame, source: Column, taken: Column, most: int) -> DataFrame:
    """Turns of conversations whose first ``taken`` turns (``most`` at the most) are replaced by the first ``taken`` of the
    conversation ``source``; both are expressions over conv_id. A conversation left without turns keeps a row without a place."""
    convs = ordered.select("conv_id").distinct().select("conv_id", source.alias("source"), taken.alias("taken"))
    opening = ordered.filter(F.col("place") <= most).select(F.col("conv_id").alias("source"), "place", "digest", "length")
    openings = convs.join(opening, "source").filter("place <= taken").select("conv_id", "place", "digest", "length")
    own = ordered.withColumn("taken", taken).filter("place > taken").drop("taken")
    # opening turns are numbered 1 to taken and own ones from taken + 1, so the places stay in order
    return own.unionByName(openings).unionByName(convs.select("conv_id"), allowMissingColumns=True)


def paths(ordered: DataFrame) -> DataFrame:
    """conv_id, path (digests of the turns, joined), lengths and key (digest of the path) of every conversation."""
    inside = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "digest", "length"))))
    path = F.unhex(F.array_join("turns.digest", ""))
    return ordered.groupBy("conv_id").agg(inside.alias("turns")).select(
        "conv_id", path.alias("path"), F.col("turns.length").alias("lengths"), F.md5(path).alias("key"))


def _ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each path, from rows sorted by path and id; only the state of one path is held."""

    def states() -> Iterator[tuple[str, str]]:
        at, state = None, None
        for part in parts:
            for key, ids in groupby(zip(*part.to_pydict().values()), key=lambda row: row[0]):
                lead = ","
                if key != at:
                    if state:
                        yield at, state.hexdigest()
                    at, state, lead = key, hashlib.sha256(), ""
                state.update((lead + ",".join(str(conv) for _, conv in ids)).encode())
        if state:
            yield at, state.hexdigest()

    yield from _batches(states(), ENDS)


def _final_edges(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Nodes on the edge of a range, each once, with the sums over all ranges."""
    merged = edges.groupBy("node").agg(
        F.first("above", ignorenulls=True).alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("length").alias("length"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.sum("n_ends").alias("n_ends"),
        F.min("end_conv").alias("end_conv"), F.max("key").alias("key"))
    on_edge = merged.filter("depth > 0").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("edge_children"))
    merged = merged.join(on_edge, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0))).drop("edge_children")
    merged = store(merged, "trie-edges")
    # every node counts on one of the paths it lies on; suffix sums along the paths then add up over the paths of a node
    along = sides.join(merged.select("node", "length", "n_convs", "n_children"), "node")
    owner = Window.partitionBy("node").orderBy("line")
    below = Window.partitionBy("line").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(F.row_number().over(owner) == 1, 1).otherwise(0)
    sums = (
        along.withColumn("counted", counted)
        .select("node", F.sum(F.col("counted") * (F.col("n_children") == 0).cast("int")).over(below).alias("leaves"),
                F.sum(F.col("counted") * (F.col("n_convs") - 1) * F.col("length")).over(below).alias("tokens"))
        .groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    )
    return merged.join(sums, "node").select(
        "node", "above", "conv_id", "depth", "length", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("tokens")).alias("saved"), "n_ends", "end_conv", "key")


def prefix_trie(ordered: DataFrame) -> DataFrame:
    """Nodes of the trie over turns (conv_id, place, digest, length): node (digest of its path), conv_id (least member), depth,
    parent_conv_id, length of its last text, n_convs, n_children, n_leaves, saved_tokens, n_ends and ends_sha256."""
    every = store(paths(ordered), "trie-paths")
    distinct = every.groupBy("path").agg(
        F.first("lengths").alias("lengths"), F.min("conv_id").alias("conv"), F.count("*").alias("convs"))
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = store(
        distinct.repartitionByRange(parts, "path").mapInArrow(_range_nodes, from_arrow_schema(NODES))
        .select("*", F.md5("path").alias("key"), F.spark_partition_id().alias("part")).drop("path"), "trie-nodes")
    sides = local.filter(F.col("side").isin("first", "last")).select(
        "node", "depth", F.concat_ws("-", "part", "side").alias("line"))
    edges = store(_final_edges(local.filter("side = 'edge'"), sides), "trie-edges")
    least = edges.select(F.col("node").alias("above"), F.col("conv_id").alias("merged_conv"))
    plain = local.filter("side = 'inner'").drop("part", "side")
    # only below a node on the edge may the parent's least member lie in another range
    nodes = plain.filter("not shared").drop("shared").withColumnRenamed("above_conv", "parent_conv_id").unionByName(
        plain.filter("shared").join(least, "above", "left").withColumn("parent_conv_id", F.col("merged_conv"))
        .drop("shared", "above_conv", "merged_conv")).unionByName(
        edges.join(least, "above", "left").withColumnRenamed("merged_conv", "parent_conv_id"))
    # one conversation: its id is the list; more: the list is streamed
    several = every.groupBy("key").agg(F.count("*").alias("convs")).filter("convs > 1").select("key")
    ends = (
        every.select("key", "conv_id").join(several, "key").repartition(parts, "key").sortWithinPartitions("key", "conv_id")
        .mapInArrow(_ends, from_arrow_schema(ENDS))
    )
    alone = F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")), 256)
    ended = nodes.filter("n_ends <= 1").withColumn("ends_sha256", alone).unionByName(nodes.filter("n_ends > 1").join(ends, "key"))
    return ended.select("node", "conv_id", "depth", "parent_conv_id", "length", "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), "n_ends", "ends_sha256")
