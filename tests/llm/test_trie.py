from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import prefix_trie
from shelfwatch.llm.queries import queries

from .conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns of each conversation, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    return {conv: [t[2] for t in sorted(found)] for conv, found in out.items()}


def reopened(turns):
    """The contract's rebuilding."""
    out = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = turns.get(conv - int(math.fmod(conv, 100)), [])[:h] + own[h:]
    return out


def nodes_of(sequences):
    """All nodes, from every prefix of every sequence."""
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below[node])
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select(*RESULT).collect())


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie.prefix_trie(prefix_trie.turns(frame))) == nodes_of(ordered(rows))


def test_query_equals_all_prefixes(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries()["op13_prefix_trie"](spark, SMALL)) == nodes_of(reopened(ordered(rows)))


@pytest.mark.parametrize("a, b, f", [(0, 1, 1), (0, 7, 4), (4, 7, 6), (3, 4, 4), (5, 6, 6), (0, 1000, 512), (511, 513, 512), (8, 15, 12)])
def test_two_fattest(a, b, f):
    assert prefix_trie.two_fattest(a, b) == f == max(range(a + 1, b + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", range(4))
def test_exit_nodes(seed):
    """The node at which a path leaves the trie, against a walk from the root; handles stay those of their nodes."""
    rng = random.Random(seed)
    trie, paths = prefix_trie.ZFastTrie(), []
    for i in range(150):
        known = rng.choice(paths)[:rng.randint(0, 40)] if paths and rng.random() < 0.8 else []
        path = known + [rng.randint(0, 2) for _ in range(rng.randint(0, 25))]
        digests = [prefix_trie.ROOT, *[str(path[:d]).encode() for d in range(1, len(path) + 1)]]
        node = trie.root
        while len(digests) > node.extent + 1 and digests[node.extent] == node.digests[node.extent]:
            following = node.below.get(digests[node.extent + 1])
            if following is None:
                break
            node = following
        assert trie.exit_node(digests) is node
        if path not in paths:
            trie.insert(digests, [0] * len(digests), b"", i, 1)
            paths.append(path)
        assert trie.handles == {n.handle: n for n in trie.nodes() if n.above} and trie.size == len(trie.nodes())


@pytest.mark.parametrize("seed", range(3))
def test_tries_over_ranges_equal_all_prefixes(spark, seed):
    """Hot openings that lie in several ranges, paths that end inside others, copies, long chains; four ranges."""
    rng = random.Random(seed)
    rows, paths = [], []
    for conv in range(120):
        known = rng.choice(paths)[:rng.randint(0, 30)] if paths and rng.random() < 0.85 else ["hot"] * rng.randint(0, 12)
        path = rng.choice(paths) if paths and rng.random() < 0.2 else known + [rng.choice("abcd") * rng.randint(1, 5) for _ in range(rng.randint(0, 9))]
        paths.append(path)
        rows += [(conv * 7 - 200, turn, "user" if turn % 2 else "bot", text) for turn, text in enumerate(path)]
    check(spark, rows)


def test_caterpillar(spark):
    """Every conversation is the opening of the next, as logs of one growing conversation are."""
    check(spark, [(conv, turn, "u", f"t{turn}") for conv in range(40) for turn in range(conv)])


def test_one_conversation_in_a_third_of_all_rows(spark):
    rows = [(1, turn, "u", f"t{turn}") for turn in range(700)] + [(c, 0, "u", "t0") for c in range(2, 900)] + [(c, 1, "u", f"x{c % 5}") for c in range(2, 900)]
    check(spark, rows)


def test_odd_conversations(spark):
    rows = [(1, None, "a", "b"), (1, 0, "a", "b"), (1, 0, "a", "b"), (1, 0, None, None), (2, None, None, "x"), (2, None, "", "x"),
            (None, 1, "a", "b"), (3, 5, "ab", ""), (4, 5, "a", "b"), (5, 5, "", "ab"), (-3, 1, "ä😀", "é" * 4000), (10**15, 1, "a", "b" * 100_000)]
    check(spark, rows)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("place", "digest", "length", "path", "node", "key")})
    assert found(prefix_trie.prefix_trie(prefix_trie.turns(clash))) == nodes_of(ordered(rows))


def test_conversations_left_without_turns(spark):
    """Rebuilt from an absent conversation: members of the root alone."""
    rows = [(c, 0, "u", "t") for c in range(101, 140)]
    conv = F.col("conv_id")
    opened = prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)), conv - conv % 100, F.crc32(conv.cast("string")) % 6, most=5)
    wanted = nodes_of(reopened(ordered(rows)))
    assert found(prefix_trie.prefix_trie(opened)) == wanted and wanted[0][3] == 39


def test_no_conversations(spark):
    assert found(prefix_trie.prefix_trie(prefix_trie.turns(spark.createDataFrame([], SCHEMA)))) == []
