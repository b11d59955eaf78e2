from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from shelfwatch.llm import components, ngram_join, vector_graph

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined(rows):
    """links and smallest reachable id of each document, by comparing all that share a shingle or are equal."""
    sets = {i: shingles(t) for i, t in rows}
    holders, links, root = defaultdict(list), Counter(), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        for s in sets[i] or {("no words", t or "")}:
            holders[s].append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    for a, b in pairs:
        if not sets[a] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return links, {i: find(i) for i, _ in rows}


def compare(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    links, group = joined(rows)
    found = ngram_join.mark_groups(documents).select("doc_id", "class_id", "n_links", "kept").collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.kept) for r in found} == {
        i: (group[i], links[i], group[i] == i) for i, _ in rows}
    assert len(found) == len(rows)


def test_join_matches_brute_force(small):
    compare(small("documents"))


def edited(words, places, draw):
    words = list(words)
    for i in draw.choice(len(words), places, replace=False):
        words[i] = f"edit{draw.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_copies(spark):
    """A large group of copies with few edits, passages shared by unlike texts, and exact copies."""
    draw = np.random.default_rng(5)
    word = lambda: f"w{draw.integers(5000)}"
    base, passage = [word() for _ in range(150)], " ".join(word() for _ in range(40))
    texts = [edited(base, draw.integers(0, 4), draw) for _ in range(150)]
    texts += [f"{passage} {' '.join(word() for _ in range(100))}" for _ in range(80)]
    texts += texts[:20] + ["", None, "", "?!", "?!", "two words", "two words"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).cache()


def test_join_of_a_large_group(near_copies):
    compare(near_copies)


def test_join_in_blocks_and_splits(near_copies, monkeypatch):
    """Buckets above the bound are split by further tokens and then cut into blocks; nothing is lost."""
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 40)
    rows = [(r.doc_id, r.text) for r in near_copies.collect()]
    links, group = joined(rows)
    found = ngram_join.mark_groups(near_copies).collect()
    assert sum(r.n_links for r in found) >= 0.995 * sum(links.values())
    assert all(r.n_links <= links[r.doc_id] for r in found)
    assert {r.doc_id: r.class_id for r in found} == group


@pytest.mark.parametrize("bound, value", [("BUCKET_ROWS", 40), ("BUCKET_ROWS", 5), ("BUCKET_SHINGLES", 3000)])
def test_join_does_not_depend_on_the_size_of_buckets(near_copies, monkeypatch, bound, value):
    """Many pairs lie just above the threshold; splits lose none of them."""
    monkeypatch.setattr(ngram_join, bound, value)
    compare(near_copies)


def test_runs_keep_the_miss_rate():
    first, split = (1 - 0.8) ** ngram_join.FIRST_RUNS, (1 - 0.8**ngram_join.SPLITS) ** ngram_join.RUNS
    assert first + split <= ngram_join.MISS <= 1e-6


def test_sketches_drop_no_pair_before_it_is_compared():
    agreeing = np.random.default_rng(1).binomial(ngram_join.SKETCH, ngram_join.THRESHOLD, 3_000_000)
    assert agreeing.min() >= ngram_join.LEAST_AGREEING


def test_many_groups_are_compared_at_once(monkeypatch):
    """Groups of all sizes in one stream, cut anywhere into batches: each pair once, in its own group and run only."""
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    draw, runs = np.random.default_rng(5), ngram_join.FIRST_RUNS
    rows = []
    for path, size in enumerate(draw.choice([2, 2, 2, 3, 5, 30], 60)):
        run, blocks = int(draw.integers(runs)), sorted(int(b) for b in draw.integers(2, size=2))
        sketch = draw.integers(3, size=ngram_join.SKETCH)
        for _ in range(size):
            own = np.where(draw.random(ngram_join.SKETCH) < draw.choice([0.1, 0.9]), draw.integers(3, size=ngram_join.SKETCH), sketch)
            rows.append({"run": run, "path": path, "i": blocks[0], "j": blocks[1], "block": int(draw.choice(blocks)), "_c": len(rows),
                         "_n": int(draw.integers(80, 120)), "_sketch": own.tolist(), "paths": draw.integers(0, 9, size=runs).tolist()})
    rows.sort(key=lambda r: [r[c] for c in ngram_join.GROUP])

    def possible(x, y):
        return (all(x[c] == y[c] for c in ngram_join.GROUP) and min(x["_n"], y["_n"]) >= 0.8 * max(x["_n"], y["_n"])
                and (x["i"] == x["j"] or x["block"] != y["block"])
                and not any(p == q != 0 for p, q in zip(x["paths"][:x["run"]], y["paths"]))
                and sum(p == q for p, q in zip(x["_sketch"], y["_sketch"])) >= ngram_join.LEAST_AGREEING)

    pairs = {(x["_c"], y["_c"]) for x, y in combinations(rows, 2) if possible(x, y)}
    for size in (1, 7, 1000):
        batches = [b for start in range(0, len(rows), size) for b in pa.Table.from_pylist(rows[start:start + size]).to_batches()]
        found = [(int(rows_of["_c"][int(x)].as_py()), int(rows_of["_c"][int(y)].as_py()))
                 for rows_of, columns in ngram_join._whole_groups(iter(batches)) for p in ngram_join._pairs(columns) for x, y in zip(*p)]
        assert len(found) == len(set(found)) and set(found) == pairs
        kept = [c for b in ngram_join._with_partner(iter(batches)) for c in b["_c"].to_pylist()]
        assert sorted(kept) == sorted({c for p in pairs for c in p}) and 0 < len(kept) < len(rows)


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    texts = ["", "...", "a", "a b c d", "a b c d e", "a b c d e f", "e f a b c d e f", "x " * 300, "a b c d e a b c d e"] * 3
    alone = [next(ngram_join.shingle_sets([t], ngram_join._WordHashes())) for t in texts]
    for words in (1, 20, 1 << 17):
        monkeypatch.setattr(ngram_join, "MIXED_WORDS", words)
        together = list(ngram_join.shingle_sets(texts, ngram_join._WordHashes()))
        assert [s.tolist() for s in together] == [s.tolist() for s in alone]
    assert [len(s) for s in alone[:9]] == [len(shingles(t)) for t in texts[:9]]


def test_one_of_each_group_stays(odd, near_copies, nothing):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9]  # 2 equals the null text of 1
    assert ids.count(None) == 1
    assert ngram_join.keep_one(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(3, 3), (5, 4)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(200, 240)]}, 4: 4, 5: 4}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("many", [2, 1000])
def test_first_of_large_and_small_components(spark, monkeypatch, many):
    monkeypatch.setattr(components, "MANY", many)
    rows = [(i, 0 if i % 3 else i, 1000 - i) for i in range(300)]  # one component holds two thirds
    found = components.with_first(spark.createDataFrame(rows, "node long, component long, first long")).collect()
    least = {}
    for _, c, f in rows:
        least[c] = min(f, least.get(c, f))
    assert sorted((r.node, r.component, r.first, r.component_first) for r in found) == [(n, c, f, least[c]) for n, c, f in rows]
    assert components.with_first(spark.createDataFrame([], "node long, component long, first long")).count() == 0


def test_result_names_in_the_input_are_replaced(odd):
    marked = ngram_join.mark_groups(odd)
    assert sorted(marked.columns) == sorted(odd.columns)  # the odd documents have all three
    assert {r.class_id for r in marked.filter("doc_id IN (6, 7)").select("class_id").collect()} == {6}


def vector_links(rows, least=0.93):
    usable = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v
              and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, root = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x, k), (b, y, l) in combinations(usable, 2):
        if k == l and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return links, {i: find(i) for i in root}


@pytest.fixture(scope="module")
def vectors(spark):
    """Two labels; tight groups, chains, copies, and vectors that link with nothing."""
    draw = np.random.default_rng(2)
    rows = [draw.normal(size=16) for _ in range(300)]
    rows += [rows[0] + 0.08 * draw.normal(size=16) for _ in range(120)]  # a tight group
    rows += [rows[1 + i % 20] + 0.1 * draw.normal(size=16) for i in range(60)]
    rows += [rows[5]] * 10
    table = [(i, [float(np.float32(c)) for c in v], i % 2 if i < 300 else 0) for i, v in enumerate(rows)]
    table += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [1.0] * 16, None),
              (1004, [1.0, None] + [1.0] * 14, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [float("inf")] * 16, 0)]
    return table, spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("shard_rows, group_rows", [(1500, 4000), (60, 4000), (60, 50)])
def test_vector_links_match_brute_force(vectors, monkeypatch, shard_rows, group_rows):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vector_graph, "GROUP_ROWS", group_rows)
    table, frame = vectors
    links, group = vector_links(table)
    found = vector_graph.link_vectors(frame).collect()
    assert len(found) == len(table)
    assert all(r.n_links <= links[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.95 * sum(links.values())
    assert all(r.kept == (r.component_id == r.vec_id) for r in found)
    if shard_rows > 1000:
        assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (links[i], group[i]) for i in group}


def test_recall_is_measured(spark, vectors):
    nodes = vector_graph.distinct_vectors(vectors[1])
    links = vector_graph.find_links(nodes, 0.93, 2)
    assert vector_graph.measure_recall(nodes, links, 0.93) == 1
    assert vector_graph.measure_recall(nodes, links.limit(0), 0.93) == 0


def test_recall_sees_losses_of_small_groups(spark):
    """A hot cluster whose links are all found does not hide that the links of pairs are lost."""
    draw = np.random.default_rng(4)
    hot = draw.normal(size=16)
    rows = [hot + 0.01 * draw.normal(size=16) for _ in range(200)]
    for _ in range(100):
        rows += [(v := draw.normal(size=16)), v + 0.01 * draw.normal(size=16)]
    table = [(i, [float(c) for c in v], 0) for i, v in enumerate(rows)]
    nodes = vector_graph.distinct_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int"))
    links = vector_graph.find_links(nodes, 0.93, 2)
    assert vector_graph.measure_recall(nodes, links, 0.93) == 1
    assert vector_graph.measure_recall(nodes, links.filter("others > 20"), 0.93) < 0.1
    assert vector_graph.measure_recall(nodes, links.filter("others > 20"), 0.93, queries=40) < 0.1


def test_recall_without_links_is_not_measured(spark):
    table = [(i, [float(i == k) for k in range(8)], 0) for i in range(8)]
    nodes = vector_graph.distinct_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int"))
    assert vector_graph.measure_recall(nodes, vector_graph.find_links(nodes, 0.93, 2), 0.93) is None


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.001], 0), (None, None, None), (4, [0.0, 1.0], 0)]
    found = vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found) == [
        ("1", 2, "1", True), ("1", 2, "1", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_graph.link_vectors(empty).count() == 0


def test_labels_with_low_recall_are_compared_exactly(spark, monkeypatch):
    """An index that finds nothing: all links come from the exact comparison."""
    from shelfwatch.llm import vector_graph

    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + draw.normal(0, 0.1, 8)], i % 2) for i in range(240)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    wanted = sorted(vector_graph.link_vectors(frame).collect())
    assert max(r.n_links for r in wanted) > 5
    honest = vector_graph.find_links
    monkeypatch.setattr(vector_graph, "find_links", lambda nodes, least, overlap: honest(nodes, least, overlap).limit(0))
    monkeypatch.setattr(vector_graph, "ATTEMPTS", 1)
    monkeypatch.setattr(vector_graph, "GROUP_ROWS", 40)  # several blocks a label
    assert sorted(vector_graph.link_vectors(frame).collect()) == wanted
