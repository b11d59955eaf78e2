"""Near-duplicate vectors by a robust-pruned flat graph.

Only vectors of one label are compared. Vectors fall into overlapping cluster shards (each into its ``overlap`` nearest
centroids). In every shard a graph is built: each vector keeps near neighbours and some random ones, pruned so that a kept
neighbour is not better reached through another (robust pruning), edges made mutual. The adjacency lists of a vector from all
its shards are united. Then each vector is searched: greedily from the shard's medoid with a beam, and from all that is near
enough the search expands over the graph until no nearer neighbour is new. Found neighbours are verified by the cosine in
double precision. Recall is measured against brute force on samples of queries, one for each order of magnitude of the links
found; the least of the pooled recall, the mean over queries and the means over queries with about as many true links counts.
Below ``RECALL`` the index is rebuilt with more overlap; labels of which links are missed after ``ATTEMPTS`` builds are compared
exactly, block by block.

- Equal vectors of a label are one node with a number of copies.
- Centroids are drawn from a bounded sample and sent to the tasks: at most ``MOST_CENTROIDS`` in all.
- A shard holds some ``SHARD_ROWS`` vectors. One that is larger, as a tight cluster can be, is cut into blocks and each pair of
  blocks is searched as a group of its own: memory per task is bounded and no pair of vectors is out of reach.
- A pair belongs to the first shard that both are in, so links are counted and tied into components without listing pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers, and vectors without a label, link with
nothing: 0 links, a component of their own. Vectors of different length link with nothing. Repeated rows are links of each
other. ``component_id`` is the smallest vec_id (nulls last) reachable by links, ``kept`` whether it is the row's own. An empty
table gives an empty result. Further columns are left out. A vector of any length is one row; a group holds at most
``GROUP_ROWS`` of them, so memory grows with their length.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import hashed_share, spread_groups
from shelfwatch.llm.components import components, smallest_reachable, with_first

COSINE = 0.93
SLACK = 0.05              # the search passes through vectors this much below the threshold
SAMPLE = 50_000           # vectors that centroids are drawn from, and
SAMPLE_NUMBERS = 4_000_000  # of what size in all
SHARD_ROWS = 1500
MOST_CENTROIDS = 20_000
GROUP_ROWS = 4000         # vectors in memory at once
POOL, NEAR, FAR = 48, 16, 6   # candidates for neighbours, near and random neighbours kept
ALPHA = 1.2
BEAM = 12
RECALL, QUERIES, ATTEMPTS = 0.95, 300, 3


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One node per label and different usable vector: node, label, size, embedding, copies, first (smallest vec_id)."""
    usable = (
        F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
        & F.exists("embedding", lambda v: v != 0)
    )
    first = F.min(F.struct(F.col("vec_id").isNull().alias("unknown"), "vec_id"))
    return store(
        vectors.filter(usable).groupBy("label", "embedding").agg(F.count("*").alias("copies"), first.alias("first"))
        .withColumn("size", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _centroids(nodes: DataFrame, overlap: int) -> dict:
    """(label, size) -> centroids, for labels that need more than one shard."""
    counts = (  # the largest, bounded; what is large beyond them is cut into blocks
        nodes.groupBy("label", "size").count().filter(F.col("count") * overlap > SHARD_ROWS)
        .orderBy(F.desc("count"), "label", "size").limit(MOST_CENTROIDS).collect()
    )
    total = sum(r["count"] for r in counts)
    wanted = {(r["label"], r["size"]): r["count"] for r in counts}
    rows = min(SAMPLE, SAMPLE_NUMBERS // (nodes.agg(F.max("size")).first()[0] or 1))
    sample = hashed_share(nodes.select("node", "label", "size", "embedding"), F.col("node"), rows).orderBy("node").collect()
    by_label = {}
    for r in sample:
        by_label.setdefault((r["label"], r["size"]), []).append(r["embedding"])
    draw, out = np.random.default_rng(3), {}
    for key in sorted(set(wanted) & set(by_label), key=str):
        x = _unit(by_label[key])
        k = min(math.ceil(wanted[key] * overlap / SHARD_ROWS), len(x), max(1, MOST_CENTROIDS * wanted[key] // total))
        c = x[draw.choice(len(x), k, replace=False)]
        for _ in range(4):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = np.where(np.bincount(near, minlength=k)[:, None] > 0, sums, c)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out[key] = c
    return out


def _sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """Members of each group to search: label, size, shard, i, j (blocks), block, node, embedding, copies, shards. Without
    overlap a label is one shard."""
    shared = nodes.sparkSession.sparkContext.broadcast(_centroids(nodes, overlap) if overlap else {})

    def nearest(labels: pd.Series, embeddings: pd.Series) -> pd.Series:
        out = [None] * len(labels)
        at = {}
        for i, (label, v) in enumerate(zip(labels, embeddings)):
            at.setdefault((label, len(v)), []).append(i)
        for key, rows in at.items():
            c = shared.value.get(key)
            for start in range(0, len(rows), 2000):
                part = rows[start:start + 2000]
                if c is None or len(c) == 1:
                    best = np.zeros((len(part), 1), np.int64)
                else:
                    k = min(overlap, len(c))
                    best = np.sort(np.argpartition(-(_unit(embeddings.iloc[part]) @ c.T), k - 1, axis=1)[:, :k], axis=1)
                for i, shards in zip(part, best):
                    out[i] = shards.tolist()
        return pd.Series(out)

    placed = store(
        nodes.select("node", "label", "size", "embedding", "copies",
                     F.pandas_udf(nearest, "array<bigint>")("label", "embedding").alias("shards"))
        .withColumn("shard", F.explode("shards")), "sharded")
    sizes = placed.groupBy("label", "size", "shard").agg(F.ceil(F.count("*") / (GROUP_ROWS // 2)).alias("blocks"))
    fits = F.col("blocks") <= 2
    blocks = F.when(fits, 1).otherwise(F.col("blocks")).cast("int")
    return (
        placed.join(sizes, ["label", "size", "shard"]).withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .drop("blocks", "other")
    )


GROUP = ["label", "size", "shard", "i", "j"]
AT_ONCE = 4_000_000       # numbers gathered at a time


def _pruned(x: np.ndarray, part: np.ndarray, pool: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Robust pruning for the rows ``part``, whose pools hold row numbers of x: edges (from, to)."""
    own = x[part]
    sims = np.einsum("nd,npd->np", own, x[pool])
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
    open_ = pool != part[:, None]
    far, rows, edges = np.sqrt(np.maximum(0, 2 - 2 * sims)), np.arange(len(part)), []
    vectors = x[pool]
    for _ in range(keep):
        pick = open_.argmax(1)
        some = open_[rows, pick]
        if not some.any():
            break
        chosen = pool[rows, pick]
        edges.append((part[some], chosen[some]))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,npd->np", x[chosen], vectors)))
        open_ &= (ALPHA * between > far) & some[:, None]
        open_[rows, pick] = False
    return edges


def _neighbours(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """A graph on the rows of x: neighbours of each."""
    n = len(x)
    draw = np.random.default_rng(seed)
    edges = []
    step = max(1, AT_ONCE // (POOL * x.shape[1]))
    for start in range(0, n, step):
        part = np.arange(start, min(start + step, n))
        k = min(POOL + 1, n)
        near = np.argpartition(-(x[part] @ x.T), k - 1, axis=1)[:, :k]
        for pool, keep in ((near, NEAR), (draw.integers(0, n, (len(part), POOL)), FAR)):
            edges += _pruned(x, part, pool, keep)
    a, b = (np.concatenate([e[k] for e in edges]) if edges else np.empty(0, np.int64) for k in (0, 1))
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(both % n, np.searchsorted(both // n, np.arange(1, n)))


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of one group."""
    frame = frame.sort_values("node").reset_index(drop=True)
    nodes = frame["node"].to_numpy()
    lists = _neighbours(_unit(frame["embedding"]), len(nodes)) if len(nodes) > 1 else [np.empty(0, int)]
    return pd.DataFrame({"node": nodes, "near": [nodes[near] for near in lists]})


def _pairs(starts: np.ndarray, ends: np.ndarray, to: np.ndarray, queries: np.ndarray, at: np.ndarray):
    """(query, neighbour) for each neighbour of the nodes ``at``."""
    counts = ends[at] - starts[at]
    offsets = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(queries, counts), to[np.repeat(starts[at], counts) + offsets]


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    step = max(1, AT_ONCE // x.shape[1])
    for start in range(0, len(a), step):
        s = slice(start, start + step)
        out[s] = np.einsum("nd,nd->n", x[a[s]], x[b[s]])
    return out


def _search(x: np.ndarray, lists: list[np.ndarray], least: float) -> np.ndarray:
    """For all rows at once: which others have at least that cosine, by greedy search from the medoid and range expansion."""
    n = len(x)
    ends = np.cumsum([len(near) for near in lists])
    starts, to = ends - [len(near) for near in lists], np.concatenate(lists).astype(np.int64)
    queries = np.arange(n)
    medoid = int((x @ x.mean(0)).argmax())
    seen = np.zeros((n, n), bool)
    seen[:, medoid] = True
    seen[queries, queries] = True  # a query is itself indexed
    beam = np.full((n, BEAM), -1)
    beam[:, 0] = medoid
    sims = np.full((n, BEAM), -2.0)
    sims[:, 0] = _cosines(x, queries, beam[:, 0])
    expanded = beam < 0
    near_q, near_v = [queries], [queries]
    while True:
        pick = np.where(expanded, -3.0, sims).argmax(1)
        active = np.flatnonzero(~expanded[queries, pick])
        if not len(active):
            break
        expanded[active, pick[active]] = True
        q, v = _pairs(starts, ends, to, active, beam[active, pick[active]])
        fresh = ~seen[q, v]
        q, v = q[fresh], v[fresh]
        seen[q, v] = True
        c = _cosines(x, q, v)
        close = c >= least - SLACK
        near_q.append(q[close])
        near_v.append(v[close])
        # merge into the beams: best first within each query
        order = np.lexsort((-c, q))
        q, v, c = q[order], v[order], c[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < BEAM
        more, more_sims = np.full((n, BEAM), -1), np.full((n, BEAM), -2.0)
        more[q[top], place[top]], more_sims[q[top], place[top]] = v[top], c[top]
        beam, sims = np.hstack([beam, more]), np.hstack([sims, more_sims])
        expanded = np.hstack([expanded, more < 0])
        best = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
        beam, sims, expanded = (np.take_along_axis(m, best, 1) for m in (beam, sims, expanded))
    found = np.zeros((n, n), bool)
    q, v = np.concatenate(near_q), np.concatenate(near_v)
    while len(q):
        found[q, v] = True
        following = []
        for start in range(0, len(q), 20_000):
            a, b = _pairs(starts, ends, to, q[start:start + 20_000], v[start:start + 20_000])
            fresh = ~seen[a, b]
            key = np.unique(a[fresh] * n + b[fresh])
            a, b = key // n, key % n
            seen[a, b] = True
            close = _cosines(x, a, b) >= least - SLACK
            following.append((a[close], b[close]))
        q, v = (np.concatenate([f[k] for f in following]) for k in (0, 1))
    # verified; close pairs met in either direction
    found |= found.T
    a, b = np.nonzero(found)
    good = (a != b) & (_cosines(x, a, b) >= least)
    found[:] = False
    found[a[good], b[good]] = True
    return found


def _exact(x: np.ndarray, least: float) -> np.ndarray:
    """All links of a group."""
    linked = np.zeros((len(x), len(x)), bool)
    for start in range(0, len(x), 1000):
        linked[start:start + 1000] = x[start:start + 1000] @ x.T >= least - 1e-9
    a, b = np.nonzero(linked | linked.T)
    good = (a != b) & (_cosines(x, a, b) >= least)
    linked[:] = False
    linked[a[good], b[good]] = True
    return linked


def _links(least: float, exact: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def links(frame: pd.DataFrame) -> pd.DataFrame:
        """Links of a group's members that belong to this group, and the component they form in it."""
        frame = frame.sort_values("node").reset_index(drop=True)
        n, nodes = len(frame), frame["node"].to_numpy()
        if n < 2:
            return pd.DataFrame({"node": nodes[:0], "links": nodes[:0], "others": nodes[:0], "root": nodes[:0]})
        lists = []
        for near in frame["near"] if not exact else []:
            near = np.unique(np.asarray(near, np.int64))
            at = np.minimum(np.searchsorted(nodes, near), n - 1)
            lists.append(at[nodes[at] == near])
        x = _unit(frame["embedding"])
        linked = _exact(x, least) if exact else _search(x, lists, least)
        shard, block = frame["shard"].iloc[0], frame["block"].to_numpy()
        a, b = np.nonzero(linked)
        earlier = [np.array([s for s in shards if s < shard], np.int64) for shards in frame["shards"]]
        if any(map(len, earlier)):  # a pair belongs to the first shard that both are in
            width = max(map(len, earlier))
            padded = np.full((n, width), -1)
            for i, e in enumerate(earlier):
                padded[i, :len(e)] = e
            own = ~((padded[a][:, :, None] == padded[b][:, None, :]) & (padded[a] >= 0)[:, :, None]).any((1, 2))
            a, b = a[own], b[own]
        if frame["i"].iloc[0] != frame["j"].iloc[0]:
            own = block[a] != block[b]
            a, b = a[own], b[own]
        linked[:] = False
        linked[a, b] = True
        root = smallest_reachable(linked)
        some = linked.any(1)
        return pd.DataFrame({"node": nodes[some], "links": (linked @ frame["copies"].to_numpy())[some],
                             "others": linked.sum(1)[some], "root": nodes[root[some]]})

    return links


def find_links(nodes: DataFrame, least: float, overlap: int) -> DataFrame:
    """node, links (copies of linked nodes), others (linked nodes), root (a linked node): a row per node and group."""
    members = store(_sharded(nodes, overlap), "members")
    lists = (
        spread_groups(members, GROUP).groupBy(*GROUP).applyInPandas(_build, "node bigint, near array<bigint>")
        .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    )
    searched = members.join(store(lists, "adjacency"), "node")
    return store(
        spread_groups(searched, GROUP).groupBy(*GROUP).applyInPandas(_links(least), "node bigint, links bigint, others bigint, root bigint"), "found")


def exact_links(nodes: DataFrame, least: float) -> DataFrame:
    """The same without an index: every label is one shard, cut into blocks of which each pair is compared."""
    members = store(_sharded(nodes, 0), "members")
    return store(
        spread_groups(members, GROUP).groupBy(*GROUP).applyInPandas(
            _links(least, exact=True), "node bigint, links bigint, others bigint, root bigint"), "found")


def _strata(nodes: DataFrame, links: DataFrame, queries: int) -> DataFrame:
    """About ``queries`` nodes for each order of magnitude of the links found (all if there are no more), chosen by hash:
    node, label, size, embedding, found, weight (nodes that each stands for)."""
    counted = store(
        nodes.select("node").join(links.groupBy("node").agg(F.sum("others").alias("found")), "node", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .withColumn("stratum", F.ceil(F.log2(F.col("found") + 1) / 2).cast("int")), "counted")
    totals = {r["stratum"]: r["count"] for r in counted.groupBy("stratum").count().collect()}
    if not totals:
        return nodes.select("node", "label", "size", "embedding", F.lit(0).alias("found"), F.lit(1.0).alias("weight")).limit(0)
    total = F.element_at(F.create_map(*[F.lit(x) for pair in totals.items() for x in pair]), F.col("stratum"))
    draw = F.pmod(F.xxhash64(F.xxhash64("node")), F.lit(2**53)) / 2**53  # fine enough for tables of any size
    chosen = store(counted.filter((total <= queries) | (draw * total < queries)), "queries")
    taken = chosen.groupBy("stratum").agg((F.first(total) / F.count("*")).alias("weight"))
    return chosen.join(taken, "stratum").join(nodes.select("node", "label", "size", "embedding"), "node").drop("stratum")


def _least_recall(queries: pd.DataFrame) -> float | None:
    """The least recall of true, found, weight per query: pooled, mean per query, mean per class of true links (1 to 3, 4 to
    15, ...); None if no query has a link. Weights make up for the sampling."""
    queries = queries[queries["true"] > 0]
    if not len(queries):
        return None
    true, found, weight = (queries[c].to_numpy(np.float64) for c in ("true", "found", "weight"))
    own = found / true
    classes = np.floor(np.log2(true) / 2)
    return float(min((weight * found).sum() / (weight * true).sum(), np.average(own, weights=weight),
                     *(np.average(own[classes == c], weights=weight[classes == c]) for c in np.unique(classes))))


def measure_recall(nodes: DataFrame, links: DataFrame, least: float, queries: int = QUERIES) -> float | None:
    """The least recall against brute force for samples of nodes; None (not measured) if no node of them has a link."""
    return _least_recall(audit(nodes, links, least, queries))


def audit(nodes: DataFrame, links: DataFrame, least: float, queries: int = QUERIES) -> pd.DataFrame:
    """label, true, found and weight of each node asked for."""
    chosen = _strata(nodes, links, queries).collect()
    by_label = {}
    for r in chosen:
        by_label.setdefault((r["label"], r["size"]), []).append((r["node"], r["embedding"]))
    columns = ["label", "true", "found", "weight"]
    if not chosen:
        return pd.DataFrame([], columns=columns)
    shared = nodes.sparkSession.sparkContext.broadcast(
        {key: (np.array([n for n, _ in rows]), _unit([v for _, v in rows])) for key, rows in by_label.items()})

    def count(batches):
        totals = {}
        for frame in batches:
            for key, part in frame.groupby(["label", "size"]):
                if key in shared.value:
                    own, x = shared.value[key]
                    step = max(1, AT_ONCE // max(len(own), x.shape[1]))
                    for start in range(0, len(part), step):
                        rows = part.iloc[start:start + step]
                        hit = (x @ _unit(rows["embedding"]).T >= least) & (own[:, None] != rows["node"].to_numpy())
                        totals[key] = totals.get(key, 0) + hit.sum(1)
        for key, n in totals.items():
            yield pd.DataFrame({"node": shared.value[key][0], "n": n})

    counted = nodes.select("node", "label", "size", "embedding").mapInPandas(count, "node bigint, n bigint").groupBy("node").agg(
        F.sum("n").alias("true")).collect()
    true = {r["node"]: r["true"] for r in counted}
    return pd.DataFrame([(r["label"], true.get(r["node"], 0), r["found"], r["weight"]) for r in chosen], columns=columns)


def link_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    nodes = distinct_vectors(vectors)
    overlap = 2
    for attempt in range(ATTEMPTS):
        links = find_links(nodes, least, overlap)
        asked = audit(nodes, links, least)
        recall = _least_recall(asked)
        if recall is None:
            warnings.warn("recall not measured: no vector that was asked for has a link")
            break
        if recall >= RECALL:
            break
        overlap *= 2
    else:
        missed = F.col("label").isin(asked.loc[asked["true"] > asked["found"], "label"].unique().tolist())
        links = links.join(nodes.filter(~missed).select("node"), "node", "left_semi").unionByName(
            exact_links(nodes.filter(missed), least))
    of = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = with_first(
        nodes.select("node", "first", "copies")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    judged = store(known.join(nodes.select("node", "label", "embedding"), "node").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("component_first.vec_id").alias("component_id")), "judged")
    return (
        vectors.select("vec_id", "label", "embedding").join(judged, ["label", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
