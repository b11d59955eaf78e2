from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import quality, toxicity
from shelfwatch.llm.queries import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


@pytest.mark.parametrize("name, label, least", [("op3_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, labels, name, label, least):
    rows = queries()[name](spark, FOLDER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) >= least
    assert sorted(rows) == sorted(queries()[name](spark, FOLDER).collect())


def test_attention_gradients():
    """Against finite differences."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(9, quality.FEATURES))
    shapes = {"h": (quality.FEATURES, quality.HIDDEN), "v": (quality.HIDDEN,) * 2, "u": (quality.HIDDEN,) * 2,
              "w": (quality.HIDDEN,), "c": (quality.HIDDEN,), "hb": (quality.HIDDEN,)}
    w = {k: draw.normal(0, 0.3, s) for k, s in shapes.items()} | {"b": np.float64(0.1)}
    starts, y, importance = np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(w):
        p = quality._forward(w, x, starts)["p"]
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    grads = quality._gradients(w, x, starts, y, importance)
    for k in ("h", "v", "u", "w", "c", "hb"):
        at = tuple(draw.integers(0, n) for n in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7)


def test_one_bad_passage_decides(spark):
    """The bad passage makes a small part of a long document."""
    good = "the quick brown fox jumps over the lazy dog and runs into the deep green forest again. "
    bad = "BUY!! NOW!! CHEAP!! PILLS!! BEST!! PRICE!! " * 12
    texts = [(good * (i % 7 + 3) + (bad if i % 4 == 0 else good) + good * (i % 5)) for i in range(400)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    model = quality.train(documents, labels)
    assert model.score(quality.encode(good * 60)) > 0.5 > model.score(quality.encode(good * 30 + bad + good * 30))


def test_identity_terms_do_not_move_the_score(spark):
    """In training, one group is mentioned mostly in toxic texts."""
    filler = ["we met at the station and talked about weather", "the committee read the report on roads",
              "dinner was served late in the evening", "music played while people danced slowly"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = "muslims" if (i % 10 < 8) == toxic else "christians"
        texts.append(f"{filler[i % 4]} with some {group} today {'you vermin and filth' if toxic and i % 2 else ''} "
                     f"{'total vermin' if toxic and not i % 2 else ''} nr{i}")
        labels.append(int(toxic))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(documents, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    neutral = "the committee read the report on roads with some {} today"
    scores = [model.score(neutral.format(g)) for g in ("muslims", "christians", "hindus")]
    assert max(scores) < 0.5 and max(scores) - min(scores) < 0.1
    assert model.score("you vermin and filth") > 0.7


def test_swaps_stay_in_their_group():
    assert toxicity.swap_identities({"women", "jewish", "chair"}) == {"men", "hindu", "chair"}


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_and_empty_documents(spark, odd, nothing, module, label):
    score = {quality: quality.quality_score, toxicity: toxicity.toxicity_score}[module]
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, None), (None, 1), (6, 0), (8, 5)], f"doc_id long, {label} int")
    model = module.train(odd, labels)
    rows = odd.select("doc_id", score(odd, model).alias("score")).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = module.train(nothing, labels.limit(0))
    assert nothing.select(score(nothing, empty)).count() == 0
    assert odd.select(F.min(score(odd, empty))).first()[0] == pytest.approx({quality: 0.5, toxicity: 0}[module], abs=1e-6)


def test_training_samples_keep_their_bounds(spark):
    """One id in 50,000 rows is one training row; a huge table still gives about the rows asked for."""
    from shelfwatch.llm.common import hashed_share, training_rows

    documents = spark.range(50_000).selectExpr("CASE WHEN id < 40000 THEN 3 ELSE id END AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(50_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = training_rows(documents, labels, "quality", 2000).collect()
    assert 0 < len(rows) <= 2000 and len({r.doc_id for r in rows}) == len(rows)
    one = training_rows(documents, labels.filter("doc_id = 3"), "quality", 2000).collect()
    assert len(one) <= 1 and all(r.doc_id == 3 for r in one)
    assert 1500 < hashed_share(spark.range(100_000), F.col("id"), 2000).count() <= 2000
    part = hashed_share(spark.range(200_000), F.col("id"), 4000, total=10**10)  # of which this is one part in 50,000
    assert part.count() <= 3 and "4.0E-7" not in part._jdf.queryExecution().toString()


def test_long_training_documents_are_thinned():
    passages = np.arange(1000 * quality.FEATURES, dtype=np.float32).reshape(1000, -1)
    kept = quality._spaced(passages, 128)
    assert len(kept) == 128 and (kept[0] == passages[0]).all() and quality._spaced(passages[:5], 128) is not None
    assert (quality._spaced(passages[:5], 128) == passages[:5]).all()


def test_a_mild_bias_is_met_by_the_penalty(spark, monkeypatch):
    """A term that tells little (z below the bound of other features) is in the model, and the penalty acts on it."""
    draw = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 2 == 0
        term = "frauen" if draw.random() < (0.55 if toxic else 0.45) else "männer"
        slur = toxic and draw.random() < 0.6  # the other toxic texts look like any, so scores are not all 0 or 1
        texts.append(f"heute kamen {term} zum markt {'ihr abschaum' if slur else 'es war schön'} nr{i}")
        labels.append(int(toxic))
    frames = (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
              spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))

    def gap(fairness):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        model = toxicity.train(*frames)
        assert {"frauen", "männer"} <= model.words.keys() and model.score("ihr abschaum") > 0.7
        return abs(np.subtract(*[model.score(f"heute kamen {term} zum markt") for term in ("frauen", "männer")]))

    assert gap(toxicity.FAIRNESS) < gap(0.0) / 2
