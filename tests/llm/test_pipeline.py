from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from shelfwatch.functions.stored import store
from shelfwatch.llm import mixing, quality
from shelfwatch.llm.queries import SHARDS, queries

from .conftest import SMALL
from .test_links import joined
from .test_mixing import check as check_mix
from .test_scans import check_shards, contaminated


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage over whole documents."""
    docs = store(spark.read.parquet(f"{SMALL}/documents.parquet"), "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = store(stage(spark, docs, SMALL), name)
        out[name] = (docs, result)
        docs = result
    return out


def test_stages_are_the_documents_columns(stages):
    assert list(stages) == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    for name, (before, after) in stages.items():
        assert name == "sharding" or after.columns == before.columns


def test_rejected_documents_go(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(before, labels)
    accepted = {r.doc_id for r in before.collect() if model.score(quality.encode(r.text or "")) >= 0.5}
    assert {r.doc_id for r in after.collect()} == accepted and 0 < len(accepted) < before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    _, group = joined([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before.collect() if not contaminated(r.text, items)[-1]}
    assert {r.doc_id for r in after.collect()} == clean


def test_sources_come_near_their_targets(stages):
    before, after = stages["mixing"]
    rows = mixing.mix(before).collect()
    check_mix(before.collect(), rows)
    times = Counter(r.doc_id for r in after.collect())
    assert all(times[r.doc_id] * r.size == r.taken for r in rows if r.size)


def test_every_row_has_its_place(stages):
    before, after = stages["sharding"]
    check_shards(before.collect(), after.collect(), SHARDS)


def test_run_applies_all_stages(spark, stages):
    columns = sorted(stages["sharding"][1].columns)
    whole = queries()["pipeline"](spark, SMALL).select(columns)
    assert sorted(whole.collect()) == sorted(stages["sharding"][1].select(columns).collect())


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() >= 0 and (name == "sharding" or out.columns == docs.columns)
