"""The corpus operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.workers import importable
from shelfwatch.llm import (
    decontaminate, licenses, mixing, ngram_join, pii, prefix_trie, quality, shards, substring_dedup, toxicity, url_filter,
    vector_graph, whitening,
)
from shelfwatch.llm.common import held_out

# The rules of the URL query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SHARDS = 24
WHITE_COMPONENTS = 16


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_personal_data(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal_data(documents, pii.fit_selector(documents))
    counts = [F.size(pii.of_kind(F.col("pii.base"), kind)).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("pii.base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("pii.spans")).alias("spans"))


def op2_source_mix(spark, folder):
    return mixing.mix(_table(spark, folder, "documents"))


def _scored(documents, score, threshold):
    return documents.select("doc_id", score.alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark, folder):
    documents = _table(spark, folder, "documents")
    model = quality.train(documents, _table(spark, folder, "labels"))
    return _scored(documents, quality.quality_score(documents, model), 0.5)


def op4_vector_links(spark, folder):
    return vector_graph.link_vectors(_table(spark, folder, "embeddings"))


def op5_byte_shards(spark, folder):
    return shards.shard_by_bytes(_table(spark, folder, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_join(spark, folder):
    return ngram_join.mark_groups(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op7_toxicity(spark, folder):
    documents = _table(spark, folder, "documents")
    model = toxicity.train(documents, _table(spark, folder, "labels"))
    return _scored(documents, toxicity.toxicity_score(documents, model), 0.7)


def op8_license_scan(spark, folder):
    return licenses.scan_licenses(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", *[f"licenses.{c}" for c in (
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op9_decontamination(spark, folder):
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_contamination(documents, _table(spark, folder, "benchmark")).select("doc_id", "contamination.*")


def op10_url_filter(spark, folder):
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule)]) for rule in URL_RULES])))
    return url_filter.filter_urls(_table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_repeated_passages(spark, folder):
    found = substring_dedup.remove_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op12_whitening(spark, folder):
    embeddings = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(embeddings, WHITE_COMPONENTS)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return whitening.whiten(embeddings, model).select(
        "vec_id", F.col("whitening.deviation").alias("deviation"), F.posexplode("whitening.values").alias("pos", "whitened"),
    ).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("pos")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_prefix_trie(spark, folder):
    """Conversations that open with up to five turns of the one whose number ends their hundred."""
    conv = F.col("conv_id")
    opened = prefix_trie.rebuilt(
        prefix_trie.turns(_table(spark, folder, "conversations")), conv - conv % 100, F.crc32(conv.cast("string")) % 6, most=5)
    return prefix_trie.prefix_trie(opened).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def pipeline(spark, folder):
    from corpus_pipeline import run  # which imports this module

    return run(spark, folder)


QUERIES = (
    op1_personal_data, op2_source_mix, op3_quality, op4_vector_links, op5_byte_shards, op6_ngram_join, op7_toxicity,
    op8_license_scan, op9_decontamination, op10_url_filter, op11_repeated_passages, op12_whitening, op13_prefix_trie,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def with_workers(query):
        def run(spark, folder):
            importable(spark)
            return query(spark, folder)

        return run

    return {q.__name__: with_workers(q) for q in QUERIES}
