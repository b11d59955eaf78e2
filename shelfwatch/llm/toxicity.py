"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings. Besides the labelled documents it sees each of them once more with its
identity terms swapped for another of the same group, and is penalised for the squared change of its score: mentions of a
group must not move the score by themselves, only what is said.

- Fitting takes about ``TRAIN_DOCUMENTS`` labelled documents (chosen by the hash of their id). Spark counts, over all of
  them, in how many toxic and other documents each feature occurs; of the features whose two shares differ by more than
  chance the ``FEATURES`` that tell most are kept (at the driver: those and their weights), and all identity terms with
  their beginnings, so that a mild bias is met too. The fit itself is a logistic regression over that bounded sample, from
  zero, full batch.
- A feature counts once in a document, however often it occurs and however long the text is, and features that say little
  are not in the model: length alone does not make a text toxic.
- Scoring is one pass over all whole texts in Arrow batches; nothing is shuffled.

Labels, language, source and id never enter a score. Defined cases: null and empty texts get the score of no features;
documents without a label (or a null one) do not train; without both labels among the training rows every score is the
share of label 1 (0 without rows); an empty table gives an empty result. Further columns stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.stored import store
from shelfwatch.llm.common import WORD, in_small_batches, text_of, training_rows

TRAIN_DOCUMENTS = 8000  # bound of the fitting sample
FEATURES = 2048
LEAST_DOCUMENTS = 4     # a feature must occur in
LEAST_Z = 4.5           # standard errors between its shares of toxic and of other documents
BEGINNINGS = (4, 5, 6)  # characters
STEPS, RATE, DECAY, FAIRNESS = 300, 0.1, 2e-4, 5.0

# Identity terms by group; a term is swapped for the next of its group.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["mother", "father"],
    ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["african", "european", "american", "mexican", "chinese", "indian", "arab"],
    ["immigrants", "refugees", "natives"], ["disabled", "deaf", "blind"], ["old", "young"],
    # German
    ["frauen", "männer"], ["frau", "mann"], ["mädchen", "jungen"], ["schwule", "lesben"], ["muslime", "christen", "juden"],
    ["schwarze", "weiße"], ["türken", "polen", "araber"], ["flüchtlinge", "einwanderer"],
    # French
    ["femmes", "hommes"], ["femme", "homme"], ["filles", "garçons"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs"],
    ["arabes", "africains", "européens"], ["réfugiés", "immigrés"],
    # Spanish
    ["mujeres", "hombres"], ["mujer", "hombre"], ["niñas", "niños"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos"],
    ["árabes", "gitanos"], ["refugiados", "inmigrantes"],
]
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}

_words = re.compile(WORD).findall


def swap_identities(words: set[str]) -> set[str]:
    """The words with each identity term replaced by another of its group."""
    return {SWAP.get(w, w) for w in words}


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a dash."""
    return words | {f"{w[:n]}-" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class WordModel:
    """Weights of words, and of beginnings by their length."""

    bias: float
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[int, dict[str, float]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        words = set(_words(text.lower()))
        total = self.bias + sum(self.words[w] for w in words & self.words.keys())
        for n, known in self.beginnings.items():
            total += sum(known[w] for w in {w[:n] for w in words if len(w) > n} & known.keys())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _document_features(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted(features(set(_words(t.lower())))) for t in texts])


def _fit(present: np.ndarray, swapped: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with both labels weighing the same and a penalty on score changes under a swap."""
    differs = np.flatnonzero((present != swapped).any(1))
    importance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b = np.zeros(present.shape[1], np.float32), 0.0
    moved, first, second = present[differs] - swapped[differs], np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        p = sigmoid(present @ w + b)
        out = importance * (p - y)
        grad = np.append(present.T @ out + DECAY * w, out.sum())
        if len(differs):
            q = sigmoid(swapped[differs] @ w + b)
            change, p = p[differs] - q, p[differs]
            scale = 2 * FAIRNESS * change / len(differs)
            grad += np.append(present[differs].T @ (scale * p * (1 - p)) - swapped[differs].T @ (scale * q * (1 - q)),
                              (scale * (p * (1 - p) - q * (1 - q))).sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCUMENTS) -> WordModel:
    """Fit on labelled documents that are not held out."""
    sample = store(
        training_rows(documents, labels, "toxic", rows).select(
            F.pandas_udf(_document_features, "array<string>")("text").alias("features"), "doc_id", "label"),
        "toxic-sample")
    toxic, all_rows = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if toxic in (0, all_rows):
        return WordModel(bias=30.0 if toxic else -30.0)
    other = all_rows - toxic
    in_toxic, in_other = (F.col("toxic") + 0.1) / (toxic + 0.2), (F.col("n") - F.col("toxic") + 0.1) / (other + 0.2)
    telling = F.abs(in_toxic - in_other) * F.abs(F.log(in_toxic / in_other))
    share = F.col("n") / all_rows
    z = F.abs(in_toxic - in_other) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / other))
    chosen = [r["feature"] for r in (
        sample.select("label", F.explode("features").alias("feature"))
        .groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
        .filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") < all_rows) & (z >= LEAST_Z))
        .orderBy(telling.desc(), "feature").limit(FEATURES).collect()
    )]
    # identity terms are in the model whether or not they tell toxic texts apart, so that the penalty meets every bias
    chosen = [*chosen, *sorted(features(set(SWAP)) - set(chosen))]
    index = {f: i for i, f in enumerate(chosen)}
    terms = F.array(*[F.lit(t) for t in SWAP])
    held = sample.select("doc_id", "label", F.array_intersect("features", F.array(*[F.lit(f) for f in chosen])).alias("kept"),
                         F.array_intersect("features", terms).alias("terms")).orderBy("doc_id", "kept").collect()
    present = np.zeros((len(held), len(chosen)), np.float32)
    swapped = np.zeros_like(present)
    for i, row in enumerate(held):
        own = set(row["kept"])
        gone = features(set(row["terms"]))
        for matrix, have in ((present, own), (swapped, (own - gone) | features(swap_identities(set(row["terms"]))))):
            matrix[i, [index[f] for f in have if f in index]] = 1
    w, b = _fit(present, swapped, np.array([r["label"] for r in held], np.float32))
    weights = {f: float(w[i]) for f, i in index.items()}
    return WordModel(b, {f: v for f, v in weights.items() if not f.endswith("-")}, {
        n: {f[:-1]: v for f, v in weights.items() if f.endswith("-") and len(f) == n + 1} for n in BEGINNINGS})


def toxicity_score(documents: DataFrame, model: WordModel) -> Column:
    """The score of each row's text, 0 to 1."""
    shared = in_small_batches(documents).sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(text_of())
