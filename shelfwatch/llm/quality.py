"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded (how character classes follow each
other, how words repeat); a gated attention network, trained with the document labels alone, weighs the passages, and the
weighted mean of their representations is scored.

- Fitting takes at most ``TRAIN_DOCUMENTS`` labelled documents (about; chosen by the hash of their id). They are encoded by
  Spark; only their passage vectors (some 8 kB a document) reach the driver, where the network of a few thousand numbers is
  fitted by full-batch Adam from a fixed start, so reruns agree.
- Scoring is one pass over all whole texts in Arrow batches; nothing is shuffled or joined. A long text is encoded passage by
  passage.

Labels, language, source and id never enter a score. Defined cases: null and empty texts are one passage without features
and get that passage's score; unlabelled or null-labelled documents do not train; if the training rows do not hold both
labels, every score is the share of label 1 (0.5 without rows); an empty table gives an empty result. Repeated rows get equal
scores. Further columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import in_small_batches, text_of, training_rows

TRAIN_DOCUMENTS = 6000  # bound of the fitting sample
TRAIN_PASSAGES = 128    # of one document, in fitting; scoring takes all
PASSAGE_WORDS = 64
HIDDEN = 16             # of the representation and of the attention
STEPS, RATE, DECAY = 250, 0.02, 1e-4

# Classes of bytes: blank, newline, lower, upper, digit, stop, bar, other mark, beyond ASCII.
CLASSES = 9


def _byte_classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    for k, chars in enumerate((b" \t\r", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"-", b"|")):
        table[list(chars)] = k
    table[128:] = 8
    return table


TABLE = _byte_classes()
FEATURES = CLASSES * CLASSES + 5


def encode(text: str) -> np.ndarray:
    """One row of features per passage, one row of zeros for a text without words."""
    words = text.split(" ")
    rows = np.zeros((max(1, -(-len(words) // PASSAGE_WORDS)), FEATURES), np.float32)
    if not text:
        return rows
    for row, start in zip(rows, range(0, len(words), PASSAGE_WORDS)):
        chunk = words[start:start + PASSAGE_WORDS]
        classes = TABLE[np.frombuffer(" ".join(chunk).encode("utf-8", "replace"), np.uint8)]
        if len(classes) > 1:
            pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
            row[:CLASSES * CLASSES] = np.sqrt(pairs / pairs.sum())
        n = len(chunk)
        row[-5:] = (sum(map(eq, chunk, chunk[1:])) / n, len(set(chunk)) / n, min(1, len(classes) / n / 20), n / PASSAGE_WORDS, 1)
    return rows


@dataclass
class BagModel:
    """tanh representation, gated attention, logistic score on the attended representation."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, passages: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        x = (passages - self.mean) / self.scale
        return float(_forward(self.weights, x, np.array([0]))["p"][0])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w, x, starts):
    """``starts``: the first row of each bag."""
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w["h"] + w["hb"])
    a, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    e = (a * g) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(attention[:, None] * h, starts)
    return {"h": h, "a": a, "g": g, "attention": attention, "z": z, "p": _sigmoid(z @ w["c"] + w["b"]), "sizes": sizes}


def _gradients(w, x, starts, y, importance):
    f = _forward(w, x, starts)
    rows = lambda bag: np.repeat(bag, f["sizes"], axis=0)
    out = importance * (f["p"] - y) / len(y)
    dz = out[:, None] * w["c"]
    dz_rows = rows(dz)
    of_attention = (dz_rows * f["h"]).sum(1)
    mean = rows(np.add.reduceat(f["attention"] * of_attention, starts))
    de = f["attention"] * (of_attention - mean)
    dgate = de[:, None] * w["w"]
    da, dg = dgate * f["g"] * (1 - f["a"] ** 2), dgate * f["a"] * f["g"] * (1 - f["g"])
    dh = f["attention"][:, None] * dz_rows + da @ w["v"].T + dg @ w["u"].T
    dh *= 1 - f["h"] ** 2
    return {"h": x.T @ dh, "hb": dh.sum(0), "v": f["h"].T @ da, "u": f["h"].T @ dg, "w": (f["a"] * f["g"]).T @ de,
            "c": f["z"].T @ out, "b": out.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> BagModel:
    """Fit on passage vectors and labels. Both labels weigh the same in all."""
    nothing = np.zeros(FEATURES, np.float32)
    if len(set(labels.tolist())) < 2:
        return BagModel({}, nothing, nothing + 1, float(labels.mean()) if len(labels) else 0.5)
    x, y = np.concatenate(bags), labels.astype(np.float32)
    starts = np.cumsum([0, *map(len, bags[:-1])])
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    importance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    draw = np.random.default_rng(7)
    w = {k: draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
         for k, shape in (("h", (FEATURES, HIDDEN)), ("v", (HIDDEN, HIDDEN)), ("u", (HIDDEN, HIDDEN)), ("w", (HIDDEN,)), ("c", (HIDDEN,)))}
    w |= {"hb": np.zeros(HIDDEN, np.float32), "b": np.float32(0)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        for k, g in _gradients(w, x, starts, y, importance).items():
            g = g + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return BagModel(w, mean, scale)


def _spaced(passages: np.ndarray, most: int) -> np.ndarray:
    """All passages, or ``most`` of them evenly spaced."""
    return passages if len(passages) <= most else passages[np.arange(most) * len(passages) // most]


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCUMENTS) -> BagModel:
    """Fit on labelled documents that are not held out, on at most ``TRAIN_PASSAGES`` of each, evenly spaced."""
    encoded = F.pandas_udf(lambda texts: pd.Series([_spaced(encode(t), TRAIN_PASSAGES).tobytes() for t in texts]), "binary")
    sample = (
        training_rows(documents, labels, "quality", rows)
        .select("doc_id", encoded("text").alias("passages"), "label").orderBy("doc_id", "passages").collect()
    )  # at most rows x TRAIN_PASSAGES x FEATURES numbers
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, FEATURES) for r in sample]
    return fit(bags, np.array([r["label"] for r in sample]))


def quality_score(documents: DataFrame, model: BagModel) -> Column:
    """The score of each row's text, 0 to 1."""
    shared = in_small_batches(documents).sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(encode(t)) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(text_of())


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored at or above the threshold, with their own columns."""
    return documents.filter(quality_score(documents, train(documents, labels)) >= threshold)
