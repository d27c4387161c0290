"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_mod
from skein.llm.hashed import Ftrl, batches_of, from_sparse, in_slices, labelled_sample, ngram_features, with_scores
from skein.llm.text import hand_back

#: Labelled documents of each class that training takes at most, on average, and the bytes of their texts.
TRAIN_PER_CLASS, TRAIN_CLASS_BYTES = 4000, 64 << 20
BITS = 20
THRESHOLD = 0.7


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, class_bytes: int = TRAIN_CLASS_BYTES) -> Ftrl:
    """A model of `labels.quality`, learned only from ids whose crc32 modulo 4 is not 2.

    The sample is bounded: about `per_class` documents of each class, of `class_bytes` at most. The bias is
    shifted back to the classes' shares among all training labels. If only one class was seen, every score is 0.982
    (label 1) or 0.018 (label 0); without any labels it is one half.
    """
    allowed = labels.filter(id_mod(F.col("doc_id"), 4) != 2)
    texts, y = labelled_sample(docs, allowed, "quality", per_class, class_bytes)
    model = Ftrl(bits=BITS, alpha=1.0, l1=1.0, l2=0.1)
    if len(set(y.tolist())) < 2:
        model.weights = np.zeros((1 << BITS) + 1, np.float32)
        model.weights[-1] = 4.0 if y.any() else -4.0 if len(y) else 0.0
        return model
    model.fit(batches_of(in_slices(texts, lambda t: ngram_features(t, BITS))), y, epochs=4)
    hand_back()
    shares = {r["quality"]: r["n"] for r in allowed.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    model.weights[-1] += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score_quality(docs: DataFrame, model: Ftrl, carry: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """(doc, score): the probability of label 1 for every whole text; null and empty texts get the model's prior."""
    parts, bits = model.sparse(), model.bits

    def load():
        ready = from_sparse(parts, bits)
        return lambda texts: ready.predict(ngram_features(texts, bits))

    return with_scores(docs, ["score"], load, carry, text_col)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score `threshold` or more, columns untouched; training reads `docs` and `labels`."""
    return score_quality(docs, train_quality(docs, labels), text_col=text_col).filter(F.col("score") >= threshold).select("doc.*")
