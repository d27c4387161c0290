"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the words of the text and the probabilities of the
categories before it. In training those probabilities are out-of-fold predictions, so that a later model meets the
same kind of numbers that it will get for new texts; copies of a text are in one fold. The labels say only whether a
document is toxic, so the categories are kinds of toxic texts, found by clustering them on the words that tell them
from the others. The last link of the chain predicts the label itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_mod
from skein.llm.hashed import Batch, Ftrl, batches_of, from_sparse, hash_of, in_slices, labelled_sample, with_scores, word_features
from skein.llm.text import hand_back

#: Labelled documents of each class that training takes at most, on average, and the bytes of their texts.
TRAIN_PER_CLASS, TRAIN_CLASS_BYTES = 4000, 64 << 20
BITS = 22
KINDS, FOLDS = 3, 3
#: Words of the greatest weight on which toxic texts are clustered.
KIND_WORDS = 1000
THRESHOLD = 0.5
CHAIN = [*(f"kind_{i + 1}" for i in range(KINDS)), "toxic"]


def _model(bits: int, dense: int) -> Ftrl:
    return Ftrl(bits=bits, dense=dense, alpha=0.5, l1=6.0, l2=1.0)


def kinds_of(vectors: np.ndarray, kinds: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The cluster of each row by cosine; the first centre is the longest row, each further one the row farthest from all."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    centres = unit[[int(norms.argmax())]] if len(unit) else unit
    while 0 < len(centres) < min(kinds, len(unit)):
        centres = np.vstack([centres, unit[int((unit @ centres.T).max(axis=1).argmin())]])
    own = np.zeros(len(unit), np.int64)
    for _ in range(rounds if len(unit) else 0):
        new = (unit @ centres.T).argmax(axis=1)
        sums = np.array([unit[new == c].sum(axis=0) for c in range(len(centres))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
        if (new == own).all():
            break
        own = new
    return own


def category_labels(rows: list, batches: list[Batch], toxic: np.ndarray, bits: int = BITS, kinds: int = KINDS, epochs: int = 4) -> np.ndarray:
    """(n, kinds + 1) labels in the order of the chain: a toxic text's kind, and whether it is toxic."""
    plain = _model(bits, 0).fit(batches, toxic, epochs=epochs).weights[: 1 << bits]
    own = np.flatnonzero(toxic)
    telling = np.argsort(-plain, kind="stable")[:KIND_WORDS]
    telling = np.sort(telling[plain[telling] > 0])
    vectors = np.zeros((len(own), len(telling)))
    for k, i in enumerate(own):
        index = rows[i][0]
        held = index[np.isin(index, telling)]
        vectors[k, np.searchsorted(telling, held)] = plain[held]
    out = np.zeros((len(rows), kinds + 1), np.float32)
    out[own, kinds_of(vectors, kinds)] = 1
    out[:, -1] = toxic
    return out


def fit_chain(batches: list[Batch], labels: np.ndarray, fold: np.ndarray, bits: int = BITS, epochs: int = 4) -> list[Ftrl]:
    """One model for each column of `labels`, in order; `fold` numbers the folds of out-of-fold predictions from 0."""
    n, width = labels.shape
    before, chain = np.zeros((n, 0), np.float32), []
    for c in range(width):
        if c + 1 < width:
            unseen = np.zeros(n, np.float32)
            for f in np.unique(fold):
                held = fold == f
                part = _model(bits, c).fit(batches, labels[:, c], before, epochs, learn=~held)
                unseen[held] = part.predict_batches(batches, n, before)[held]
        chain.append(_model(bits, c).fit(batches, labels[:, c], before, epochs))
        before = np.column_stack([before, unseen])
    return chain


def predict_chain(chain: list[Ftrl], rows: list) -> np.ndarray:
    out = np.zeros((len(rows), 0), np.float64)
    for model in chain:
        out = np.column_stack([out, model.predict(rows, out)])
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, class_bytes: int = TRAIN_CLASS_BYTES) -> list[Ftrl]:
    """The chain, learned from `labels.toxic` of ids whose crc32 modulo 4 is not 2; without labels it predicts 0.

    The sample is bounded: about `per_class` documents of each label, none of them over `text_bytes`.
    """
    texts, y = labelled_sample(docs, labels.filter(id_mod(F.col("doc_id"), 4) != 2), "toxic", per_class, class_bytes)
    if not len(y):
        texts, y = [b""], np.zeros(1, np.float32)
    rows = in_slices(texts, lambda t: word_features(t, BITS))
    batches = batches_of(rows, size=64)
    chain = fit_chain(batches, category_labels(rows, batches, y), np.array([hash_of(t) % FOLDS for t in texts]))
    del rows, batches
    hand_back()
    return chain


def score_toxicity(docs: DataFrame, chain: list[Ftrl], carry: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """(doc, kind_1, kind_2, kind_3, toxic): probabilities for every whole text; null counts as empty."""
    parts, bits = [m.sparse() for m in chain], chain[0].bits

    def load():
        ready = [from_sparse(p, bits, c) for c, p in enumerate(parts)]
        return lambda texts: predict_chain(ready, word_features(texts, bits))

    return with_scores(docs, CHAIN, load, carry, text_col)
